"""Documents to token ids in five stages: language, lines, near copies, benchmark passages, pieces.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; run() writes what a stage
returns as Parquet in the shared folder and reads it again. All but the last return the columns of documents.
Null and empty texts are rejected with the languages; empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, language, line_dedup, minhash, pieces
from lodestone.llm.common import crc_mod, scratch, staged, table, unstage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and all texts if no language can be learned, have no language and go."""
    model = language.learn(docs.filter(crc_mod("doc_id", 5) != 0).select("doc_id", "text", "lang"))
    # The other columns go along as one, so that none clashes with the stage's own.
    others = F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("others_")
    found = language.identify(docs.select(others, "text"), model).filter(F.col("lang_pred") != language.UNKNOWN)
    return found.select(*["text" if c == "text" else F.col("others_")[c].alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go; a document that keeps no line with words goes with them. n_chars follows the text."""
    kept = line_dedup.clean(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else kept


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return minhash.dedup(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the benchmark's windows cover a twentieth of the words or more go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of pieces, checksum of their ids, and whether decoding gave the text back."""
    import public_tokenizers

    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark_passages),
    ("sentencepiece", token_pieces),
]

#: SQL can't express parsing by automata, signatures or pieces; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; each one's tables go as soon as its result is written, and the result once the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark, name):
            docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        if before is not None:
            unstage(before)
        before = docs
    return docs
