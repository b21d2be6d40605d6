"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are runs of characters outside [\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased. An item's
windows are its runs of SPAN words, or all its words if it has fewer. A fingerprint is the smallest hash of
GRAM words among SPAN - GRAM + 1 consecutive ones (the rightmost of equal ones), so a window that a document
shares with an item has a fingerprint that both chose, at the same place of the window: joining fingerprints
misses none. Each hit is extended to the windows around it, which are compared with the items' by a digest of
128 bits of their words. Items of fewer than SPAN words are looked for by the hash of all their words. A text of
more than 2 ** 26 - 1 words is refused, as its places couldn't be told apart.

The benchmark's fingerprints are broadcast while they are at most BROADCAST_ROWS; beyond that the fingerprints
are joined by shuffle and hit documents are read a second time. Nothing else is broadcast.

Null and empty texts have no words: documents keep a row with zeros, items match nothing. Repeated rows give
repeated results; null item ids are listed as empty text. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import staged, table, tidy, whole

SPAN, GRAM = 13, 5
BROADCAST_ROWS = 200_000
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The low bits of a packed fingerprint hold its place, counted down, so that the rightmost of equal hashes is least.
_PLACE = (1 << 26) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value evaluated once: as a lambda's variable it isn't inlined into inner lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words as written; A-Z are lower-cased where words are compared."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def folded(ws: Column, start: Column, n: Column | int) -> Column:
    """n words from start (from 0) as one text, A-Z lower-cased."""
    return F.translate(F.array_join(F.slice(ws, start + 1, n), " "), _UPPER, _UPPER.lower())


def _gram(hashes: Column, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(hashes, at + k) for k in range(n)]).bitwiseAND(F.lit(~_PLACE))


def _upto(n: Column) -> Column:
    """0 .. n - 1; empty if n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("array()").cast("array<int>"))


def fingerprints(ws: Column, short: list[int], span: int = SPAN, gram: int = GRAM) -> Column:
    """array<struct<h long, pos int, len int>>: winnowed grams of windows of span words; all grams of each short length."""

    def winnowed(hashes: Column) -> Column:
        n = F.size(hashes)
        packed = F.transform(_upto(F.when(n >= span, n - gram + 1).otherwise(0)), lambda i: _gram(hashes, i, gram).bitwiseOR(F.lit(_PLACE) - i.cast("long")))
        least = let(packed, lambda p: F.array_distinct(F.transform(_upto(n - span + 1), lambda i: F.array_min(F.slice(p, i + 1, span - gram + 1)))))
        found = F.transform(least, lambda v: F.struct(v.bitwiseAND(F.lit(~_PLACE)).alias("h"), (F.lit(_PLACE) - v.bitwiseAND(F.lit(_PLACE))).cast("int").alias("pos"), F.lit(span).alias("len")))
        return F.concat(found, *[_short(hashes, n, m) for m in short])

    return let(F.transform(ws, lambda w: F.xxhash64(F.lower(w))), winnowed)


def _short(hashes: Column, n: Column, m: int) -> Column:
    return F.transform(_upto(n - m + 1), lambda i: F.struct(_gram(hashes, i, m).alias("h"), i.alias("pos"), F.lit(m).alias("len")))


def item_windows(benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """(item_id string, len, window md5) of all windows of all items."""
    ws = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    n = F.least(F.size("ws"), F.lit(span))
    at = ws.select("item_id", "ws", n.alias("len"), F.explode(F.sequence(F.lit(0), F.size("ws") - n)).alias("at"))
    return at.select("item_id", "len", F.md5(folded(F.col("ws"), F.col("at"), F.col("len")).cast("binary")).alias("w")).distinct()


def hits(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: (doc_id, key, n_words, copies, found array<struct<at,len>>, ws array of window md5)."""
    items = benchmark.select(words(F.col("text")).alias("ws")).filter(F.size("ws") > 0).distinct()
    short = sorted(r[0] for r in items.filter(F.size("ws") < span).select(F.size("ws")).distinct().collect())  # span - 1 rows at most
    marks = items.select(F.explode(fingerprints(F.col("ws"), short, span, gram)).alias("f"))
    # An item of at least span words has no use for its short grams, nor a short one for longer or shorter ones.
    if short:
        marks = items.select(F.explode(F.filter(fingerprints(F.col("ws"), short, span, gram), lambda f: f["len"] == F.least(F.size("ws"), F.lit(span)))).alias("f"))
    marks = marks.select(F.col("f.h").alias("h"), F.col("f.len").alias("len")).distinct()
    marks = staged(marks, "benchmark-fingerprints")
    windows = staged(item_windows(benchmark, span).select("w").distinct().withColumn("known", F.lit(True)), "benchmark-windows")
    small = marks.count() <= broadcast_rows and windows.count() <= broadcast_rows
    hint = F.broadcast if small else (lambda df: df)

    docs = documents.select("doc_id", F.xxhash64("text").alias("key"), words(F.col("text")).alias("ws"))
    many = F.raise_error(F.lit("a text has more words than places can be told apart")).cast("int")
    docs = docs.withColumn("n_words", F.when(F.size("ws") <= _PLACE, F.size("ws")).otherwise(many))
    mark = F.explode(F.concat(F.array(F.lit(None).cast("struct<h:bigint,pos:int,len:int>")), fingerprints(F.col("ws"), short, span, gram))).alias("f")
    carried = ["doc_id", "key", "n_words", *["ws"] * small]
    probes = docs.select(*carried, mark).select(*carried, F.col("f.h").alias("h"), F.col("f.pos").alias("pos"), F.col("f.len").alias("len"))
    met = probes.join(hint(marks.withColumn("met", F.lit(True))), ["h", "len"], "left").filter("h is null or met").drop("met")
    if not small:
        places = met.groupBy("doc_id", "key", "n_words").agg(F.collect_list(F.struct("h", "pos", "len")).alias("met"), F.count_if(F.col("h").isNull()).alias("copies"))
        texts = documents.select(F.col("doc_id").alias("doc_id_"), F.xxhash64("text").alias("key_"), "text").dropDuplicates(["doc_id_", "key_"])
        met = places.join(texts, F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("key") == F.col("key_")))
        met = met.select("doc_id", "key", "n_words", words(F.col("text")).alias("ws"), F.explode(F.concat(F.array_repeat(F.lit(None).cast("struct<h:bigint,pos:int,len:int>"), F.col("copies").cast("int")), F.filter("met", lambda m: m["h"].isNotNull()))).alias("f"))
        met = met.select("doc_id", "key", "n_words", "ws", F.col("f.h").alias("h"), F.col("f.pos").alias("pos"), F.col("f.len").alias("len"))
    around = F.when(F.col("h").isNull(), F.array(F.lit(-1))).when(F.col("len") < span, F.array("pos")).otherwise(F.sequence(F.greatest(F.lit(0), F.col("pos") - (span - gram)), F.least(F.col("pos"), F.col("n_words") - span)))
    tried = met.select("doc_id", "key", "n_words", "ws", "len", F.explode(around).alias("at"))
    tried = tried.select("doc_id", "key", "n_words", "at", "len", F.when(F.col("at") >= 0, F.md5(folded(F.col("ws"), F.col("at"), F.col("len")).cast("binary"))).alias("w"))
    exact = tried.join(hint(windows), "w", "left").filter("at < 0 or known")
    return exact.groupBy("doc_id", "key", "n_words").agg(
        F.count_if(F.col("at") < 0).alias("copies"),
        F.collect_set(F.when(F.col("at") >= 0, F.struct("at", "len"))).alias("found"),
        F.sort_array(F.collect_set("w")).alias("ws"),
    )


def contaminated(documents: DataFrame, benchmark: DataFrame, share: int = 20, **kw) -> DataFrame:
    """One row per document: doc_id, key (xxhash64 of the text), n_words, n_hit, n_items, items (sorted ids), contaminated.

    contaminated: words inside windows are at least one in share.
    """
    found = staged(hits(documents, benchmark, **kw), "contamination")
    # Documents that hold the same windows share their list of items.
    sets = found.filter(F.size("ws") > 0).select("ws").distinct().withColumn("set", F.md5(F.array_join("ws", "").cast("binary")))
    items = sets.select("set", F.explode("ws").alias("w")).join(item_windows(benchmark, kw.get("span", SPAN)).select("w", "item_id"), "w").select("set", "item_id").distinct()
    lists = items.groupBy("set").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    none = F.concat(F.lit("-"), F.pmod(F.hash("doc_id", "key"), F.lit(4096)).cast("string"))
    marked = found.withColumn("set", F.when(F.size("ws") > 0, F.md5(F.array_join("ws", "").cast("binary"))).otherwise(none))
    n_hit = F.size(F.array_distinct(F.flatten(F.transform("found", lambda f: F.sequence(f["at"], f["at"] + f["len"] - 1))))).cast("long")
    out = marked.join(lists, "set", "left").select("doc_id", "key", "copies", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("items", F.expr("array()").cast("array<string>")).alias("items"))
    out = out.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "copy")


def clean(documents: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    bad = contaminated(documents, benchmark, **kw).filter("contaminated").select(F.col("doc_id").alias("bad_id_"), F.col("key").alias("bad_key_")).distinct()
    docs = documents.select(whole(documents), F.col("doc_id").alias("id_"), F.xxhash64("text").alias("hash_"))
    return docs.join(bad, F.col("id_").eqNullSafe(F.col("bad_id_")) & (F.col("hash_") == F.col("bad_key_")), "left_anti").select("whole_.*")


@tidy
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document shares with the benchmark."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(list_slice(ws, i, i + least(len(ws), 13) - 1), ' ') AS w FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT r, i, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS w FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
h AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.w = bw.w),
p AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""
