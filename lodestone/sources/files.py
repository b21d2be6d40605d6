"""Text trees, JSON indexes and their sinks (SRC3-5, SNK1-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAPERS = "generated_at string, generator string, papers array<struct<id:string,file:string,kind:string,pages:int,doi:string,declared_doi:string,curated_year:int,curated_venue:string,journal_hint:string,year_hint:string,title_hint:string,authors_hint:array<string>,abstract_hint:string,has_fulltext:boolean,chars:int,txt:string,numeric_claims:array<string>,note:string>>"


def text_tree(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """SRC4, SRC5: (path, name, text) of whole files."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    where = F.col("_metadata.file_path")
    return files.select(where.alias("path"), F.element_at(F.split(where, "/"), -1).alias("name"), F.col("value").alias("text"))


def index_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC3, DM1, DM2: one row per record of an index; what a kind of record lacks is null."""
    return spark.read.schema(PAPERS).json(path, multiLine=True).select(F.explode("papers").alias("p")).select("p.*")


def write_texts(df: DataFrame, key: str, text: str, path: str) -> None:
    """SNK1: texts under one folder per key."""
    df.select(key, F.col(text).alias("value")).write.partitionBy(key).text(path)


def write_index(df: DataFrame, key: str, path: str) -> None:
    """SNK2: JSON lines in the order of the key, nulls left out."""
    df.orderBy(key).select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)
