"""Importance resampling towards a target: hashed n-gram buckets, gains, and a draw without replacement.

A text's features are its words and its pairs of neighbouring words, each hashed to one of BUCKETS buckets. A
bucket's gain is 1000 times the logarithm of its smoothed share among the target's features over that among the
documents', floored. A document's weight is the floored mean of its features' gains; Gumbel noise drawn from its id
is added, and the highest scores are drawn, which draws without replacement in proportion to the exponentials.

Higher-order functions make each document's array of buckets, which is written once; its weight is an aggregate over
element_at of the gains, an array of BUCKETS entries in the plan. Only totals of buckets shuffle, one row for each
bucket and task at most, and one narrow row for each drawable document. The order of the draw is a range partition:
rows are numbered within their range and the ranges' counts, one row each, say where each begins.

Null texts have no words. A document without features weighs 0. A null doc_id is hashed as the empty text and comes
last among ties; of rows that are equal in score and id any may come first. Repeated rows count as often as they
stand. With an empty target or no documents the gains are those of the smoothing alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import staged, table, tidy

BUCKETS = 10000
SEED = 7
#: Documents with fewer words aren't drawn; of N others floor(SHARE * N / 100) are.
LEAST_WORDS, SHARE = 20, 25
#: What lies between words: all ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in their order; none of a null text."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    # Separators at either end would leave an empty word there.
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def buckets(found: Column, n: int = BUCKETS) -> Column:
    """The bucket of each word and of each pair of neighbours, as array<int>."""
    bucket = lambda x: (F.crc32(x.cast("binary")) % F.lit(n)).cast("int")
    many = F.greatest(F.size(found) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(found, 1, many), F.slice(found, 2, many), lambda a, b: bucket(F.concat(a, F.lit(" "), b)))
    return F.concat(F.transform(found, bucket), pairs)


def features(documents: DataFrame, n: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, buckets array<int>) of each text."""
    cut = documents.select("doc_id", words(F.col("text")).alias("words"))
    return cut.select("doc_id", F.size("words").alias("n_words"), buckets(F.col("words"), n).alias("buckets"))


def totals(featured: DataFrame) -> dict[int, int]:
    """How often each bucket occurs: at most as many rows as there are buckets."""
    found = featured.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().collect()
    return {r["bucket"]: r["count"] for r in found}


def gains(spark: SparkSession, target: dict[int, int], source: dict[int, int], n: int = BUCKETS) -> list[int]:
    """The gain of each bucket, computed by Spark so that logarithms round alike everywhere."""
    many, all_ = sum(target.values()), sum(source.values())
    rows = spark.createDataFrame([(k, target.get(k, 0), source.get(k, 0)) for k in range(n)], "k int, t long, s long").coalesce(1)
    up, down = (F.col("t") + 1) * F.lit(all_ + n).cast("double"), (F.col("s") + 1) * F.lit(many + n).cast("double")
    return [r.gain for r in rows.sort("k").select(F.floor(1000 * F.log(up / down)).alias("gain")).collect()]


def weight(found: Column, gain: list[int]) -> Column:
    """The floored mean of the gains of a document's buckets."""
    # A text that the optimiser folds into one array literal, not an expression for each entry.
    table_ = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    total = F.aggregate(found, F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(table_, b + 1))
    size = F.size(found).cast("long")
    return F.when(size > 0, ((total - F.pmod(total, size)) / size).cast("long")).otherwise(F.lit(0).cast("long"))


def noise(key: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel variable that depends on the seed and the id, floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def draw(scored: DataFrame, share: int = SHARE, least: int = LEAST_WORDS) -> DataFrame:
    """scored (doc_id, n_words, score, ...) with a column rank: the place of a drawn document, null of the others.

    Rows are dealt out by score and id in ranges, sorted there and written with their place in their range.
    """
    can = F.col("n_words") >= least
    ordered = scored.withColumn("can", can).repartitionByRange(F.desc("can"), F.desc("score"), F.asc_nulls_last("doc_id"))
    ordered = ordered.sortWithinPartitions(F.desc("can"), F.desc("score"), F.asc_nulls_last("doc_id"))
    row = F.monotonically_increasing_id()
    placed = staged(ordered.withColumn("range", F.shiftright(row, 33)).withColumn("place", row.bitwiseAND(F.lit((1 << 33) - 1))), "op11-ordered")
    # One row for each range.
    counts = sorted(placed.groupBy("range").agg(F.count("*").alias("rows"), F.count_if("can").alias("can")).collect(), key=lambda r: r["range"])
    drawn, before, starts = sum(r.can for r in counts) * share // 100, 0, []
    for r in counts:
        starts.append((r["range"], before))
        before += r.rows
    begins = F.broadcast(placed.sparkSession.createDataFrame(starts, "range long, before long").coalesce(1))
    rank = F.col("before") + F.col("place") + 1
    found = placed.join(begins, "range", "left").withColumn("rank", F.when(F.col("can") & (rank <= drawn), rank))
    return found.drop("can", "range", "place", "before")


@tidy
def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of features, the weight, the score and the rank of each document."""
    featured = staged(features(table(spark, sf_dir, "documents")), "op11-features")
    target = totals(features(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")))
    found = weight(F.col("buckets"), gains(spark, target, totals(featured)))
    scored = featured.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), found.alias("weight"))
    return draw(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id")))).select("doc_id", "n_features", "weight", "score", "rank")


#: The table of crc32 is made from its polynomial; bytes are read from the hexadecimal form of a text.
OP11_SQL = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), texts AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
), cut AS (
  SELECT side, r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM texts
), feats AS (
  SELECT side, r, doc_id, len(w) AS n_words,
    list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS f
  FROM cut
), spread AS (SELECT side, r, unnest(f) AS f FROM feats
), known AS (SELECT DISTINCT f FROM spread
), hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(octet_length(encode(f))), lambda i: ('0x' || hex(encode(f))[2 * i + 1 : 2 * i + 2])::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS k
  FROM known, crc
), met AS (SELECT side, r, k FROM spread JOIN hashed USING (f)
), counts AS (
  SELECT k, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM met GROUP BY k
), sums AS (SELECT sum(s) AS ss, sum(t) AS tt FROM counts
), gains AS (
  SELECT k, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000)::DOUBLE / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE))) AS gain FROM counts, sums
), weights AS (
  SELECT r, floor(sum(gain) / count(*))::BIGINT AS w FROM met JOIN gains USING (k) WHERE side = 'd' GROUP BY r
), scored AS (
  SELECT r, doc_id, n_words, len(f)::BIGINT AS n_features, coalesce(w, 0) AS weight,
    coalesce(w, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM feats LEFT JOIN weights USING (r) WHERE side = 'd'
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, floor(25 * count(*) OVER () / 100) AS n FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""
