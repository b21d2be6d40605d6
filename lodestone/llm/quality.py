"""Quality classifier: a convolutional network over bytes, in numpy.

A text's UTF-8 bytes are read whole, in chunks of two halves of HALF bytes that overlap by one half. Learned
filters of WIDTH bytes slide over them by STRIDE bytes, and each chunk keeps the largest response of each. To that is
added, weighed for each filter, the share of the chunk's bytes that stood so many bytes before in the same text too,
for each of LAGS. The text keeps the largest and the mean of its chunks' values, which one logistic unit combines into
a probability. A text's score
depends on the text alone: what lies beyond its ends counts as zeros.

Fitting takes at most DOCS labelled rows of each label, those with the smallest hash of their id, whole; rows are
weighted back to the labels' shares among all learning rows. Scoring covers all bytes of all texts. Null texts
count as empty; an empty text is one chunk of padding. With no labels to learn from every score is 0.5; with one
label alone, the share of rows with label 1, smoothed. Of rows that repeat an id the least text's hash teaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import crc_mod, slices, table

HALF, WIDTH, STRIDE, FILTERS = 512, 8, 4, 16
LAGS = tuple(range(1, 25))
DOCS = 1500
EPOCHS, BATCH, RATE = 14, 64, 0.01
#: The score from which a text is predicted to have label 1.
KEEP = 0.3
#: So many rows of HALF bytes are held at once.
_ROWS = 2048


def halves(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in rows of HALF bytes, padded with zeros, and the number of rows of each (one at least)."""
    rows = np.maximum(1, -(-np.array([len(x) for x in texts]) // HALF))
    flat = np.zeros(rows.sum() * HALF, np.uint8)
    for x, at in zip(texts, ((np.cumsum(rows) - rows) * HALF).tolist(), strict=True):
        flat[at : at + len(x)] = np.frombuffer(x, np.uint8)
    return flat.reshape(-1, HALF), rows


def chunk_ends(rows: np.ndarray) -> np.ndarray:
    """For each row the row that ends the chunk it begins: the next of its text, or itself if it is the last."""
    last = np.repeat(np.cumsum(rows) - 1, rows)
    return np.minimum(np.arange(rows.sum()) + 1, last)


def repeats(grid: np.ndarray, first: np.ndarray, a: int, b: int) -> np.ndarray:
    """(row, lag): the share of the rows' bytes that stood LAGS bytes before in the same text; first: rows that begin a text."""
    reach = LAGS[-1]
    before = np.zeros((b - a, reach), np.uint8)
    later = ~first[a:b]
    before[later] = grid[np.arange(a, b)[later] - 1, HALF - reach :]
    wide = np.hstack([before, grid[a:b]])
    real = grid[a:b] != 0
    n = np.maximum(1, np.count_nonzero(real, axis=1))
    return np.stack([np.count_nonzero((wide[:, reach - lag : reach - lag + HALF] == grid[a:b]) & real, axis=1) / n for lag in LAGS], 1).astype(np.float32)


class Network:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.filters = (rng.standard_normal((WIDTH, 256, FILTERS)) * 0.1).astype(np.float32)
        self.lags = (rng.standard_normal((len(LAGS), FILTERS)) * 0.1).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = np.zeros(2 * FILTERS)
        self.base = 0.0

    def tops(self, grid: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, filter): the largest response before rectifying and its place in the row; and the rows' repeats."""
        n = len(grid)
        # Rows that begin a text, and what lies beyond the last.
        first = np.zeros(n + 1, bool)
        first[np.cumsum(rows) - rows] = first[n] = True
        top, place, same = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64), np.empty((n, len(LAGS)), np.float32)
        for a in range(0, n, _ROWS):
            b = min(n, a + _ROWS)
            wide = np.zeros((b - a, HALF + WIDTH - STRIDE), np.uint8)
            wide[:, :HALF] = grid[a:b]
            on = np.flatnonzero(~first[a + 1 : b + 1])
            wide[on, HALF:] = grid[a + on + 1, : WIDTH - STRIDE]
            total = self.filters[0].take(wide[:, 0:HALF:STRIDE], axis=0)
            for k in range(1, WIDTH):
                total += self.filters[k].take(wide[:, k : k + HALF : STRIDE], axis=0)
            place[a:b] = total.argmax(1)
            top[a:b] = np.take_along_axis(total, place[a:b][:, None, :], 1)[:, 0]
            same[a:b] = repeats(grid, first, a, b)
        return top, place * STRIDE, same

    def chunks(self, top: np.ndarray, same: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(chunk, filter): the rectified largest response of both halves, the lags' weighted bits added."""
        # Summed lag by lag, so that no chunk's rounding depends on how many are worked on together.
        share, lagged = np.maximum(same, same[ends]), np.zeros_like(top)
        for k, w in enumerate(self.lags):
            lagged += share[:, k : k + 1] * w
        return np.maximum(np.maximum(top, top[ends]) + lagged + self.bias, 0)

    def features(self, texts: list[bytes]) -> np.ndarray:
        grid, rows = halves(texts)
        top, _, same = self.tops(grid, rows)
        chunk = self.chunks(top, same, chunk_ends(rows))
        at = np.cumsum(rows) - rows
        return np.hstack([np.maximum.reduceat(chunk, at), np.add.reduceat(chunk.astype(np.float64), at) / rows[:, None]])

    def score(self, texts: list[bytes]) -> np.ndarray:
        # Summed feature by feature, so that no text's rounding depends on how many are scored together.
        x = self.features(texts)
        total = np.full(len(x), self.base)
        for k, w in enumerate(self.out):
            total += x[:, k] * w
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def fit(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray, seed: int = 0) -> Network:
        """Adam on the weighted log loss; gradients pass through the places that pooling kept."""
        rng = np.random.default_rng(seed)
        values = [self.filters, self.lags, self.bias, self.out]
        first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
        share = float((weights * labels).sum() / weights.sum())
        self.base, b1, b2, step = float(np.log(share / (1 - share))), 0.0, 0.0, 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(texts))
            for s in range(0, len(order), BATCH):
                part = order[s : s + BATCH]
                grid, rows = halves([texts[i] for i in part])
                n, ends = len(grid), chunk_ends(rows)
                top, place, same = self.tops(grid, rows)
                chunk = self.chunks(top, same, ends)
                at, of = np.cumsum(rows) - rows, np.repeat(np.arange(len(part)), rows)
                best, mean = np.maximum.reduceat(chunk, at), np.add.reduceat(chunk, at) / rows[:, None]
                x = np.hstack([best, mean])
                p = 1 / (1 + np.exp(-np.clip(x @ self.out + self.base, -30, 30)))
                d = (p - labels[part]) * weights[part] / weights[part].sum()
                dx = d[:, None] * self.out
                # Which chunk gave the text's largest value, which row the chunk's, which place the row's.
                hit = chunk == best[of]
                hit &= np.cumsum(hit, 0) - (np.cumsum(hit, 0)[at] - hit[at])[of] == 1
                dchunk = np.where(chunk > 0, hit * dx[of, :FILTERS] + dx[of, FILTERS:] / rows[of][:, None], 0)
                own = top >= top[ends]
                drow = np.where(own, dchunk, 0)
                np.add.at(drow, ends, np.where(own, 0, dchunk))
                wide = np.zeros((n, HALF + WIDTH), np.uint8)
                wide[:, :HALF] = grid
                on = np.flatnonzero(ends != np.arange(n))
                wide[on, HALF:] = grid[on + 1, :WIDTH]
                grads = np.zeros(WIDTH * 256 * FILTERS)
                f, row = np.arange(FILTERS)[None, :], np.arange(n)[:, None]
                for k in range(WIDTH):
                    grads += np.bincount(((k * 256 + wide[row, place + k].astype(np.int64)) * FILTERS + f).ravel(), drow.ravel(), len(grads))
                all_grads = [grads.reshape(self.filters.shape) + 1e-5 * self.filters, np.maximum(same, same[ends]).T @ dchunk + 1e-4 * self.lags, dchunk.sum(0), x.T @ d + 1e-4 * self.out]
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for v, g, a, b in zip(values, all_grads, first, second, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    v -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(v.dtype)
                b1 += 0.1 * (d.sum() - b1)
                b2 += 0.01 * (d.sum() ** 2 - b2)
                self.base -= rate * (b1 / (1 - 0.9**step)) / (np.sqrt(b2 / (1 - 0.99**step)) + 1e-8)
        return self


class Constant:
    def __init__(self, value: float):
        self.value = value

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.value)


def learn(documents: DataFrame, labels: DataFrame, docs: int = DOCS) -> Network | Constant:
    """A network fitted to labels (doc_id, quality) of documents (doc_id, text); null ids, labels and other labels teach nothing."""
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").distinct()
    many = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(many) < 2:
        return Constant((many.get(1, 0) + 0.5) / (sum(many.values()) + 1))
    h = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1))
    share = F.when(F.col("y") == 1, F.lit(2.0 * docs / many[1])).otherwise(F.lit(2.0 * docs / many[0]))
    part = rows.withColumn("h", h).filter(F.col("h") <= share * (1 << 40))
    part = part.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy("h", "doc_id"))).filter(F.col("k") <= docs)
    # At most 2 * docs rows: a side of constant size, and one text of each.
    met = documents.select("doc_id", "text").join(F.broadcast(part.select("doc_id", "y", "h")), "doc_id")
    found = met.groupBy("h", "doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).orderBy("h", "doc_id", "y").collect()
    texts, y = [(r.text or "").encode() for r in found], np.array([r.y for r in found])
    if len(set(y.tolist())) < 2:
        return Constant((many[1] + 0.5) / (sum(many.values()) + 1))
    weights = np.where(y == 1, many[1] / (y == 1).sum(), many[0] / (y == 0).sum())
    return Network().fit(texts, y, weights / weights.mean())


def score(documents: DataFrame, model: Network | Constant) -> DataFrame:
    """The documents with a column quality_score added (an existing one is replaced)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    docs = documents.drop("quality_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256, "text"):
            texts = [(x or "").encode() for x in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(texts), pa.float64())], names=[*b.schema.names, "quality_score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, quality_score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of each document."""
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 5) == 0
    model = learn(docs.filter(~held), table(spark, sf_dir, "labels").filter(~held))
    found = score(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= KEEP, 1).otherwise(0).alias("predicted"))
