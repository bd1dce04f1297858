"""Operator 5: quality classifier, hashed word n-grams under FTRL-proximal logistic regression.

Features of a text are its distinct hashed words and word pairs, each of weight
SCALE / sqrt(number of distinct features), and shape features of the words (length,
capitals, marks, digits) hashed alike.  Training takes at most ``max_rows``
labelled rows, those of least keyed hash of doc_id: a bounded sample whose bound is
this documented parameter.  Each shard of the sample trains its own
follow-the-regularised-leader learner, and the weights are averaged (parameter
mixing); a text's score is the sparse dot product of its features with them.

Edge cases: null and empty texts have no features and score the bias alone;
without labels, or labels of one class, the score is the share of label 1 (0.5
without labels); null labels teach nothing; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import GOLDEN, batch_udf, list_array, mix64, table, text_chunks

BITS = 20
DIM = 1 << BITS
MAX_ROWS = 40_000
#: A learner for each so many rows.
SHARD_ROWS = 8_000
#: Passes over few rows: so many that this many rows are seen, between 3 and 20.
SEEN_ROWS = 30_000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.01, 0.01
#: Weight of a text's features together, as a vector's length.
SCALE = 4.0
THRESHOLD = 0.3
_KIND = np.full(256, 7, dtype=np.uint64)  # letters beyond ASCII
_KIND[:128] = 0
_KIND[48:58] = 1
_KIND[65:91] = 2
_KIND[97:123] = 3
for _c in "!?":
    _KIND[ord(_c)] = 4
for _c in "#*$%&|<>":
    _KIND[ord(_c)] = 5
for _c in ".,;:'\"-":
    _KIND[ord(_c)] = 6


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature indexes of each text, one after another, and their numbers."""
    out, counts = [], []
    for _, _, w in text_chunks(column):
        hashes = w.hashes()
        pair = np.zeros(0, np.uint64) if not len(hashes) else mix64(hashes[:-1] * GOLDEN + hashes[1:])
        # the shape of a word: kinds of its first and last bytes, and its length up to 15
        size = np.minimum(w.end - w.start, 15).astype(np.uint64)
        shape = mix64((_KIND[w.raw[w.start]] * np.uint64(8) + _KIND[w.raw[w.end - 1]]) * np.uint64(16) + size + np.uint64(1 << 40))
        for i in range(len(w.at) - 1):
            a, b = w.first[i], w.first[i + 1]
            found = np.unique(np.concatenate([hashes[a:b], pair[a : max(a, b - 1)], shape[a:b]]) >> np.uint64(64 - BITS))
            out.append(found)
            counts.append(len(found))
    return (np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)), np.array(counts, dtype=np.int64)


def features(text: Column) -> Column:
    """Hashed features of a text, as indexes below DIM."""

    def of(column: pa.Array) -> pa.Array:
        found, counts = _features(column)
        return list_array(found.astype(np.int32), counts)

    return batch_udf(of, "array<int>")(text)


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int) -> np.ndarray:
    """Weights, the bias last, after epochs passes over (features, label) rows by FTRL-proximal."""
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        l1 = np.where(at == DIM, 0.0, L1)  # the bias isn't held back
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for found, label in rows:
            at = np.append(found, DIM)
            x = np.full(len(at), SCALE / np.sqrt(max(1, len(found))))
            x[-1] = 1.0
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(np.arange(DIM + 1))


def _train_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for order, found, label in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            rows.append((order, found.values.to_numpy(), label))
    if not rows:
        return
    rows.sort(key=lambda r: r[0])
    w = ftrl([(f, y) for _, f, y in rows], min(20, max(3, SEEN_ROWS // len(rows))))
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at] * len(rows)), pa.array(np.full(len(at), len(rows)))], names=["at", "w", "rows"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights from (doc_id, text) and (doc_id, label) rows; at most max_rows labels, those of least hash of doc_id."""
    known = labels.where("label is not null and doc_id is not null").withColumn("order", F.xxhash64(F.col("doc_id"), F.lit("quality")))
    picked = known.select("doc_id", "order", "label").orderBy("order", "doc_id").limit(max_rows).groupBy("doc_id", "order").agg(F.max("label").alias("y"))
    share = picked.agg(F.count("*").alias("n"), F.sum("y").alias("ones")).first()
    out = np.zeros(DIM + 1)
    n, ones = share["n"], share["ones"] or 0
    if not n or ones in (0, n):
        out[DIM] = 0.0 if not n else (20.0 if ones else -20.0)
        return out
    shards = 1 + n // SHARD_ROWS
    rows = docs.join(F.broadcast(picked.select(F.col("doc_id").alias("picked_id"), "order", "y")), F.col("doc_id") == F.col("picked_id"))  # max_rows rows at most
    sample = rows.select("order", features(F.col("text")).alias("f"), "y").repartition(shards, F.pmod("order", F.lit(shards)))
    mixed = sample.mapInArrow(_train_shard, "at int, w double, rows bigint").groupBy("at").agg(F.sum("w").alias("w"))
    learned = mixed.toArrow()  # DIM + 1 rows at most
    out[learned["at"].to_numpy()] = learned["w"].to_numpy() / n
    return out


def score(text: Column, spark: SparkSession, weights: np.ndarray) -> Column:
    """Probability of label 1."""
    held = spark.sparkContext.broadcast(weights)  # DIM + 1 numbers

    def of(column: pa.Array) -> pa.Array:
        w = held.value
        found, counts = _features(column)
        # summed text by text, so that a score doesn't depend on the texts beside it
        total, some = np.zeros(len(counts)), counts > 0
        if some.any():
            total[some] = np.add.reduceat(w[found], (np.cumsum(counts) - counts)[some])
        dot = total * SCALE / np.sqrt(np.maximum(counts, 1)) + w[DIM]
        return pa.array(1.0 / (1.0 + np.exp(-np.clip(dot, -30, 30))))

    return batch_udf(of, "double")(text)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % 5 == 0
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id")).select("doc_id", F.col("quality").cast("int").alias("label"))
    weights = train(docs.select("doc_id", "text"), labels)
    out = docs.select("doc_id", held_out("doc_id").alias("held_out"), score(F.col("text"), spark, weights).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
