"""Operator 8: sharding by jump consistent hashing.

The shard of a row is a function of its key and the number of shards alone; no
ring table is kept.  With one more shard a row stays where it is or moves to the
new shard, and 1 / (shards + 1) of the rows move.

Slots number a shard's rows from 0 without gaps, in two levels, so that no task
sees a whole shard: rows are counted by (shard, bucket), the few counts are summed
up to offsets, and rows are numbered within their bucket by key.  Buckets are dealt by
key, size and CRC-32, so that rows without a key, or with a common one, are spread.

Edge cases: a null key is a key of its own; a null text has size 1 and the CRC-32
of no bytes, 0; equal keys go to one shard; equal rows take neighbouring slots in any
order; no rows give no rows; other columns stay out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import batch_udf, cut, mix64, table

SHARDS = 8
#: Rows of a shard are numbered in this many separate buckets; the offsets table has shards * BUCKETS rows and is broadcast.
BUCKETS = 1024
_NULL_KEY = -(1 << 62)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys, all at a time."""
    key = keys.astype(np.uint64)
    shard = np.zeros(len(key), dtype=np.int64)
    going, at = np.arange(len(key)), np.zeros(len(key), dtype=np.float64)
    while len(going):
        shard[going] = at[going].astype(np.int64)
        key[going] = key[going] * np.uint64(2862933555777941757) + np.uint64(1)
        step = ((key[going] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        at[going] = np.floor((shard[going] + 1) * (float(1 << 31) / step))
        going = going[at[going] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """Shard 0 .. shards - 1 of a long key."""

    def of(k: pa.Array) -> pa.Array:
        return pa.array(jump(mix64(pc.fill_null(k, _NULL_KEY).to_numpy(zero_copy_only=False).view(np.uint64)), shards), pa.int32())

    return batch_udf(of, "int")(key)


def numbered(rows: DataFrame, shard: str, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """rows with column slot: 0, 1, 2 ... within each shard, in an order that keys alone decide; a column slot of rows is replaced."""
    columns = [c for c in rows.columns if c != "slot"]
    held = rows.select(rows[shard].alias("shard"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket"), F.struct(*keys).alias("key"), F.struct(*[rows[c] for c in columns]).alias("row"))
    counts = held.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    local = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key"))
    placed = held.withColumn("local", local).join(F.broadcast(offsets), ["shard", "bucket"])
    return placed.select("row.*", (F.col("offset") + F.col("local") - 1).alias("slot"))


def sharded(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, grown_shard, slot) of each row."""
    raw = F.coalesce(docs[text], F.lit("")).cast("binary")
    own = docs.select(docs[key].cast("long").alias("key"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    own = own.withColumns({"shard": shard_of(F.col("key"), shards), "grown_shard": shard_of(F.col("key"), shards + 1)})
    return numbered(cut(own, "shards"), "shard", ["key", "size", "text_crc32"]).withColumnRenamed("key", key)


def op8_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
