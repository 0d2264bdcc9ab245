"""Sharding by jump consistent hashing: stable keys to shards, without a table.

The shard follows from the key and the number of shards alone. With one more
shard, only rows that go into the new one move, one in n + 1 of them.

Slots number the rows of a shard from 0 without gaps. Rows of a shard are first
split into BUCKETS hash buckets; the buckets' counts (a table of at most
shards x BUCKETS rows) give each bucket's first slot, so no task numbers a
whole shard.

Defined results: a null key is a key like others, all its rows share a shard;
null text has size 1 and the CRC of the empty text. Repeated rows get slots of
their own. An empty table gives an empty table. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.columns import picked
from larkspur.runtime import ensure_importable, written

BUCKETS = 1024


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Lamping and Veach's jump consistent hash of 64-bit keys."""
    key = keys.astype(np.uint64)
    b, j = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    open_ = np.arange(len(key))
    while len(open_):
        b[open_] = j[open_]
        key[open_] = key[open_] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[open_] >> np.uint64(33)).astype(np.float64) + 1)
        j[open_] = ((b[open_] + 1) * step).astype(np.int64)
        open_ = open_[j[open_] < shards]
    return b


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a long column; keys are scrambled by xxhash64 first."""

    def run(keys: pa.Array) -> pa.Array:
        return pa.array(jump_hash(keys.to_numpy(zero_copy_only=False).view(np.uint64), shards).astype(np.int32))

    return F.arrow_udf(run, "int")(F.xxhash64(key))


def sharded(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    ensure_importable(docs.sparkSession)
    body = F.coalesce(F.col("text"), F.lit(""))
    placed = picked(docs, key=key, text=text).select(
        F.col("key").cast("long").alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
    )
    # by size and checksum too, so that the rows of one much repeated id are spread
    bucket = F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit("bucket")), F.lit(BUCKETS)).cast("int")
    placed = placed.withColumn("bucket", bucket)
    placed = placed.withColumn("shard", jump_shard(F.col("doc_id"), shards)).withColumn("grown_shard", jump_shard(F.col("doc_id"), shards + 1))
    placed = written(placed, "placed")  # a few numbers for each text, so texts are read once
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    numbered = placed.withColumn("place", F.row_number().over(inside) - 1)
    # at most shards * BUCKETS rows: safe to broadcast whatever the corpus
    return numbered.join(F.broadcast(firsts), ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, key: str = "doc_id") -> None:
    """Write whole documents, one folder for each shard."""
    ensure_importable(docs.sparkSession)
    docs.withColumn("shard", jump_shard(F.col(key).cast("long"), shards)).write.partitionBy("shard").parquet(path)
