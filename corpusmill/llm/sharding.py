"""Sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import MASK
from corpusmill.session import cut_lineage

STEP = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key, by the jump consistent hash (no ring table)."""
    key = keys.astype(np.uint64).copy()
    shard = np.zeros(len(key), np.int64)
    todo = np.arange(len(key))
    at = np.zeros(len(key), np.int64)
    while len(todo):
        shard[todo] = at
        k = key[todo] * np.uint64(STEP & MASK) + np.uint64(1)
        key[todo] = k
        at = ((shard[todo] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        go = at < shards
        todo, at = todo[go], at[go]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a column of any hashable type; null is a key like any other."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def udf(h: pd.Series) -> pd.Series:
        return pd.Series(jump(h.to_numpy().astype(np.int64).view(np.uint64), shards).astype(np.int32))

    return udf(F.xxhash64(key))


def assign_shards(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """rows with `shard`, `slot` (gapless from 0 within a shard) and `grown_shard` (one shard more).

    Only the key and the shard count decide a shard, and appending a shard moves rows only into it.
    Slots follow the order of the keys (nulls first; rows with equal keys in any order), and are
    given without gathering a shard: rows are dealt by key range, each part is counted by shard, and a
    part numbers its own rows from the sum of the parts before it. What is sent to the driver is a
    number for each part and shard. Other columns pass through, empty and very long texts among them;
    those named like the new ones are replaced, and `_tie` and `_part` are dropped. Empty input: no rows.
    """
    rows = rows.drop("shard", "slot", "grown_shard", "_tie", "_part")
    placed = rows.withColumns({"shard": shard_of(F.col(key), shards), "grown_shard": shard_of(F.col(key), shards + 1), "_tie": F.monotonically_increasing_id()})
    placed = cut_lineage(placed.repartitionByRange(F.col(key).asc_nulls_first(), F.col("_tie")).sortWithinPartitions(F.col(key).asc_nulls_first(), "_tie").withColumn("_tie", F.spark_partition_id()).withColumnRenamed("_tie", "_part"))
    counts = placed.groupBy(F.col("_part").alias("part"), "shard").count().collect()
    before: dict[int, np.ndarray] = {}
    total = np.zeros(shards, np.int64)
    by_part: dict[int, list] = {}
    for r in counts:
        by_part.setdefault(r["part"], []).append(r)
    for part in sorted(by_part):
        before[part] = total.copy()
        for r in by_part[part]:
            total[r["shard"]] += r["count"]
    sent = placed.sparkSession.sparkContext.broadcast(before)
    at, own = placed.columns.index("shard"), placed.columns.index("_part")

    def number(batches):
        part, following = -1, None
        for b in batches:
            if not b.num_rows:
                continue
            shard = b.column(at).to_numpy(zero_copy_only=False)
            if part != b.column(own)[0].as_py():
                part = b.column(own)[0].as_py()
                following = sent.value[part].copy()
            order = np.argsort(shard, kind="stable")
            n = np.bincount(shard, minlength=shards)
            slot = np.empty(len(shard), np.int64)
            slot[order] = np.arange(len(shard)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(following, n)
            following += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(slot)], [*b.schema.names, "slot"])

    return placed.mapInArrow(number, T.StructType([*placed.schema.fields, T.StructField("slot", T.LongType())])).drop("_part")


def op2(docs: DataFrame) -> DataFrame:
    """Whole texts count for size and digest; a null text has no bytes and the digest of an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    return assign_shards(rows, "doc_id", 40).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
