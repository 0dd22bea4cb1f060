"""Shards by jump consistent hashing.

A key's shard depends on the key and the shard count alone; with one shard more,
a key stays or moves to the new shard. No ring table is kept.

Defined cases: a null key counts as the key -1; a null text has no
bytes; a very long text counts its bytes like any other; repeated rows share a shard and get
their own slots, equal ones in any order; other columns, whatever their names, are not looked at,
but write_shards refuses documents that have its folder's name as a column; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import durable, table

#: The generator of jump consistent hashing (Lamping and Veach): fixed values.
MULTIPLIER, STEP_BITS = 2862933555777941757, 33
SHARDS = 24


def jump(keys: np.ndarray, n: int) -> np.ndarray:
    """The shard, from 0 to n - 1, of each unsigned 64-bit key."""
    if n < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    step = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = step[live]
        state[live] = state[live] * np.uint64(MULTIPLIER) + np.uint64(1)
        spread = ((state[live] >> np.uint64(STEP_BITS)) + np.uint64(1)).astype(np.float64)
        step[live] = ((shard[live] + 1) * (float(1 << 31) / spread)).astype(np.int64)
        live = live[step[live] < n]
    return shard


def shard_of(key: Column, n: int) -> Column:
    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), n).astype(np.int32))

    return of(F.coalesce(key.cast("long"), F.lit(-1)))


def assign(docs: DataFrame, n: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's shard and slot: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Slots number a shard's rows from 0 without gaps. The narrow rows are written once with the
    input split they came from; a shard's rows are numbered split by split, and each split starts
    where those before it end. So neither a large shard nor a repeated key meets in one task.
    """
    text = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumns({"shard": shard_of(F.col("doc_id"), n), "grown_shard": shard_of(F.col("doc_id"), n + 1), "split": F.spark_partition_id()})
    placed = durable(rows, "shards")
    before = Window.partitionBy("shard").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "split").count()
    starts = counts.select("shard", "split", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "split").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("k", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "split"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("k")).alias("slot"), "grown_shard"
    )


def write_shards(docs: DataFrame, path: str, n: int = SHARDS, id_col: str = "doc_id", name: str = "shard") -> None:
    """The documents themselves, one folder a shard (name=0 and so on); a shard's rows are written by many tasks."""
    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")
    docs.withColumn(name, shard_of(F.col(id_col), n)).write.partitionBy(name).parquet(path)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
