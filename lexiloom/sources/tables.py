"""Tables by name, durable intermediate results, joins with small sides and with skewed keys, global numbering."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Counted rows up to which a narrow table is broadcast.
BROADCAST_ROWS = 500_000
#: A key with more than this share of a table's rows is joined apart; there are fewer such keys than 1 / HOT.
HOT = 1 / 4096
#: Where intermediate results go on a local master that names no shared folder.
LOCAL_DIR = "/tmp/lexiloom-checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files make fewer splits than there are cores; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def parts(spark: SparkSession) -> int:
    """Partitions for an explicit shuffle: what the session asks of any other shuffle."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir; it goes when the application ends.

    Where the session names none, a local master takes LOCAL_DIR; a cluster has no folder to guess, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = LOCAL_DIR
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/lexiloom-{tag}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def durable(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, and safe from lost executors."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows allow one; otherwise the planner's choice stands."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def skew_join(rows: DataFrame, found: DataFrame, key: str, total: int) -> DataFrame:
    """The inner join of rows with found (one row for each value of key, a long or string, with n, its number of rows), without n.

    Values of more than HOT of the total are looked up in a broadcast table, which has fewer than 1 / HOT rows
    whatever the data; their rows then go through the shuffle under scattered keys.
    """
    names = [c for c in found.columns if c not in (key, "n")]
    hot = F.broadcast(found.where(F.col("n") > HOT * total).select(F.col(key).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in names]))
    looked = rows.join(hot, F.col(key) == F.col("_hot"), "left")
    scattered = F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.xxhash64(F.monotonically_increasing_id()).cast(rows.schema[key].dataType))
    cold = found.select(F.col(key).alias("_cold"), *[F.col(c).alias(f"_cold_{c}") for c in names])
    both = looked.withColumn("_key", scattered).join(cold, F.col("_key") == F.col("_cold"), "left").where("_hot is not null or _cold is not null")
    return both.select(*rows.columns, *[F.when(F.col("_hot").isNotNull(), F.col(f"_hot_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c) for c in names])


def numbered(df: DataFrame, order: Sequence[Column], name: str, sums: dict[str, str] | None = None) -> DataFrame:
    """df, written once, with a running number from 0 in the given order and, by name, the sum of a column over all rows before.

    No task holds more than its range of the order: rows are sorted by ranges, numbered within one, and
    shifted by the totals of the ranges before, of which there is a row each. The order should be total.
    """
    sums = sums or {}
    spark = df.sparkSession
    at = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    ranged = df.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    written = durable(ranged.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    totals = written.groupBy("_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{k}") for k, c in sums.items()])
    before = totals.select("_range", F.coalesce(F.sum("_n").over(ahead), zero).alias("_before"), *[F.coalesce(F.sum(f"_sum_{k}").over(ahead), zero).alias(f"_before_{k}") for k in sums])
    inside = written.withColumns({f"_in_{k}": F.coalesce(F.sum(c).over(at), zero) for k, c in sums.items()}) if sums else written
    shifted = inside.join(F.broadcast(before), "_range")  # a row for each range
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))  # monotonically_increasing_id keeps the row's place in its partition there
    return shifted.select(*df.columns, (F.col("_before") + place).alias(name), *[(F.col(f"_before_{k}") + F.col(f"_in_{k}")).alias(k) for k in sums])
