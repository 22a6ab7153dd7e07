"""Helpers that every module may use: table access, materialisation, bounded broadcast, salting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes a side may have before a join stops broadcasting it.
BROADCAST_BYTES = 16 << 20
#: Copies of the smaller side of a join on a key that one value may dominate.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a folder of our own only where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "strataq-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint: survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def clear_checkpoints(spark: SparkSession) -> None:
    """Deletes what this session has checkpointed; for the end of a job, when its results are written.

    On a cluster spark.cleaner.referenceTracking.cleanCheckpoints does it as soon as nothing refers to a checkpoint.
    """
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(at.get())
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for child in fs.listStatus(path):
            fs.delete(child.getPath(), True)


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes in memory, by its own values."""
    total = F.lit(16)
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        elif kind == "array" and f.dataType.elementType.typeName() in ("double", "float", "long", "integer", "short", "byte", "boolean"):
            total = total + F.coalesce(F.size(c), F.lit(0)) * 8 + 24
        elif kind in ("array", "map", "struct"):
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) * 2
        else:
            total = total + 8
    return total


def small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint if df, already materialised, takes at most max_bytes; else df as it is (a shuffled join)."""
    size = df.agg(F.sum(_row_bytes(df))).first()[0] or 0
    return F.broadcast(df) if size <= max_bytes else df


def salted_join(large: DataFrame, unique: DataFrame, key: str, spread: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Joins on a key that may hold a third of large: large is spread over `salts` partitions a key, unique is repeated."""
    left = large.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with `n`: 1, 2, ... in the given total order, by range partitions and offsets; no task sees all rows."""
    from pyspark.sql import Window as W

    placed = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))  # one row a partition
    offsets = sizes.select("_pid", (F.sum("_c").over(W.orderBy("_pid")) - F.col("_c")).alias("_before"))
    return placed.join(F.broadcast(offsets), "_pid").withColumn("n", F.col("_before") + F.col("_i") + 1).drop("_pid", "_i", "_before")


def numbered_within(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """df with `n`: 1, 2, ... within each key in the given total order; a key with most of the rows is spread over ranges."""
    from pyspark.sql import Window as W

    placed = materialise(df.repartitionByRange(F.col(key), *order).withColumn("_pid", F.spark_partition_id()))
    counts = placed.groupBy(key, "_pid").agg(F.count(F.lit(1)).alias("_c"))  # a row for each key and range it lies in
    offsets = counts.select(F.col(key).alias("_k"), F.col("_pid").alias("_p"), (F.sum("_c").over(W.partitionBy(key).orderBy("_pid")) - F.col("_c")).alias("_before"))
    local = placed.withColumn("_i", F.row_number().over(W.partitionBy("_pid", key).orderBy(*order)))
    joined = local.join(offsets, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_pid") == F.col("_p")))
    return joined.withColumn("n", F.col("_before") + F.col("_i")).drop("_pid", "_i", "_before", "_k", "_p")
