"""Prefix sums and ranks over a whole table without a single sorted partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chain import with_checkpoint_dir


def running_before(df: DataFrame, order: list[str], value: Column, out: str, parts: int | None = None) -> DataFrame:
    """df with the sum of value over all rows before each in a total order.

    Rows are dealt by range, so a partition holds a run of the order; only the
    sum of each partition meets in one place, a row for each. There are as many
    ranges as spark.sql.shuffle.partitions says, which is set for the size of the
    data. The dealt rows are a checkpoint, which outlives lost executors.
    """
    with_checkpoint_dir(df.sparkSession)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_v", value).repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()).checkpoint()
    sums = ranged.groupBy(F.col("_p").alias("_q")).agg(F.sum("_v").alias("_s"))
    before = W.orderBy("_q").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_q", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"))  # a row for each partition
    inside = W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(sums), F.col("_p") == F.col("_q"))
    return joined.withColumn(out, F.col("_b") + F.coalesce(F.sum("_v").over(inside), F.lit(0))).drop("_v", "_p", "_q", "_b")


def ranked(df: DataFrame, order: list[str], out: str, parts: int | None = None) -> DataFrame:
    """df with the place of each row, from 1, in a total order."""
    return running_before(df, order, F.lit(1).cast("long"), "_n", parts).withColumn(out, F.col("_n") + 1).drop("_n")
