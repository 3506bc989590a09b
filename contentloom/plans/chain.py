"""Heights of hash-linked logs that come without them, by pointer doubling."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go where spark.checkpoint.dir says; only local tests without it get a temporary folder."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="contentloom-"))


def heights(log: DataFrame, key: str = "cid", prev: str = "prev") -> DataFrame:
    """log with height: 1 for an event without prev, else one more than its prev's; null where a link is missing or a loop.

    Each round doubles the reach of every pointer, so a chain of n takes about
    log2 n joins of equal size on the key.
    """
    with_checkpoint_dir(log.sparkSession)
    links = log.select(F.col(key).alias("k"), F.col(prev).alias("to"), F.lit(1).cast("long").alias("steps"))
    before = None
    for _ in range(max(1, log.count()).bit_length() + 1):
        links = links.checkpoint()
        open_ = links.where(F.col("to").isNotNull()).count()
        if open_ in (0, before):
            break
        before = open_
        there = links.select(F.col("k").alias("t"), F.col("to").alias("far"), F.col("steps").alias("more"))
        joined = links.join(there, F.col("to") == F.col("t"), "left")
        links = joined.select("k", F.when(F.col("t").isNotNull(), F.col("far")).otherwise(F.col("to")).alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
    found = links.where(F.col("to").isNull()).select(F.col("k").alias("_k"), F.col("steps").alias("height"))
    return log.join(found, F.col(key) == F.col("_k"), "left").drop("_k")
