"""Monotone counters and the status row of a node."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import peer_address
from ..schemas import METRICS


def counters(increments: DataFrame) -> DataFrame:
    """One row of all counters from increments (name, by); only positive amounts count."""
    positive = F.greatest(F.col("by"), F.lit(0))
    return increments.agg(*[F.coalesce(F.sum(F.when(F.col("name") == m, positive)), F.lit(0)).cast("long").alias(m) for m in METRICS])


def identity(spark: SparkSession, peer: str, addrs: list[str]) -> DataFrame:
    """The node's own row: peer, addrs and the addresses that others dial."""
    one = spark.createDataFrame([(peer, addrs)], "peer string, addrs array<string>")
    return one.withColumn("dial", F.transform("addrs", lambda a: peer_address(a, F.col("peer"))))


def status(head: DataFrame, metrics: DataFrame, peers: DataFrame) -> DataFrame:
    """Head, height, known peers and counters in one row."""
    known = peers.agg(F.count("*").alias("known_peers"))
    return head.select(F.col("cid").alias("head"), "height").join(F.broadcast(known)).join(F.broadcast(metrics))
