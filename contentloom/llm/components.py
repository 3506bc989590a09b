"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Links of one partition.
ROWS = 200_000


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))


def _stars(pair: DataFrame) -> bool:
    """Whether every node has one link down, to a node that has none: then all is done."""
    down = pair.groupBy(F.col("u").alias("w")).agg(F.count("*").alias("n"))
    return down.where("n > 1").isEmpty() and pair.join(down, F.col("v") == F.col("w"), "left_semi").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link: the least node that links reach from it.

    Links with a null end, from a node to itself or repeated say nothing new; an
    empty table gives an empty one.

    Links are only joined and reduced to minima, so a node with very many
    links is no more than many rows. Every round ends in a checkpoint.
    """
    pair = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pair = checkpoint(pair)
    parts = pair.count() // ROWS + 1  # the work on few links shall not be spread over many tasks
    while not _stars(pair):
        both = pair.unionByName(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("w", F.least("m", "w").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        joined = large.join(_least(large), F.col("u") == F.col("w"))
        moved = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        pair = checkpoint(joined.select("u", F.col("m").alias("v")).unionByName(moved).distinct().coalesce(parts))
    roots = pair.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pair.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
