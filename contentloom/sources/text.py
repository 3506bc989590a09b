"""Line and address list sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cleaned(lines: DataFrame, column: str = "value", comments: bool = True) -> DataFrame:
    """Trimmed lines that are not blank and, if comments are known, don't begin with #."""
    kept = lines.select(F.trim(F.col(column)).alias("value")).where(F.col("value") != "")
    return kept.where(~F.col("value").startswith("#")) if comments else kept


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """cid for every line of a manifest file, repeated lines too."""
    return cleaned(spark.read.text(path)).withColumnRenamed("value", "cid")


def payload(spark: SparkSession, path: str) -> DataFrame:
    """path, data of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("data"))


def comma_list(text: Column) -> Column:
    return F.explode(F.split(text, ","))


def seeds(flags: DataFrame, env: DataFrame, lines: DataFrame, self_id: str | None = None) -> DataFrame:
    """The distinct seeds of flags (value), comma lists (value) and file lines (value), without one's own."""
    listed = cleaned(env.select(comma_list(F.col("value")).alias("value")), comments=False)
    every = cleaned(flags, comments=False).unionByName(listed).unionByName(cleaned(lines)).dropDuplicates(["value"])
    return every if self_id is None else every.where(F.col("value") != self_id)
