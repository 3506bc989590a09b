"""Mixing sources to target weights, by Efraimidis-Spirakis sampling.

Only DataFrame functions. Every source gets a budget of words. Whole epochs of
the source come first; what remains goes to its documents in the order of
exponential keys scaled by their quality weights (the smallest first), until
the prefix sum of their sizes meets the budget. The document at the border
gives only its first words, so the words taken equal the rounded target.

A source is never sorted as a whole: keys fall into BUCKETS slices by a
monotone function of the key, sizes are summed by slice (partly before the
shuffle), and only the slice that holds the border is sorted. A source with a
third of all rows is thereby spread over BUCKETS groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BUCKETS = 4096
QUALITY = {1: 2.0, 0: 0.5}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def uniform(key: Column) -> Column:
    """A number in (0, 1) that depends on the key only; it can be had in other SQL dialects too."""
    digits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double")
    return (digits + 1) / F.lit(float(16**12 + 1))


def source_targets(sources: DataFrame) -> DataFrame:
    """source, source_size -> also weight and target; one row per source.

    Sources in order of code points, null last, weigh 5, 2, 1, repeating.
    Sources that their limit stops are those with the least 2 * size / weight:
    with sources in that order, the level that all others reach follows from
    prefix sums.
    """
    at = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), at.cast("int") + 1).cast("double")
    ranked = sources.withColumn("weight", weight).withColumn("ratio", MOST * F.col("source_size") / F.col("weight"))
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    level = (F.lit(SHARE) * F.sum("source_size").over(W.partitionBy()) - F.coalesce(MOST * F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level)
    met = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(W.partitionBy())["level"]
    target = F.least((MOST * F.col("source_size")).cast("double"), met * F.col("weight"))
    return ranked.select("source", "source_size", "weight", F.coalesce(target, (MOST * F.col("source_size")).cast("double")).alias("target"))


def mix_sized(rows: DataFrame) -> DataFrame:
    """doc_id, source, size, weight -> doc_id, size, source_size, target, taken; one row for each."""
    weight = F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(1.0)
    rows = rows.select("doc_id", "source", "size", (-F.log(uniform(F.col("doc_id"))) / weight).alias("key"))
    rows = checkpoint(rows.withColumn("bucket", F.floor((1 - F.exp(-F.col("key"))) * BUCKETS).cast("int")))
    slices = rows.groupBy(F.col("source").alias("s"), F.col("bucket").alias("b")).agg(F.sum("size").alias("slice_size"))
    sources = source_targets(slices.groupBy(F.col("s").alias("source")).agg(F.sum("slice_size").alias("source_size")))
    budget = F.floor(F.col("target") + 0.5)
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    running = W.partitionBy("s").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    plan = slices.withColumn("before", F.coalesce(F.sum("slice_size").over(running), F.lit(0)))
    plan = plan.join(sources, F.col("s").eqNullSafe(F.col("source"))).drop("source", "slice_size", "weight")
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    inner = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - first))
    taken = (F.col("epochs") * F.col("size") + part).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs (doc_id, text, source).

    A document's weight follows the least quality label that labels (doc_id,
    quality) has for it (QUALITY); 1 without one. Null texts count 0 words and
    are taken 0 times; a null source is a source of its own; equal keys follow
    doc_id and size, and equal rows share what falls to them in any order. No
    rows give no rows. Columns other than those named are not read.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    if labels is None:
        return mix_sized(sized.withColumn("weight", F.lit(1.0)))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("labelled")).agg(F.min("quality").alias("label"))
    weight = F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in QUALITY.items()], F.lit(1.0))
    return mix_sized(sized.join(known, F.col("doc_id") == F.col("labelled"), "left").select("doc_id", "source", "size", weight.alias("weight")))


ORACLE_SQL = """
WITH known AS (SELECT doc_id AS labelled, min(quality) AS label FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    CASE label WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710657.0::DOUBLE AS u
  FROM documents LEFT JOIN known ON doc_id = labelled),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM sized GROUP BY source),
levels AS (
  SELECT *, 2 * source_size / w AS ratio,
    (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(2 * sum(source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
met AS (SELECT arg_min(level, ratio) AS met FROM levels WHERE level <= ratio),
targets AS (SELECT source, source_size, coalesce(least((2 * source_size)::DOUBLE, met * w), (2 * source_size)::DOUBLE) AS target FROM levels, met),
plans AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target + 0.5) / source_size) ELSE 0 END::BIGINT AS epochs FROM targets),
ranked AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, floor(p.target + 0.5)::BIGINT - p.epochs * p.source_size AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / weight, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized d JOIN plans p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM ranked
"""
