"""Blocks keyed by the hash of their content, the manifest of known ones, and restores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import limit_or
from ..plans.prefix import ranked, running_before


def key(data: Column) -> Column:
    return F.sha2(data, 256)


def put(data: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Blocks (cid, data, size) of data (data) that the store has not yet, each once."""
    new = data.select(key(F.col("data")).alias("cid"), "data").dropDuplicates(["cid"])
    new = new.withColumn("size", F.octet_length("data").cast("long"))
    return new if store is None else new.join(store.select("cid"), "cid", "left_anti")


def put_indexed(data: DataFrame, store: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks that are new to the store, the manifest with all blocks of data)."""
    return put(data, store), index(manifest, put(data))


def lookup_indexed(asked: DataFrame, store: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lookup(), the manifest with those of asked that were found)."""
    return lookup(asked, store), index(manifest, asked.join(store.select("cid"), "cid", "left_semi"))


def index(*cids: DataFrame) -> DataFrame:
    """The manifest: the set of all cids; a null is none."""
    every = cids[0].select("cid")
    for more in cids[1:]:
        every = every.unionByName(more.select("cid"))
    return every.where(F.col("cid").isNotNull()).distinct()


def lookup(asked: DataFrame, store: DataFrame) -> DataFrame:
    """asked (cid) with found, size and the data in base64."""
    found = asked.join(store.select("cid", "data", F.lit(True).alias("found")), "cid", "left")
    return found.select(*asked.columns, F.coalesce("found", F.lit(False)).alias("found"), F.octet_length("data").cast("long").alias("size"), F.base64("data").alias("data_b64"))


def page(manifest: DataFrame, after: str = "", limit: int = 1000) -> DataFrame:
    """The next cids behind a cursor, in order; all for a limit of 0."""
    rows = manifest.where(F.col("cid") > after) if after else manifest
    rows = rows.select("cid").orderBy("cid")
    return rows.limit(limit) if limit > 0 else rows


def snapshot(manifest: DataFrame, after: str = "", limit: str | int | None = None) -> DataFrame:
    """page() as a client asks for it: a limit that is no number from 1 to 100,000 means 1,000."""
    return page(manifest, after, limit_or(limit, 1000, 100_000))


def missing(manifest: DataFrame, store: DataFrame) -> DataFrame:
    return manifest.join(store.select("cid"), "cid", "left_anti")


def restore(manifest: DataFrame, store: DataFrame, budget: int = 0) -> DataFrame:
    """ok, failed, bytes of a restore of manifest (pos, cid; repeated ones too) from store (cid, size).

    With a budget an item starts only while the bytes before it are fewer;
    what does not start counts neither way.
    """
    rows = manifest.join(store.select("cid", F.col("size").alias("bytes")), "cid", "left")
    if budget > 0:
        rows = running_before(rows.select("pos", "cid", "bytes"), ["pos", "cid"], F.coalesce("bytes", F.lit(0)), "spent").where(F.col("spent") < budget)
    there = F.col("bytes").isNotNull()
    return rows.agg(F.count_if(there).alias("ok"), F.count_if(~there).alias("failed"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))


def restore_progress(manifest: DataFrame, store: DataFrame, steps: int = 10) -> DataFrame:
    """step, ok, failed, bytes: what a restore of manifest (pos, cid) has done after each of so many equal parts of its items, in the order of pos."""
    rows = ranked(manifest.select("pos", "cid"), ["pos", "cid"], "place").join(store.select("cid", F.col("size").alias("bytes")), "cid", "left")
    total = manifest.agg(F.count("*").alias("total"))
    rows = rows.join(F.broadcast(total)).withColumn("step", F.ceil(F.col("place") * steps / F.col("total")).cast("int"))
    there = F.col("bytes").isNotNull()
    each = rows.groupBy("step").agg(F.count_if(there).alias("ok"), F.count_if(~there).alias("failed"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"))
    so_far = W.orderBy("step").rowsBetween(W.unboundedPreceding, 0)  # a row for each step
    return each.select("step", *[F.sum(c).over(so_far).alias(c) for c in ("ok", "failed", "bytes")])


def latest_providers(bound: DataFrame) -> DataFrame:
    """cid, provider: the last one bound (seq, cid, provider)."""
    return bound.groupBy("cid").agg(F.max(F.struct("seq", "provider"))["provider"].alias("provider"))


def provide(asked: DataFrame, providers: DataFrame, constant: str | None = None) -> DataFrame:
    """asked (cid) with its provider, or the constant one where there is none."""
    found = asked.join(providers, "cid", "left")
    return found if constant is None else found.withColumn("provider", F.coalesce("provider", F.lit(constant)))


def cleared(providers: DataFrame, cids: DataFrame) -> DataFrame:
    return providers.join(cids.select("cid"), "cid", "left_anti")
