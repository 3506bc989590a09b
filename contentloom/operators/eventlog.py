"""The append-only event log: a hash-linked list, here with its heights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import limit_or
from ..plans.prefix import ranked

TYPE = "peer_added"
MAX_DEPTH = 512
MAX_BLOCK = 1 << 20


def chained(firsts: DataFrame) -> DataFrame:
    """Events (seq, ts, peer) as a log: height, the key and prev of each.

    Keys are hashes of the event's own fields, so links need no walk; the
    ranks come from ranges of seq.
    """
    rows = ranked(firsts, ["seq"], "height").withColumn("cid", F.sha2(F.concat_ws("|", F.lit(TYPE), F.col("ts"), F.col("peer")), 256))
    before = rows.select((F.col("height") + 1).alias("h"), F.col("cid").alias("prev"))
    return rows.join(before, F.col("height") == F.col("h"), "left").select("height", "cid", "prev", "ts", "peer", F.lit(TYPE).alias("type"))


def head(log: DataFrame) -> DataFrame:
    """The cid and height of the last event, in one row; no cid and 0 for an empty log."""
    return log.agg(F.max(F.struct("height", "cid")).alias("h")).select(F.col("h.cid").alias("cid"), F.coalesce("h.height", F.lit(0)).cast("long").alias("height"))


def walk(log: DataFrame, limit: int) -> DataFrame:
    """applied: the links followed from the head back, at most limit; one fewer than the events."""
    return head(log).select(F.least(F.lit(limit), F.greatest(F.col("height") - 1, F.lit(0))).cast("long").alias("applied"))


def recent(log: DataFrame, limit: int) -> DataFrame:
    """The last events, newest first, up to the first gap below the head."""
    if limit <= 0:
        return log.limit(0)
    rows = log.orderBy(F.desc("height")).limit(limit)  # at most limit rows meet for the gap test
    whole = (F.max("height").over(W.partitionBy()) - F.col("height") + 1) == F.row_number().over(W.orderBy(F.desc("height")))
    return rows.withColumn("_ok", whole & (F.col("type") == TYPE)).withColumn("_all", F.min(F.col("_ok").cast("int")).over(W.orderBy(F.desc("height")))).where("_all = 1").drop("_ok", "_all")


def recent_page(log: DataFrame, limit: str | int | None = None) -> DataFrame:
    """recent() as a client asks for it: a limit that is no number from 1 to 1,000 means 50."""
    return recent(log, limit_or(limit, 50, 1000))


def sync_suffix(local: DataFrame, remote: DataFrame, remote_height: int, max_depth: int = 0, max_block: int = 0) -> DataFrame:
    """What a sync from a remote log does: applied, cid and height of the head after it, and error (null for none).

    local and remote are logs (height, cid, type, peer, size). The walk goes
    from the remote head down at most max_depth events (512 for 0), and ends
    at the local head, which it has to reach unless the local log is empty.
    An event met on the way that is too large, or of another type, or without
    a peer, is an error. An error leaves the head where it was.
    """
    depth = max_depth if max_depth > 0 else MAX_DEPTH
    ours = head(local).select(F.col("cid").alias("our_cid"), F.col("height").alias("our_height"))
    top = remote.agg(F.max("height").alias("top"))
    walked = remote.join(F.broadcast(top)).where(F.col("height") > F.col("top") - depth).join(F.broadcast(ours))
    base = walked.agg(F.max(F.when(F.col("cid") == F.col("our_cid"), F.col("height"))).alias("base"))
    visited = walked.join(F.broadcast(base)).where(F.col("base").isNull() | (F.col("height") >= F.col("base")))
    big = (F.col("size") > max_block) if max_block > 0 else F.lit(False)
    wrong = (F.col("type") != TYPE) | (F.coalesce(F.col("peer"), F.lit("")) == "")
    facts = visited.agg(
        F.count_if(F.col("base").isNull() | (F.col("height") > F.col("base"))).alias("applied"),
        F.max(F.struct("height", "cid"))["cid"].alias("far"),
        F.coalesce(F.bool_or(big), F.lit(False)).alias("big"),
        F.coalesce(F.bool_or(wrong), F.lit(False)).alias("wrong"),
        F.max("base").alias("base"),
    ).join(F.broadcast(ours))
    idle = F.col("our_height") >= remote_height
    error = F.when(idle, None).when(F.col("big"), "block too large").when(F.col("wrong"), "bad event").when(F.col("base").isNull() & (F.col("our_height") > 0), "no common ancestor")
    done = facts.withColumn("error", error.cast("string")).withColumn("moves", ~idle & F.col("error").isNull())
    return done.select(F.when(F.col("moves"), F.col("applied")).otherwise(0).cast("long").alias("applied"), F.when(F.col("moves"), F.col("far")).otherwise(F.col("our_cid")).alias("cid"), (F.col("our_height") + F.when(F.col("moves"), F.col("applied")).otherwise(0)).cast("long").alias("height"), "error")


def first_seen(acts: DataFrame) -> DataFrame:
    """peer, seq: the first action of each."""
    return acts.groupBy("peer").agg(F.min("seq").alias("seq"))


def append_new(log: DataFrame, more: DataFrame) -> DataFrame:
    """The peers of more (peer, seq) that the log has not, each once: what a grow-only set gains."""
    return first_seen(more).join(log.select("peer").distinct(), "peer", "left_anti")
