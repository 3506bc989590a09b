"""Handshake messages, the gate for unverified peers, and address lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..schemas import VERSION

PROTOCOL = "/handshake/1.0.0"


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Message rows of JSON lines; masks keep all their bits."""
    m = lines.select("*", F.from_json(column, VERSION).alias("_m"))
    m = m.select(*lines.columns, "_m.*")
    return m.withColumn("services", X.unsigned_bits(F.col("services"))).withColumn("nonce", X.unsigned_bits(F.col("nonce")))


def reason(allow: int = 0, scheme: str = "", least: tuple[int, int, int] = X.MIN_VERSION):
    """Why a message (services, agent, auth_scheme, auth_proof) is refused; null if it is not."""
    refused = F.when(~X.services_ok(F.col("services"), allow), "services").when(~X.version_ok(F.col("agent"), least), "agent")
    if scheme:
        refused = refused.when(F.coalesce(F.col("auth_scheme"), F.lit("")) != scheme, "auth scheme").when(F.coalesce(F.col("auth_proof"), F.lit("")) == "", "auth proof")
    return refused


def exchanges(messages: DataFrame) -> DataFrame:
    """conv, complete: whether a conversation's turns (conv, turn, role) alternate, from the first, between two sides."""
    sides = messages.groupBy("conv").agg(F.count("*").alias("n"), F.countDistinct("turn").alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.countDistinct(F.col("turn") % 2, "role").alias("sides"), F.countDistinct("role").alias("roles"))
    whole = (F.col("n") >= 2) & (F.col("n") == F.col("turns")) & (F.col("high") - F.col("low") + 1 == F.col("n")) & (F.col("sides") == 2) & (F.col("roles") == 2)
    return sides.select("conv", F.col("n").alias("messages"), whole.alias("complete"))


STEPS = (("initiator", "version"), ("responder", "version"), ("initiator", "verack"), ("responder", "verack"))


def completed(messages: DataFrame, timeout_s: float = 5) -> DataFrame:
    """conv, outcome of exchanges (conv, turn, role, kind, at in seconds).

    A version of each side and then a verack of each side, the initiator first,
    all before the deadline: then the outcome is ok. Else it is order, if the
    messages so far are not the first of these; timeout, if one came late; open.
    """
    place = F.row_number().over(W.partitionBy("conv").orderBy("turn", "role"))
    least = [F.when(F.col("_n") == k + 1, (F.col("role") == role) & (F.col("kind") == kind)) for k, (role, kind) in enumerate(STEPS)]
    right = F.coalesce(*least, F.lit(False))
    kept = messages.withColumn("_n", place).where(F.col("_n") <= len(STEPS) + 1)  # a rank filter: long conversations stay small
    seen = kept.groupBy("conv").agg(F.count("*").alias("n"), F.bool_and(right).alias("right"), (F.max("at") - F.min("at")).alias("took"))
    outcome = F.when(~F.col("right"), "order").when(F.col("took") > timeout_s, "timeout").when(F.col("n") == len(STEPS), "ok").otherwise("open")
    return seen.select("conv", outcome.alias("outcome"))


def gated(streams: DataFrame, verified: DataFrame) -> DataFrame:
    """Streams (peer, protocol) of verified peers (peer), and the handshake's own."""
    known = verified.select(F.col("peer").alias("_v")).distinct()
    return streams.join(known, F.col("peer") == F.col("_v"), "left").where(F.col("_v").isNotNull() | (F.col("protocol") == PROTOCOL)).drop("_v")


def neighbours(edges: DataFrame, self_id) -> DataFrame:
    """The distinct peers at the other end of one's own connections (a, b)."""
    return edges.where(F.col("a") == self_id).select(F.col("b").alias("peer")).where(F.col("peer") != self_id).distinct()


def peer_list(entries: DataFrame, column: str = "entry") -> DataFrame:
    """addr, peer of every entry that is an address with a peer; one row for each entry."""
    addr, peer = X.split_peer_address(F.col(column))
    return entries.select(addr.alias("addr"), peer.alias("peer")).where((F.col("addr") != "") & (F.col("peer") != ""))
