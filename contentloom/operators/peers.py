"""The peer table: a fold of actions, scores, candidates, pruning and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..schemas import PEER

STALE_S, MAX_FAIL, MAX_KNOWN = 24 * 3600, 8, 5000
SAMPLE = 16
SPREAD = 16


def load(lines: DataFrame) -> DataFrame:
    """Peer rows of key, value (JSON); what can't be read is left out, a missing id comes from the key."""
    row = F.from_json("value", PEER, {"mode": "PERMISSIVE"})
    is_object = F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{")
    kept = lines.where(is_object).select("key", row.alias("r")).where("r IS NOT NULL")
    peer = F.coalesce(F.nullif("r.peer_id", F.lit("")), X.unescape_key(F.col("key")))
    return kept.select(peer.alias("peer_id"), *[F.col(f"r.{f.name}") for f in PEER if f.name != "peer_id"])


def fold(acts: DataFrame, score_now: DataFrame | None = None) -> DataFrame:
    """The table that actions (seq, at, peer, kind, addrs, services, source) leave.

    Addresses unite; a service mask or source that is not empty replaces the
    one before; failures count since the last success. Each is a sum, minimum
    or maximum, so a peer with very many actions is reduced before the
    shuffle. Times that never were are 0.
    """
    when = lambda kinds: F.coalesce(F.max(F.when(F.col("kind").isin(*kinds), F.col("at"))), F.lit(0)).cast("long")
    latest = lambda c, empty: F.coalesce(F.max(F.when(F.col(c) != empty, F.struct("seq", c)))[c], F.lit(empty))
    main = acts.groupBy("peer").agg(
        latest("services", 0).cast("long").alias("services"),
        latest("source", "").alias("source"),
        when(["seen", "success"]).alias("last_seen_unix"),
        when(["failure", "success", "attempt"]).alias("last_tried_unix"),
        when(["success"]).alias("last_succ_unix"),
    )
    addrs = acts.select("peer", F.explode("addrs").alias("addr")).distinct().groupBy("peer").agg(F.array_sort(F.collect_list("addr")).alias("addrs"))
    out = main.join(addrs, "peer", "left").join(failures(acts), "peer", "left")
    out = out.select("peer", F.coalesce("addrs", F.array().cast("array<string>")).alias("addrs"), "services", "last_seen_unix", "last_tried_unix", "last_succ_unix", F.coalesce("failure_count", F.lit(0)).cast("long").alias("failure_count"), "source", F.lit(0).cast("long").alias("expire_at_unix"))
    return out if score_now is None else scored(out, score_now)


def failures(acts: DataFrame) -> DataFrame:
    """peer, failure_count: failures after the last success, for every peer."""
    won = acts.where("kind = 'success'").groupBy(F.col("peer").alias("p")).agg(F.max("seq").alias("won"))
    # a peer's failures meet its last success in SPREAD tasks, so one with very many is no single task's
    won = won.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    lost = acts.where("kind = 'failure'").select("peer", "seq", F.pmod(F.xxhash64("seq"), F.lit(SPREAD)).cast("int").alias("salt"))
    lost = lost.join(won, (F.col("peer") == F.col("p")) & (F.col("salt") == F.col("s")), "left").where(F.col("won").isNull() | (F.col("seq") > F.col("won")))
    counted = lost.groupBy(F.col("peer").alias("p")).agg(F.count("*").alias("n"))
    return acts.select("peer").distinct().join(counted, F.col("peer") == F.col("p"), "left").select("peer", F.coalesce("n", F.lit(0)).cast("long").alias("failure_count"))


def scored(peers: DataFrame, clock: DataFrame, want: int = 0) -> DataFrame:
    """peers with score at the time of clock (now, one row)."""
    return peers.join(F.broadcast(clock)).withColumn("score", X.peer_score(F.col("now"), want)).drop("now")


def candidates(peers: DataFrame, clock: DataFrame, limit: int = 20, want: int = 0, max_fail: int = MAX_FAIL, exclude: DataFrame | None = None) -> DataFrame:
    """The best peers to dial: not expired, with fewer failures than max_fail, not in exclude (peer); all for a limit of 0."""
    kept = peers.join(F.broadcast(clock)).where(~X.expired(F.col("now")) & (F.col("failure_count") < max_fail))
    kept = kept.withColumn("score", X.peer_score(F.col("now"), want)).drop("now")
    if exclude is not None:
        kept = kept.join(exclude.select("peer").distinct(), "peer", "left_anti")
    kept = kept.orderBy(F.desc("score"), F.desc("last_succ_unix"), F.desc("last_seen_unix"), "failure_count", "peer")
    return kept.limit(limit) if limit > 0 else kept


def candidates_page(peers: DataFrame, clock: DataFrame, limit: str | int | None = None) -> DataFrame:
    """candidates() as a client asks for them: a limit that is no number from 1 to 200 means 20."""
    return candidates(peers, clock, X.limit_or(limit, 20, 200))


def policy(stale_s: int = 0, max_fail: int = 0) -> tuple[int, int]:
    """The limits of pruning; what is not above 0 leaves the usual one."""
    return stale_s if stale_s > 0 else STALE_S, max_fail if max_fail > 0 else MAX_FAIL


def pruned(peers: DataFrame, clock: DataFrame, stale_s: int = STALE_S, max_fail: int = MAX_FAIL) -> tuple[DataFrame, DataFrame]:
    """(peers that stay, peers that go); limits as policy() has them."""
    stale_s, max_fail = policy(stale_s, max_fail)
    every = peers.join(F.broadcast(clock))
    bad = X.stale(F.col("now"), stale_s, max_fail)
    return every.where(~bad).drop("now"), every.where(bad).drop("now")


def soft_cap(acts: DataFrame, cap: int = MAX_KNOWN) -> DataFrame:
    """The actions of the first cap peers to arrive; later peers are ignored; no cap for 0."""
    if cap <= 0:
        return acts
    first = acts.groupBy("peer").agg(F.min("seq").alias("first")).orderBy("first", "peer").limit(cap)
    return acts.join(first.select("peer"), "peer", "left_semi")


def sample(peers: DataFrame, clock: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """The addresses, with the peer's id, of the best peers; one row for each address."""
    best = candidates(peers, clock, limit)
    return best.select("peer", F.explode("addrs").alias("addr")).select(X.peer_address(F.col("addr"), F.col("peer").cast("string")).alias("entry"))


def as_json(rows: DataFrame, key: str, value: str = "value") -> DataFrame:
    """key, value (JSON) for every row, as rows are stored and answered: load() reads them back."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias(value))


def first_per_key(rows: DataFrame, key: str, order: list[Column | str], most: int) -> DataFrame:
    """At most so many rows of each key, the first ones.

    Spark keeps only the first ones of each task before the shuffle (a rank
    filter becomes a group limit), so a key with very many rows stays small.
    """
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def deficit(peers: DataFrame, clock: DataFrame, connections: DataFrame, least: int = 4) -> DataFrame:
    """Twice as many candidates as outbound connections (direction) are missing; none if none is."""
    missing = connections.agg(F.greatest(F.lit(0), F.lit(least) - F.count_if(F.col("direction") == "outbound")).alias("needed"))
    ranked = candidates(peers, clock, 2 * least)
    order = W.orderBy(F.desc("score"), F.desc("last_succ_unix"), F.desc("last_seen_unix"), "failure_count", "peer")
    return ranked.withColumn("place", F.row_number().over(order)).join(F.broadcast(missing)).where(F.col("place") <= 2 * F.col("needed")).drop("needed")


def gossip(acts: DataFrame, learned: DataFrame, self_id: int, at: DataFrame) -> DataFrame:
    """Actions with what gossip taught (peer, addr) appended as sightings, oneself left out."""
    more = learned.where(F.col("peer") != self_id).join(F.broadcast(at))
    more = more.select(F.lit(None).cast("long").alias("seq"), F.col("now").alias("at"), "peer", F.lit("seen").alias("kind"), F.array("addr").alias("addrs"), F.lit(0).cast("long").alias("services"), F.lit("gossip").alias("source"))
    return acts.unionByName(more.withColumn("seq", F.lit(2**62).cast("long")))
