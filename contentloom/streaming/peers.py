"""Streams of peer actions: the peer table as state, and logs appended by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import peers

STATE = "addrs array<string>, services long, last_seen_unix long, last_tried_unix long, last_succ_unix long, failure_count long, source string, seq long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = f"peer long, {STATE}"
FIELDS = [f.strip().split()[0] for f in STATE.split(",")]


class PeerFold(StatefulProcessor):
    """One peer's row, changed by its actions in the order of seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.row.get() if self.row.exists() else ([], 0, 0, 0, 0, 0, "", -1)
        addrs, services, seen, tried, won, fails, source, last = old
        addrs, lost, success, given, named = set(addrs), [], -1, -1, -1
        for a in rows:  # one chunk at a time; of a peer's failures only their places are kept until the batch's last success is known
            is_ = lambda *kinds, a=a: a["kind"].isin(kinds)
            at = lambda mask, old, a=a: max(old, int(a["at"][mask].max())) if mask.any() else old
            addrs.update(x for some in a["addrs"] for x in some)
            seen, tried, won = at(is_("seen", "success"), seen), at(is_("success", "failure", "attempt"), tried), at(is_("success"), won)
            for mask, is_service in ((a["services"] != 0, True), (a["source"] != "", False)):
                if mask.any():
                    top = a[mask].nlargest(1, "seq").iloc[0]
                    if is_service and top["seq"] > given:
                        given, services = int(top["seq"]), int(top["services"])
                    elif not is_service and top["seq"] > named:
                        named, source = int(top["seq"]), top["source"]
            success = max(success, int(a["seq"][is_("success")].max())) if is_("success").any() else success
            lost.append(a["seq"][is_("failure")].to_numpy())
            last = max(last, int(a["seq"].max()))
        fails = sum(int((x > success).sum()) for x in lost) + (fails if success < 0 else 0)
        new = (sorted(addrs), services, seen, tried, won, fails, source, last)
        self.row.update(new)
        yield pd.DataFrame([(key[0], *new)], columns=["peer", *FIELDS])

    def close(self) -> None:
        pass


def peer_updates(acts: DataFrame) -> DataFrame:
    """A row of the peer table for every peer that a batch of actions changes."""
    return acts.groupBy("peer").transformWithStateInPandas(PeerFold(), OUTPUT, "Update", "None")


def run_available(acts: DataFrame, checkpoint: str, out: str) -> None:
    """Folds what a stream of actions has, and appends the changed rows to out as Parquet."""
    # a batch that is tried again replaces its own rows
    _run(acts, checkpoint, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"))


def _run(acts: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    conf, name = acts.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKSDB)  # state of this kind is kept by it only
    query = peer_updates(acts).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        conf.set(name, before)


def upsert_json(changed: DataFrame, folder: str, number: int) -> None:
    """Writes changed rows of the peer table as JSON, one file set a batch: write-through, repeatable, and read by current()."""
    rows = changed.select(F.col("peer").cast("string").alias("key"), "seq", F.to_json(F.struct(*[c for c in changed.columns if c != "seq"])).alias("value"))
    rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def current(spark: SparkSession, folder: str) -> DataFrame:
    """key, value (JSON) of each peer, as the last batch that changed it wrote it."""
    rows = spark.read.parquet(folder)
    return rows.groupBy("key").agg(F.max(F.struct("seq", "batch", "value"))["value"].alias("value"))


def run_upserts(acts: DataFrame, checkpoint: str, folder: str) -> None:
    """Folds what a stream of actions has into JSON rows."""
    _run(acts, checkpoint, lambda batch, number: upsert_json(batch, folder, number))


def prune_tick(spark: SparkSession, folder: str, out: str, now: int, stale_s: int = 0, max_fail: int = 0) -> int:
    """What a timer does every few minutes: writes the peers that stay (Parquet in out), and says how many go."""
    every = peers.load(current(spark, folder)).withColumnRenamed("peer_id", "peer")
    stay, go = peers.pruned(every, spark.range(1).select(F.lit(now).cast("long").alias("now")), stale_s, max_fail)
    stay.write.mode("overwrite").parquet(out)
    return go.count()


def gossip_log(learned: DataFrame, checkpoint: str, out: str, self_id: str) -> None:
    """Appends the peers that a stream of samples (seq, ts, peer) teaches, oneself left out."""
    append_log(learned.where((F.col("peer") != self_id) & (F.col("peer") != "")), checkpoint, out)


def latest(updates: DataFrame) -> DataFrame:
    """The table that the updates leave: of each peer the row with the highest seq."""
    newest = F.max(F.struct("seq", *[c for c in updates.columns if c not in ("peer", "seq", "batch")])).alias("r")
    return updates.groupBy("peer").agg(newest).select("peer", "r.*").drop("seq")


def append_log(firsts: DataFrame, checkpoint: str, out: str) -> None:
    """Appends the peers of a stream (seq, ts, peer) that the log in out has not: a grow-only set, batch by batch."""

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = batch.groupBy("peer").agg(F.min(F.struct("seq", "ts")).alias("f")).select("f.seq", "f.ts", "peer")
        try:
            known = spark.read.parquet(out).where(F.col("batch") < number)
        except Exception as e:  # nothing was written so far
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        new = first if known is None else first.join(known.select("peer"), "peer", "left_anti").select("seq", "ts", "peer")
        new.write.mode("overwrite").parquet(f"{out}/batch={number}")

    firsts.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
