"""The fixtures' cases for peers, blocks, logs, messages and lists."""

import random

import pytest
from pyspark.sql import functions as F

from contentloom.functions import codec
from contentloom.functions import expressions as X
from contentloom.operators import blocks, eventlog, handshake, metrics, peers
from contentloom.plans import chain, prefix
from contentloom.sources import text
from contentloom.streaming import peers as stream

ACTION = "seq long, at long, peer long, kind string, addrs array<string>, services long, source string"
NOW = 1_000_000


def now(spark, at=NOW):
    return spark.createDataFrame([(at,)], "now long")


# --- peers


@pytest.mark.parametrize("succ,seen,fails,score", [(0, 0, 0, 0), (1_000_000, 1_000_000, 0, 70), (999_941, 1_000_000, 0, 70), (999_940, 1_000_000, 0, 69), (997_000, 1_000_000, 0, 20), (990_000, 987_940, 3, -15), (1_000_120, 1_000_000, 0, 72)])
def test_score(spark, succ, seen, fails, score):
    row = spark.createDataFrame([(succ, seen, fails, 1)], "last_succ_unix long, last_seen_unix long, failure_count long, services long")
    assert row.select(X.peer_score(F.lit(NOW))).first()[0] == score
    assert row.select(X.peer_score(F.lit(NOW), 1)).first()[0] == score + 100
    assert row.select(X.peer_score(F.lit(NOW), 2)).first()[0] == score


def two_peers(spark):
    rows = [(1, NOW, 1, "seen", ["/ip4/10.0.0.1/tcp/4001"], 1, "seed"), (2, NOW, 1, "success", [], 0, ""), (3, NOW, 2, "seen", ["/ip4/10.0.0.2/tcp/4001"], 0, "seed"), (4, NOW, 2, "attempt", [], 0, ""), (5, NOW, 2, "failure", [], 0, ""), (6, NOW, 2, "failure", [], 0, "")]
    return spark.createDataFrame(rows, ACTION)


def test_ranking_and_pruning(spark):
    table = peers.fold(two_peers(spark))
    best = peers.candidates(table, now(spark), 2, want=1).collect()
    assert [(r.peer, r.score) for r in best] == [(1, 170), (2, 10)]
    stay, go = peers.pruned(table, now(spark), 3600, 1)
    assert [r.peer for r in stay.collect()] == [1] and [r.peer for r in go.collect()] == [2]
    assert [r.peer for r in peers.candidates(table, now(spark), 0, exclude=spark.createDataFrame([(1,)], "peer long")).collect()] == [2]
    gone = table.withColumn("expire_at_unix", F.when(F.col("peer") == 1, NOW).otherwise(0))
    assert [r.peer for r in peers.candidates(gone, now(spark)).collect()] == [2]
    assert sorted(r.entry for r in peers.sample(table, now(spark)).collect()) == ["/ip4/10.0.0.1/tcp/4001/p2p/1", "/ip4/10.0.0.2/tcp/4001/p2p/2"]


def plain_fold(rows):
    out = {}
    for _, at, peer, kind, addrs, services, source in sorted(rows):
        r = out.setdefault(peer, {"addrs": set(), "services": 0, "source": "", "seen": 0, "tried": 0, "won": 0, "fails": 0})
        r["addrs"] |= set(addrs)
        r["services"], r["source"] = services or r["services"], source or r["source"]
        if kind in ("seen", "success"):
            r["seen"] = at
        if kind != "seen":
            r["tried"] = at
        if kind == "success":
            r["won"], r["fails"] = at, 0
        r["fails"] += kind == "failure"
    return {p: (sorted(r["addrs"]), r["services"], r["seen"], r["tried"], r["won"], r["fails"], r["source"]) for p, r in out.items()}


def actions(seed, n=300):
    r = random.Random(seed)
    return [(k, 1000 + k, r.randrange(12), r.choice(["seen", "success", "failure", "failure"]), [f"/ip4/1.2.3.{r.randrange(4)}"] if r.random() < 0.3 else [], r.choice([0, 0, 1, -1]), r.choice(["", "", "a", "b"])) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_one_by_one(spark, seed):
    rows = actions(seed)
    found = {r.peer: (r.addrs, r.services, r.last_seen_unix, r.last_tried_unix, r.last_succ_unix, r.failure_count, r.source) for r in peers.fold(spark.createDataFrame(random.Random(9).sample(rows, len(rows)), ACTION)).collect()}
    assert found == plain_fold(rows)


def test_stream_equals_fold(spark, tmp_path):
    from contentloom.streaming import peers as stream

    rows = actions(3, 120)
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : k * 40 + 40], ACTION).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(ACTION).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    stream.run_available(source, f"{tmp_path}/state", f"{tmp_path}/out")
    found = stream.latest(spark.read.parquet(f"{tmp_path}/out")).collect()
    want = plain_fold(rows)
    # files may come in any order, so only what does not depend on it is compared
    assert {r.peer: (sorted(r.addrs), r.last_seen_unix, r.last_tried_unix, r.last_succ_unix) for r in found} == {p: (w[0], *w[2:5]) for p, w in want.items()}


def test_soft_cap_and_limits(spark):
    acts = spark.createDataFrame(actions(4), ACTION)
    order = list(dict.fromkeys(r[2] for r in actions(4)))
    assert {r.peer for r in peers.soft_cap(acts, 5).select("peer").distinct().collect()} == set(order[:5])
    assert peers.soft_cap(acts, 0).count() == 300
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 9)], "k string, v int")
    assert sorted(map(tuple, peers.first_per_key(rows, "k", ["v"], 2).collect())) == [("a", 1), ("a", 2), ("b", 9)]


def test_load(spark):
    rows = [("p_1", '{"peer_id":"p/1","addrs":["x"],"failure_count":2}'), ("p_2", '{"last_seen_unix":5}'), ("p_3", "{broken"), ("p_4", None), ("p_5", '"text"')]
    found = {r.peer_id: (r.addrs, r.failure_count, r.last_seen_unix) for r in peers.load(spark.createDataFrame(rows, "key string, value string")).collect()}
    assert found == {"p/1": (["x"], 2, None), "p/2": (None, None, 5)}


def test_deficit(spark):
    table, links = peers.fold(two_peers(spark)), lambda n: spark.createDataFrame([("outbound",)] * n + [("inbound",)], "direction string")
    assert [peers.deficit(table, now(spark), links(n), 2).count() for n in (0, 1, 2, 3)] == [2, 2, 0, 0]


# --- blocks


def manifest(spark):
    store = blocks.put(spark.createDataFrame([(b"ochre",), (b"teal",), (b"ochre",)], "data binary"))
    names = [("ochre",), ("teal",), ("umber",)]
    cids = [r.cid for r in spark.createDataFrame(names, "n string").select(F.sha2("n", 256).alias("cid")).collect()]
    return store, spark.createDataFrame(list(enumerate([*cids, "??"])), "pos long, cid string")


@pytest.mark.parametrize("budget,ok,size", [(0, 2, 9), (5, 1, 5), (6, 2, 9), (100, 2, 9)])
def test_restore(spark, budget, ok, size):
    store, asked = manifest(spark)
    row = blocks.restore(asked, store, budget).first()
    assert (row.ok, row.bytes) == (ok, size) and (row.failed == 2 if budget in (0, 100) else row.failed <= 2)


def test_put_lookup_page(spark):
    store, asked = manifest(spark)
    assert store.count() == 2 and blocks.put(spark.createDataFrame([(b"teal",), (b"new",)], "data binary"), store).count() == 1
    found = blocks.lookup(asked, store).orderBy("pos").collect()
    assert [(r.found, r.size, r.data_b64) for r in found] == [(True, 5, "b2NocmU="), (True, 4, "dGVhbA=="), (False, None, None), (False, None, None)]
    assert blocks.missing(asked, store).count() == 2
    every = blocks.index(asked, asked, store)
    pages, after = [], ""
    while page := [r.cid for r in blocks.page(every, after, 3).collect()]:
        pages += page
        after = page[-1]
    assert pages == [r.cid for r in blocks.page(every, limit=0).collect()] and len(pages) == 4


def test_providers(spark):
    bound = spark.createDataFrame([(1, "c", "p1"), (2, "c", "p2"), (3, "d", "p1")], "seq long, cid string, provider string")
    asked = spark.createDataFrame([("c",), ("d",), ("e",)], "cid string")
    known = blocks.cleared(blocks.latest_providers(bound), spark.createDataFrame([("d",)], "cid string"))
    assert {tuple(r) for r in blocks.provide(asked, known).collect()} == {("c", "p2"), ("d", None), ("e", None)}
    assert {tuple(r) for r in blocks.provide(asked, known, "me").collect()} == {("c", "p2"), ("d", "me"), ("e", "me")}


# --- event log


def chained(spark, names, prev=None):
    rows = []
    for k, name in enumerate(names):
        cid = codec.event_cid(codec.encode_event(k, name, prev))
        rows.append((k + 1, cid, prev, k, name, "peer_added", 60))
        prev = cid
    return spark.createDataFrame(rows, "height long, cid string, prev string, ts long, peer string, type string, size long")


def sync(spark, local, remote, height, **more):
    r = eventlog.sync_suffix(local, remote, height, **more).first()
    return r.applied, r.height, r.error


def test_sync_suffix(spark):
    names = [f"peer{k}" for k in range(12)]
    log = chained(spark, names)
    upto = lambda n: log.where(F.col("height") <= n)
    assert sync(spark, upto(0), upto(2), 2) == (2, 2, None)
    assert sync(spark, upto(2), upto(3), 3) == (1, 3, None)
    assert sync(spark, upto(3), upto(3), 3) == (0, 3, None)
    assert sync(spark, upto(2), chained(spark, ["U1"]), 3, max_depth=2)[::2] == (0, "no common ancestor")
    assert sync(spark, upto(2), upto(7), 7, max_depth=5) == (0, 2, "no common ancestor")
    assert sync(spark, upto(2), upto(6), 6, max_depth=5) == (4, 6, None)
    assert sync(spark, upto(0), log, 12, max_depth=5) == (5, 5, None)
    assert sync(spark, upto(2), upto(4).withColumn("size", F.lit(99).cast("long")), 4, max_block=64) == (0, 2, "block too large")
    assert sync(spark, upto(2), upto(4).withColumn("peer", F.when(F.col("height") == 4, "").otherwise(F.col("peer"))), 4) == (0, 2, "bad event")
    assert sync(spark, upto(2), upto(4).withColumn("type", F.when(F.col("height") == 2, "x").otherwise(F.col("type"))), 4) == (0, 2, "bad event")


def test_log_reads(spark):
    log = chained(spark, [f"p{k}" for k in range(7)])
    assert eventlog.walk(log, 100).first()[0] == 6 and eventlog.walk(log, 3).first()[0] == 3 and eventlog.walk(log.limit(0), 3).first()[0] == 0
    assert tuple(eventlog.head(log.limit(0)).first()) == (None, 0)
    assert [r.height for r in eventlog.recent(log, 3).collect()] == [7, 6, 5] and eventlog.recent(log, 0).collect() == [] and eventlog.recent(log.limit(0), 5).collect() == []
    assert [r.height for r in eventlog.recent(log.where("height <> 5"), 6).collect()] == [7, 6]
    assert {r.cid: r.height for r in chain.heights(log.select("cid", "prev")).collect()} == {r.cid: r.height for r in log.collect()}
    broken = log.select("cid", F.when(F.col("height") == 3, "lost").otherwise(F.col("prev")).alias("prev"))
    assert sorted(r.height or 0 for r in chain.heights(broken).collect()) == [0, 0, 0, 0, 0, 1, 2]


def test_append_new(spark):
    acts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "seq long, peer string")
    log = chained(spark, ["a"])
    new = eventlog.append_new(log, acts)
    assert {tuple(r) for r in new.collect()} == {("b", 2), ("c", 4)}
    again = log.select("peer").unionByName(new.select("peer"))
    assert eventlog.append_new(again, acts).collect() == []


def test_prefix_sums(spark):
    rows = spark.createDataFrame([(k, k % 5) for k in random.Random(1).sample(range(200), 200)], "k long, v long")
    found = {r.k: (r.s, r.n) for r in prefix.ranked(prefix.running_before(rows, ["k"], F.col("v"), "s", 7), ["k"], "n", 5).collect()}
    total = 0
    for k in range(200):
        assert found[k] == (total, k + 1)
        total += k % 5


# --- messages and lists


@pytest.mark.parametrize("agent,ok", [("node/0.1.0", True), ("node/0.0.9", False), ("node/0.10.0", True), ("other/9.9.9", True), ("0.1.0", True), ("node/", False), ("node/0.1.x", True), ("node/0.1", True), ("node/ 1 .0.0", False), ("", False), (None, False), ("a/b/+1.0", True), ("n/-1.9.9", False)])
def test_versions(spark, agent, ok):
    assert spark.createDataFrame([(agent,)], "a string").select(X.version_ok(F.col("a"))).first()[0] is ok


def test_messages(spark):
    lines = ['{"services":18446744073709551615,"agent":"n/1.0.0","auth_scheme":"s","auth_proof":"p"}', '{"services":2,"agent":"n/0.0.1"}', '{"services":4,"agent":"n/1.0.0"}', '{"services":2,"agent":"n/1.0.0","auth_scheme":"x"}', '{"services":2,"agent":"n/1.0.0","auth_scheme":"s","auth_proof":""}']
    rows = handshake.parsed(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r.services for r in rows.collect()] == [-1, 2, 4, 2, 2]
    assert [r[0] for r in rows.select(handshake.reason()).collect()] == [None, "agent", None, None, None]
    assert [r[0] for r in rows.select(handshake.reason(3, "s")).collect()] == ["services", "agent", "services", "auth scheme", "auth proof"]


def test_gate_neighbours_lists(spark):
    streams = spark.createDataFrame([("a", "/x"), ("b", "/x"), ("b", handshake.PROTOCOL)], "peer string, protocol string")
    verified = spark.createDataFrame([("a",), ("a",)], "peer string")
    assert {tuple(r) for r in handshake.gated(streams, verified).collect()} == {("a", "/x"), ("b", handshake.PROTOCOL)}
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a"), ("c", "d")], "a string, b string")
    assert [tuple(r) for r in handshake.neighbours(edges, "a").collect()] == [("b",)]
    entries = spark.createDataFrame([("/ip4/1.2.3.4/tcp/1/p2p/X",), ("/ip4/1.2.3.4",), ("",), ("/p2p/X",)], "entry string")
    assert [tuple(r) for r in handshake.peer_list(entries).collect()] == [("/ip4/1.2.3.4/tcp/1", "X")]
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert sorted(r[0] for r in text.seeds(lines(" a ", "", "#f"), lines("b, ,a", "#g"), lines("# no", " c", "me"), "me").collect()) == ["#f", "#g", "a", "b", "c"]


def test_addresses(spark):
    row = lambda x: spark.createDataFrame([(x,)], "a string").select(X.rewrite_ip4(F.col("a"), "9.9.9.9"), X.ip4(F.col("a")), X.is_public_ip4(X.ip4(F.col("a")))).first()
    assert tuple(row("/ip4/10.0.0.1/tcp/1/ip4/2.2.2.2")) == ("/ip4/9.9.9.9/tcp/1/ip4/2.2.2.2", "10.0.0.1", False)
    assert tuple(row("/ip6/::1/tcp/1")) == ("/ip6/::1/tcp/1", "", False)
    for ip, public in (("8.8.8.8", True), ("127.0.0.1", False), ("172.16.0.1", False), ("172.32.0.1", True), ("192.168.0.1", False), ("169.254.1.1", False), ("300.1.1.1", False)):
        assert row(f"/ip4/{ip}")[2] is public
    heights = spark.createDataFrame([("12abc",), (" -3",), ("",), ("x",), (None,)], "t string")
    assert [r[0] for r in heights.select(X.parse_height(F.col("t"))).collect()] == [12, -3, 0, 0, 0]
    assert [X.limit_or(v, 50, 1000) for v in ("7", "0", "1001", "x", None, 1000)] == [7, 50, 50, 50, 50, 1000]


def test_counters(spark):
    rows = spark.createDataFrame([("dials_failed", 1), ("restore_bytes", 5), ("restore_bytes", -7), ("unknown", 3)], "name string, by long")
    row = metrics.counters(rows).first().asDict()
    assert row["dials_failed"] == 1 and row["restore_bytes"] == 5 and sum(row.values()) == 6
    assert sum(metrics.counters(rows.limit(0)).first()) == 0


# --- pages, policies, jobs and streams


def test_limits_as_clients_ask_for_them(spark):
    cids = spark.range(1500).select(F.format_string("%05d", "id").alias("cid"))
    assert [blocks.snapshot(cids, limit=x).count() for x in (None, "x", "0", "100001", "7")] == [1000, 1000, 1000, 1000, 7]
    log = spark.range(1, 1200).select(F.col("id").alias("height"), F.lit("c").alias("cid"), F.lit(eventlog.TYPE).alias("type"))
    assert [eventlog.recent_page(log, x).count() for x in (None, "1001", "1000", 3)] == [50, 50, 1000, 3]


def test_policy_ignores_what_is_not_above_zero(spark):
    assert peers.policy() == peers.policy(-1, 0) == (peers.STALE_S, peers.MAX_FAIL) and peers.policy(5, 2) == (5, 2)


def test_put_and_get_keep_the_manifest(spark):
    data = spark.createDataFrame([(b"a",), (b"b",), (b"b",)], "data binary")
    there = blocks.put(spark.createDataFrame([(b"a",), (b"z",)], "data binary"))
    new, manifest = blocks.put_indexed(data, there, spark.createDataFrame([("q",)], "cid string"))
    assert new.count() == 1 and manifest.count() == 3
    asked = spark.createDataFrame([("none",)], "cid string").unionByName(there.select("cid"))
    found, manifest = blocks.lookup_indexed(asked, there, blocks.index(new))
    assert found.where("found").count() == 2 and manifest.count() == 3


def test_handshakes_in_order_and_in_time(spark):
    right = [("initiator", "version"), ("responder", "version"), ("initiator", "verack"), ("responder", "verack")]
    rows = [("ok", k, r, m, k) for k, (r, m) in enumerate(right)] + [("late", k, r, m, 2.0 * k) for k, (r, m) in enumerate(right)]
    rows += [("open", k, r, m, k) for k, (r, m) in enumerate(right[:2])] + [("order", k, r, m, k) for k, (r, m) in enumerate([right[0], right[2]])]
    rows += [("more", k, r, m, k) for k, (r, m) in enumerate([*right, *right])]
    found = handshake.completed(spark.createDataFrame([(c, k, r, m, float(t)) for c, k, r, m, t in rows], "conv string, turn int, role string, kind string, at double"))
    assert {x.conv: x.outcome for x in found.collect()} == {"ok": "ok", "late": "timeout", "open": "open", "order": "order", "more": "order"}


def test_identity_and_json_rows(spark):
    (own,) = metrics.identity(spark, "P", ["/ip4/1.2.3.4/tcp/1"]).collect()
    assert own.dial == ["/ip4/1.2.3.4/tcp/1/p2p/P"]
    rows = spark.createDataFrame([("a", 3)], "peer_id string, services long")
    assert [tuple(x)[:1] + (x.services,) for x in peers.load(peers.as_json(rows, "peer_id")).collect()] == [("a", 3)]


def test_streamed_upserts_prune_gate_and_gossip(spark, tmp_path):
    acts = [(1, 100, 5, "seen", ["/x"], 1, "seed"), (2, 110, 5, "failure", [], 0, ""), (3, 120, 6, "failure", [], 0, ""), (4, 130, 6, "success", [], 2, ""), (5, 140, 6, "failure", [], 0, "")]
    schema = "seq long, at long, peer long, kind string, addrs array<string>, services long, source string"
    for k in range(2):  # two batches
        spark.createDataFrame(acts[3 * k : 3 * k + 3], schema).coalesce(1).write.parquet(f"{tmp_path}/acts/{k}")
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/acts")
    stream.run_upserts(source, f"{tmp_path}/state", f"{tmp_path}/rows")
    found = {x.peer_id: (x.addrs, x.services, x.last_seen_unix, x.failure_count) for x in peers.load(stream.current(spark, f"{tmp_path}/rows")).collect()}
    assert found == {"5": (["/x"], 1, 100, 1), "6": ([], 2, 130, 1)}
    assert stream.prune_tick(spark, f"{tmp_path}/rows", f"{tmp_path}/stay", 160, 50) == 1
    assert [x.peer for x in spark.read.parquet(f"{tmp_path}/stay").collect()] == ["6"]

    asked = source.select(F.col("peer").cast("string").alias("peer"), F.when(F.col("seq") == 1, handshake.PROTOCOL).otherwise("/other").alias("protocol"))
    passed = handshake.gated(asked, spark.createDataFrame([("6",)], "peer string"))
    passed.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/gate").option("path", f"{tmp_path}/passed").trigger(availableNow=True).start().awaitTermination()
    assert sorted((x.peer, x.protocol) for x in spark.read.parquet(f"{tmp_path}/passed").collect()) == [("5", handshake.PROTOCOL), *[("6", "/other")] * 3]

    stream.gossip_log(source.select("seq", F.col("at").alias("ts"), F.col("peer").cast("string").alias("peer")), f"{tmp_path}/gs", f"{tmp_path}/log", "6")
    assert [(x.seq, x.peer) for x in spark.read.parquet(f"{tmp_path}/log").collect()] == [(1, "5")]
