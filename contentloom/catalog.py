"""The registered queries of the content and peer operators, and their SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codec, signature
from .functions import expressions as X
from .operators import blocks, eventlog, handshake, metrics, peers
from .plans import chain
from .sources import text, workload
from .sources.workload import ACTIONS_SQL, LOG_SQL, table
from .streaming import peers as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LIMIT = 20
CAP = 40
SELF = 7

#: The fold of actions in SQL.
PEERS_SQL = f"""{ACTIONS_SQL},
won AS (SELECT peer, max(seq) AS seq FROM a WHERE kind = 'success' GROUP BY peer),
peers AS (SELECT a.peer,
  coalesce(max(tm) FILTER (kind IN ('seen', 'success')), 0) AS last_seen_unix,
  coalesce(max(tm) FILTER (kind IN ('failure', 'success')), 0) AS last_tried_unix,
  coalesce(max(tm) FILTER (kind = 'success'), 0) AS last_succ_unix,
  count(*) FILTER (kind = 'failure' AND a.seq > coalesce(won.seq, -1)) AS failure_count,
  coalesce(arg_max(services, a.seq) FILTER (services <> 0), 0) AS services,
  coalesce(arg_max(source, a.seq) FILTER (source <> ''), '') AS source
  FROM a LEFT JOIN won ON a.peer = won.peer GROUP BY a.peer)"""


def score_sql(want: int = 0) -> str:
    wanted = f"CASE WHEN services & {want} <> 0 THEN 100 ELSE 0 END + " if want else ""
    return f"""CAST({wanted}CASE WHEN last_succ_unix > 0 THEN greatest(0, 50 - CAST(trunc((now - last_succ_unix) / 60) AS BIGINT)) ELSE 0 END
  + CASE WHEN last_seen_unix > 0 THEN greatest(0, 20 - CAST(trunc((now - last_seen_unix) / 600) AS BIGINT)) ELSE 0 END - 5 * failure_count AS DOUBLE)"""


COLUMNS_SQL = "peer, services, last_seen_unix, last_tried_unix, last_succ_unix, failure_count, source"
ORDER_SQL = "ORDER BY score DESC, last_succ_unix DESC, last_seen_unix DESC, failure_count, peer"
COLUMNS = ["peer", "services", "last_seen_unix", "last_tried_unix", "last_succ_unix", "failure_count", "source"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- peers


@query(f"WITH {PEERS_SQL} SELECT {COLUMNS_SQL}, {score_sql()} AS score FROM peers, clock WHERE failure_count < 8 {ORDER_SQL} LIMIT {LIMIT}")
def dial_candidates(spark, sf_dir):
    acts = workload.actions(spark, sf_dir)
    return peers.candidates(peers.fold(acts), workload.clock(acts), LIMIT).select(*COLUMNS, "score")


@query(f"WITH {PEERS_SQL} SELECT {COLUMNS_SQL}, {score_sql(2)} AS score FROM peers, clock WHERE failure_count < 8 {ORDER_SQL} LIMIT {LIMIT}")
def dial_candidates_wanted(spark, sf_dir):
    acts = workload.actions(spark, sf_dir)
    return peers.candidates(peers.fold(acts), workload.clock(acts), LIMIT, want=2).select(*COLUMNS, "score")


@query(f"WITH {PEERS_SQL} SELECT {COLUMNS_SQL}, {score_sql()} AS score FROM peers, clock WHERE failure_count < 8 AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = peer) {ORDER_SQL} LIMIT {LIMIT}")
def dial_candidates_excluding(spark, sf_dir):
    acts = workload.actions(spark, sf_dir)
    exclude = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("peer"))
    return peers.candidates(peers.fold(acts), workload.clock(acts), LIMIT, exclude=exclude).select(*COLUMNS, "score")


@query(f"WITH {PEERS_SQL}, u AS (SELECT peer, array_to_string(list_sort(list(DISTINCT addr) FILTER (addr IS NOT NULL)), ',') AS addrs FROM a GROUP BY peer) SELECT {COLUMNS_SQL}, coalesce(addrs, '') AS addrs FROM peers JOIN u USING (peer)")
def peer_table(spark, sf_dir):
    return peers.fold(workload.actions(spark, sf_dir)).select(*COLUMNS, F.array_join("addrs", ",").alias("addrs"))


@query(f"WITH {PEERS_SQL} SELECT peer, {score_sql()} AS score, {score_sql(1)} AS score_wanted FROM peers, clock")
def peer_score(spark, sf_dir):
    acts = workload.actions(spark, sf_dir)
    rows = peers.fold(acts).join(F.broadcast(workload.clock(acts)))
    return rows.select("peer", X.peer_score(F.col("now")).alias("score"), X.peer_score(F.col("now"), 1).alias("score_wanted"))


@query(f"WITH {PEERS_SQL} SELECT peer, failure_count FROM peers")
def consecutive_failures(spark, sf_dir):
    return peers.failures(workload.actions(spark, sf_dir))


STALE_SQL = "(failure_count >= 8 OR (last_seen_unix <> 0 AND last_seen_unix < now - 86400))"


@query(f"WITH {PEERS_SQL} SELECT {COLUMNS_SQL} FROM peers, clock WHERE NOT {STALE_SQL}")
def prune_peers(spark, sf_dir):
    acts = workload.actions(spark, sf_dir)
    return peers.pruned(peers.fold(acts), workload.clock(acts))[0].select(*COLUMNS)


@query(f"WITH {PEERS_SQL} SELECT count(*) AS removed FROM peers, clock WHERE {STALE_SQL}")
def prune_count(spark, sf_dir):
    acts = workload.actions(spark, sf_dir)
    return peers.pruned(peers.fold(acts), workload.clock(acts))[1].agg(F.count("*").alias("removed"))


@query(f"WITH {ACTIONS_SQL}, f AS (SELECT peer, min(seq) AS first FROM a GROUP BY peer ORDER BY first, peer LIMIT {CAP}) SELECT a.peer, count(*) AS actions, max(tm) AS last FROM a JOIN f ON a.peer = f.peer GROUP BY a.peer")
def peer_soft_cap(spark, sf_dir):
    return peers.soft_cap(workload.actions(spark, sf_dir), CAP).groupBy("peer").agg(F.count("*").alias("actions"), F.max("at").alias("last"))


@query(f"WITH {PEERS_SQL}, best AS (SELECT *, {score_sql()} AS score FROM peers, clock WHERE failure_count < 8 {ORDER_SQL} LIMIT 16) SELECT DISTINCT addr || '/p2p/' || a.peer AS entry FROM a JOIN best ON a.peer = best.peer WHERE addr IS NOT NULL")
def peer_sample(spark, sf_dir):
    acts = workload.actions(spark, sf_dir)
    return peers.sample(peers.fold(acts), workload.clock(acts))


@query(f"WITH {ACTIONS_SQL} SELECT peer, coalesce(array_to_string(list_sort(list(DISTINCT addr) FILTER (addr IS NOT NULL)), ','), '') AS addrs, count(DISTINCT addr) AS n FROM a GROUP BY peer")
def addr_union(spark, sf_dir):
    folded = peers.fold(workload.actions(spark, sf_dir))
    return folded.select("peer", F.array_join("addrs", ",").alias("addrs"), F.size("addrs").cast("long").alias("n"))


@query(f"WITH {PEERS_SQL} SELECT peer, least(1 + failure_count, 300) AS wait_s FROM peers")
def dial_backoff(spark, sf_dir):
    return peers.failures(workload.actions(spark, sf_dir)).select("peer", X.backoff(F.col("failure_count")).alias("wait_s"))


@query(
    f"""WITH {PEERS_SQL}, need AS (SELECT greatest(0, 8 - count(*) FILTER (turn % 5 = 0 AND conv_id < 2)) AS needed FROM conversations),
best AS (SELECT *, {score_sql()} AS score FROM peers, clock WHERE failure_count < 8), ranked AS (SELECT *, row_number() OVER ({ORDER_SQL}) AS place FROM best)
SELECT peer, score, place FROM ranked, need WHERE place <= 2 * needed"""
)
def outbound_deficit(spark, sf_dir):
    acts = workload.actions(spark, sf_dir)
    out = F.when((F.col("turn") % 5 == 0) & (F.col("conv_id") < 2), "outbound").otherwise("inbound")
    connections = table(spark, sf_dir, "conversations").select(out.alias("direction"))
    return peers.deficit(peers.fold(acts), workload.clock(acts), connections, 8).select("peer", "score", F.col("place").cast("long").alias("place"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def per_key_limit(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return peers.first_per_key(orders, "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("SELECT h AS host, page_id FROM (SELECT page_id, h, row_number() OVER (PARTITION BY h ORDER BY page_id) AS r FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS h FROM pages WHERE url IS NOT NULL)) WHERE r <= 3")
def per_host_limit(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"))
    return peers.first_per_key(pages, "host", ["page_id"], 3).select("host", "page_id")


@query(
    """SELECT CASE WHEN event_id % 3 = 0 THEN 'peer/' || user_id ELSE 'p' || user_id END AS peer_id, event_id AS last_seen_unix, event_id % 7 AS failure_count
FROM events WHERE user_id IS NOT NULL AND event_id % 5 <> 0"""
)
def peer_load(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    good = F.to_json(F.struct(F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("p"), F.col("user_id"))).alias("peer_id"), F.col("event_id").alias("last_seen_unix"), (F.col("event_id") % 7).alias("failure_count")))
    stored = e.select(F.concat(F.lit("peer_"), F.col("user_id")).alias("key"), F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(good).alias("value"))
    return peers.load(stored).select("peer_id", "last_seen_unix", "failure_count")


@query("SELECT page_id, replace(url, '/', '_') AS key, replace(replace(url, '/', '_'), '_', '/') AS back, coalesce(try_cast(regexp_extract(substr(url, strpos(url, '://') + 3), '/([0-9]+)', 1) AS BIGINT), 0) AS height FROM pages WHERE url IS NOT NULL")
def key_escape(spark, sf_dir):
    key = X.escape_key(F.col("url"))
    number = F.regexp_extract(F.regexp_replace("url", r"^.*?://", ""), r"/([0-9]+.*)", 1)
    return table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", key.alias("key"), X.unescape_key(key).alias("back"), X.parse_height(number).alias("height"))


# --- blocks

BLOCKS_SQL = "b AS (SELECT sha256(text) AS cid, octet_length(encode(any_value(text))) AS size, min(doc_id) AS pos, any_value(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY sha256(text))"


@query(f"WITH {BLOCKS_SQL} SELECT cid, size FROM b")
def block_store(spark, sf_dir):
    return blocks.put(workload.blocks(spark, sf_dir)).select("cid", "size")


@query(f"WITH {BLOCKS_SQL}, asked AS (SELECT labels.doc_id, CASE WHEN labels.doc_id % 4 = 0 THEN 'none' ELSE sha256(text) END AS cid FROM labels JOIN documents ON labels.doc_id = documents.doc_id WHERE text IS NOT NULL) SELECT doc_id, asked.cid, size IS NOT NULL AS found, size, base64(encode(text)) AS data_b64 FROM asked LEFT JOIN b ON asked.cid = b.cid")
def block_lookup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    asked = table(spark, sf_dir, "labels").select("doc_id").join(docs, "doc_id").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "none").otherwise(F.col("h")).alias("cid"))
    found = blocks.lookup(asked, blocks.put(workload.blocks(spark, sf_dir)))
    return found.withColumn("data_b64", F.regexp_replace("data_b64", r"[\r\n]", ""))


@query("SELECT sha256(text) AS cid FROM documents WHERE text IS NOT NULL UNION SELECT sha256(text) FROM benchmark WHERE text IS NOT NULL")
def manifest_index(spark, sf_dir):
    return blocks.index(*[table(spark, sf_dir, t).select(F.sha2(F.col("text").cast("binary"), 256).alias("cid")) for t in ("documents", "benchmark")])


@query(f"WITH {BLOCKS_SQL} SELECT cid, size IS NULL OR cid IN (SELECT sha256(text) FROM benchmark) AS old FROM (SELECT cid, size FROM b UNION ALL SELECT DISTINCT sha256(text), NULL FROM benchmark WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT cid FROM b))")
def put_indexed(spark, sf_dir):
    """The documents put into a store that has the benchmark's blocks: the manifest, and which of it the store had."""
    there = blocks.put(table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select(F.col("text").cast("binary").alias("data")))
    new, manifest = blocks.put_indexed(workload.blocks(spark, sf_dir), there, blocks.index(there))
    return manifest.join(new.select("cid", F.lit(False).alias("new")), "cid", "left").select("cid", F.col("new").isNull().alias("old"))


@query("WITH asked AS (SELECT coalesce(sha256(text), 'none') AS cid FROM labels LEFT JOIN documents ON labels.doc_id = documents.doc_id) SELECT DISTINCT cid FROM (SELECT sha256(text) AS cid FROM benchmark WHERE text IS NOT NULL UNION ALL SELECT cid FROM asked WHERE cid <> 'none')")
def get_indexed(spark, sf_dir):
    """The benchmark's manifest after lookups of the labelled documents: those found are in it as well."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    asked = table(spark, sf_dir, "labels").select("doc_id").join(docs, "doc_id", "left").select(F.coalesce("h", F.lit("none")).alias("cid"))
    there = blocks.index(table(spark, sf_dir, "benchmark").select(F.sha2(F.col("text").cast("binary"), 256).alias("cid")))
    return blocks.lookup_indexed(asked, blocks.put(workload.blocks(spark, sf_dir)), there)[1]


@query("SELECT trim(line) AS cid, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#') GROUP BY 1")
def manifest_parse(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return text.cleaned(lines).groupBy(F.col("value").alias("cid")).agg(F.count("*").alias("n"))


@query(f"WITH {BLOCKS_SQL} SELECT cid FROM b WHERE cid > '8' ORDER BY cid LIMIT 100")
def snapshot_page(spark, sf_dir):
    return blocks.page(blocks.index(blocks.put(workload.blocks(spark, sf_dir))), "8", 100)


@query(f"WITH {BLOCKS_SQL} SELECT count(*) AS count, max(cid) AS next FROM (SELECT cid FROM b ORDER BY cid LIMIT 1000)")
def snapshot_count(spark, sf_dir):
    return blocks.page(blocks.index(blocks.put(workload.blocks(spark, sf_dir)))).agg(F.count("*").alias("count"), F.max("cid").alias("next"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = o_orderkey)")
def missing_blocks(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cid"))
    return blocks.missing(asked, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cid"))).select(F.col("cid").alias("o_orderkey"))


@query("SELECT count(n_chars) AS ok, count(*) - count(n_chars) AS failed, coalesce(sum(n_chars), 0)::BIGINT AS bytes FROM orders LEFT JOIN documents ON doc_id = o_orderkey")
def restore_manifest(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("cid"))
    store = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cid"), F.col("n_chars").alias("size"))
    return blocks.restore(asked, store)


@query("WITH m AS (SELECT o_orderkey, n_chars, coalesce(sum(coalesce(n_chars, 0)) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM orders LEFT JOIN documents ON doc_id = o_orderkey) SELECT count(n_chars) AS ok, count(*) - count(n_chars) AS failed, coalesce(sum(n_chars), 0)::BIGINT AS bytes FROM m WHERE spent < 500000")
def restore_budget(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("cid"))
    store = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cid"), F.col("n_chars").alias("size"))
    return blocks.restore(asked, store, 500_000)


@query("WITH m AS (SELECT n_chars, ceil(row_number() OVER (ORDER BY o_orderkey) * 10.0 / count(*) OVER ())::INTEGER AS step FROM orders LEFT JOIN documents ON doc_id = o_orderkey), e AS (SELECT step, count(n_chars) AS ok, count(*) - count(n_chars) AS failed, coalesce(sum(n_chars), 0) AS bytes FROM m GROUP BY step) SELECT step, sum(ok) OVER (ORDER BY step)::BIGINT AS ok, sum(failed) OVER (ORDER BY step)::BIGINT AS failed, sum(bytes) OVER (ORDER BY step)::BIGINT AS bytes FROM e")
def restore_progress(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("cid"))
    store = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cid"), F.col("n_chars").alias("size"))
    return blocks.restore_progress(asked, store)


@query("WITH p AS (SELECT s_nationkey AS cid, arg_max(s_name, s_suppkey) AS provider FROM supplier GROUP BY 1) SELECT doc_id, coalesce(provider, 'self') AS provider FROM documents LEFT JOIN (SELECT * FROM p WHERE cid <> 3) p ON doc_id % 30 = cid")
def provider_lookup(spark, sf_dir):
    bound = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_nationkey").cast("long").alias("cid"), F.col("s_name").alias("provider"))
    known = blocks.cleared(blocks.latest_providers(bound), spark.createDataFrame([(3,)], "cid long"))
    asked = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 30).alias("cid"))
    return blocks.provide(asked, known, "self").select("doc_id", "provider")


# --- event log

CHAIN_SQL = f"{LOG_SQL}, c AS (SELECT row_number() OVER (ORDER BY seq) AS height, sha256('peer_added|' || ts || '|' || peer) AS cid, ts, peer, lag(sha256('peer_added|' || ts || '|' || peer)) OVER (ORDER BY seq) AS prev FROM log)"


@query(f"WITH {CHAIN_SQL} SELECT height, cid, prev, ts, peer FROM c")
def event_chain(spark, sf_dir):
    return eventlog.chained(workload.log(spark, sf_dir)).drop("type")


@query(f"WITH {CHAIN_SQL} SELECT cid, height FROM c")
def event_heights(spark, sf_dir):
    """Heights found again from the links alone."""
    log = eventlog.chained(workload.log(spark, sf_dir)).select("cid", "prev")
    return chain.heights(log).select("cid", "height")


@query(f"WITH {CHAIN_SQL} SELECT arg_max(cid, height) AS cid, coalesce(max(height), 0) AS height FROM c")
def log_head(spark, sf_dir):
    return eventlog.head(eventlog.chained(workload.log(spark, sf_dir)))


@query(f"WITH {CHAIN_SQL} SELECT height, cid, ts, peer FROM c ORDER BY height DESC LIMIT 50")
def recent_events(spark, sf_dir):
    return eventlog.recent(eventlog.chained(workload.log(spark, sf_dir)), 50).select("height", "cid", "ts", "peer")


@query(f"WITH RECURSIVE {CHAIN_SQL}, w AS (SELECT cid, prev, 0 AS steps FROM c WHERE height = (SELECT max(height) FROM c) UNION ALL SELECT c.cid, c.prev, steps + 1 FROM w JOIN c ON c.cid = w.prev WHERE steps < 20) SELECT max(steps)::BIGINT AS applied FROM w")
def log_walk(spark, sf_dir):
    return eventlog.walk(eventlog.chained(workload.log(spark, sf_dir)), 20)


@query(f"WITH {CHAIN_SQL}, l AS (SELECT greatest(max(height) - 30, 0) AS ours FROM c) SELECT count(*) FILTER (height > ours) AS applied, arg_max(cid, height) AS cid, max(height) AS height, NULL::VARCHAR AS error FROM c, l")
def sync_suffix(spark, sf_dir):
    remote = eventlog.chained(workload.log(spark, sf_dir)).withColumn("size", F.length("peer") + 40)
    top = remote.agg(F.max("height").alias("top"))
    local = remote.join(F.broadcast(top)).where(F.col("height") <= F.col("top") - 30).drop("top")
    return eventlog.sync_suffix(local, remote, 2**40, 64, 1 << 20)


@query(f"WITH {ACTIONS_SQL} SELECT peer, min(seq) AS seq FROM a GROUP BY peer")
def gset_first_seen(spark, sf_dir):
    return eventlog.first_seen(workload.actions(spark, sf_dir))


@query(f"WITH {ACTIONS_SQL} SELECT peer, min(seq) AS seq FROM a WHERE peer NOT IN (SELECT peer FROM a WHERE seq < 100) GROUP BY peer")
def gset_append(spark, sf_dir):
    acts = workload.actions(spark, sf_dir)
    return eventlog.append_new(acts.where("seq < 100"), acts)


@query()
def event_cid(spark, sf_dir):
    log = eventlog.chained(workload.log(spark, sf_dir))
    return log.select("height", codec.event_cid_column(codec.event_block_column(F.col("ts"), F.col("peer"), F.col("prev"))).alias("cid"))


@query(f"WITH {CHAIN_SQL} SELECT height, 'peer_added' AS type, ts, peer, prev FROM c")
def event_decode(spark, sf_dir):
    """Events read back from their encoded blocks."""
    log = eventlog.chained(workload.log(spark, sf_dir))
    block = codec.event_block_column(F.col("ts"), F.col("peer"), F.col("prev"))
    return log.select("height", codec.decode_event_column(block).alias("e")).select("height", "e.*")


@query()
def block_cids(spark, sf_dir):
    """Content identifiers of all blocks, with the hash read back from them."""
    cid = codec.block_cid_column(F.col("data"))
    stored = blocks.put(workload.blocks(spark, sf_dir)).select(F.col("cid").alias("sha256"), cid.alias("cid"))
    return stored.withColumn("multihash", codec.multihash_column(F.col("cid")))


# --- handshake

AGENT_SQL = "CASE event_id % 6 WHEN 0 THEN 'node/0.' || (user_id % 3) || '.' || (event_id % 12) WHEN 1 THEN 'other/9.9.9' WHEN 2 THEN 'node/' WHEN 3 THEN '0.1.0' WHEN 4 THEN 'node/0.1.x' ELSE 'node/0.' || (user_id % 3) END"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    kind = F.col("event_id") % 6
    minor = F.concat(F.lit("node/0."), (F.col("user_id") % 3).cast("string"))
    agent = F.when(kind == 0, F.concat(minor, F.lit("."), (F.col("event_id") % 12).cast("string"))).when(kind == 1, "other/9.9.9").when(kind == 2, "node/").when(kind == 3, "0.1.0").when(kind == 4, "node/0.1.x").otherwise(minor)
    scheme, proof = F.when(F.col("event_id") % 10 == 0, "none").otherwise("ed25519"), F.when(F.col("event_id") % 7 == 0, "").otherwise("sig")
    return e.select("event_id", (F.col("event_id") % 8).cast("long").alias("services"), agent.alias("agent"), scheme.alias("auth_scheme"), proof.alias("auth_proof"))


VERSION_OK_SQL = """(CASE event_id % 6 WHEN 0 THEN user_id % 3 >= 1 WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN true ELSE user_id % 3 >= 1 END)"""


@query(f"SELECT event_id, {AGENT_SQL} AS agent FROM events WHERE user_id IS NOT NULL AND {VERSION_OK_SQL}")
def agent_version_filter(spark, sf_dir):
    return messages(spark, sf_dir).where(X.version_ok(F.col("agent"))).select("event_id", "agent")


@query(f"SELECT event_id, CASE WHEN (event_id % 8) & ~3::BIGINT <> 0 THEN 'services' WHEN NOT {VERSION_OK_SQL} THEN 'agent' WHEN event_id % 10 = 0 THEN 'auth scheme' WHEN event_id % 7 = 0 THEN 'auth proof' END AS refused FROM events WHERE user_id IS NOT NULL")
def handshake_validate(spark, sf_dir):
    return messages(spark, sf_dir).select("event_id", handshake.reason(3, "ed25519").alias("refused"))


@query("SELECT conv_id AS conv, count(*) AS messages, count(*) >= 2 AND count(*) = count(DISTINCT turn) AND max(turn) - min(turn) + 1 = count(*) AND count(DISTINCT (turn % 2) || coalesce(role, '?')) = 2 AND count(DISTINCT role) = 2 AS complete FROM conversations WHERE role IS NOT NULL AND turn IS NOT NULL AND conv_id IS NOT NULL GROUP BY conv_id")
def handshake_exchanges(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role IS NOT NULL AND turn IS NOT NULL AND conv_id IS NOT NULL")
    return handshake.exchanges(rows.select(F.col("conv_id").alias("conv"), "turn", "role"))


@query("""WITH m AS (SELECT conv_id AS conv, role, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role DESC) AS n FROM conversations WHERE role IS NOT NULL AND turn IS NOT NULL AND conv_id IS NOT NULL),
k AS (SELECT conv, n, turn, CASE role WHEN 'user' THEN 'initiator' ELSE 'responder' END AS role, CASE WHEN turn < 2 THEN 'version' ELSE 'verack' END AS kind FROM m WHERE n <= 5),
s AS (SELECT conv, count(*) AS n, bool_and(CASE n WHEN 1 THEN role = 'initiator' AND kind = 'version' WHEN 2 THEN role = 'responder' AND kind = 'version' WHEN 3 THEN role = 'initiator' AND kind = 'verack' WHEN 4 THEN role = 'responder' AND kind = 'verack' ELSE false END) AS fits, max(turn) - min(turn) AS took FROM k GROUP BY conv)
SELECT conv, CASE WHEN NOT fits THEN 'order' WHEN took > 5 THEN 'timeout' WHEN n = 4 THEN 'ok' ELSE 'open' END AS outcome FROM s""")
def handshake_completed(spark, sf_dir):
    """Conversations taken for handshakes: the user's side begins, its first two turns are versions, a turn takes a second."""
    c = table(spark, sf_dir, "conversations").where("role IS NOT NULL AND turn IS NOT NULL AND conv_id IS NOT NULL")
    side = F.when(F.col("role") == "user", "initiator").otherwise("responder")
    kind = F.when(F.col("turn") < 2, "version").otherwise("verack")
    return handshake.completed(c.select(F.col("conv_id").alias("conv"), "turn", side.alias("role"), kind.alias("kind"), F.col("turn").alias("at")))


@query("SELECT event_id, user_id AS peer FROM events e WHERE user_id IS NOT NULL AND (event_type = 'view' OR EXISTS (SELECT 1 FROM events v WHERE v.event_type = 'signup' AND v.user_id = e.user_id))")
def gate_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL").select("event_id", F.col("user_id").alias("peer"), "event_type")
    streams = e.withColumn("protocol", F.when(F.col("event_type") == "view", handshake.PROTOCOL).otherwise("/block/1.0.0"))
    return handshake.gated(streams, e.where("event_type = 'signup'")).select("event_id", "peer")


#: Key, message and signature of the second test of RFC 8032, 7.1.
TOKEN_KEY = bytes.fromhex("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c")
TOKEN_PEER = b"\x72"
TOKEN = "kqAJqfDUyrhyDoILX2QlQKKye1QWUD+Ps3YiI+vbadoIWsHkPhWZbkWPNhPQ8R2MOHsurrQwKu6wDSkWErsMAA=="


@query("SELECT event_id, event_id % 3 = 0 AS verified FROM events")
def token_verify(spark, sf_dir):
    """Tokens of peers against the key of an authority; each distinct token and peer is verified once."""
    good = F.col("event_id") % 3 == 0
    peer = F.when(F.col("event_id") % 3 == 1, F.lit(b"x")).otherwise(F.lit(TOKEN_PEER))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(good | (F.col("event_id") % 3 == 1), TOKEN).otherwise("bm90IGEgc2lnbmF0dXJl").alias("token"), peer.alias("peer"))
    pairs = rows.select(F.col("token").alias("t"), F.col("peer").alias("p")).distinct()
    pairs = pairs.withColumn("verified", signature.token_ok_column(F.col("t"), F.col("p"), [TOKEN_KEY]))
    return rows.join(pairs, (F.col("token") == F.col("t")) & (F.col("peer") == F.col("p"))).select("event_id", "verified")


HOST_SQL = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"


@query(f"SELECT DISTINCT h AS value FROM (SELECT {HOST_SQL} AS h FROM pages UNION ALL SELECT unnest(string_split(' ' || s_name || ' , ' || s_nationkey || ',', ',')) FROM supplier UNION ALL SELECT CASE WHEN n_nationkey % 2 = 0 THEN '# ' || n_name ELSE n_name END FROM nation) t(x), LATERAL (SELECT trim(x) AS h) WHERE h <> '' AND NOT starts_with(h, '#') AND h <> 'EGYPT'")
def seed_normalize(spark, sf_dir):
    flags = table(spark, sf_dir, "pages").where("url IS NOT NULL").select(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("value"))
    env = table(spark, sf_dir, "supplier").select(F.concat(F.lit(" "), "s_name", F.lit(" , "), "s_nationkey", F.lit(",")).alias("value"))
    lines = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("# "), "n_name")).otherwise(F.col("n_name")).alias("value"))
    return text.seeds(flags, env, lines, "EGYPT")


@query(f"WITH {ACTIONS_SQL}, l AS (SELECT c_custkey % 200 AS peer, '/ip4/10.9.' || (c_custkey % 3) || '.1/tcp/4001' AS addr FROM customer WHERE c_custkey % 200 <> {SELF}), every AS (SELECT peer, addr, tm FROM a UNION ALL SELECT peer, addr, now FROM l, clock) SELECT peer, coalesce(array_to_string(list_sort(list(DISTINCT addr) FILTER (addr IS NOT NULL)), ','), '') AS addrs, coalesce(max(tm) FILTER (addr IS NOT NULL), 0) AS sighted FROM every GROUP BY peer")
def gossip_merge(spark, sf_dir):
    acts = workload.actions(spark, sf_dir)
    addr = F.concat(F.lit("/ip4/10.9."), (F.col("c_custkey") % 3).cast("string"), F.lit(".1/tcp/4001"))
    learned = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 200).alias("peer"), addr.alias("addr"))
    merged = peers.gossip(acts, learned, SELF, workload.clock(acts))
    folded = peers.fold(merged.where("kind = 'seen'"))
    every = merged.select("peer").distinct().join(folded, "peer", "left")
    return every.select("peer", F.coalesce(F.array_join("addrs", ","), F.lit("")).alias("addrs"), F.coalesce("last_seen_unix", F.lit(0)).cast("long").alias("sighted"))


@query(f"SELECT DISTINCT user_id AS peer FROM events WHERE user_id % 10 = {SELF} AND user_id <> {SELF}")
def neighbors(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("a"), F.col("user_id").alias("b"))
    return handshake.neighbours(e, SELF)


@query("SELECT page_id, regexp_replace('/ip4/10.0.0.' || (page_id % 250) || '/tcp/4001' || CASE WHEN page_id % 3 = 0 THEN '/ip4/1.2.3.4' ELSE '' END, '/ip4/[^/]*', '/ip4/203.0.113.9') AS addr, page_id % 3 = 1 AS public FROM pages")
def addr_rewrite(spark, sf_dir):
    addr = F.concat(F.lit("/ip4/10.0.0."), (F.col("page_id") % 250).cast("string"), F.lit("/tcp/4001"), F.when(F.col("page_id") % 3 == 0, "/ip4/1.2.3.4").otherwise(""))
    kind = F.col("page_id") % 3
    ip = F.when(kind == 0, "192.168.1.1").when(kind == 1, F.concat(F.lit("8.8.4."), (F.col("page_id") % 250).cast("string"))).otherwise("10.1.2.300")
    return table(spark, sf_dir, "pages").select("page_id", X.rewrite_ip4(addr, "203.0.113.9").alias("addr"), X.is_public_ip4(ip).alias("public"))


@query(f"WITH {ACTIONS_SQL} SELECT a.seq, addr, CAST(peer AS VARCHAR) AS peer FROM a WHERE addr IS NOT NULL AND seq % 4 <> 0")
def peerlist_parse(spark, sf_dir):
    acts = workload.actions(spark, sf_dir).where("kind = 'seen'")
    entry = F.when(F.col("seq") % 4 == 0, F.col("addrs")[0]).otherwise(X.peer_address(F.col("addrs")[0], F.col("peer").cast("string")))
    rows = acts.select("seq", entry.alias("entry"))
    addr, peer = X.split_peer_address(F.col("entry"))
    return rows.select("seq", addr.alias("addr"), peer.alias("peer")).where("addr <> '' AND peer <> ''")


# --- metrics and status

METRICS_SQL = """m AS (SELECT count(*) FILTER (event_type IN ('purchase', 'error')) AS dials_attempted, count(*) FILTER (event_type = 'purchase') AS dials_succeeded,
  count(*) FILTER (event_type = 'error') AS dials_failed, 0::BIGINT AS peers_pruned, count(*) FILTER (event_type = 'click') AS gossip_learned,
  count(*) FILTER (event_type = 'signup') AS restores_started, 0::BIGINT AS restores_ok, 0::BIGINT AS restores_failed,
  coalesce(sum(greatest(CAST(floor(value) AS BIGINT) - 50, 0)) FILTER (event_type = 'signup'), 0)::BIGINT AS restore_bytes FROM events WHERE user_id IS NOT NULL)"""


def increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    one = F.lit(1).cast("long")
    kind = F.col("event_type")
    pair = lambda when, name, by=one: F.when(when, F.struct(F.lit(name).alias("name"), by.alias("by")))
    pairs = F.array(
        pair(kind.isin("purchase", "error"), "dials_attempted"),
        pair(kind == "purchase", "dials_succeeded"),
        pair(kind == "error", "dials_failed"),
        pair(kind == "click", "gossip_learned"),
        pair(kind == "signup", "restores_started"),
        pair(kind == "signup", "restore_bytes", F.floor("value").cast("long") - 50),
    )
    return e.select(F.explode(F.array_compact(pairs)).alias("x")).select("x.*")


@query(f"WITH {METRICS_SQL} SELECT * FROM m")
def node_metrics(spark, sf_dir):
    return metrics.counters(increments(spark, sf_dir))


@query(f"WITH {CHAIN_SQL}, {METRICS_SQL} SELECT arg_max(cid, height) AS head, max(height) AS height, count(DISTINCT peer) AS known_peers, any_value(m) .* FROM c, m".replace("any_value(m) .*", ", ".join(f"any_value(m.{x}) AS {x}" for x in ("dials_attempted", "dials_succeeded", "dials_failed", "peers_pruned", "gossip_learned", "restores_started", "restores_ok", "restores_failed", "restore_bytes"))))
def node_status(spark, sf_dir):
    log = eventlog.chained(workload.log(spark, sf_dir))
    return metrics.status(eventlog.head(log), metrics.counters(increments(spark, sf_dir)), log.select("peer").distinct())


# --- streams


def stream_folder(spark: SparkSession) -> str:
    chain.with_checkpoint_dir(spark)
    return os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"stream-{uuid.uuid4().hex}")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


@query(f"WITH {PEERS_SQL} SELECT {COLUMNS_SQL} FROM peers")
def peer_table_stream(spark, sf_dir):
    """peer_table, folded by a stateful stream over the events file."""
    out = stream_folder(spark)
    acts = workload.actions_of(event_stream(spark, sf_dir))
    stream.run_available(acts, f"{out}/state", f"{out}/rows")
    return stream.latest(spark.read.parquet(f"{out}/rows")).select(*COLUMNS)


@query(f"WITH {CHAIN_SQL} SELECT height, cid, prev, ts, peer FROM c")
def event_chain_stream(spark, sf_dir):
    """event_chain, appended by a stream over the events file."""
    out = stream_folder(spark)
    firsts = event_stream(spark, sf_dir).where("user_id IS NOT NULL").select(F.col("event_id").alias("seq"), workload.epoch("ts").alias("ts"), F.col("user_id").cast("string").alias("peer"))
    stream.append_log(firsts, f"{out}/state", f"{out}/rows")
    return eventlog.chained(spark.read.parquet(f"{out}/rows").select("seq", "ts", "peer")).drop("type")
