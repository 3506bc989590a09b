"""The shared tables as the engine's own: actions of peers, a log, blocks and manifests.

events: user_id is the peer; purchase is a dial success, error a dial failure,
view, click and signup are sightings; event_id is the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(column: str) -> Column:
    """Whole seconds since 1970 of a timestamp column without a zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, at, peer, kind, addrs, services, source."""
    return actions_of(table(spark, sf_dir, "events"))


def actions_of(events: DataFrame) -> DataFrame:
    e = events.where(F.col("user_id").isNotNull())
    kind = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "failure").otherwise("seen")
    seen = kind == "seen"
    addr = F.concat(F.lit("/ip4/10."), (F.col("user_id") % 250).cast("string"), F.lit("."), (F.col("event_id") % 5).cast("string"), F.lit(".1/tcp/4001"))
    source = F.when(F.col("event_type") == "signup", "seed").when(F.col("event_type") == "click", "gossip").otherwise("")
    services = F.when(F.col("event_type") == "signup", F.col("event_id") % 4).otherwise(0)
    return e.select(F.col("event_id").alias("seq"), epoch("ts").alias("at"), F.col("user_id").alias("peer"), kind.alias("kind"), F.when(seen, F.array(addr)).otherwise(F.array().cast("array<string>")).alias("addrs"), services.cast("long").alias("services"), source.alias("source"))


def clock(acts: DataFrame) -> DataFrame:
    """now: the time of the latest action, in one row."""
    return acts.agg(F.max("at").alias("now"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first action of each peer, in the order of arrival: seq, ts, peer."""
    acts = table(spark, sf_dir, "events").where(F.col("user_id").isNotNull())
    first = acts.groupBy("user_id").agg(F.min(F.struct("event_id", "ts")).alias("f"))
    return first.select(F.col("f.event_id").alias("seq"), epoch("f.ts").alias("ts"), F.col("user_id").cast("string").alias("peer"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """data of every document, in order of doc_id."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return d.select(F.col("doc_id").alias("pos"), F.col("text").cast("binary").alias("data"))


#: The same in SQL.
ACTIONS_SQL = """a AS (SELECT event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS tm, user_id AS peer,
  CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' ELSE 'seen' END AS kind,
  CASE WHEN event_type NOT IN ('purchase', 'error') THEN '/ip4/10.' || (user_id % 250) || '.' || (event_id % 5) || '.1/tcp/4001' END AS addr,
  CAST(CASE WHEN event_type = 'signup' THEN event_id % 4 ELSE 0 END AS BIGINT) AS services,
  CASE event_type WHEN 'signup' THEN 'seed' WHEN 'click' THEN 'gossip' ELSE '' END AS source
  FROM events WHERE user_id IS NOT NULL), clock AS (SELECT max(tm) AS now FROM a)"""
LOG_SQL = """log AS (SELECT min(event_id) AS seq, CAST(floor(epoch(arg_min(ts, event_id))) AS BIGINT) AS ts, CAST(user_id AS VARCHAR) AS peer
  FROM events WHERE user_id IS NOT NULL GROUP BY user_id)"""
