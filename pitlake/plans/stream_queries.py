"""Queries of the streaming steps; each drains the events as a stream and returns what the sink holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitlake.plans.registry import Tables, query
from pitlake.sources.sinks import scratch
from pitlake.streaming import events as st


def stream(t: Tables):
    return st.read_events(t.spark, t.sf_dir)


def batch(t: Tables):
    return t.table("events").withColumn("ts", F.col("ts").cast("timestamp"))


query("st_tumbling_bars", "", "SELECT event_type, CAST(ts AS DATE) AS d, round(arg_min(value, (ts, event_id)), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(arg_max(value, (ts, event_id)), 6) AS close, count(*) AS n FROM events GROUP BY 1, 2")(
    lambda t: st.kept_bars(stream(t).withWatermark("ts", "1 hour"), scratch(t.spark, "bars")).select("event_type", "d", *[F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")], "n")
)
query(
    "st_episode_sessions", "",
    "SELECT user_id, CAST(min(ts) AS VARCHAR)[:19] AS started, count(*) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS nw FROM events)) GROUP BY user_id, s HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
)(lambda t: st.run_once(st.sessions(stream(t).withWatermark("ts", "1 hour"), "12 hours"), "sessions").select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "n"))
query("st_dedup_late", "", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")(
    lambda t: st.run_once(st.dedup_late(stream(t), ["user_id", "event_type"], "3650 days").select("user_id", "event_type"), "dedup").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
)
query("st_quarantine", "", "SELECT coalesce(CASE WHEN value IS NULL THEN 'no_value' WHEN value < 0 THEN 'negative' WHEN props IS NULL OR props = '' THEN 'no_props' END, 'valid') AS rule, count(*) AS n FROM events GROUP BY 1")(
    lambda t: (lambda v, r: st.run_once(v.select(F.lit("valid").alias("rule")), "valid").union(st.run_once(r.select("rule"), "rejected")).groupBy("rule").agg(F.count("*").alias("n")))(*st.quarantine(stream(t)))
)
query("st_append_on_change", "", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")(lambda t: st.append_on_change(stream(t), scratch(t.spark, "changes")))
query(
    "st_stale_feed", "",
    "SELECT CAST(user_id AS VARCHAR) AS feed, strftime(since, '%Y-%m-%d %H:%M:%S') AS since, ended IS NULL AS open FROM (SELECT user_id, ts AS since, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS ended FROM events) WHERE coalesce(ended, (SELECT max(ts) FROM events)) > since + INTERVAL 36 HOUR",
)(lambda t: st.stale_feeds(stream(t), scratch(t.spark, "stale"), "user_id", "36 hours").select("feed", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"), F.col("ended").isNull().alias("open")))
query("st_asof_enrich", "", "SELECT e.event_id, e.event_type, round(l.level, 6) AS level FROM events e ASOF LEFT JOIN (SELECT event_type, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 36 HOUR AS known, avg(value) AS level FROM events GROUP BY event_type, CAST(ts AS DATE)) l ON l.event_type = e.event_type AND e.ts >= l.known")(
    lambda t: st.enrich_asof(stream(t), batch(t).groupBy("event_type", F.to_date("ts").alias("d")).agg(F.avg("value").alias("level")).select("event_type", (F.col("d").cast("timestamp") + F.expr("interval 36 hours")).alias("known"), "level"), scratch(t.spark, "enrich")).withColumn("level", F.round("level", 6))
)
query("st_incremental_ingest", "", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, round(arg_max(value, (ts, event_id)), 6) AS value FROM events GROUP BY 1, 2")(
    lambda t: st.incremental_ingest(stream(t), scratch(t.spark, "ingest")).withColumn("value", F.round("value", 6))
)
