"""Queries of streams: each is run over all of the events and its table returned."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.plans.registry import query, table
from textloom.streaming import queries as S


def _events(spark, sf):
    return S.follow(spark, f"{sf}/events.parquet")


@query("stream_tumbling", "SELECT date_trunc('hour', ts) AS began, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    return S.drain(S.tumbling(_events(spark, sf)), "complete")


@query("stream_sliding", """SELECT date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS began, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events, range(2) t(k) GROUP BY ALL""")
def stream_sliding(spark, sf):
    return S.drain(S.tumbling(_events(spark, sf), "2 hours", "1 hour"), "complete")


@query("stream_sessions", """WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
    SELECT user_id, min(ts) AS began, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf):
    return S.drain(S.sessions(_events(spark, sf)), "complete")


@query("stream_unique", "SELECT event_id, user_id FROM events")
def stream_unique(spark, sf):
    e = _events(spark, sf)
    return S.drain(S.unique(e.union(e), ["event_id"]).select("event_id", "user_id"))


@query("stream_alerts")
def stream_alerts(spark, sf):
    return S.drain(S.alerts(_events(spark, sf), "value", lambda v: v > 90, 3600.0))


@query("metric_trailing", "SELECT event_id, count(*) OVER w AS n, min(value) OVER w AS least, max(value) OVER w AS most, round(avg(value) OVER w, 6) AS mean FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW)")
def metric_trailing(spark, sf):
    return S.trailing(table(spark, sf, "events"))


@query("metric_summary", "SELECT event_type, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY event_type")
def metric_summary(spark, sf):
    e = table(spark, sf, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.join(F.broadcast(last), F.expr("ts > last - INTERVAL 24 HOURS")).groupBy("event_type").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))  # one row is broadcast


@query("metric_trend", """WITH h AS (SELECT event_type, value, ntile(2) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS half FROM events)
    SELECT event_type, round(avg(value) FILTER (WHERE half = 2) - avg(value) FILTER (WHERE half = 1), 6) AS trend, round(stddev_samp(value), 6) AS volatility FROM h GROUP BY event_type""")
def metric_trend(spark, sf):
    from textloom.operators.warehouse import ranked

    e = table(spark, sf, "events")
    n = e.groupBy("event_type").agg(F.count("*").alias("_n"))  # a row a kind
    h = ranked(e.select("event_type", "ts", "event_id", "value"), ["event_type"], ["ts", "event_id"]).join(n, "event_type").withColumn("half", F.when(2 * F.col("_place") < F.col("_n"), 1).otherwise(2))
    mean = lambda k: F.avg(F.when(F.col("half") == k, F.col("value")))
    return h.groupBy("event_type").agg(F.round(mean(2) - mean(1), 6).alias("trend"), F.round(F.stddev_samp("value"), 6).alias("volatility"))


@query("alert_conditions", "SELECT event_type, avg(value) > 50 AS gt, avg(value) <= 50 AS lte, false AS other FROM events GROUP BY event_type")
def alert_conditions(spark, sf):
    m = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("v"))
    return m.select("event_type", S.condition(F.col("v"), "gt", 50).alias("gt"), S.condition(F.col("v"), "lte", 50).alias("lte"), S.condition(F.col("v"), "near", 50).alias("other"))


@query("log_lines", "SELECT event_id, '10.0.0.' || (user_id % 250)::VARCHAR AS ip, 'GET /' || event_type AS request, (200 + event_id % 5)::INT AS status, event_id AS size FROM events")
def log_lines(spark, sf):
    """Access-log lines made of the events, and parsed again."""
    line = F.format_string('10.0.0.%d - - [%s] "GET /%s" %d %d', F.col("user_id") % 250, F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss Z"), "event_type", 200 + F.col("event_id") % 5, "event_id")
    parsed = table(spark, sf, "events").select("event_id", S.parse_log(line).alias("p"))
    return parsed.select("event_id", "p.ip", "p.request", "p.status", "p.size")
