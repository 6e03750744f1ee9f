"""Queries of the streaming operators: the events table is read as a stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import folds
from ..streaming.runs import available
from .base import query, table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


@query("""SELECT user_id, event_id, seen, stall, help_level FROM (WITH o AS (SELECT *, row_number() OVER w AS seen, sum((event_type <> 'error')::INT) OVER w AS grp FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, count_if(event_type = 'error') OVER (PARTITION BY user_id, grp ORDER BY ts, event_id)::BIGINT AS stall FROM o)
SELECT user_id, event_id, seen, stall, least(3, sum((stall >= 2)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS help_level FROM s)""")
def x01_stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return available(folds.running_state(events(spark, sf_dir)))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def x04_trace_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return available(folds.windowed_counts(events(spark, sf_dir)), "complete").withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def x07_session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return available(folds.sessions(events(spark, sf_dir)), "complete")


@query("SELECT a.event_id AS action_id, d.event_id AS result_id FROM events a JOIN events d ON a.event_type = 'view' AND d.event_type = 'click' AND d.user_id % 10 = a.user_id % 10 AND d.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR")
def x02_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as pending actions, clicks of the same tenth of users within the hour as deliveries."""
    e = events(spark, sf_dir)
    actions = e.where("event_type = 'view'").select((F.col("user_id") % 10).alias("action_id"), F.col("event_id").alias("action"), "ts")
    deliveries = events(spark, sf_dir).where("event_type = 'click'").select((F.col("user_id") % 10).alias("delivered_id"), F.col("event_id").alias("result"), F.col("ts").alias("delivered_ts"))
    out = available(folds.commits(actions, deliveries).select("action", "result"))
    return out.select(F.col("action").alias("action_id"), F.col("result").alias("result_id"))


@query("""WITH o AS (SELECT user_id, event_id, event_type, ts, lead(event_type) OVER w AS next, lead(ts) OVER w AS until FROM events WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
v AS (SELECT *, (SELECT min(b.ts) FROM events b WHERE b.user_id = o.user_id AND b.ts >= o.ts + INTERVAL 1 DAY) AS later, (SELECT max(ts) FROM events) AS top FROM o WHERE event_type = 'view')
SELECT user_id, event_id, CASE WHEN until IS NOT NULL AND date_trunc('milliseconds', until) < date_trunc('milliseconds', ts) + INTERVAL 1 DAY THEN CASE next WHEN 'click' THEN 'applied' ELSE 'superseded' END ELSE 'expired' END AS status FROM v WHERE (until IS NOT NULL AND date_trunc('milliseconds', until) < date_trunc('milliseconds', ts) + INTERVAL 1 DAY) OR later IS NOT NULL OR ts + INTERVAL 1 DAY < top - INTERVAL 1 HOUR""")
def x03_expiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending turns that live a day."""
    return available(folds.expiring(events(spark, sf_dir)))


@query("SELECT user_id, count(*) AS n, arg_max(event_type, (ts, event_id)) AS last_type, max(event_id) AS last_event, count_if(event_type = 'error')::BIGINT AS errors FROM events GROUP BY 1")
def x05_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return available(folds.snapshots(events(spark, sf_dir)), "complete")


@query("""WITH o AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS before, lag(event_id) OVER w AS opened FROM events WHERE event_type IN ('view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, CASE WHEN before = 'view' THEN opened END AS review_id, CASE WHEN before = 'view' THEN 'confirmed' ELSE 'rejected' END AS status FROM o WHERE event_type = 'purchase'""")
def x06_confirmed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return available(folds.confirmed_once(events(spark, sf_dir)))


@query("SELECT user_id * 100 + event_id % 7 AS submission_id FROM events GROUP BY 1")
def z10_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of each submission id, whichever arrives first."""
    e = events(spark, sf_dir).withColumn("submission_id", F.col("user_id") * 100 + F.col("event_id") % 7)
    return available(folds.first_of_key(e, "submission_id", "400 days").select("submission_id"))
