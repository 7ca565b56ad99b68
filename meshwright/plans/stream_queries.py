"""Windows over the event table, as a batch; the same plans run on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..streaming.refresh import event_windows, session_lengths
from .registry import query, table


@query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = event_windows(table(spark, sf_dir, "events"))
    return got.select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""
WITH gaps AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
runs AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM gaps)
SELECT user_id, CAST(count(DISTINCT s) AS BIGINT) AS sessions, CAST(count(*) AS BIGINT) AS n FROM runs GROUP BY user_id""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_lengths(table(spark, sf_dir, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))
