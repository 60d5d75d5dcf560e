"""Streams run over the events at hand, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.streaming import jobs


def stream_job_states(spark: SparkSession, folder: str) -> DataFrame:
    """Last states of jobs, by a stream."""
    out = jobs.run_available(jobs.job_states(jobs.events(spark, folder)), "complete")
    return out.select("user_id", "status", F.unix_micros("at").alias("at"), "steps")


def stream_rate_window(spark: SparkSession, folder: str) -> DataFrame:
    """Events per second, by a stream; the last second stays open."""
    return jobs.run_available(jobs.rate_window(jobs.events(spark, folder)))


def stream_first_in_ten_minutes(spark: SparkSession, folder: str) -> DataFrame:
    """Events without repeats, by a stream with state."""
    return jobs.run_available(jobs.first_in_ten_minutes(jobs.events(spark, folder)))


def stream_in_flight_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Which events may start a job, by a stream with state."""
    return jobs.run_available(jobs.in_flight_gate(jobs.events(spark, folder)))


QUERIES = {f.__name__: f for f in (stream_job_states, stream_rate_window, stream_first_in_ten_minutes, stream_in_flight_gate)}
GATE_SQL = """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS came FROM events),
s AS (
  SELECT user_id, arg_min(event_id, (came, event_id)) AS event_id, min(came) AS came FROM e GROUP BY user_id
  UNION ALL
  SELECT s.user_id, arg_min(e.event_id, (e.came, e.event_id)), min(e.came) FROM s JOIN e ON e.user_id = s.user_id AND e.came >= s.came + 90000000 GROUP BY s.user_id)
SELECT event_id, user_id, event_id IN (SELECT event_id FROM s) AS started FROM e"""
ORACLES = {
    "stream_job_states": "SELECT user_id, arg_max(event_type, (epoch_us(ts), event_id)) AS status, max(epoch_us(ts)) AS \"at\", count(*) AS steps FROM events GROUP BY 1",
    # a second is done when the watermark, a second behind the last event, has passed its end
    "stream_rate_window": "SELECT second, count(*) AS events FROM (SELECT CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS second FROM events) WHERE (second + 1) * 1000 <= (SELECT epoch_ms(max(ts)) FROM events) - 1000 GROUP BY 1",
    "stream_first_in_ten_minutes": "SELECT event_id, user_id, event_type FROM (SELECT *, lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR epoch_us(ts) - before > 600000000",
    "stream_in_flight_gate": GATE_SQL,
}
