"""Event-time forms of the job and rate operators. Each takes a stream of events and agrees with its batch form.

Watermarks are the spans that the operators look back: a second, ten minutes, an hour, 90 seconds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerloom.operators.sequential import gate
from ledgerloom.session import remove, shared_dir, stored

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """The events of a folder as a stream; times are made instants, as watermarks need them.

    All files at hand are one batch, so their order does not matter; with ``files_per_trigger`` they must be in order of time, up
    to the watermark of the operator.
    """
    reader = spark.readStream.schema(EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def rate_window(stream: DataFrame) -> DataFrame:
    """Events per second."""
    counts = stream.withWatermark("ts", "1 second").groupBy(F.window("ts", "1 second")).agg(F.count(F.lit(1)).alias("events"))
    return counts.select(F.unix_timestamp("window.start").alias("second"), "events")


def hourly_counts(stream: DataFrame) -> DataFrame:
    """Events per user in hours that begin every ten minutes."""
    counts = stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour", "10 minutes"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return counts.select("user_id", F.unix_timestamp("window.start").alias("second"), "events")


def first_in_ten_minutes(stream: DataFrame, span_s: float = 600.0) -> DataFrame:
    """Events without those within ten minutes of the event before of their user and type, whether that one was kept or not.

    The time of the last event is the state of a user and type, and expires after the span.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        at = rows["ts"].astype("datetime64[us]").astype("int64")
        before = at.shift(1, fill_value=state.get[0] if state.exists else -(1 << 62))
        last = max(int(at.iloc[-1]), state.get[0] if state.exists else int(at.iloc[-1]))
        state.update((last,))
        # only what the watermark has passed times out; an old event that comes later still finds the state
        state.setTimeoutTimestamp(max(int(last / 1000 + span_s * 1000), state.getCurrentWatermarkMs()) + 1)
        kept = rows[(at - before > span_s * 1e6).to_numpy()]
        yield pd.DataFrame({"event_id": kept["event_id"], "user_id": key[0], "event_type": key[1]})

    keyed = stream.withWatermark("ts", f"{int(span_s)} seconds").groupBy("user_id", "event_type")
    return keyed.applyInPandasWithState(run, "event_id long, user_id long, event_type string", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def job_states(stream: DataFrame) -> DataFrame:
    """The last state of each user's job; in update mode."""
    return stream.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("at"), F.count(F.lit(1)).alias("steps"))


def in_flight_gate(stream: DataFrame, stale_s: float = 90.0) -> DataFrame:
    """Which events may start a job of their user; the time of the running job is the state, and expires when stale."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        times = [t.timestamp() for t in rows["ts"]]
        before = [state.get[0]] if state.exists else []
        started = gate(before + times, [None] * (len(before) + len(times)), stale_s)[len(before) :]
        last = max([t for t, s in zip(times, started) if s], default=before[0] if before else None)
        state.update((last,))
        state.setTimeoutTimestamp(int(max(times) * 1000 + stale_s * 1000) + 1)
        yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "started": started})

    keyed = stream.withWatermark("ts", f"{int(stale_s)} seconds").groupBy("user_id")
    return keyed.applyInPandasWithState(run, "event_id long, user_id long, started boolean", "since double", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(result: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into a table in the shared folder, and read that table.

    The sink and the checkpoint lie in the shared folder, so a lost executor repeats no row. In
    update and complete mode the last version of the result is kept.
    """
    spark = result.sparkSession
    base = stored(spark, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")
    if mode == "append":
        query = result.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    else:
        save = lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")
        query = result.writeStream.foreachBatch(save).outputMode("complete").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    remove(spark, f"{base}/state")  # all input is read, so nothing will resume
    return spark.read.schema(result.schema).parquet(f"{base}/out")
