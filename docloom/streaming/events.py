"""Streaming twins of the event operators. Every stateful one has a watermark, so its state is bounded."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events of a folder of Parquet files as a stream, with their time as event time."""
    return spark.readStream.schema(SCHEMA).parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts and sums per window and type; later events than `late` are dropped."""
    return events.withWatermark("at", late).groupBy(F.window("at", length, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return events.withWatermark("at", late).groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("events"))


def once(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def durations(events: DataFrame, start: str, end: str, within: str = "1 day") -> DataFrame:
    """Starts with the ends of the same user within the given time; starts without one come out with nulls once the
    watermark passes."""
    s = events.filter(F.col("event_type") == start).select("event_id", F.col("user_id").alias("u"), F.col("at").alias("began")).withWatermark("began", within)
    e = events.filter(F.col("event_type") == end).select("user_id", F.col("at").alias("ended")).withWatermark("ended", within)
    return s.join(e, F.expr(f"u = user_id and ended >= began and ended < began + interval {within}"), "left_outer")


def running_tools(events: DataFrame, start: str, end: str, late: str = "1 day", idle: str = "7 days") -> DataFrame:
    """(user_id, open, done, ended): starts and ends of each user so far, in keyed state. A user without an event for `idle`
    of event time, counted from the watermark, comes out once more with ended true and is forgotten."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_, done, newest = state.get if state.exists else (0, 0, 0)
        row = lambda ended: pd.DataFrame({"user_id": [key[0]], "open": [open_], "done": [done], "ended": [ended]})
        if state.hasTimedOut:
            state.remove()
            yield row(True)
            return
        # The events of one trigger in order of time, however many batches they come in.
        pdf = pd.concat(list(batches)).sort_values(["at", "event_id"])
        for kind in pdf["event_type"]:
            if kind == start:
                open_ += 1
            elif kind == end and open_:
                open_, done = open_ - 1, done + 1
        newest = max(newest, int(pdf["at"].max().timestamp() * 1000))
        state.update((open_, done, newest))
        state.setTimeoutTimestamp(max(newest + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield row(False)

    marked = events.withWatermark("at", late).select("user_id", "at", "event_id", "event_type")
    return marked.groupBy("user_id").applyInPandasWithState(
        step, "user_id bigint, open bigint, done bigint, ended boolean", "open bigint, done bigint, newest bigint", "update", GroupStateTimeout.EventTimeTimeout
    )


def drained(stream: DataFrame, mode: str, checkpoint: str, to: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote (for update mode, the last row of each batch's
    keys). Exactly once: the checkpoint holds offsets, each batch is a folder of its own and is overwritten if retried."""

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{to}/batch={batch:06d}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return stream.sparkSession.read.option("recursiveFileLookup", "true").parquet(to)
