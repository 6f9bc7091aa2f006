"""Streaming queries run to their end over the events table."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.plans.registry import query
from docloom.session import shared_dir
from docloom.streaming import events as E


def _run(spark: SparkSession, sf_dir: str, make, mode: str) -> DataFrame:
    at = os.path.join(shared_dir(spark), f"stream-{uuid.uuid4().hex}")
    return E.drained(make(E.read_events(spark, f"{sf_dir}/event[s].parquet")), mode, f"{at}/checkpoint", f"{at}/out")


@query("stm_windows", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def stm_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed counts as a stream gives them in complete mode."""
    out = _run(spark, sf_dir, lambda e: e.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "complete")
    last = out.agg(F.max("batch")).first()[0]
    return out.filter(F.col("batch") == last).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("stm_tool_state", """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END AS d, event_type FROM events),
    b AS (SELECT user_id, n, d, sum(d) OVER w AS level FROM e WINDOW w AS (PARTITION BY user_id ORDER BY n)), m AS (SELECT user_id, n, d, level, least(0, min(level) OVER (PARTITION BY user_id ORDER BY n)) AS low FROM b),
    l AS (SELECT user_id, count(*) FILTER (WHERE d = 1) AS starts, max_by(level - low, n) AS open FROM m GROUP BY user_id) SELECT user_id, CAST(open AS BIGINT) AS open, CAST(starts - open AS BIGINT) AS done FROM l""")
def stm_tool_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and ended calls of each user at the end of the stream; an end without an open start counts for nothing."""
    out = _run(spark, sf_dir, lambda e: E.running_tools(e, "click", "purchase", "60 days", "60 days"), "update")
    return out.filter("not ended").groupBy("user_id").agg(F.max_by(F.struct("open", "done"), "batch").alias("s")).select("user_id", "s.open", "s.done")


@query("stm_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, s""")
def stm_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of 30 minutes as the stream gives them in complete mode."""
    out = _run(spark, sf_dir, lambda e: E.sessions(e, "30 minutes", "60 days"), "complete")
    last = out.agg(F.max("batch")).first()[0]
    return out.filter(F.col("batch") == last).select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "events")


@query("stm_durations", """SELECT s.event_id, count(e.event_id) AS ends, min(epoch_us(e.ts) - epoch_us(s.ts)) AS micros FROM events s JOIN events e ON e.user_id = s.user_id AND e.event_type = 'purchase' AND e.ts >= s.ts AND e.ts < s.ts + INTERVAL 1 DAY
    WHERE s.event_type = 'click' GROUP BY s.event_id""")
def stm_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the purchases of the same user within a day, by a join of two streams."""
    out = _run(spark, sf_dir, lambda e: E.durations(e, "click", "purchase"), "append").filter("ended is not null")
    took = F.unix_micros("ended") - F.unix_micros("began")
    return out.groupBy("event_id").agg(F.count("*").alias("ends"), F.min(took).alias("micros"))


@query("stm_once", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stm_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event of each user and type, as the stream lets them through."""
    return _run(spark, sf_dir, lambda e: E.once(e, ["user_id", "event_type"], "60 days"), "append").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
