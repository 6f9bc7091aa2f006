"""Event logs, graphs and relational reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import graph, sessions
from docloom.plans.dialects import both, said
from docloom.plans.registry import query
from docloom.session import table

both("src_events", "SELECT event_id, user_id, event_type, CAST(JSONGET(props, '$.k') AS BIGINT) AS k FROM events")
both("tool_counts", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type")
both("tool_errors", "SELECT event_id, user_id FROM events WHERE event_type = 'error' OR CAST(JSONGET(props, '$.exit') AS BIGINT) <> 0")
both("sequence", """SELECT event_id, user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS place, coalesce(MICROS(ts) - MICROS(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 0) AS since FROM events""")
both("ack_once", "SELECT user_id, event_type, event_id FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
both("pending_tasks", "SELECT user_id FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type IN ('click', 'purchase')) WHERE r = 1 AND event_type = 'click'")
both("embed_misses", "SELECT DISTINCT sha2(text, 256) AS sha FROM sections WHERE text IS NOT NULL AND sha2(text, 256) NOT IN (SELECT sha2(text, 256) FROM sections WHERE removed_at IS NOT NULL AND text IS NOT NULL)",
     "SELECT DISTINCT sha256(text) AS sha FROM sections WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM sections WHERE removed_at IS NOT NULL AND text IS NOT NULL)")
both("daily_log", "SELECT DAY(ts, YMD) AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2")
both("tumbling", """SELECT window.start AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY window(ts, '1 hour'), event_type""",
     """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
both("sessions", """SELECT user_id, CAST(count(DISTINCT s) AS BIGINT) AS sessions FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, event_id,
    CASE WHEN MICROS(ts) - MICROS(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id""")
both("source_weights", "SELECT source, round(sqrt(CAST(n AS DOUBLE)) / sum(sqrt(CAST(n AS DOUBLE))) OVER (), 6) AS p FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
both("context_cut", """SELECT id, CAST(CASE WHEN used >= 8000 THEN 0 WHEN used + n > 8000 THEN 8000 - used ELSE n END AS BIGINT) AS kept FROM (SELECT id, n, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY ordinal, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
    FROM (SELECT DISTINCT id, doc_id, ordinal, CHARS(text) AS n FROM sections WHERE text IS NOT NULL))""")

#: A session and its transcript, tools of every category, a call that never ends and one that ends twice.
_LOG = [
    ("s1", 0.0, "session_start", None, None, None, None, None, None, None, None, None, None, None), ("s1", 1.0, "prompt", None, None, None, None, None, None, None, None, None, None, None),
    ("s1", 1.5, "memory_inject", None, None, None, None, None, None, None, "injected", None, None, None), ("s1", 2.0, "tool_start", "tu1", "mcp__memory__search", None, None, None, None, None, None, None, None, None),
    ("s1", 2.25, "tool_end", "tu1", "mcp__memory__search", None, 250, False, None, None, None, None, None, None), ("s1", 3.0, "tool_start", "tu2", "Bash", "grep -rn name .", None, None, None, None, None, None, None, None),
    ("s1", 3.5, "tool_end", "tu2", "Bash", "grep -rn name .", 500, True, None, None, None, None, None, None), ("s1", 4.0, "tool_start", "tu3", "mcp__memory__remember", None, None, None, None, None, None, None, None, None),
    ("s1", 5.0, "trace", None, None, None, None, None, "reasoning", None, None, None, {"input_tokens": 100, "output_tokens": 20}, None), ("s1", 5.1, "trace", None, None, None, None, None, "tool_result", True, None, None, None, None),
    ("s1", 5.2, "trace", None, None, None, None, None, "tool_call", None, None, None, {"input_tokens": 50, "output_tokens": 5}, None), ("s1", 6.04, "session_end", None, None, None, None, None, None, None, None, None, None, None),
    ("s2", 10.0, "prompt", None, None, None, None, None, None, None, None, None, None, None), ("s2", 10.5, "memory_inject", None, None, None, None, None, None, None, "skipped", "short", None, None),
    ("s2", 11.0, "tool_start", "a", "Read", None, None, None, None, None, None, None, None, None), ("s2", 11.2, "tool_end", "a", "Read", None, 200, None, None, None, None, None, None, None), ("s2", 11.9, "tool_end", "a", "Read", None, 900, None, None, None, None, None, None, None),
    ("s2", 12.0, "tool_start", "b", "Read", None, None, None, None, None, None, None, None, None), ("s2", 12.4, "tool_end", "b", "Read", None, 400, None, None, None, None, None, None, None), ("s2", 13.0, "pre_compact", None, None, None, None, None, None, None, None, None, None, None),
    ("s2", 14.0, "hook", None, None, None, None, None, None, None, None, None, None, False), ("s2", 15.0, "monitor_error", None, None, None, None, None, None, None, None, None, None, None), ("s2", 16.0, "subagent_stop", None, None, None, None, None, None, None, None, None, None, None),
    ("s2", 17.0, "tool_start", None, "Edit", None, None, None, None, None, None, None, None, None),
]
_LOG_KIND = "session string, t double, event string, call string, tool string, command string, duration_ms bigint, error boolean, step string, is_error boolean, decision string, reason string, usage map<string,bigint>, ok boolean"
_CALLS = [
    ("Grep", None, "grep", None), ("Bash", "grep -rn name .", "grep", None), ("Bash", "cd x && rg foo", "grep", None), ("Bash", "ls -la", "shell", None), ("Bash", "memory search 'who is it' --fast", "memory_search", "cli:memory search"),
    ("Bash", "~/.local/bin/memory refresh", "memory_update", "cli:memory refresh"), ("mcp__memory__search", None, "memory_search", "mcp:search"), ("mcp__memory__remember", None, "memory_update", "mcp:remember"), ("mcp__memory__refresh", None, "memory_update", "mcp:refresh"),
    ("Read", None, "read", None), ("Edit", None, "edit", None), ("mcp__draw__x", None, "mcp", None), ("Bash", "memory unknown; find .", "grep", None), ("WebSearch", None, "web", None), ("Agent", None, "agent", None), ("Unheard", None, "other", None), ("Bash", None, "shell", None),
]


@query("classify", said("tool, command, category, memory", _CALLS))
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category of tool calls, one of each kind."""
    calls = spark.createDataFrame([c[:2] for c in _CALLS], "tool string, command string")
    return calls.withColumn("of", sessions.classified(F.col("tool"), F.coalesce("command", F.lit("")), ["memory"])).select("tool", "command", "of.*")


_TASKS = [("limiter middleware", "completed"), ("tests for 429", "in_progress"), ("document the setting", "pending")]
_TALK = [
    ("a", 1, "user", "text", "Add rate limiting\n to the API", None, None, None), ("a", 2, "assistant", "tool_use", None, "Edit", "backend/api.py", None), ("a", 2, "assistant", "tool_use", None, "TodoWrite", None, _TASKS),
    ("a", 2, "assistant", "text", "Done with it.\nPer org or per user?\nOr both? \nNo.\nHow many?\nSince when?", None, None, None), ("a", 3, "user", "tool_result", None, None, None, None), ("a", 3, "user", "text", "ok then", None, None, None), ("a", 4, "user", "text", "<command>x</command>", None, None, None),
    ("a", 5, "assistant", "tool_use", None, "Write", "docs/a.md", None), ("a", 6, "assistant", "tool_use", None, "Edit", "backend/api.py", None), ("a", 7, "assistant", "text", "Fine.", None, None, None), ("b", 1, "user", "text", "First", None, None, None), ("b", 2, "user", "text", "Second", None, None, None),
    ("b", 3, "assistant", "tool_use", None, "TodoWrite", None, []), ("c", 1, "user", "text", "Caveat: none", None, None, None),
]


@query("handoff_extract", said("session, item, place, said", [
    ("a", "goal", 1, "Add rate limiting to the API"), ("a", "state", 1, "1 done, 1 in progress, 1 pending"), ("a", "open", 2, "[in_progress] tests for 429"), ("a", "open", 3, "[pending] document the setting"), ("a", "next", 3, "document the setting"),
    ("a", "file", 1, "backend/api.py"), ("a", "file", 2, "docs/a.md"), ("a", "question", 1, "Since when?"), ("a", "question", 2, "How many?"), ("a", "question", 3, "Or both?"), ("b", "goal", 1, "First"), ("b", "latest", 1, "Second"),
]))
def handoff_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "session string, no int, role string, kind string, text string, tool string, file string, tasks array<struct<content: string, status: string>>"
    return sessions.handoff(spark.createDataFrame(_TALK, kind))


@query("session_report", said("session, measure, name, value", [
    *[("s1", m, "", float(v)) for m, v in {"events": 12, "duration_s": 6.0, "prompts": 1, "tool_calls": 3, "grep_calls": 1, "memory_calls": 2, "memory_searches": 1, "memory_updates": 1, "memory_injected": 1, "tool_errors": 2, "unfinished_tool_calls": 1,
        "reasoning_steps": 1, "compactions": 0, "subagents": 0, "hook_errors": 0, "monitor_errors": 0}.items()],
    *[("s2", m, "", float(v)) for m, v in {"events": 12, "duration_s": 7.0, "prompts": 1, "tool_calls": 3, "grep_calls": 0, "memory_calls": 0, "memory_searches": 0, "memory_updates": 0, "memory_injected": 0, "tool_errors": 0, "unfinished_tool_calls": 0,
        "reasoning_steps": 0, "compactions": 1, "subagents": 1, "hook_errors": 1, "monitor_errors": 1}.items()],
    ("s1", "by_category", "grep", 1.0), ("s1", "by_category", "memory_search", 1.0), ("s1", "by_category", "memory_update", 1.0), ("s2", "by_category", "read", 2.0), ("s2", "by_category", "edit", 1.0), ("s1", "memory_commands", "mcp:search", 1.0),
    ("s1", "memory_commands", "mcp:remember", 1.0), ("s2", "memory_inject_skipped", "short", 1.0), ("s1", "duration_ms_median", "memory_search", 250.0), ("s1", "duration_ms_median", "grep", 500.0), ("s2", "duration_ms_median", "read", 400.0),
    ("s1", "duration_ms_max", "memory_search", 250.0), ("s1", "duration_ms_max", "grep", 500.0), ("s2", "duration_ms_max", "read", 900.0), ("s1", "tokens", "input_tokens", 150.0), ("s1", "tokens", "output_tokens", 25.0),
]))
def session_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.summary(spark.createDataFrame(_LOG, _LOG_KIND), ["memory"])


@query("call_durations", said("session, call, tool, duration_ms", [("s1", "tu1", "mcp__memory__search", 250), ("s1", "tu2", "Bash", 500), ("s1", "tu3", "mcp__memory__remember", None), ("s2", "a", "Read", 200), ("s2", "b", "Read", 400), ("s2", None, "Edit", None)]))
def call_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.durations(spark.createDataFrame(_LOG, _LOG_KIND))


def _as_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a log: users as sessions, views as prompts, clicks and purchases as starts and ends of a call
    that their number names."""
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for x in ("view", "prompt", "click", "tool_start", "purchase", "tool_end", "error", "monitor_error", "signup", "session_start")])
    call = F.pmod("event_id", F.lit(7)).cast("string")
    return e.select(F.col("user_id").alias("session"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), kind[F.col("event_type")].alias("event"), call.alias("call"), F.lit("Read").alias("tool"), F.round("value").cast("bigint").alias("duration_ms"))


_AS_LOG = """WITH l AS (SELECT user_id AS session, epoch_us(ts) AS t, CASE event_type WHEN 'view' THEN 'prompt' WHEN 'click' THEN 'tool_start' WHEN 'purchase' THEN 'tool_end' WHEN 'error' THEN 'monitor_error' ELSE 'session_start' END AS event,
    CAST(event_id % 7 AS VARCHAR) AS call, CAST(round(value) AS BIGINT) AS ms FROM events)"""


@query("session_summary", _AS_LOG + """, w AS (SELECT session, count(*)::DOUBLE AS events, round((max(t) - min(t)) / 1e6, 1) AS duration_s, count(*) FILTER (WHERE event = 'prompt')::DOUBLE AS prompts, count(*) FILTER (WHERE event = 'tool_start')::DOUBLE AS tool_calls,
        greatest(0, count(*) FILTER (WHERE event = 'tool_start') - count(*) FILTER (WHERE event = 'tool_end'))::DOUBLE AS unfinished_tool_calls, count(*) FILTER (WHERE event = 'monitor_error')::DOUBLE AS monitor_errors,
        0::DOUBLE AS grep_calls, 0::DOUBLE AS memory_calls, 0::DOUBLE AS memory_searches, 0::DOUBLE AS memory_updates, 0::DOUBLE AS memory_injected, 0::DOUBLE AS tool_errors, 0::DOUBLE AS reasoning_steps, 0::DOUBLE AS compactions, 0::DOUBLE AS subagents, 0::DOUBLE AS hook_errors
        FROM l GROUP BY session)
    SELECT session, measure, '' AS name, value FROM (UNPIVOT w ON COLUMNS(* EXCLUDE (session)) INTO NAME measure VALUE value)
    UNION ALL SELECT session, 'by_category', 'read', count(*) FROM l WHERE event = 'tool_start' GROUP BY session
    UNION ALL SELECT session, 'duration_ms_median', 'read', list_sort(list(ms))[len(list(ms)) // 2 + 1] FROM l WHERE event = 'tool_end' AND ms IS NOT NULL GROUP BY session
    UNION ALL SELECT session, 'duration_ms_max', 'read', max(ms) FROM l WHERE event = 'tool_end' AND ms IS NOT NULL GROUP BY session""")
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.summary(_as_log(spark, sf_dir), ["memory"])


@query("tool_durations", _AS_LOG + """ SELECT s.session, s.call, s.t AS begun, CASE WHEN e.t >= s.t THEN CAST(round((e.t / 1e6::DOUBLE - s.t / 1e6::DOUBLE) * 1000) AS BIGINT) END AS duration_ms FROM l s
    LEFT JOIN (SELECT session, call, min(t) AS t FROM l WHERE event = 'tool_end' GROUP BY ALL) e ON e.session = s.session AND e.call = s.call WHERE s.event = 'tool_start'""".replace("s.t AS begun, ", ""))
def tool_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.durations(_as_log(spark, sf_dir)).select("session", "call", "duration_ms")


@query("nth_pairing", _AS_LOG + """, n AS (SELECT session, event, t, row_number() OVER (PARTITION BY session, event ORDER BY t) AS n FROM l)
    SELECT a.session, a.n, a.t AS first_t, b.t AS then_t FROM n a LEFT JOIN n b ON b.session = a.session AND b.n = a.n AND b.event = 'tool_start' WHERE a.event = 'prompt'""")
def nth_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th prompt of each session with its n-th call."""
    pairs = sessions.paired(_as_log(spark, sf_dir), "prompt", "tool_start")
    micros = lambda c: F.round(F.col(c) * 1e6).cast("bigint").alias(c)
    return pairs.select("session", "n", micros("first_t"), micros("then_t"))


_EDGES = "e AS (SELECT DISTINCT lower(trim(section_id)) AS a, lower(trim(node_id)) AS b FROM links WHERE section_id IS NOT NULL AND node_id IS NOT NULL), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), src AS (SELECT min(a) AS s FROM e)"
_HOPS = "WITH " + _EDGES + """, h1 AS (SELECT b AS v FROM u, src WHERE a = s), h2 AS (SELECT DISTINCT b AS v FROM u JOIN h1 ON a = v), h3 AS (SELECT DISTINCT b AS v FROM u JOIN h2 ON a = v),
    d AS (SELECT s AS v, 0 AS hops FROM src UNION ALL SELECT v, 1 FROM h1 UNION ALL SELECT v, 2 FROM h2 UNION ALL SELECT v, 3 FROM h3)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "links").select(F.lower(F.trim("section_id")).alias("a"), F.lower(F.trim("node_id")).alias("b"))
    return e.filter("a is not null and b is not null").distinct()


@query("bfs3", _HOPS + " SELECT v AS vertex, CAST(min(hops) AS INTEGER) AS hops FROM d GROUP BY v")
def bfs3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything within three hops of the first section."""
    e = _edges(spark, sf_dir)
    return graph.hops(e, e.agg(F.min("a").alias("vertex")), 3)


@query("hop_distance", "WITH RECURSIVE " + _EDGES + """, walk AS (SELECT s AS v, 0 AS hops FROM src UNION SELECT u.b, walk.hops + 1 FROM walk JOIN u ON u.a = walk.v WHERE walk.hops < 6) SELECT v AS vertex, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY v""")
def hop_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hop distances from the first section, up to six."""
    e = _edges(spark, sf_dir)
    return graph.hops(e, e.agg(F.min("a").alias("vertex")), 6)


@query("graph_expand", "WITH " + _EDGES + """, hit AS (SELECT a AS v, CAST(row_number() OVER (ORDER BY a) AS BIGINT) AS rank FROM (SELECT DISTINCT a FROM e ORDER BY a LIMIT 8)), n AS (SELECT hit.v, hit.rank, e.b AS w, row_number() OVER (PARTITION BY hit.v ORDER BY e.b) AS r FROM hit JOIN e ON e.a = hit.v),
    s AS (SELECT v AS vertex, 1.0::DOUBLE / rank AS score FROM hit UNION ALL SELECT w, 0.5::DOUBLE / rank FROM n WHERE r <= 6) SELECT vertex, round(max(score), 6) AS score FROM s GROUP BY vertex""")
def graph_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight sections and up to six linked symbols of each at half the score; the best score wins."""
    e = _edges(spark, sf_dir)
    hits = e.select("a").distinct().orderBy("a").limit(8).select("a", F.expr("1.0D / row_number() over (order by a)").alias("score"))
    return graph.expand(hits.withColumnRenamed("a", "vertex"), e, 6, 0.5).withColumn("score", F.round("score", 6))
