"""Event logs of agent sessions: what a tool call is, how long it took, and what a session came to.

Events are rows (session, t, event, ...) with t in seconds; columns that a log lacks count as null. Sums and counts are
combined before the shuffle, so a session of any length is a few numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import is_request

#: Shell commands that search, and the commands of a memory by what they do.
SEARCHES = r"(^|[\s|;&(`])(grep|egrep|fgrep|rg|ag|ack|git\s+grep|find|fd)\s"
MEMORY_SEARCH = "search docs docs-for status".split()
MEMORY_UPDATE = "refresh note setup update build rollback".split()
MEMORY_TOOLS = "refresh remember".split()
KINDS = {"Read": "read", "Edit": "edit", "Write": "edit", "MultiEdit": "edit", "NotebookEdit": "edit", "WebFetch": "web", "WebSearch": "web", "Task": "agent", "Agent": "agent", "Grep": "grep", "Glob": "grep"}

#: Columns of an event beside session, t and event.
FIELDS = {
    "call": "string", "tool": "string", "command": "string", "duration_ms": "bigint", "error": "boolean", "step": "string", "is_error": "boolean", "decision": "string", "reason": "string", "ok": "boolean",
    "usage": "map<string,bigint>",
}


def classified(tool: Column, command: Column, memories: list[str]) -> Column:
    """struct(category, memory): the category of a tool call, and for a memory's own tool or command line which it was.
    memories: the names under which a memory is a tool server (mcp__name__tool) or a command."""
    names = "|".join(memories)
    served = F.element_at(F.split(tool, "__"), -1)
    line = rf"(^|[\s|;&(`/])({names})\s+([a-z-]+)"
    program, sub = F.regexp_extract(command, line, 2), F.regexp_extract(command, line, 3)
    shell = (
        F.when(sub.isin(MEMORY_UPDATE), F.struct(F.lit("memory_update").alias("category"), F.concat(F.lit("cli:"), program, F.lit(" "), sub).alias("memory")))
        .when(sub.isin(MEMORY_SEARCH), F.struct(F.lit("memory_search").alias("category"), F.concat(F.lit("cli:"), program, F.lit(" "), sub).alias("memory")))
        .when(F.concat(F.lit(" "), command).rlike(SEARCHES), _plain("grep"))
        .otherwise(_plain("shell"))
    )
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    of_memory = tool.rlike(rf"^mcp__({names})__")
    return (
        F.when(of_memory, F.struct(F.when(served.isin(MEMORY_TOOLS), "memory_update").otherwise("memory_search").alias("category"), F.concat(F.lit("mcp:"), served).alias("memory")))
        .when(tool == "Bash", shell)
        .when(kinds[tool].isNotNull(), F.struct(kinds[tool].alias("category"), F.lit(None).cast("string").alias("memory")))
        .when(tool.rlike("^mcp__"), _plain("mcp"))
        .otherwise(_plain("other"))
    )


def _plain(category: str) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(None).cast("string").alias("memory"))


def filled(events: DataFrame, memories: list[str]) -> DataFrame:
    """events with every column of FIELDS and with category and memory of their tool."""
    rows = events.select("session", "t", "event", *[(F.col(c) if c in events.columns else F.lit(None)).cast(kind).alias(c) for c, kind in FIELDS.items()])
    of = classified(F.coalesce("tool", F.lit("")), F.coalesce("command", F.lit("")), memories)
    return rows.withColumn("of", of).select("*", "of.category", "of.memory").drop("of")


def durations(events: DataFrame) -> DataFrame:
    """(session, call, tool, duration_ms) of each tool_start: to the first tool_end of the same call, null without one.
    A call without an id, or whose id ended before it began, has none."""
    starts = events.filter("event = 'tool_start'").select("session", "call", "tool", F.col("t").alias("begun"))
    ends = events.filter("event = 'tool_end' and call is not null").groupBy("session", "call").agg(F.min("t").alias("ended"))
    took = F.round((F.col("ended") - F.col("begun")) * 1000).cast("bigint")
    return starts.join(ends, ["session", "call"], "left").select("session", "call", "tool", F.when(F.col("ended") >= F.col("begun"), took).alias("duration_ms"))


def summary(events: DataFrame, memories: list[str]) -> DataFrame:
    """(session, measure, name, value), the measures of each session; name tells apart those by category, command, reason
    or kind of token, else it is ''. Counts of nothing are listed as 0 where they have no name, and not at all where they
    have one. The median is the upper one."""
    e = filled(events, memories)
    is_ = lambda name: F.col("event") == name
    start, end, trace = is_("tool_start"), is_("tool_end"), is_("trace")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")).cast("double")
    injected = is_("memory_inject") & (F.col("decision") == "injected")
    measures = {
        "events": F.count("*").cast("double"),
        "duration_s": F.coalesce(F.round(F.max("t") - F.min("t"), 1), F.lit(0.0)),
        "prompts": n(is_("prompt")),
        "tool_calls": n(start),
        "grep_calls": n(start & (F.col("category") == "grep")),
        "memory_calls": n(start & F.col("category").isin("memory_search", "memory_update")),
        "memory_searches": n(start & (F.col("category") == "memory_search")),
        "memory_updates": n(start & (F.col("category") == "memory_update")),
        "memory_injected": n(injected),
        "tool_errors": n(end & F.col("error")) + n(trace & (F.col("step") == "tool_result") & F.col("is_error")),
        "unfinished_tool_calls": F.greatest(n(start) - n(end), F.lit(0.0)),
        "reasoning_steps": n(trace & (F.col("step") == "reasoning")),
        "compactions": n(is_("pre_compact")),
        "subagents": n(is_("subagent_stop")),
        "hook_errors": n(is_("hook") & ~F.coalesce("ok", F.lit(True))),
        "monitor_errors": n(is_("monitor_error")),
    }
    whole = e.groupBy("session").agg(*[c.alias(k) for k, c in measures.items()])
    out = whole.unpivot("session", list(measures), "measure", "value").select("session", "measure", F.lit("").alias("name"), "value")
    by = lambda rows, measure, name, value: rows.groupBy("session", F.coalesce(name, F.lit("")).alias("name")).agg(value.cast("double").alias("value")).select("session", F.lit(measure).alias("measure"), "name", "value")
    timed = e.filter(end & F.col("duration_ms").isNotNull())
    tokens = e.filter(trace).select("session", F.explode("usage").alias("kind", "n"))
    for rows, measure, name, value in (
        (e.filter(start), "by_category", F.col("category"), F.count("*")),
        (e.filter(start & F.col("memory").isNotNull()), "memory_commands", F.col("memory"), F.count("*")),
        (e.filter(is_("memory_inject") & ~F.coalesce(F.col("decision") == "injected", F.lit(False))), "memory_inject_skipped", F.col("reason"), F.count("*")),
        # Just above one half: the first value of which more than half are at or below it.
        (timed, "duration_ms_median", F.col("category"), F.expr("percentile_disc(0.500000000001) within group (order by duration_ms)")),
        (timed, "duration_ms_max", F.col("category"), F.max("duration_ms")),
        (tokens, "tokens", F.col("kind"), F.coalesce(F.sum("n"), F.lit(0))),
    ):
        out = out.union(by(rows, measure, name, value))
    return out


def paired(events: DataFrame, one: str, other: str) -> DataFrame:
    """(session, n, first_t, then_t): the n-th event `one` of each session with its n-th `other`, in order of time; null
    where there are fewer. Each kind is numbered by itself."""
    numbered = lambda name, t: events.filter(F.col("event") == name).select("session", F.col("t").alias(t), F.expr("cast(row_number() over (partition by session order by t) as bigint)").alias("n"))
    return numbered(one, "first_t").join(numbered(other, "then_t"), ["session", "n"], "left")


#: Tools that touch a file, and the one that keeps a list of tasks.
EDITS = "Edit Write MultiEdit NotebookEdit".split()
TASKS = "TodoWrite"


def handoff(blocks: DataFrame) -> DataFrame:
    """(session, item, place, said): what is handed on of each session: goal (the first request), latest (the last one if it
    is another), state (the last list of tasks in numbers), open (its tasks that aren't completed), next (those pending), file
    (the 15 touched last, in order of their last touch), question (the last three of the last reply that asks any).

    blocks: the blocks of a transcript in order, (session, no, role, kind, text, tool, file, tasks): role user or assistant,
    kind text, tool_use or tool_result, no numbers the messages; a message with a tool's result is no request; tasks is an
    array of structs (content, status). Every item is a grouped extreme or a short list by rank, so a long session is
    never gathered."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    results = blocks.filter("role = 'user' and kind = 'tool_result'").select("session", "no").distinct()
    asked = blocks.filter("role = 'user' and kind = 'text'").filter(is_request(F.col("text"))).join(results, ["session", "no"], "left_anti").select("session", "no", F.left(text, F.lit(600)).alias("said"))
    ends = asked.groupBy("session").agg(F.min_by("said", "no").alias("first"), F.max_by("said", "no").alias("last"))
    item = lambda df, name, place, said: df.select("session", F.lit(name).alias("item"), place.cast("int").alias("place"), said.alias("said"))
    one = F.lit(1)
    out = item(ends, "goal", one, F.col("first")).union(item(ends.filter("first <> last"), "latest", one, F.col("last")))
    lists = blocks.filter((F.col("tool") == TASKS) & (F.size("tasks") > 0)).groupBy("session").agg(F.max_by("tasks", "no").alias("tasks"))
    count = lambda status: F.size(F.filter("tasks", lambda t: t["status"] == status)).cast("string")
    out = out.union(item(lists, "state", one, F.concat(count("completed"), F.lit(" done, "), count("in_progress"), F.lit(" in progress, "), count("pending"), F.lit(" pending"))))
    each = lists.select("session", F.posexplode("tasks").alias("i", "t"))
    out = out.union(item(each.filter("t.status <> 'completed'"), "open", F.col("i") + 1, F.concat(F.lit("["), "t.status", F.lit("] "), "t.content")))
    out = out.union(item(each.filter("t.status = 'pending'"), "next", F.col("i") + 1, F.col("t.content")))
    ranked = lambda df, *order: df.withColumn("r", F.row_number().over(Window.partitionBy("session").orderBy(*order)))
    touched = blocks.filter(F.col("tool").isin(EDITS) & (F.coalesce("file", F.lit("")) != "")).groupBy("session", "file").agg(F.max("no").alias("no"))
    last = ranked(touched, F.desc("no"), "file").filter("r <= 15")
    out = out.union(item(last, "file", F.col("r"), F.col("file")))
    lines = blocks.filter("role = 'assistant' and kind = 'text'").select("session", "no", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("i", "line")).withColumn("line", F.trim("line")).filter(F.col("line").endswith("?"))
    newest = lines.groupBy("session").agg(F.max("no").alias("no"))
    return out.union(item(ranked(lines.join(newest, ["session", "no"]), F.desc("i")).filter("r <= 3"), "question", F.col("r"), F.col("line")))
