"""Readers run over files written from the tables, and rules over one text or one number that need no join."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import markdown
from docloom.functions import text as T
from docloom.operators import curate, search
from docloom.operators.documents import each_text
from docloom.plans.dialects import both, said
from docloom.plans.registry import query
from docloom.session import shared_dir, table
from docloom.sources import code, diffs, files


def _folder(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), f"files-{uuid.uuid4().hex}")


@query("src_jsonl", "SELECT event_id, user_id, event_type FROM events")
def src_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as compressed JSON lines with a broken line behind every hundredth, read back."""
    at = _folder(spark)
    row = F.to_json(F.struct("event_id", "user_id", "event_type"))
    said_ = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 100 == 0, F.concat(row, F.lit("\n{broken"))).otherwise(row).alias("value"))
    said_.write.option("compression", "gzip").text(at)
    return files.json_lines(spark, at, "event_id bigint, user_id bigint, event_type string")


@query("src_sentences", r"""SELECT said FROM (SELECT md5(question) AS said, question FROM questions UNION ALL SELECT md5(answer), answer FROM questions WHERE NOT contains(answer, chr(10)) AND NOT contains(answer, chr(13)) UNION ALL SELECT md5(question), question FROM questions)
    WHERE len(list_filter(regexp_split_to_array(question, '[\s\x{a0}\x{2003}\x{2005}\x{2007}-\x{2009}\x{202f}\x{3000}]+'), lambda w: w <> '')) >= 5""")
def src_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of at least five words from three formats: questions as Parquet and JSON lines, answers of one line as text."""
    q, at = table(spark, sf_dir, "questions"), _folder(spark)
    q.select(F.col("question").alias("text")).write.parquet(f"{at}/p")
    q.select(F.to_json(F.struct(F.col("question").alias("text"))).alias("value")).write.text(f"{at}/j")
    q.filter("answer is not null and not contains(answer, '\n') and not contains(answer, '\r')").select(F.col("answer").alias("value")).write.text(f"{at}/t")
    return files.sentences(spark, [("parquet", f"{at}/p"), ("json", f"{at}/j"), ("text", f"{at}/t")]).select(F.md5("text").alias("said"))


_MODULE = '"""About jobs."""\n\n\nclass Job(Base):\n    """One job."""\n\n    def run(self, a, *rest):\n        """Runs it."""\n\n    def _hidden(self): pass\n\n\ndef start(x):\n    def inner(): pass\n'


@query("code_symbols", said("path, name, label, kind, owner, first, last, signature", [
    ("app/jobs.py", "Job", "Job", "class", None, 4, 10, "Job"), ("app/jobs.py", "Job.run", ".run()", "method", "Job", 7, 8, "run(self, a, *rest)"), ("app/jobs.py", "Job._hidden", "._hidden()", "method", "Job", 10, 10, "_hidden(self)"),
    ("app/jobs.py", "start", "start()", "function", None, 13, 14, "start(x)"), ("app/jobs.py", "start.inner", "inner()", "nested", "start", 14, 14, "inner()"),
]))
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.symbols(_modules(spark)).drop("doc")


@query("api_reference", said("path, text", [("app/jobs.py", "# Module `app.jobs`\n\nAbout jobs.\n\n## class `app.jobs.Job`, a subclass of `Base`\n\nOne job.\n\n- `Job.run(self, a, *rest)`: Runs it.\n\n## `app.jobs.start(x)`")]))
def api_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.api_reference(_modules(spark))


def _modules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("app/jobs.py", _MODULE), ("bad.py", "def ("), ("none.py", None), ("doc.md", _MODULE)], "path string, text string")


@query("symbol_source", """WITH n AS (SELECT DISTINCT n.id, TRY_CAST(regexp_extract(n.source_location, '[0-9]+') AS INT) AS line, s.id AS section FROM nodes n JOIN (SELECT component, min(id) AS id FROM sections WHERE text IS NOT NULL GROUP BY component) s ON s.component = n.component),
    t AS (SELECT DISTINCT id, text FROM sections) SELECT n.id, md5(array_to_string(string_split(regexp_replace(regexp_replace(text, '\r\n', chr(10), 'g'), '\r', chr(10), 'g'), chr(10))[greatest(coalesce(line, 1), 1):greatest(coalesce(line, 1), 1) + 59], chr(10))) AS said FROM n JOIN t ON t.id = n.section""")
def symbol_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 60 lines from each symbol's line, of the component's first section, as the tables hold no code."""
    sections = table(spark, sf_dir, "sections").filter("text is not null")
    first = sections.groupBy("component").agg(F.min("id").alias("section"))
    texts = sections.select(F.col("id").alias("section"), "text").distinct()
    line = F.expr("try_cast(regexp_extract(source_location, '[0-9]+', 0) as int)")
    n = table(spark, sf_dir, "nodes").join(first, "component").select("id", line.alias("line"), "section").distinct().join(texts, "section")
    return n.select("id", F.md5(code.slice_of(F.col("text"), F.col("line"))).alias("said"))


_PAGE = "---\ntype: reference\n---\n# Top\n\n" + "plain words of a page " * 14 + "\n\n## It\nThis one opens badly. " + "w " * 30 + ".\n##  \n" + "ok word " * 40 + "\nFacts:\n- A → uses → B\n- broken\n\n- three words only\nUse someName and `other_name` and call() here.\n```\nnot_looked at\n```\n"


@query("doc_lint", said("page, level, line, message", [
    ("page", "warning", 4, "no facts"), ("page", "warning", 4, "sentence of 70 words"), ("page", "warning", 8, "opens with a pronoun"), ("page", "warning", 8, "34 words"), ("page", "warning", 8, "sentence of 31 words"), ("page", "error", 10, "empty heading"), ("page", "error", 10, "malformed fact"),
    ("page", "warning", 10, "sentence of 91 words"), ("page", "warning", 10, "code word without backticks: call()"), ("page", "warning", 10, "code word without backticks: someName"), ("bare", "error", 1, "no front matter"), ("odd", "error", 1, "unknown type of page"), ("none", "error", 1, "no front matter"),
]))
def doc_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.createDataFrame([("page", _PAGE), ("bare", "text"), ("odd", "---\ntype: essay\n---\nx"), ("none", None)], "page string, text string")
    return each_text(pages, ["page", "text"], "page string, level string, line int, message string", lambda p, t: [(p, *f) for f in markdown.lint(t or "")])


@query("facts", said("page, line, subject, relation, object, qualifier", [("a", 2, "A b", "uses", "B", "since 2"), ("a", 3, "C", "is", "D", None), ("c", 2, "X", "has", "Y", None)]))
def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.createDataFrame([("a", "Facts:\n- A b → uses → B (since 2)\n- C -> is -> D\n\nother\n- E → is → F"), ("b", "- A → no → list"), ("c", "**Facts:**\n* X → has → Y\nend"), ("d", None)], "page string, text string")
    return each_text(pages, ["page", "text"], "page string, line int, subject string, relation string, object string, qualifier string", lambda p, t: [(p, *f) for f in markdown.facts(t or "")])


@query("sections_older", said("level, path, first, last, text", [(0, "", 1, 3, "---\na: 1\n---"), (1, "A", 4, 4, "# A"), (2, "A > B", 5, 6, "## B\nb")]))
def sections_older(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older way: front matter is text, and a heading alone is a section."""
    df = spark.createDataFrame([("---\na: 1\n---\n# A\n## B\nb",)], "text string")
    return each_text(df, ["text"], "level int, path string, first int, last int, text string", lambda t: [(n, " > ".join(h), a, b, x) for n, h, a, b, x in markdown.sections(t, older=True)])


@query("fil_words", r"""WITH l AS (SELECT doc_id, text, unnest(generate_series(1, len(l))) AS no, unnest(l) AS line FROM (SELECT doc_id, text, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
    f AS (SELECT doc_id, length(line) AS n, line LIKE '```%' OR sum(CASE WHEN line LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) % 2 = 1 AS inside FROM l),
    c AS (SELECT doc_id, sum(CASE WHEN inside THEN n ELSE 0 END) / greatest(sum(n), 1)::DOUBLE AS share FROM f GROUP BY doc_id),
    w AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \t\r\n]+')) AS n_words FROM documents) SELECT doc_id, n_words::BIGINT AS n_words, round(share, 6) AS share FROM w JOIN c USING (doc_id) WHERE n_words BETWEEN 60 AND 400 AND share < 0.5""")
def fil_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of 60 to 400 words of which less than half is code."""
    n = F.size(T.all_of(F.col("text"), "[^ \t\r\n]+")).cast("bigint")
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", n.alias("n_words"), curate.code_share(F.col("text")).alias("share"))
    return docs.filter("n_words between 60 and 400 and share < 0.5").withColumn("share", F.round("share", 6))


@query("batch_ids", "SELECT doc_id, source, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 64) AS BIGINT) AS batch FROM documents")
def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 64 documents of one source."""
    rows = curate.running_before(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", F.lit(1))
    return rows.select("doc_id", "source", F.floor(F.col("before") / 64).alias("batch"))


@query("fixed_chunks", r"""WITH t AS (SELECT doc_id, source, len(regexp_extract_all(text, '[^ \t\r\n]+')) AS n FROM documents WHERE text IS NOT NULL), b AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id) - n AS before FROM t),
    c AS (SELECT source, (before + k) // 512 AS chunk, count(*) AS tokens FROM b, generate_series(0, n - 1) AS g(k) GROUP BY ALL) SELECT source, CAST(chunk AS BIGINT) AS chunk FROM c WHERE tokens = 512""")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of exactly 512 words of each source's documents, one after another; a short last one is dropped."""
    n = F.size(T.all_of(F.col("text"), "[^ \t\r\n]+")).cast("bigint")
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "source", n.alias("n"))
    rows = curate.running_before(docs, "source", "doc_id", F.col("n")).filter("n > 0")
    first, last = F.floor(F.col("before") / 512), F.floor((F.col("before") + F.col("n") - 1) / 512)
    parts = rows.select("source", "before", "n", F.explode(F.sequence(first, last)).alias("chunk"))
    held = F.least(F.col("before") + F.col("n"), (F.col("chunk") + 1) * 512) - F.greatest(F.col("before"), F.col("chunk") * 512)
    return parts.groupBy("source", "chunk").agg(F.sum(held).alias("tokens")).filter("tokens = 512").select("source", "chunk")


@query("head_tail_split", "SELECT doc_id, CASE WHEN r * 100 <= n * 90 THEN 'head' ELSE 'tail' END AS part FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)")
def head_tail_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("\0")).alias("source"))
    sizes = docs.groupBy("source").agg(F.count("*").alias("n"))
    rows = curate.running_before(docs, "source", "doc_id", F.lit(1)).join(sizes, "source")
    return rows.select("doc_id", F.when((F.col("before") + 1) * 100 <= F.col("n") * 90, "head").otherwise("tail").alias("part"))


@query("softmax", "SELECT doc_id, source, round(exp(z - m) / s, 9) AS p FROM (SELECT doc_id, source, length(text) / 500.0::DOUBLE AS z, max(length(text) / 500.0::DOUBLE) OVER (PARTITION BY source) AS m FROM documents WHERE text IS NOT NULL) JOIN (SELECT source AS src, sum(exp(z - m)) AS s FROM (SELECT source, length(text) / 500.0::DOUBLE AS z, max(length(text) / 500.0::DOUBLE) OVER (PARTITION BY source) AS m FROM documents WHERE text IS NOT NULL) GROUP BY source) ON src IS NOT DISTINCT FROM source")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The softmax of the documents' lengths within their source."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "source", (F.length("text") / 500.0).alias("z"))
    return search.softmax(docs, "source", "z").select("doc_id", "source", F.round("p", 9).alias("p"))


@query("dev_suite", "SELECT id, 'dev-' || lpad(CAST(row_number() OVER (ORDER BY id) AS VARCHAR), 5, '0') AS item FROM (SELECT DISTINCT id FROM questions WHERE lower(trim(split)) = 'dev')")
def dev_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "questions").filter("lower(trim(split)) = 'dev'").select("id").distinct()
    return curate.numbered(ids, "id").select("id", F.concat(F.lit("dev-"), F.lpad(F.col("number").cast("string"), 5, "0")).alias("item"))


@query("round_robin", "SELECT id, source, CAST(row_number() OVER (ORDER BY r, source, id) AS BIGINT) AS pick FROM (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat('3|', id)), id) AS r FROM (SELECT DISTINCT id, source FROM questions)) WHERE r <= 50")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty questions of each source, one of each in turn."""
    q = table(spark, sf_dir, "questions").select("id", "source").distinct().withColumn("h", F.md5(F.concat(F.lit("3|"), "id")))
    picked = q.withColumn("r", F.expr("row_number() over (partition by source order by h, id)")).filter("r <= 50")
    return curate.numbered(picked, "r", "source", "id").select("id", "source", F.col("number").cast("bigint").alias("pick"))


@query("canonical_hash", """SELECT event_id, sha256(concat('{"event_id":', event_id, ',"event_type":', CASE WHEN event_type IS NULL THEN 'null' ELSE '"' || event_type || '"' END, ',"user_id":', coalesce(user_id::VARCHAR, 'null'), ',"value":', CASE WHEN value IS NULL THEN 'null' ELSE CAST(round(value * 100) AS BIGINT)::VARCHAR END, '}')) AS h FROM events""")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of each event as JSON with sorted keys and nulls written out."""
    e = table(spark, sf_dir, "events").withColumn("value", F.round(F.col("value") * 100).cast("bigint"))
    return e.select("event_id", T.canonical_hash(*(F.col(c) for c in ("event_id", "event_type", "user_id", "value"))).alias("h"))


both("request_text", r"SELECT DISTINCT id FROM questions WHERE regexp_replace(question, RX'^[ \t\r\n]+|[ \t\r\n]+$', ''/*g*/) <> '' AND NOT MATCHES(question, RX'^[ \t\r\n]*(<|\[Request interrupted|Caveat:)') AND question NOT LIKE '%tool_use_id%'")


@query("request_rule", said("text", [("do it",), (" plain [Request interrupted",), ("x < y",)]))
def request_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("do it",), (" plain [Request interrupted",), ("x < y",), ("<tag>",), (" [Request interrupted by user]",), ("Caveat: no",), ("a tool_use_id b",), ("  \n",), ("",), (None,)]
    return spark.createDataFrame(rows, "text string").filter(T.is_request(F.col("text")))


@query("json_block", said("id, block, kind", [("a", '{"k": [1, 2]}', "object"), ("c", "[1]", "array")]))
def json_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first block of a reply that is JSON, fenced or not, and what it is."""
    rows = [("a", 'Here:\n```json\n{"k": [1, 2]}\n```\nend'), ("b", "```json\n{broken\n```"), ("c", "```\nnot json\n```\n```\n[1]\n```"), ("d", "none"), ("e", None)]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("block", T.json_block(F.col("text"))).filter("block is not null")
    return df.select("id", "block", F.when(F.col("block").startswith("{"), "object").otherwise("array").alias("kind"))


@query("token_mask", r"""SELECT id, md5(array_to_string(list_transform(w, lambda t, i: CASE WHEN ('0x' || substr(md5('0|' || id || '|' || CAST(i - 1 AS VARCHAR)), 1, 8))::BIGINT % 1000000 < 150000 THEN '[MASK]' ELSE t END), ' ')) AS said
    FROM (SELECT DISTINCT id, list_filter(string_split(question, ' '), lambda t: t <> '') AS w FROM questions WHERE question IS NOT NULL)""")
def token_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with 15 % of their words masked."""
    words = F.filter(F.split("question", " "), lambda t: t != "")
    return table(spark, sf_dir, "questions").filter("question is not null").select("id", words.alias("w")).distinct().select("id", F.md5(F.array_join(curate.masked(F.col("w"), F.col("id"), 0.15), " ")).alias("said"))


@query("settings_resolve", said("name, value, origin, problem", [("mode", "all", "environment", None), ("k", "8", "file", None), ("budget", "2000", "default", "no int"), ("core", "true", "environment", None), ("style", "short", "default", "not a choice"), ("home", "x", "default", None), ("rate", "0.5", "file", None)]))
def settings_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = spark.createDataFrame
    kinds = [("mode", "accurate", "str", ["accurate", "all"]), ("k", "5", "int", None), ("budget", "2000", "int", None), ("core", "false", "bool", None), ("style", "short", "str", ["short", "long"]), ("home", "x", "str", None), ("rate", "1.0", "float", None)]
    file = make([("k", " 8 "), ("mode", "fast"), ("style", "wide"), ("rate", "0.5")], "name string, value string")
    return curate.resolved_settings(make(kinds, "name string, value string, kind string, choices array<string>"), file, make([("mode", "all"), ("budget", "many"), ("core", "ON")], "name string, value string"))


both("iso_days", "SELECT event_id, DAY(ts, YMD) AS day, MICROS(ts) AS micros FROM events")


@query("unix_days", said("t, day", [(0, "1970-01-01"), (86399, "1970-01-01"), (86400, "1970-01-02"), (1700000000, "2023-11-14"), (-1, "1969-12-31"), (None, None)]))
def unix_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in (0, 86399, 86400, 1700000000, -1, None)], "t bigint").select("t", F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd").alias("day"))


@query("mean_pool", said("id, v", [("a", "0.6 0.8"), ("b", "0.0 0.0")]))
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit vector of the mean of token vectors, masked ones aside; nothing to pool gives zeros."""
    rows = [("a", [[3.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [True, True, False]), ("b", [[1.0, 1.0]], [False])]
    df = spark.createDataFrame(rows, "id string, tokens array<array<double>>, keep array<boolean>")
    return df.select("id", F.array_join(F.transform(search.mean_pool(F.col("tokens"), F.col("keep"), 2), lambda x: F.round(x, 6).cast("string")), " ").alias("v"))


@query("git_times", "SELECT path, max(date_trunc('second', commit_time)) AS newest FROM docs WHERE commit_time IS NOT NULL GROUP BY path")
def git_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest commit of each path, from a log written of the docs, a commit for each row."""
    at = _folder(spark)
    docs = table(spark, sf_dir, "docs").filter("commit_time is not null")
    ct = F.unix_seconds(F.col("commit_time").cast("timestamp")).cast("string")
    docs.select(F.concat(ct, F.lit("\n\n"), "path", F.lit("\n")).alias("value")).write.option("lineSep", "\x01").text(at)
    return files.commit_log(spark, at).select("path", F.col("at").cast("timestamp_ntz").alias("newest"))


_DIFF = (
    "diff --git a/src/a.py b/src/a.py\n--- a/src/a.py\n+++ b/src/a.py\n@@ -3,3 +3,4 @@ def f():\n same\n-old\n+new\n+--- looks like a head\n same\n@@ -20 +21,0 @@\n-gone\n"
    "diff --git a/new.md b/new.md\nnew file mode 100644\n--- /dev/null\n+++ b/new.md\n@@ -0,0 +1 @@\n+hello\n\\ No newline at end of file\ndiff --git a/dead.py b/dead.py\ndeleted file mode 100644\n--- a/dead.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n"
    "diff --git a/old name.md b/to.md\nsimilarity index 100%\nrename from old name.md\nrename to to.md\n"
)


@query("hunk_lines", said("diff, path, sign, line, text", [
    (1, "src/a.py", "-", None, "old"), (1, "src/a.py", "+", 4, "new"), (1, "src/a.py", "+", 5, "--- looks like a head"), (1, "src/a.py", "-", None, "gone"), (1, "new.md", "+", 1, "hello"), (1, "dead.py", "-", None, "x"),
]))
def hunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.diff_tables(spark.createDataFrame([(1, _DIFF), (2, None), (3, "")], "diff int, text string"))[1]


@query("diff_files", said("diff, path, status", [(1, "src/a.py", "M"), (1, "new.md", "A"), (1, "dead.py", "D"), (1, "to.md", "R")]))
def diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.diff_tables(spark.createDataFrame([(1, _DIFF), (2, None), (3, "")], "diff int, text string"))[0]
