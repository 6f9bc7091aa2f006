"""Sections, symbols and the links between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import bare_mention
from docloom.operators import links as L
from docloom.plans.dialects import both, said
from docloom.plans.registry import query
from docloom.session import stored, table

#: A name without what stands around it, in SQL.
_BARE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '^\s+|\s+$', '', 'g'), '^[`''"]+|[`''"]+$', '', 'g'), '[.,:;]+$', ''), '(?s)\(.*$', '')"""
_PATH = r"(?:[\p{L}\p{N}_.-]+/)*(?:[\p{L}\p{N}_.-]+\.(?:py|ts|tsx|js|jsx|mjs|tf|swift|kt|go|ya?ml|json|sh|sql|toml|ini|cfg|conf|Dockerfile|dockerfile)|(?:[\p{L}\p{N}_.-]+/)*(?:Dockerfile|Makefile|Procfile|crontab|Caddyfile))"
_NAMED = r"""s AS (SELECT DISTINCT id, component, text FROM sections),
    tick AS (SELECT DISTINCT id AS section_id, component, unnest(regexp_extract_all(text, '`([^`\n]{2,120})`', 1)) AS mention FROM s),
    m0 AS (SELECT section_id, component, mention FROM tick
        UNION SELECT id, component, unnest(regexp_extract_all(text, '(?:^|[^\p{L}\p{N}_/.-])(""" + _PATH + r""")\b', 1)) FROM s
        UNION SELECT id, component, unnest(regexp_extract_all(text, '\b([a-z]+[A-Z][A-Za-z0-9]+|[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]+|[a-z][a-z0-9]*_[a-z0-9_]{2,}|(?:var|module|data|aws_[a-z0-9_]+)\.[A-Za-z0-9_.-]+)\b', 1)) FROM s),
    m AS (SELECT *, """ + _BARE.format("mention") + r""" AS name FROM m0)"""  # fmt: skip
#: Names that the links and unresolved tables hold, with the component of their section.
_HELD = r"""s AS (SELECT DISTINCT lower(id) AS id, component, text FROM sections),
    h0 AS (SELECT lower(trim(section_id)) AS section_id, mention FROM links UNION SELECT lower(trim(section_id)), mention FROM unresolved),
    m AS (SELECT DISTINCT h0.section_id, s.component, mention, """ + _BARE.format("mention") + r""" AS name FROM h0 JOIN s ON s.id = h0.section_id WHERE mention IS NOT NULL)"""  # fmt: skip
_TESTS = r"regexp_matches({0}, '(^|/)(tests?|__tests__|spec|specs|e2e|fixtures?|testing)(/|$)|[._-](test|spec)\.[a-z]+$|(^|/)(test_[^/]+|conftest\.py)$')"
_CORE = r"""cd AS (SELECT DISTINCT array_to_string(p[1:k], '/') AS folder, p[k] AS last, list_has_any(p[2:k], ['test', 'tests', '__tests__', 'spec', 'e2e', 'fixtures', 'examples', 'example', 'docs', 'doc', 'scripts', 'tools', 'benchmarks', 'migrations', 'stories', 'storybook'])
            OR len(list_filter(p[2:k], lambda x: starts_with(x, '.'))) > 0 AS off
        FROM (SELECT p, unnest(generate_series(2, len(p) - 1)) AS k FROM (SELECT DISTINCT string_split(source_file, '/') AS p FROM nodes WHERE source_file <> '' AND NOT """ + _TESTS.format("source_file") + r"""))),
    ck AS (SELECT folder, CASE WHEN last IN ('backend', 'server', 'api', 'services', 'service', 'worker', 'workers', 'jobs', 'pipeline', 'db', 'database', 'core', 'internal', 'cmd', 'scraper') THEN 0
            WHEN last IN ('src', 'lib', 'pkg') THEN 1 END AS weak FROM cd WHERE NOT off),
    cb AS (SELECT folder FROM ck WHERE weak = (SELECT min(weak) FROM ck)),
    core AS (SELECT folder FROM cb x WHERE NOT EXISTS (SELECT 1 FROM cb y WHERE starts_with(x.folder, y.folder || '/')))"""  # fmt: skip
_LINKED = r"""fact AS (SELECT DISTINCT id AS node_id, component AS of, trim(label) AS label, coalesce(source_file, '') AS file FROM nodes
        WHERE trim(label) <> '' AND length(trim(label)) <= 80 AND coalesce(kind, '') <> 'rationale' AND coalesce(file_type, '') <> 'rationale'),
    role AS (SELECT *, file <> '' AND label = regexp_extract(file, '[^/]*$') AS is_file, """ + _TESTS.format("file") + r""" OR regexp_matches(file, '(^|/)(examples?|samples?)(/|$)') AS test,
        EXISTS (SELECT 1 FROM core c WHERE starts_with(fact.file, c.folder || '/')) OR NOT EXISTS (SELECT 1 FROM core) AS in_core FROM fact),
    idx AS (SELECT array_to_string(p[len(p) - k + 1:], '/') AS key, * EXCLUDE (p, k) FROM (SELECT *, unnest([1, 2, 3, 4]) AS k FROM (SELECT *, string_split(file, '/')[2:] AS p FROM role WHERE is_file)) WHERE k <= len(p)
        UNION ALL SELECT * FROM (SELECT regexp_replace(regexp_replace(label, '\(\)$', ''), '^\.+', '') AS key, * FROM role WHERE NOT is_file AND file <> '' AND NOT test) WHERE length(key) >= 3),
    ask AS (SELECT DISTINCT component, mention, name FROM m),
    met AS (SELECT a.*, 0 AS way, i.* EXCLUDE (key) FROM ask a JOIN idx i ON i.key = a.name
        UNION ALL SELECT a.*, 2, i.* EXCLUDE (key) FROM ask a JOIN idx i ON i.key = regexp_extract(a.name, '[^.]*$')
        WHERE a.name LIKE '%.%' AND a.name NOT LIKE '%/%' AND NOT regexp_matches(a.name, '^(var\.|module\.|aws_)')
            AND list_has_any(list_filter(list_transform(string_split(a.name, '.')[:-2], lambda x: regexp_replace(lower(x), '^~+', '')), lambda x: length(x) >= 3), regexp_split_to_array(lower(i.file), '[/._-]'))),
    b1 AS (SELECT *, component IS NOT DISTINCT FROM of AS own FROM met QUALIFY way = min(way) OVER (PARTITION BY component, mention)),
    b2 AS (SELECT * FROM b1 QUALIFY own OR NOT bool_or(own) OVER (PARTITION BY component, mention)),
    b3 AS (SELECT component, mention, name, node_id, any_value(is_file) AS is_file, any_value(test) AS test, any_value(in_core) AS in_core, any_value(file) AS file FROM b2 GROUP BY ALL),
    b4 AS (SELECT *, count(*) OVER p AS n, sum(in_core::INT) OVER p AS nc FROM b3 WINDOW p AS (PARTITION BY component, mention)),
    b5 AS (SELECT * EXCLUDE (n), CASE WHEN one THEN 1 ELSE n END AS n FROM (SELECT *, n > 1 AND nc = 1 AND EXISTS (SELECT 1 FROM core) AND NOT (name LIKE '%/%' OR regexp_full_match(name, '""" + _PATH + r"""')) AS one FROM b4) WHERE NOT one OR in_core),
    c AS (SELECT m.section_id, b5.*, NOT regexp_full_match(m.name, '[A-Za-z][a-z0-9]*') OR (NOT b5.is_file AND NOT b5.test AND (regexp_matches(m.name, '^[A-Z]') OR (b5.in_core AND contains(s.text, regexp_extract(b5.file, '[^/]*$'))))) AS may
        FROM m JOIN b5 ON b5.component IS NOT DISTINCT FROM m.component AND b5.mention = m.mention JOIN s ON s.id = m.section_id WHERE b5.n <= 3),
    l AS (SELECT section_id, mention AS said, name AS mention, node_id, in_core, n = 1 AND bool_or(may) AS sure FROM c GROUP BY section_id, mention, name, node_id, in_core, n)"""  # fmt: skip


@query("mentions", "WITH " + _NAMED + " SELECT section_id, mention FROM m0")
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.section_mentions(table(spark, sf_dir, "sections")).select("section_id", "mention").distinct()


@query("norm_mention", "WITH " + _NAMED + " SELECT DISTINCT mention, name FROM m")
def norm_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.section_mentions(table(spark, sf_dir, "sections")).select("mention", "name").distinct()


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = [table(spark, sf_dir, t).select(F.lower(F.trim("section_id")).alias("section_id"), "mention") for t in ("links", "unresolved")]
    sections = table(spark, sf_dir, "sections").select(F.lower("id").alias("section_id"), "component").distinct()
    rows = said[0].union(said[1]).filter("mention is not null").distinct().join(sections, "section_id")
    return rows.withColumns({"ticked": F.lit(False), "name": bare_mention(F.col("mention"))})


def _linked(spark: SparkSession, sf_dir: str, held: bool = True) -> tuple[DataFrame, DataFrame]:
    """The links of the sections' texts, or of the names that the tables hold for them."""
    nodes, sections = table(spark, sf_dir, "nodes"), table(spark, sf_dir, "sections").select("id", "component", "text")
    sections = sections.withColumn("id", F.lower("id")) if held else sections
    return L.link_sections(sections, nodes, None, stored(L.core_folders(nodes)), _held(spark, sf_dir) if held else None)


@query("doc_code_links", f"WITH {_HELD}, {_CORE}, {_LINKED} SELECT DISTINCT section_id, mention, node_id, CASE WHEN sure THEN 'EXTRACTED' ELSE 'AMBIGUOUS' END AS confidence, CASE WHEN sure THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS score FROM l")
def doc_code_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir)[0].select("section_id", "mention", "node_id", "confidence", "score").distinct()


@query("link_order", rf"""WITH {_HELD}, {_CORE}, {_LINKED}, k AS (SELECT *, CASE WHEN mention LIKE '%/%' OR regexp_full_match(mention, '{_PATH}') THEN 0 WHEN mention LIKE '%.%' THEN 1 WHEN regexp_full_match(mention, '[A-Za-z][a-z0-9]*') THEN 3 ELSE 2 END AS spec FROM l)
    SELECT section_id, mention, node_id, CAST(row_number() OVER (PARTITION BY section_id ORDER BY NOT sure, NOT in_core, spec, said, node_id) AS INTEGER) AS position FROM k""")
def link_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links as they are shown."""
    return _linked(spark, sf_dir)[0].select("section_id", "mention", "node_id", "position")


@query("unresolved_mentions", rf"""WITH {_NAMED}, {_CORE}, {_LINKED} SELECT section_id, mention FROM tick WHERE regexp_matches(mention, '[()_./]|[a-z][A-Z]|^[A-Z][a-z]+[A-Z]') AND mention NOT LIKE '% %'
    AND NOT EXISTS (SELECT 1 FROM b5 WHERE b5.component IS NOT DISTINCT FROM tick.component AND b5.mention = tick.mention)""")
def unresolved_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backticked names of code shape that stand for nothing."""
    return _linked(spark, sf_dir, False)[1]


@query("core_paths", f"WITH {_CORE} SELECT folder FROM core")
def core_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.core_folders(table(spark, sf_dir, "nodes"))


@query("symbol_roles", rf"""WITH {_CORE}, fact AS (SELECT DISTINCT id AS node_id, trim(label) AS label, coalesce(source_file, '') AS file FROM nodes WHERE trim(label) <> '' AND length(trim(label)) <= 80 AND coalesce(kind, '') <> 'rationale' AND coalesce(file_type, '') <> 'rationale')
    SELECT DISTINCT node_id, file, CASE WHEN file <> '' AND label = regexp_extract(file, '[^/]*$') THEN 'file' ELSE 'top' END AS role, {_TESTS.format("file")} OR regexp_matches(file, '(^|/)(examples?|samples?)(/|$)') AS test,
        EXISTS (SELECT 1 FROM core c WHERE starts_with(fact.file, c.folder || '/')) OR NOT EXISTS (SELECT 1 FROM core) AS core FROM fact""")
def symbol_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role, test and core of every symbol; the tables hold no edges, so all but files are top."""
    nodes = table(spark, sf_dir, "nodes")
    return L.with_core(L.symbol_facts(nodes), "file", stored(L.core_folders(nodes))).select("node_id", "file", "role", "test", "core").distinct()


#: A code graph with every role, and sections that take every branch of the link rules.
_GRAPH = [
    ("f_jobs", "jobqueue.py", "c/backend/jobqueue.py", "c"), ("pending", "pending()", "c/backend/jobqueue.py", "c"), ("JobQueue", "JobQueue", "c/backend/jobqueue.py", "c"), ("claim", ".claim()", "c/backend/jobqueue.py", "c"),
    ("f_ui", "form.tsx", "c/frontend/app/form.tsx", "c"), ("worker", "worker()", "c/frontend/app/form.tsx", "c"), ("f_t", "jobs.test.ts", "c/frontend/test/jobs.test.ts", "c"), ("query", "query()", "c/frontend/test/jobs.test.ts", "c"),
    ("f_s", "sessions.py", "c/backend/sessions.py", "c"), ("Session", "Session", "c/backend/sessions.py", "c"), ("inner", "inner_step()", "c/backend/sessions.py", "c"), ("why", "reason_why", "c/backend/sessions.py", "c"),
    ("run_a", "run_all()", "c/backend/jobqueue.py", "c"), ("run_b", "run_all()", "c/frontend/app/form.tsx", "c"), ("two_a", "run_two()", "c/frontend/app/form.tsx", "c"), ("two_b", "run_two()", "c/frontend/app/more.tsx", "c"),
    *[(f"many_{i}", "run_many()", f"c/frontend/app/m{i}.tsx", "c") for i in range(4)], ("else", "run_else()", "d/src/else.py", "d"), ("own_c", "own_name()", "c/frontend/app/form.tsx", "c"), ("own_d", "own_name()", "d/src/else.py", "d"),
]
_EDGES = [
    ("f_jobs", "pending", "contains"), ("f_jobs", "JobQueue", "contains"), ("JobQueue", "claim", "method"), ("f_ui", "worker", "contains"), ("f_t", "query", "contains"), ("f_s", "Session", "contains"),
    *[("f_jobs", x, "contains") for x in ("run_a", "run_b", "two_a", "two_b", "many_0", "many_1", "many_2", "many_3", "else", "own_c", "own_d")], ("pending", "worker", "calls"),
]
_TEXTS = [
    ("s1", "c", "Status `pending` means review; the `worker` role; `rawPost.query` column."), ("s2", "c", "In `jobqueue.py`, `pending` returns the backlog."), ("s3", "c", "Call `JobQueue.claim` first."),
    ("s4", "c", "The `data.claim` field."), ("s5", "c", "`jobqueue.claim` locks a row."), ("s6", "c", "A `Session` holds cookies."), ("s7", "c", "See `backend/jobqueue.py` and `JobQueue`, then `form.tsx`."),
    ("s8", "c", "Use `run_all()`, `run_two()`, `run_many()` and `run_else()`."), ("s9", "c", "`own_name` and `inner_step()` or `reason_why`"), ("s10", "d", "`own_name(x)` here"), ("s11", "c", "`not_there()` or `two words_x`; `claim()` and `Claim`"),
    ("s12", "c", None), ("s13", "c", ""), ("s14", "c", "Tests in jobs.test.ts."),
]


def _fixture(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    nodes = spark.createDataFrame(_GRAPH, "id string, label string, source_file string, component string").withColumn("kind", F.when(F.col("id") == "why", "rationale").otherwise("symbol"))
    texts, edges = spark.createDataFrame(_TEXTS, "id string, component string, text string"), spark.createDataFrame(_EDGES, "source string, target string, relation string")
    return L.link_sections(texts, nodes, edges, L.core_folders(nodes))


@query("link_rules", said("section_id, node_id, mention, confidence, position", [
    ("s1", "pending", "pending", "AMBIGUOUS", 1), ("s1", "worker", "worker", "AMBIGUOUS", 2), ("s2", "f_jobs", "jobqueue.py", "EXTRACTED", 1), ("s2", "pending", "pending", "EXTRACTED", 2), ("s3", "claim", "JobQueue.claim", "EXTRACTED", 1),
    ("s3", "JobQueue", "JobQueue", "EXTRACTED", 2), ("s5", "claim", "jobqueue.claim", "EXTRACTED", 1), ("s6", "Session", "Session", "EXTRACTED", 1), ("s7", "f_jobs", "backend/jobqueue.py", "EXTRACTED", 1), ("s7", "JobQueue", "JobQueue", "EXTRACTED", 2),
    ("s7", "f_ui", "form.tsx", "EXTRACTED", 3), ("s8", "run_a", "run_all", "EXTRACTED", 1), ("s8", "run_a", "run_all", "EXTRACTED", 2), ("s8", "else", "run_else", "EXTRACTED", 3), ("s8", "else", "run_else", "EXTRACTED", 4),
    ("s8", "two_a", "run_two", "AMBIGUOUS", 5), ("s8", "two_b", "run_two", "AMBIGUOUS", 6), ("s8", "two_a", "run_two", "AMBIGUOUS", 7), ("s8", "two_b", "run_two", "AMBIGUOUS", 8), ("s9", "own_c", "own_name", "EXTRACTED", 1),
    ("s10", "own_d", "own_name", "EXTRACTED", 1), ("s10", "own_d", "own_name", "EXTRACTED", 2), ("s14", "f_t", "jobs.test.ts", "EXTRACTED", 1),
]))
def link_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link rules over a small graph with edges; the rows beside it are worked out by hand."""
    return _fixture(spark)[0].select("section_id", "node_id", "mention", "confidence", "position")


@query("link_rules_open", said("section_id, mention", [("s1", "rawPost.query"), ("s4", "data.claim"), ("s9", "inner_step()"), ("s9", "reason_why"), ("s11", "not_there()"), ("s11", "claim()")]))
def link_rules_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture(spark)[1]


@query("links_v0", "WITH " + _HELD + r""", i AS (SELECT DISTINCT lower(label) AS k, id FROM nodes), c AS (SELECT k, count(*) AS n, min(id) AS node_id FROM i GROUP BY k)
    SELECT DISTINCT section_id, mention, node_id FROM m JOIN c ON k = lower(mention) WHERE n = 1""")
def links_v0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain resolver: the whole label, without roles or components, if it is one node's."""
    index = table(spark, sf_dir, "nodes").select(F.lower("label").alias("k"), "id").distinct().groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("node_id")).filter("n = 1")
    return _held(spark, sf_dir).withColumn("k", F.lower("mention")).join(index, "k").select("section_id", "mention", "node_id").distinct()


@query("link_precision", f"WITH {_HELD}, {_CORE}, {_LINKED}" + r""", mine AS (SELECT DISTINCT section_id, node_id, CASE WHEN sure THEN 'EXTRACTED' ELSE 'AMBIGUOUS' END AS stratum FROM l),
    kept AS (SELECT DISTINCT lower(trim(section_id)) AS s, lower(trim(node_id)) AS t FROM links WHERE section_id IS NOT NULL AND node_id IS NOT NULL)
    SELECT stratum, count(*) AS links, CAST(sum(CASE WHEN kept.s IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS known FROM mine LEFT JOIN kept ON s = lower(section_id) AND t = lower(node_id) GROUP BY ROLLUP (stratum) HAVING count(*) > 0""")
def link_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links made here that the links table also has, per stratum with a total."""
    mine = doc_code_links(spark, sf_dir).select("section_id", "node_id", F.col("confidence").alias("stratum")).distinct()
    kept = table(spark, sf_dir, "links").select(F.lower(F.trim("section_id")).alias("s"), F.lower(F.trim("node_id")).alias("t")).filter("s is not null and t is not null").distinct().withColumn("known", F.lit(1))
    joined = mine.withColumns({"s": F.lower("section_id"), "t": F.lower("node_id")}).join(kept, ["s", "t"], "left")
    return joined.rollup("stratum").agg(F.count("*").alias("links"), F.coalesce(F.sum("known"), F.lit(0)).alias("known"))


_SPECIFIC = r"CASE WHEN mention LIKE '%/%' THEN 0 WHEN MATCHES(mention, RX'[A-Za-z]\.[A-Za-z]') THEN 1 WHEN MATCHES(mention, RX'[_()]|[a-z][A-Z]') THEN 2 ELSE 3 END"
_LINK = """l AS (SELECT DISTINCT link_id, lower(trim(section_id)) AS section_id, lower(trim(node_id)) AS node_id, mention, upper(trim(confidence)) AS confidence, score, built_at FROM links),
    n AS (SELECT DISTINCT lower(trim(id)) AS node_id, label, source_file, source_location, kind, component FROM nodes)"""

both("section_code", f"WITH {_LINK} SELECT DISTINCT l.section_id, n.node_id, n.label, n.source_file FROM l JOIN n ON l.node_id = n.node_id WHERE l.confidence = 'EXTRACTED'")
both("docs_for", f"""WITH {_LINK} SELECT n.source_file, s.path, CAST(coalesce(min(s.line_start), 0) AS BIGINT) AS first_line, count(DISTINCT s.id) AS sections FROM l JOIN n ON l.node_id = n.node_id JOIN (SELECT DISTINCT id, path, line_start FROM sections) s ON lower(s.id) = l.section_id
    GROUP BY n.source_file, s.path""")
both("link_counts", f"WITH {_LINK} SELECT confidence, count(*) AS links, count(DISTINCT node_id) AS nodes, count(DISTINCT section_id) AS sections FROM l GROUP BY confidence")
both("component_stats", """SELECT component, count(DISTINCT doc_id) AS docs, count(DISTINCT id) AS sections, CAST(sum(words) AS BIGINT) AS words, CAST(sum(n_resolved) AS BIGINT) AS resolved, CAST(sum(n_unresolved) AS BIGINT) AS unresolved
    FROM (SELECT DISTINCT id, doc_id, component, words, n_resolved, n_unresolved FROM sections) GROUP BY component""")
both("sec_lookup", "SELECT DISTINCT s.id, s.path, s.heading_path, CAST(coalesce(s.line_start, 0) AS BIGINT) AS line_start, CAST(s.line_end AS BIGINT) AS line_end, s.component, CAST(s.ordinal AS BIGINT) AS ordinal FROM sections s JOIN (SELECT DISTINCT lower(trim(section_id)) AS k FROM links) l ON lower(s.id) = l.k")
both("missing_names", r"""WITH u AS (SELECT DISTINCT section_id, mention FROM unresolved WHERE MATCHES(mention, RX'^[A-Za-z_.]+\(\)$|^[A-Za-z0-9_./-]+\.(py|ts|go|yaml|tf|md)$') AND NOT STARTS(mention, 'http') AND NOT STARTS(mention, '/')),
    t AS (SELECT DISTINCT source_file AS f FROM nodes UNION SELECT DISTINCT regexp_extract(source_file, RX'[^/]*$', 0) FROM nodes UNION SELECT DISTINCT label FROM nodes)
    SELECT section_id, mention, position FROM (SELECT section_id, mention, CAST(row_number() OVER (PARTITION BY section_id ORDER BY mention) AS BIGINT) AS position FROM u WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.f = u.mention)) WHERE position <= 5""")
both("symbol_owner", r"""WITH n AS (SELECT DISTINCT id, label, kind, source_file, TRY_CAST(regexp_extract(source_location, RX'[0-9]+', 0) AS INT) AS line FROM nodes)
    SELECT id, owner FROM (SELECT m.id, c.id AS owner, row_number() OVER (PARTITION BY m.id ORDER BY c.line DESC, c.id) AS r FROM n m JOIN n c ON m.source_file = c.source_file AND c.line < m.line WHERE m.kind = 'method' AND c.kind = 'class') WHERE r = 1""")
_SPANS = r"""y AS (SELECT DISTINCT id, source_file, TRY_CAST(regexp_extract(source_location, RX'[0-9]+', 0) AS INT) AS line FROM nodes WHERE kind <> 'file'),
    st AS (SELECT source_file, line, CAST(coalesce(lead(line) OVER (PARTITION BY source_file ORDER BY line) - 1, 1000000000) AS BIGINT) AS line_end FROM (SELECT DISTINCT source_file, line FROM y WHERE line IS NOT NULL)),
    sp AS (SELECT y.id, y.source_file, y.line, st.line_end FROM y JOIN st ON y.source_file = st.source_file AND y.line = st.line)"""
both("symbol_spans", f"WITH {_SPANS} SELECT id, source_file, CAST(line AS BIGINT) AS line, line_end FROM sp")
_HUNKS = """h AS (SELECT source_file, CAST(min(line) + 5 AS BIGINT) AS first, CAST(min(line) + 120 AS BIGINT) AS last FROM sp GROUP BY source_file)"""
both("changed_symbols", f"WITH {_SPANS}, {_HUNKS} SELECT DISTINCT sp.id, sp.source_file FROM h JOIN sp ON h.source_file = sp.source_file WHERE sp.line <= h.last AND sp.line_end >= h.first")
both("docs_plan", f"""WITH {_SPANS}, {_HUNKS}, {_LINK}, c AS (SELECT DISTINCT lower(sp.id) AS node_id, sp.source_file FROM h JOIN sp ON h.source_file = sp.source_file WHERE sp.line <= h.last AND sp.line_end >= h.first),
    hit AS (SELECT l.section_id, 0 AS priority, 'symbol changed' AS why FROM l JOIN c ON l.node_id = c.node_id UNION ALL
            SELECT l.section_id, 1, 'file changed' FROM l JOIN n ON l.node_id = n.node_id JOIN h ON n.source_file = h.source_file)
    SELECT section_id, CAST(min(priority) AS BIGINT) AS priority, min(CASE WHEN priority = 0 THEN why END) AS why, count(*) AS links FROM hit WHERE section_id IS NOT NULL GROUP BY section_id""")
both("plan_key", f"""WITH {_SPANS}, {_HUNKS}, {_LINK} SELECT l.section_id, md5(concat(l.section_id, '|', CAST(count(DISTINCT sp.id) AS STRING), '|', min(sp.source_file))) AS plan_key
    FROM l JOIN sp ON l.node_id = lower(sp.id) JOIN h ON h.source_file = sp.source_file WHERE sp.line <= h.last AND sp.line_end >= h.first AND l.section_id IS NOT NULL GROUP BY l.section_id""",
    f"""WITH {_SPANS}, {_HUNKS}, {_LINK} SELECT l.section_id, md5(concat(l.section_id, '|', CAST(count(DISTINCT sp.id) AS VARCHAR), '|', min(sp.source_file))) AS plan_key
    FROM l JOIN sp ON l.node_id = lower(sp.id) JOIN h ON h.source_file = sp.source_file WHERE sp.line <= h.last AND sp.line_end >= h.first AND l.section_id IS NOT NULL GROUP BY l.section_id""")
both("verify_files", f"""WITH {_LINK}, f AS (SELECT l.section_id, n.source_file, min(CASE WHEN n.source_file LIKE '%.yaml' OR n.source_file LIKE '%.tf' THEN 0 ELSE 1 END) AS config, min(l.link_id) AS o FROM l JOIN n ON l.node_id = n.node_id
        WHERE l.section_id IS NOT NULL GROUP BY l.section_id, n.source_file)
    SELECT section_id, position, source_file FROM (SELECT section_id, source_file, CAST(row_number() OVER (PARTITION BY section_id ORDER BY config, o, source_file) AS BIGINT) AS position FROM f) WHERE position <= 3""")
both("hits_struct", f"""WITH {_LINK}, c AS (SELECT l.section_id, n.node_id, min(l.link_id) AS o FROM l JOIN n ON l.node_id = n.node_id WHERE l.section_id IS NOT NULL GROUP BY l.section_id, n.node_id),
    r AS (SELECT section_id, node_id, row_number() OVER (PARTITION BY section_id ORDER BY o, node_id) AS r FROM c)
    SELECT section_id, array_join(transform(array_sort(collect_list(struct(r, node_id))), x -> x.node_id), ' ') AS code FROM r WHERE r <= 6 GROUP BY section_id""",
    f"""WITH {_LINK}, c AS (SELECT l.section_id, n.node_id, min(l.link_id) AS o FROM l JOIN n ON l.node_id = n.node_id WHERE l.section_id IS NOT NULL GROUP BY l.section_id, n.node_id),
    r AS (SELECT section_id, node_id, row_number() OVER (PARTITION BY section_id ORDER BY o, node_id) AS r FROM c)
    SELECT section_id, string_agg(node_id, ' ' ORDER BY r) AS code FROM r WHERE r <= 6 GROUP BY section_id""")
both("grounding", f"""WITH {_LINK}, d AS (SELECT DISTINCT s.id, lower(s.id) AS section_id, max(d.commit_time) AS doc_time FROM sections s JOIN docs d ON s.doc_id = d.id GROUP BY s.id),
    f AS (SELECT n.source_file, max(l.built_at) AS file_time FROM l JOIN n ON l.node_id = n.node_id GROUP BY n.source_file)
    SELECT d.id, count(DISTINCT n.source_file) AS files, count(DISTINCT CASE WHEN f.file_time > d.doc_time THEN n.source_file END) AS stale FROM d JOIN l ON l.section_id = d.section_id JOIN n ON l.node_id = n.node_id JOIN f ON f.source_file = n.source_file GROUP BY d.id""")
both("flag_share", f"""WITH {_LINK}, k AS (SELECT s.id, count(l.link_id) AS links FROM (SELECT DISTINCT id FROM sections) s LEFT JOIN l ON l.section_id = lower(s.id) GROUP BY s.id), u AS (SELECT lower(trim(section_id)) AS i, count(*) AS n FROM (SELECT DISTINCT * FROM unresolved) GROUP BY 1)
    SELECT count(*) AS sections, round(avg(CAST(CASE WHEN links > 0 THEN 1 ELSE 0 END AS DOUBLE)), 6) AS with_code, round(avg(CAST(CASE WHEN u.n > 0 THEN 1 ELSE 0 END AS DOUBLE)), 6) AS with_missing, CAST(sum(links) AS BIGINT) AS links FROM k LEFT JOIN u ON u.i = lower(k.id)""")
both("path_mentions", """WITH f AS (SELECT DISTINCT source_file FROM nodes WHERE kind = 'file'), m AS (SELECT DISTINCT section_id, mention FROM unresolved WHERE mention LIKE '%/%')
    SELECT m.section_id, f.source_file FROM m JOIN f ON f.source_file = regexp_replace(m.mention, RX'[`"''.,:; ]+$|^[`"''.,:; ]+', ''/*g*/)""".replace("[`\"''", "[`\""))
both("new_names", r"""WITH t AS (SELECT DISTINCT EACH(regexp_extract_all(text, RX'--[a-z]+(?:-[a-z]+)*|[A-Z]{3,}_[A-Z_]+', 0)) AS name FROM sections), d AS (SELECT DISTINCT EACH(regexp_extract_all(text, RX'--[a-z]+(?:-[a-z]+)*|[A-Z]{3,}_[A-Z_]+', 0)) AS name FROM documents)
    SELECT d.name FROM d WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.name = d.name)""")
both("added_names", r"""WITH t AS (SELECT DISTINCT component, EACH(regexp_extract_all(text, RX'--[a-z]+(?:-[a-z]+)*', 0)) AS name FROM sections WHERE removed_at IS NULL), o AS (SELECT DISTINCT component, EACH(regexp_extract_all(text, RX'--[a-z]+(?:-[a-z]+)*', 0)) AS name FROM sections WHERE removed_at IS NOT NULL)
    SELECT component, name FROM t EXCEPT SELECT component, name FROM o""")
both("changed_terms", r"SELECT DISTINCT id, EACH(regexp_extract_all(text, RX'\b[A-Za-z]+_[A-Za-z_]+\b', 0)) AS term FROM sections WHERE removed_at IS NOT NULL")
both("changed_docs", """WITH o AS (SELECT path, min(sha256) AS sha FROM docs WHERE commit_time < TIMESTAMP '2024-10-01 00:00:00' GROUP BY path), n AS (SELECT path, max(sha256) AS sha FROM docs WHERE commit_time >= TIMESTAMP '2024-03-01 00:00:00' GROUP BY path)
    SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.sha <> n.sha THEN 'edited' ELSE 'same' END AS state FROM o FULL OUTER JOIN n ON o.path = n.path""")
both("build_manifest", """SELECT d.component, count(DISTINCT d.id) AS docs, count(DISTINCT s.id) AS sections, max(d.commit_time) AS newest, md5(min(d.sha256)) AS mark FROM docs d LEFT JOIN sections s ON s.doc_id = d.id GROUP BY d.component""")
both("doc_id", r"SELECT DISTINCT id, regexp_replace(lower(concat(component, '_', path)), RX'[^a-z0-9_]', '_'/*g*/) AS made FROM docs")
both("dir_chain", r"""SELECT DISTINCT array_join(slice(p, 1, k), '/') AS dir FROM (SELECT p, EACH(SERIES(1, size(p) - 1)) AS k FROM (SELECT SPLIT(source_file, '/') AS p FROM nodes WHERE source_file LIKE '%/%'))""",
     r"""SELECT DISTINCT array_to_string(p[1:k], '/') AS dir FROM (SELECT p, unnest(generate_series(1, len(p) - 1)) AS k FROM (SELECT string_split(source_file, '/') AS p FROM nodes WHERE source_file LIKE '%/%'))""")
both("module_dotted", r"SELECT DISTINCT source_file, regexp_replace(regexp_replace(regexp_replace(source_file, RX'\.py$', ''), RX'/__init__$', ''), RX'/', '.'/*g*/) AS module FROM nodes WHERE source_file LIKE '%.py'")
both("fil_path_class", r"""SELECT DISTINCT path, MATCHES(lower(path), RX'(^|/)(changelog|changes|history|news|releases?)([./_-]|$)') AS changelog, MATCHES(lower(path), RX'(^|/)(license|contributing|code_of_conduct|security)') AS boilerplate, MATCHES(path, RX'(^|/)(tests?|examples?)/') AS test FROM docs""")
both("path_kind", r"""SELECT DISTINCT f AS path, CASE WHEN MATCHES(lower(f), RX'\.(md|mdx|rst|adoc|txt)$') THEN 'doc' WHEN MATCHES(lower(f), RX'\.(py|ts|go|js|java|rs)$') THEN 'code' WHEN MATCHES(lower(f), RX'\.(ya?ml|toml|json|tf|cfg|ini)$') THEN 'config' ELSE 'other' END AS kind
    FROM (SELECT path AS f FROM docs UNION ALL SELECT source_file FROM nodes)""")
both("src_file_filter", r"SELECT DISTINCT path FROM docs WHERE MATCHES(lower(path), RX'\.(md|mdx|rst)$') AND NOT MATCHES(lower(path), RX'(^|/)(node_modules|\.git|build|dist|archive|vendor)/')")
both("include_paths", r"SELECT DISTINCT source_file FROM nodes WHERE (STARTS(source_file, 'atlas/') OR MATCHES(source_file, RX'^[^/]+/src/[^/]*\.py$')) AND NOT MATCHES(source_file, RX'/tests/')")
both("cfg_nodes", r"SELECT DISTINCT id, label, source_file FROM nodes WHERE kind = 'file' AND MATCHES(source_file, RX'\.(yaml|yml|toml|tf|json)$') AND NOT MATCHES(lower(source_file), RX'secret|credential|\.env')")
both("doc_partitions", r"SELECT part, count(*) AS docs FROM (SELECT DISTINCT path, CASE WHEN MATCHES(lower(path), RX'changelog|release') THEN 'changelog' WHEN MATCHES(lower(path), RX'reference|api') THEN 'needed' ELSE 'regular' END AS part FROM docs) GROUP BY part")
both("trust_suggest", r"""SELECT component, docs, code, CASE WHEN docs >= 10 * code THEN 'high' ELSE 'low' END AS trust FROM (SELECT c.component, count(DISTINCT d.path) AS docs, count(DISTINCT n.source_file) AS code FROM (SELECT DISTINCT component FROM docs UNION SELECT DISTINCT component FROM nodes) c
    LEFT JOIN docs d ON d.component = c.component LEFT JOIN (SELECT DISTINCT component, source_file FROM nodes WHERE kind = 'file') n ON n.component = c.component GROUP BY c.component)""")
both("domain_for", r"""WITH c AS (SELECT DISTINCT regexp_extract(path, RX'^([^/]+/[^/]+)/', 1) AS root FROM docs UNION SELECT DISTINCT regexp_extract(path, RX'^([^/]+)/', 1) FROM docs), p AS (SELECT DISTINCT path, regexp_extract(path, RX'^([^/]+/[^/]+)/', 1) AS two, regexp_extract(path, RX'^([^/]+)/', 1) AS one FROM docs)
    SELECT p.path, max_by(c.root, length(c.root)) AS root FROM p JOIN c ON c.root = p.two OR c.root = p.one WHERE c.root <> '' GROUP BY p.path""")
both("domain_status", """WITH b AS (SELECT component, max(added_at) AS built, count(DISTINCT id) AS sections FROM sections GROUP BY component) SELECT r.component, b.built, b.sections, CASE WHEN b.component IS NULL THEN 'not built' WHEN r.newest > b.built THEN 'stale' ELSE 'ok' END AS state
    FROM (SELECT component, max(commit_time) AS newest FROM docs GROUP BY component) r LEFT JOIN b ON b.component = r.component""")
both("section_jobs", """WITH s AS (SELECT DISTINCT md5(concat(path, '|', coalesce(text, ''))) AS mark, id FROM sections), g AS (SELECT DISTINCT g AS id FROM (SELECT EACH(transform(gold, x -> x.section)) AS g FROM questions) WHERE g IS NOT NULL)
    SELECT 'normal' AS kind, id, mark FROM s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.id = s.id) UNION ALL SELECT 'ident', id, mark FROM (SELECT id, mark FROM s ORDER BY md5(concat('1|', mark)), id LIMIT 10000)""",
     """WITH s AS (SELECT DISTINCT md5(concat(path, '|', coalesce(text, ''))) AS mark, id FROM sections), g AS (SELECT DISTINCT g AS id FROM (SELECT unnest(list_transform(gold, lambda x: x.section)) AS g FROM questions) WHERE g IS NOT NULL)
    SELECT 'normal' AS kind, id, mark FROM s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.id = s.id) UNION ALL SELECT 'ident', id, mark FROM (SELECT id, mark FROM s ORDER BY md5(concat('1|', mark)), id LIMIT 10000)""")
both("index_render", r"""SELECT component, array_join(sort_array(collect_set(coalesce(title, '')), false), '; ') AS titles FROM docs GROUP BY component""", r"""SELECT component, array_to_string(list_sort(list(DISTINCT coalesce(title, '')), 'DESC'), '; ') AS titles FROM docs GROUP BY component""")
both("one_hop", f"WITH {_LINK}, e AS (SELECT section_id AS a, node_id AS b FROM l WHERE section_id IS NOT NULL AND node_id IS NOT NULL) SELECT v, count(DISTINCT w) AS neighbours FROM (SELECT a AS v, b AS w FROM e UNION ALL SELECT b, a FROM e) GROUP BY v")
both("folder_facts", r"""SELECT regexp_extract(source_file, RX'^(.*)/[^/]*$', 1) AS folder, count(DISTINCT source_file) AS files, count(DISTINCT id) AS symbols, concat('contains ', CAST(count(DISTINCT id) AS STRING), ' symbols') AS fact FROM nodes GROUP BY 1""",
     r"""SELECT regexp_extract(source_file, '^(.*)/[^/]*$', 1) AS folder, count(DISTINCT source_file) AS files, count(DISTINCT id) AS symbols, concat('contains ', CAST(count(DISTINCT id) AS VARCHAR), ' symbols') AS fact FROM nodes GROUP BY 1""")
both("src_parquet_project", "SELECT id, level, ordinal FROM sections WHERE level <= 2")
both("union_groups", "SELECT 'doc' AS kind, id, path, CAST(NULL AS STRING) AS heading FROM docs UNION SELECT 'section', id, path, heading_path FROM sections", "SELECT 'doc' AS kind, id, path, CAST(NULL AS VARCHAR) AS heading FROM docs UNION SELECT 'section', id, path, heading_path FROM sections")
