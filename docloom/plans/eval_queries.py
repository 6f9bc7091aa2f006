"""Evaluation of rankings, mining of negatives, and reports over questions, embeddings and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import query_terms, shingle_hashes, unicode_words
from docloom.operators import evaluate, index, mining, similar
from docloom.plans.dialects import both
from docloom.plans.registry import Query, query
from docloom.plans.search_queries import _MODES_SQL, _UNIT_SQL, BM25_SQL, asked, bm25, by_mode, dense, every_20th, of_all, section_index, sections_once
from docloom.session import stored, table

#: Paths of change lists.
CHANGELOG = r"(^|/)(changelog|changes|history|news|releases?)([./_-]|$)"

_GOLD = """gold AS (SELECT DISTINCT id, path, lo, hi, section FROM (SELECT id, g.path AS path, g.lines[0] AS lo, g.lines[1] AS hi, g.section AS section FROM (SELECT id, explode(gold) AS g FROM questions)))"""
_GOLD_D = """gold AS (SELECT DISTINCT id, g.path AS path, g.lines[1] AS lo, g.lines[2] AS hi, g.section AS section FROM (SELECT id, unnest(gold) AS g FROM questions))"""
_SPAN = """SELECT DISTINCT gold.id AS question_id, s.id AS section_id FROM gold JOIN sections s ON s.path = gold.path
    WHERE least(s.line_end, hi) - greatest(s.line_start, lo) + 1 > 0 AND (2 * (least(s.line_end, hi) - greatest(s.line_start, lo) + 1) >= hi - lo + 1
        OR 2 * (least(s.line_end, hi) - greatest(s.line_start, lo) + 1) >= s.line_end - s.line_start + 1)"""
both("span_overlap", f"WITH {_GOLD} {_SPAN}", f"WITH {_GOLD_D} {_SPAN}")
both("docs_of_gold", f"WITH {_GOLD} SELECT id, count(DISTINCT path) AS paths, count(DISTINCT section) AS sections FROM gold GROUP BY id", f"WITH {_GOLD_D} SELECT id, count(DISTINCT path) AS paths, count(DISTINCT section) AS sections FROM gold GROUP BY id")
both("verified_items", r"SELECT DISTINCT id FROM questions WHERE style = 'behavior' AND NOT MATCHES(question, RX'`|[a-z]_[a-z]|--[a-z]|[A-Z]{3,}')")
both("split_leak", "SELECT a.component FROM (SELECT DISTINCT component FROM questions WHERE lower(trim(split)) = 'train') a WHERE a.component IN (SELECT component FROM questions WHERE lower(trim(split)) = 'test')")
both("job_matrix", """SELECT id, arm, rep, md5(concat(id, '|', arm, '|', CAST(rep AS STRING))) AS place FROM (SELECT DISTINCT id FROM questions WHERE lower(trim(split)) = 'test') q, (VALUES ('with'), ('without')) AS a(arm), (VALUES (1), (2), (3)) AS r(rep)""",
     """SELECT id, arm, rep, md5(concat(id, '|', arm, '|', CAST(rep AS VARCHAR))) AS place FROM (SELECT DISTINCT id FROM questions WHERE lower(trim(split)) = 'test') q, (VALUES ('with'), ('without')) AS a(arm), (VALUES (1), (2), (3)) AS r(rep)""")
both("quota_sample", "SELECT id, source, population FROM (SELECT id, source, count(*) OVER (PARTITION BY source) AS population, row_number() OVER (PARTITION BY source ORDER BY md5(concat('5|', id))) AS r FROM (SELECT DISTINCT id, source FROM questions)) WHERE r <= 20")
both("strata_hits", "SELECT source, style, count(*) AS n, round(avg(CAST(CASE WHEN multi THEN 1 ELSE 0 END AS DOUBLE)), 6) AS multi FROM (SELECT DISTINCT id, source, style, multi FROM questions) GROUP BY GROUPING SETS ((source), (source, style), ())")
both("src_reference_texts", """SELECT DISTINCT id, field, md5(said) AS said FROM (SELECT id, 'question' AS field, question AS said FROM questions UNION ALL SELECT id, 'answer', answer FROM questions UNION ALL SELECT id, 'evidence', EACH(evidence) FROM questions) WHERE said IS NOT NULL AND trim(said, ' ') <> ''""".replace("trim(said, ' ')", "regexp_replace(said, RX' ', ''/*g*/)"))
both("spec_problems", """SELECT source, problem FROM (SELECT source, CASE WHEN target_share IS NULL OR target_share <= 0 THEN 'no share' WHEN max_repeats > 3 THEN 'repeats too high' WHEN source NOT IN (SELECT source FROM documents WHERE source IS NOT NULL) THEN 'no documents' END AS problem FROM mix_targets) WHERE problem IS NOT NULL""")
both("allowlist_reject", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM mix_targets t WHERE t.source = d.source)")
both("source_for_path", """WITH c AS (SELECT DISTINCT component FROM docs WHERE component IS NOT NULL), p AS (SELECT source_file, EACH(transform(sequence(1, size(p) - 1), i -> array_join(slice(p, 1, i), '/'))) AS component FROM (SELECT DISTINCT source_file, split(source_file, '/') AS p FROM nodes WHERE source_file LIKE '%/%'))
    SELECT source_file, max_by(component, length(component)) AS owner FROM p JOIN c USING (component) GROUP BY source_file""",
     "SELECT n.source_file, max_by(c.component, length(c.component)) AS owner FROM (SELECT DISTINCT source_file FROM nodes WHERE source_file IS NOT NULL) n JOIN (SELECT DISTINCT component FROM docs WHERE component IS NOT NULL) c ON STARTS(n.source_file, concat(c.component, '/')) GROUP BY n.source_file")
both("prov_manifest", """SELECT t.source, t.target_share, coalesce(d.documents, 0) AS documents, coalesce(d.n_chars, 0) AS n_chars, md5(concat(t.source, '|', CAST(coalesce(d.documents, 0) AS STRING))) AS mark FROM mix_targets t LEFT JOIN (SELECT source, count(*) AS documents, CAST(sum(CHARS(text)) AS BIGINT) AS n_chars FROM documents GROUP BY source) d ON d.source = t.source""",
     """SELECT t.source, t.target_share, coalesce(d.documents, 0) AS documents, coalesce(d.n_chars, 0) AS n_chars, md5(concat(t.source, '|', CAST(coalesce(d.documents, 0) AS VARCHAR))) AS mark FROM mix_targets t LEFT JOIN (SELECT source, count(*) AS documents, CAST(sum(CHARS(text)) AS BIGINT) AS n_chars FROM documents GROUP BY source) d ON d.source = t.source""")
both("verify_manifest", """SELECT doc_id, problem FROM (SELECT doc_id, EACH(ARRAY(CASE WHEN n_chars IS NULL THEN 'no count' WHEN n_chars <> CHARS(text) THEN 'wrong count' END, CASE WHEN lang IS NULL THEN 'no language' END, CASE WHEN source IS NULL THEN 'no source' END)) AS problem FROM documents) WHERE problem IS NOT NULL""",
     """SELECT doc_id, problem FROM (SELECT doc_id, unnest([CASE WHEN n_chars IS NULL THEN 'no count' WHEN n_chars <> CHARS(text) THEN 'wrong count' END, CASE WHEN lang IS NULL THEN 'no language' END, CASE WHEN source IS NULL THEN 'no source' END]) AS problem FROM documents) WHERE problem IS NOT NULL""")
both("guard_path", r"SELECT DISTINCT path FROM docs WHERE MATCHES(lower(path), RX'\.bak\.|(^|/)archive/|-copy\.')")
both("guard_text", r"SELECT doc_id FROM documents WHERE MATCHES(lower(text), RX'(^|[^a-z0-9])(manifest|heartbeat)([^a-z0-9]|$)') AND MATCHES(lower(text), RX'(^|[^a-z0-9])quorum([^a-z0-9]|$)')")
both("decisions_for_hit", """WITH h AS (SELECT DISTINCT id, path, line_start, line_end FROM sections), d AS (SELECT path, line_start + 2 AS a, line_start + 6 AS b, id AS decision, added_at AS made FROM (SELECT DISTINCT id, path, line_start, added_at FROM sections))
    SELECT id, decision FROM (SELECT h.id, d.decision, row_number() OVER (PARTITION BY h.id ORDER BY d.made DESC, d.decision) AS r FROM h JOIN d ON h.path = d.path WHERE d.a IS NULL OR (d.a <= h.line_end AND d.b >= h.line_start)) WHERE r = 1""")
both("latest_decision", "SELECT path, id FROM (SELECT path, id, row_number() OVER (PARTITION BY path ORDER BY commit_time DESC NULLS LAST, id) AS r FROM (SELECT DISTINCT path, id, commit_time FROM docs)) WHERE r = 1")

_RANKED = _UNIT_SQL + """, own AS (SELECT vec_id, label FROM v),
    rel AS (SELECT query, rank - 1 AS rank, key, dense.label IS NOT DISTINCT FROM own.label AS relevant FROM dense JOIN own ON own.vec_id = query WHERE key <> query AND rank <= 11),
    first AS (SELECT query, min(CASE WHEN relevant THEN rank END) AS first FROM rel GROUP BY query)"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, rank, key, relevant): neighbours of another number, relevant if of the query's label."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label").distinct()
    d = dense(spark, sf_dir, 11).filter("key <> query").join(labels.withColumnsRenamed({"vec_id": "key", "label": "a"}), "key").join(labels.withColumnsRenamed({"vec_id": "query", "label": "b"}), "query")
    rank = F.col("rank") - 1
    return d.select("query", rank.alias("rank"), "key", F.col("a").eqNullSafe(F.col("b")).alias("relevant"))


@query("first_hit", _RANKED + " SELECT query, first FROM first WHERE first IS NOT NULL")
def first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.first_hits(_ranked(spark, sf_dir)).filter("first is not null")


@query("ir_metrics", _RANKED + """ SELECT count(*) AS queries, round(avg(CASE WHEN first <= 10 THEN 1 / log2(first + 1) ELSE 0 END), 6) AS ndcg10, round(avg(CAST(CASE WHEN first = 1 THEN 1 ELSE 0 END AS DOUBLE)), 6) AS recall1,
    round(avg(CAST(CASE WHEN first <= 10 THEN 1 ELSE 0 END AS DOUBLE)), 6) AS recall10, round(avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE / first ELSE 0 END), 6) AS mrr10 FROM first""")
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.single_gold(evaluate.first_hits(_ranked(spark, sf_dir)))


@query("public_ir", _RANKED + """, tot AS (SELECT label, count(*) - 1 AS n FROM v GROUP BY label), t AS (SELECT own.vec_id AS query, tot.n FROM own JOIN tot ON own.label IS NOT DISTINCT FROM tot.label),
    g AS (SELECT query, rank, relevant, sum(CASE WHEN relevant THEN 1 ELSE 0 END) OVER (PARTITION BY query ORDER BY rank) AS got FROM rel WHERE rank <= 10), m AS (SELECT g.*, n FROM g JOIN t USING (query))
    SELECT query, max(n) AS gold, CAST(sum(CASE WHEN relevant THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(coalesce(sum(CASE WHEN relevant THEN 1 ELSE 0 END) / nullif(max(n), 0)::DOUBLE, 0), 6) AS recall10,
    round(coalesce(sum(CASE WHEN relevant THEN got / CAST(rank AS DOUBLE) END) / nullif(least(max(n), 10), 0), 0), 6) AS map10, round(coalesce(1.0::DOUBLE / min(CASE WHEN relevant THEN rank END), 0), 6) AS mrr10,
    round(coalesce(sum(CASE WHEN relevant THEN 1 / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(generate_series(1, least(max(n), 10)), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg10 FROM m GROUP BY query""")
def public_ir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics with several relevant records: all other vectors of the query's label."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label").distinct()
    totals = v.groupBy(F.col("label").alias("l")).agg((F.count("*") - 1).alias("gold"))
    totals = v.join(totals, F.col("l").eqNullSafe(F.col("label"))).select(F.col("vec_id").alias("query"), "gold")
    out = evaluate.several_gold(_ranked(spark, sf_dir), totals)
    return out.select("query", "gold", "hits", *[F.round(c, 6).alias(c) for c in ("recall10", "map10", "mrr10", "ndcg10")])


@query("mode_table", of_all(_MODES_SQL) + ", " + _GOLD_D + r""", gs AS (SELECT DISTINCT id AS query, section FROM gold WHERE section IS NOT NULL AND id IN (SELECT id FROM asked)),
    fm AS (SELECT m.mode, m.query, min(CASE WHEN gs.section IS NOT NULL THEN m.rank END) AS first FROM modes m LEFT JOIN gs ON gs.query = m.query AND gs.section = m.key WHERE m.query IN (SELECT query FROM gs) GROUP BY ALL)
    SELECT mode, count(*) AS queries, round(avg(CASE WHEN first <= 10 THEN 1 / log2(first + 1) ELSE 0 END), 6) AS ndcg10, round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0 END), 6) AS recall1,
    round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0 END), 6) AS recall10, round(avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE / first ELSE 0 END), 6) AS mrr10 FROM fm GROUP BY mode""")
def mode_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mode over the questions that have a gold section."""
    gold = table(spark, sf_dir, "questions").select(F.col("id").alias("query"), F.explode("gold.section").alias("key")).filter("key is not null").distinct()
    ranked = by_mode(spark, sf_dir, asked).join(gold.select("query").distinct(), "query", "left_semi").join(gold.withColumn("gold", F.lit(True)), ["query", "key"], "left")
    first = ranked.groupBy("mode", "query").agg(F.min(F.when(F.col("gold"), F.col("rank"))).alias("first"))
    return evaluate.by_mode(first)


@query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired bootstrap of the gain of the first result over the second half of the ranking."""
    g = _ranked(spark, sf_dir).groupBy("query").agg((F.max(F.when(F.col("rank") <= 5, F.col("relevant").cast("double"))) - F.max(F.when(F.col("rank") > 5, F.col("relevant").cast("double")))).alias("diff"))
    return evaluate.bootstrap(g, "query")


_BM25_GOLD = BM25_SQL + ", " + _GOLD_D + """, g AS (SELECT DISTINCT id AS query, path FROM gold), p AS (SELECT DISTINCT id, path FROM sections),
    hit AS (SELECT bm25.query, count(DISTINCT CASE WHEN bm25.rank <= 5 THEN g.path END) AS at5, count(DISTINCT CASE WHEN bm25.rank <= 10 THEN g.path END) AS at10, any_value(coalesce(gn.n, 0)) AS groups FROM bm25 JOIN p ON p.id = bm25.key LEFT JOIN g ON g.query = bm25.query AND g.path = p.path LEFT JOIN (SELECT query, count(*) AS n FROM g GROUP BY query) gn ON gn.query = bm25.query GROUP BY bm25.query)"""


@query("group_recall", _BM25_GOLD + " SELECT query, groups, at5, at10, at10 = groups AND groups > 0 AS all10 FROM hit")
def group_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the gold documents of each question those among the first 5 and 10 sections, and whether the ten have all."""
    paths = table(spark, sf_dir, "sections").select(F.col("id").alias("key"), "path").distinct()
    gold = table(spark, sf_dir, "questions").select(F.col("id").alias("query"), F.explode("gold.path").alias("group")).distinct()
    return evaluate.group_hits(bm25(spark, sf_dir), paths.withColumnRenamed("path", "group"), gold)


@query("context_hits", _BM25_GOLD + " SELECT count(*) AS queries, CAST(sum(CASE WHEN at5 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS in5, CAST(sum(CASE WHEN at10 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS in10 FROM hit")
def context_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_recall(spark, sf_dir).agg(F.count("*").alias("queries"), F.sum((F.col("at5") > 0).cast("int")).alias("in5"), F.sum((F.col("at10") > 0).cast("int")).alias("in10"))


_MINED_SQL = BM25_SQL + ", " + _GOLD_D + r""", pos AS (SELECT DISTINCT g.id AS query, s.id AS positive FROM gold g JOIN s ON s.id = g.section JOIN asked a ON a.id = g.id),
    sh AS (SELECT id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS runs FROM (SELECT id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM s)),
    bad AS (SELECT DISTINCT b.query, b.key FROM bm25 b JOIN pos USING (query) JOIN sh x ON x.id = b.key JOIN sh y ON y.id = positive
        WHERE key = positive OR len(list_intersect(x.runs, y.runs)) > 0.5 * greatest(len(x.runs) + len(y.runs) - len(list_intersect(x.runs, y.runs)), 1)),
    good AS (SELECT b.query, b.rank, b.key FROM bm25 b WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.query = b.query AND bad.key = b.key)),
    comp AS (SELECT id, min(component) AS component FROM sections GROUP BY id), qcomp AS (SELECT id, min(component) AS component FROM questions GROUP BY id)"""


def _mined(spark: SparkSession, sf_dir: str, of: Query = every_20th) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(positives, texts, components of the sections, components of the questions) for the questions."""
    sections = sections_once(spark, sf_dir)
    asked_ = of(spark, sf_dir).select("query")
    gold = table(spark, sf_dir, "questions").select(F.col("id").alias("query"), F.explode("gold.section").alias("key")).distinct().join(asked_, "query", "left_semi")
    positives = stored(gold.join(sections.select(F.col("id").alias("key")), "key").select("query", "key"))
    scope = lambda t, name: table(spark, sf_dir, t).groupBy(F.col("id").alias(name)).agg(F.min("component").alias("scope"))
    return positives, sections.select(F.col("id").alias("key"), "text"), scope("sections", "key"), scope("questions", "query").join(asked_, "query", "left_semi")


@query("hard_negatives", of_all(_MINED_SQL) + """, m AS (SELECT good.*, coalesce(c.component = q.component, false) AS same FROM good LEFT JOIN comp c ON c.id = key LEFT JOIN qcomp q ON q.id = query WHERE rank <= 15),
    k AS (SELECT *, bool_or(same) OVER (PARTITION BY query) AS any_same FROM m), o AS (SELECT query, key, any_same, row_number() OVER (PARTITION BY query ORDER BY rank) AS position FROM k WHERE same OR NOT any_same)
    SELECT query, position, key AS section_id, CASE WHEN any_same THEN 'own' ELSE 'all' END AS scope FROM o WHERE position <= 10""")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of each question: the first 15 sections by keywords, without gold ones and near-copies of them, of its
    component alone if any is. A hash picks one of them, in the operator's column picked."""
    positives, texts, scopes, own = _mined(spark, sf_dir, asked)
    out = mining.hard_negatives(bm25(spark, sf_dir, 15, asked), positives, texts, scopes, own)
    return out.select("query", F.col("position").cast("bigint").alias("position"), F.col("key").alias("section_id"), "scope")


@query("neg_groups")
def neg_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each question with its seven negatives in order: the first of the 30 by keywords that aren't of a
    gold document or near-copies of one, then sections of the question's component in the order of a hash, then any others. Only where all
    sections but those are fewer, a group is shorter."""
    sections, questions = table(spark, sf_dir, "sections"), table(spark, sf_dir, "questions")
    asked_ = asked(spark, sf_dir).select("query").distinct()
    gold = questions.select(F.col("id").alias("query"), F.explode("gold.path").alias("path")).distinct().join(asked_, "query", "left_semi")
    positives = stored(gold.join(sections.select(F.col("id").alias("key"), "path"), "path").select("query", "key").distinct())
    texts = sections_once(spark, sf_dir).select(F.col("id").alias("key"), "text")
    scopes, own = (t.groupBy(F.col("id").alias(name)).agg(F.min("component").alias("scope")) for t, name in ((sections, "key"), (questions, "query")))
    own = own.join(asked_, "query", "left_semi")
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank")).cast("bigint")
    found = stored(mining.unlike_positives(bm25(spark, sf_dir, 30, asked), positives, texts).select("query", place.alias("position"), "key").filter(F.col("position") <= mining.GROUP))
    found = mining.padded(found, own.filter("scope is not null"), positives, scopes.filter("scope is not null"), ["scope"])
    found = mining.padded(found, asked_, positives, scopes.select("key"), [])
    g = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("position", "key"))).alias("n"))
    return asked_.join(g, "query", "left").select("query", F.coalesce(F.transform("n", lambda x: x["key"]), F.array().cast("array<string>")).alias("negatives"))


_KIND_SQL = _MINED_SQL + r""", att AS (SELECT id, min(doc_id) AS doc, min(component) AS component, min(path) AS path, len(regexp_extract_all(min(coalesce(text, '')), '[^ \t\r\n]+')) >= 25 AS long FROM sections GROUP BY id),
    qa AS (SELECT p.query, min(p.positive) AS positive FROM pos p GROUP BY p.query), qx AS (SELECT qa.*, a.doc, a.component, q.prose FROM qa JOIN att a ON a.id = positive JOIN (SELECT id, min(source) = 'handbook-qa' AS prose FROM questions GROUP BY id) q ON q.id = qa.query),
    kh AS (SELECT h.query, h.key, h.score, CASE WHEN a.doc = q.doc THEN 'sibling' WHEN a.component = q.component AND q.prose THEN 'book' WHEN a.component = q.component AND regexp_matches(lower(a.path), '(^|/)(changelog|changes|history|news|releases?)([./_-]|$)') THEN 'changelog'
        WHEN a.component = q.component THEN 'doc' END AS kind FROM hits h JOIN qx q USING (query) JOIN att a ON a.id = h.key WHERE a.long AND h.key <> q.positive),
    kc AS (SELECT query, kind, key, row_number() OVER (PARTITION BY query, kind ORDER BY round(score, 9) DESC, key) AS place FROM kh WHERE kind IS NOT NULL QUALIFY place <= 12)"""


def _kinds(spark: SparkSession, sf_dir: str, of: Query = every_20th) -> DataFrame:
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t\r\n]+"), lambda w: w != ""))
    keys = sections_once(spark, sf_dir, "doc_id", "component", "path", "text").withColumnsRenamed({"id": "key", "doc_id": "doc", "component": "scope"})
    keys = keys.select("key", "doc", "scope", F.lower("path").rlike(CHANGELOG).alias("changelog"), (n >= 25).alias("long"))
    positives = _mined(spark, sf_dir, of)[0].groupBy("query").agg(F.min("key").alias("positive"))
    prose = table(spark, sf_dir, "questions").groupBy(F.col("id").alias("query")).agg((F.min("source") == "handbook-qa").alias("prose"))
    queries = positives.join(prose, "query").join(keys.select(F.col("key").alias("positive"), "doc", "scope"), "positive")
    terms = index.asked_terms(of(spark, sf_dir).select("query", query_terms(F.col("question")).alias("terms")), "terms")
    return mining.candidates_by_kind(section_index(spark, sf_dir), terms, queries, keys)


@query("kind_candidates", _KIND_SQL + " SELECT query, kind, place, key FROM kc")
def kind_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every 20th question, where it has a gold section, by kind: siblings of its document, the component's change
    lists, other documents, or for handbook questions the rest of the book."""
    return _kinds(spark, sf_dir).withColumn("place", F.col("place").cast("bigint"))


@query("assemble_groups", of_all(_KIND_SQL) + """, o AS (SELECT *, CASE kind WHEN 'sibling' THEN 0 WHEN 'changelog' THEN 1 WHEN 'book' THEN 2 ELSE 3 END AS k FROM kc WHERE place <= CASE kind WHEN 'sibling' THEN 2 WHEN 'changelog' THEN 2 ELSE 7 END),
    a AS (SELECT query, key, kind, row_number() OVER (PARTITION BY query ORDER BY k, place, key) AS position FROM o QUALIFY position <= 7),
    f AS (SELECT g.query, g.key, row_number() OVER (PARTITION BY g.query ORDER BY g.rank) + coalesce(n, 0) AS position FROM good g JOIN qx USING (query) LEFT JOIN (SELECT query, count(*) AS n FROM a GROUP BY query) c ON c.query = g.query
        WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.query = g.query AND a.key = g.key)),
    u AS (SELECT query, position, key, kind FROM a UNION ALL SELECT query, position, key, 'fill' FROM f WHERE position <= 7)
    SELECT * FROM u WHERE query IN (SELECT query FROM u GROUP BY query HAVING count(*) = 7)""")
def assemble_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven negatives of each question with a gold section: by kind up to their caps, then from the keyword ranking."""
    positives, texts, _, _ = _mined(spark, sf_dir, asked)
    ranked = mining.unlike_positives(bm25(spark, sf_dir, of=asked), positives, texts).join(positives.select("query").distinct(), "query", "left_semi")
    out = mining.assemble(_kinds(spark, sf_dir, asked), ranked.select("query", F.col("rank").alias("place"), "key"))
    return out.withColumn("position", F.col("position").cast("bigint"))


both("kendall_tau", """WITH v AS (SELECT DISTINCT vec_id, label, CAST(element_at(embedding, 1) AS DOUBLE) AS a, CAST(element_at(embedding, 2) AS DOUBLE) AS b FROM embeddings WHERE vec_id % 20 = 0)
    SELECT x.label, round(avg(CAST(sign(x.a - y.a) * sign(x.b - y.b) AS DOUBLE)), 6) AS tau FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id GROUP BY x.label""",
     """WITH v AS (SELECT DISTINCT vec_id, label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings WHERE vec_id % 20 = 0)
    SELECT x.label, round(avg(CAST(sign(x.a - y.a) * sign(x.b - y.b) AS DOUBLE)), 6) AS tau FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id GROUP BY x.label""")
_FIVE = r"""WITH g AS (SELECT id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END)) AS s
        FROM (SELECT id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM (SELECT DISTINCT id, text FROM sections WHERE text IS NOT NULL))),
    c AS (SELECT s, min(id) AS rep FROM g GROUP BY s), e AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM c)"""  # fmt: skip


def _five(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = table(spark, sf_dir, "sections").select("id", "text").filter("text is not null").distinct()
    return similar.classes_of(s.select("id", shingle_hashes(unicode_words(F.col("text")), 5).alias("items")), "id", "items")


@query("near_dup_pairs", _FIVE + " SELECT a.rep AS id_a, b.rep AS id_b FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sections of a similarity of 0.8 in runs of five words, between the representatives of equal ones."""
    return similar.similar_sets(_five(spark, sf_dir)[1], 0.8).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))


@query("near_dup_members", _FIVE + " SELECT g.id, c.rep FROM g JOIN c ON g.s = c.s")
def near_dup_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sections each representative stands for."""
    return _five(spark, sf_dir)[0].select(F.col("key").alias("id"), "rep")


both("jaccard", r"""SELECT id, round(size(array_intersect(a, b)) / greatest(size(array_union(a, b)), 1), 6) AS jaccard FROM (SELECT DISTINCT id, array_distinct(regexp_extract_all(lower(question), r'[\p{L}\p{N}]+', 0)) AS a, array_distinct(regexp_extract_all(lower(answer), r'[\p{L}\p{N}]+', 0)) AS b FROM questions WHERE answer IS NOT NULL)""",
     r"""SELECT DISTINCT id, round(len(list_intersect(a, b)) / CAST(greatest(len(list_distinct(list_concat(a, b))), 1) AS DOUBLE), 6) AS jaccard FROM (SELECT id, list_distinct(regexp_extract_all(lower(question), '[\p{L}\p{N}]+')) AS a, list_distinct(regexp_extract_all(lower(answer), '[\p{L}\p{N}]+')) AS b FROM questions WHERE answer IS NOT NULL)""")
