"""Reports of judged runs, over a small table of runs made by a rule; the SQL reads the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import arms, evaluate
from docloom.plans.dialects import said
from docloom.plans.registry import query
from docloom.plans.search_queries import _SCORE_SQL, scored_pool, two_lists
from docloom.session import table

_KINDS = ["plain", "conflict-trap", "stale-trap"]
_COLUMNS = "arm, qid, rep, kind, correctness, flags_conflict, uses_stale_fact, hallucination, cites_source, turns, tool_calls, duration_ms, cost"
_TYPES = "arm string, qid string, rep int, kind string, correctness int, flags_conflict boolean, uses_stale_fact boolean, hallucination boolean, cites_source boolean, turns int, tool_calls int, duration_ms bigint, cost double"


def _run(a: int, q: int, r: int) -> tuple:
    x = (a * 7 + q * 5 + r * 3) % 11
    judged = x != 10
    return (
        ["without", "with", "more"][a], f"q{q}", r, _KINDS[q % 3], (x + a) % 3 if judged else None, x % 2 == 0 if judged else None, x % 4 == 0 if judged else None, x == 3 if judged else None, x % 3 != 0 if judged else None,
        None if x == 7 else 1 + x % 3, x, None if x == 5 else 900 * (1 + x), None if x == 2 else 0.125 * x,
    )


_RUNS = [_run(a, q, r) for a in range(3) for q in range(9) for r in range(1, 4)]
_SQL = f"WITH r AS ({said(_COLUMNS, _RUNS)})"


def _runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RUNS, _TYPES)


@query("arm_metrics", _SQL + """, j AS (SELECT * FROM r WHERE correctness IS NOT NULL), d AS (SELECT arm, list_sort(list(duration_ms / 1000.0::DOUBLE)) AS l FROM r WHERE duration_ms > 0 GROUP BY arm),
    m AS (SELECT arm, 'runs' AS metric, count(*)::DOUBLE AS value FROM r GROUP BY arm UNION ALL SELECT arm, 'correctness_mean', avg(correctness) FROM j GROUP BY arm UNION ALL SELECT arm, 'fully_correct', 100.0 * count(*) FILTER (WHERE correctness = 2) / count(*) FROM j GROUP BY arm
        UNION ALL SELECT arm, 'wrong', 100.0 * count(*) FILTER (WHERE correctness = 0) / count(*) FROM j GROUP BY arm UNION ALL SELECT arm, 'conflict_flagged', 100.0 * count(*) FILTER (WHERE flags_conflict) / count(*) FROM j WHERE kind = 'conflict-trap' GROUP BY arm
        UNION ALL SELECT arm, 'stale_as_current', 100.0 * count(*) FILTER (WHERE uses_stale_fact) / count(*) FROM j WHERE kind = 'stale-trap' GROUP BY arm UNION ALL SELECT arm, 'hallucination', 100.0 * count(*) FILTER (WHERE hallucination) / count(*) FROM j GROUP BY arm
        UNION ALL SELECT arm, 'cites_source', 100.0 * count(*) FILTER (WHERE cites_source) / count(*) FROM j GROUP BY arm UNION ALL SELECT arm, 'one_turn', 100.0 * count(*) FILTER (WHERE turns = 1) / count(*) FROM r GROUP BY arm
        UNION ALL SELECT arm, 'turns_median', median(coalesce(turns, 0)) FROM r GROUP BY arm UNION ALL SELECT arm, 'tool_calls_median', median(tool_calls) FROM r GROUP BY arm UNION ALL SELECT arm, 'seconds_median', median(duration_ms / 1000.0::DOUBLE) FROM r WHERE duration_ms > 0 GROUP BY arm
        UNION ALL SELECT arm, 'seconds_p90', l[CAST(round_even(0.9 * (len(l) - 1), 0) AS INT) + 1] FROM d UNION ALL SELECT arm, 'cost_mean', avg(coalesce(cost, 0)) FROM r GROUP BY arm UNION ALL SELECT arm, 'cost_total', sum(coalesce(cost, 0)) FROM r GROUP BY arm)
    SELECT arm, metric, round(value, 6) AS value FROM m""")
def arm_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arms.arm_metrics(_runs(spark)).withColumn("value", F.round("value", 6))


@query("paired_arms", _SQL + """, p AS (SELECT b.arm, sign(b.correctness - a.correctness) AS s FROM r a JOIN r b USING (qid, rep) WHERE a.arm = 'without' AND b.arm <> 'without' AND a.correctness IS NOT NULL AND b.correctness IS NOT NULL),
    c AS (SELECT arm, count(*) FILTER (WHERE s > 0) AS better, count(*) FILTER (WHERE s < 0) AS worse, count(*) FILTER (WHERE s = 0) AS same FROM p GROUP BY arm)
    SELECT arm, better, worse, same, round(least(1.0, 2 * list_sum(list_transform(generate_series(greatest(better, worse), better + worse), lambda i: factorial(CAST(better + worse AS INT))::DOUBLE / factorial(CAST(i AS INT))::DOUBLE / factorial(CAST(better + worse - i AS INT))::DOUBLE)) / pow(2, better + worse)), 5) AS p FROM c""")
def paired_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arms.paired_arms(_runs(spark), "without").withColumn("p", F.round("p", 5))


@query("question_spread", _SQL + " SELECT qid, arm, round(avg(correctness), 6) AS mean, (max(correctness) - min(correctness))::DOUBLE AS spread FROM r WHERE correctness IS NOT NULL GROUP BY qid, arm")
def question_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arms.question_spread(_runs(spark)).withColumn("mean", F.round("mean", 6))


_HAND = [("with|q1|1", " 2", "TRUE"), ("with|q2|1", "0", "false"), ("with|q3|1", "", "true"), ("more|q4|2", "1", None), ("gone|q1|1", "1", "true")]
_JUDGED = [("with|q1|1", 2, True), ("with|q2|1", 1, False), ("with|q3|1", 1, True), ("more|q4|2", 1, True)]


@query("judge_agreement", said("field, n, agree", [("correctness", 3, 2 / 3), ("cites", 3, 2 / 3)]))
def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    hand, judged = spark.createDataFrame(_HAND, "run string, correctness string, cites string"), spark.createDataFrame(_JUDGED, "run string, correctness int, cites boolean")
    return arms.agreement(hand, judged, ["correctness", "cites"])


@query("silent_failures", _SQL + ", c AS (SELECT qid, correctness, hallucination, count(*) AS n FROM r GROUP BY ALL) SELECT qid AS batch, CAST(sum(n) AS BIGINT) AS n, max(n) AS most FROM c GROUP BY qid HAVING 3 * max(n) > sum(n)")
def silent_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arms.silent_failures(_runs(spark), "qid", ["correctness", "hallucination"])


@query("latency_profile", "WITH t AS (SELECT event_type AS stage, value AS seconds FROM events WHERE value IS NOT NULL) SELECT stage, count(*) AS n, round(quantile_cont(seconds, 0.5), 6) AS median, round(quantile_cont(seconds, 0.9), 6) AS p90, round(sum(seconds) / (SELECT sum(seconds) FROM t), 6) AS share FROM t GROUP BY stage")
def latency_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' values as seconds of their kind."""
    out = arms.latency_profile(table(spark, sf_dir, "events").filter("value is not null").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds")))
    return out.select("stage", "n", *[F.round(c, 6).alias(c) for c in ("median", "p90", "share")])


_GOLD = [("r1", "a", 0, 3, "file"), ("r1", "a", 5, 6, "symbol"), ("r1", "b", 1, 2, "file"), ("r2", "c", 0, 1, "symbol"), ("r2", "c", 4, 6, "file"), ("r2", "c", 0, 1, "symbol")]
_PRED = [("r1", "a", 0, 3, "file"), ("r1", "a", 5, 6, "file"), ("r1", "a", 20, 22, "file"), ("r2", "c", 0, 1, "symbol"), ("r2", "c", 7, 8, "other"), ("r2", "d", 0, 1, "file")]
_SPANS_SQL = f"""WITH g AS (SELECT DISTINCT * FROM ({said("repo, doc, first, last, label", _GOLD)})), p AS (SELECT DISTINCT * FROM ({said("repo, doc, first, last, label", _PRED)}) WHERE NOT (repo = 'r1' AND doc = 'a' AND first < 25 AND last > 21)),
    t AS (SELECT coalesce(p.repo, g.repo) AS repo, coalesce(p.label, g.label) AS label, p.repo IS NOT NULL AS is_p, g.repo IS NOT NULL AS is_g FROM p FULL JOIN g ON p.repo = g.repo AND p.doc = g.doc AND p.first = g.first AND p.last = g.last AND p.label = g.label),
    b AS (SELECT p.repo IS NOT NULL AS is_p, g.repo IS NOT NULL AS is_g FROM (SELECT DISTINCT repo, doc, first, last FROM p) p FULL JOIN (SELECT DISTINCT repo, doc, first, last FROM g) g ON p.repo = g.repo AND p.doc = g.doc AND p.first = g.first AND p.last = g.last),
    u AS (SELECT 'typed' AS level, '' AS name, is_p, is_g FROM t UNION ALL SELECT 'boundary', '', * FROM b UNION ALL SELECT 'label', label, is_p, is_g FROM t UNION ALL SELECT 'repo', repo, is_p, is_g FROM t),
    c AS (SELECT level, name, count(*) FILTER (WHERE is_p AND is_g) AS tp, count(*) FILTER (WHERE is_p AND NOT is_g) AS fp, count(*) FILTER (WHERE NOT is_p AND is_g) AS fn FROM u GROUP BY ALL)
    SELECT *, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM c"""


@query("prf_by_label", _SPANS_SQL)
def prf_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "repo string, doc string, first int, last int, label string"
    ignored = spark.createDataFrame([("r1", "a", 21, 25)], "repo string, doc string, first int, last int")
    out = arms.span_scores(spark.createDataFrame(_PRED, kind), spark.createDataFrame(_GOLD, kind), ignored)
    return out.select("level", "name", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_SCORERS_SQL = _SCORE_SQL + """, z AS (SELECT query, key, round(score, 9) AS words, round(coalesce((SELECT max(l.score) FROM lists l WHERE l.query = sc.query AND l.key = sc.key AND list = 1), 0), 9) AS cosine FROM sc),
    v AS (SELECT query, key, 'words' AS scorer, words AS score FROM z UNION ALL SELECT query, key, 'cosine', cosine FROM z), su AS (SELECT id, min(source) AS suite FROM questions GROUP BY id),
    rk AS (SELECT suite, v.*, row_number() OVER (PARTITION BY v.query, scorer ORDER BY score DESC, key) AS rank FROM v JOIN su ON su.id = v.query), go AS (SELECT DISTINCT id AS query, g.section AS key FROM (SELECT id, unnest(gold) AS g FROM questions)),
    e AS (SELECT suite, rk.query, scorer, min(CASE WHEN go.key IS NOT NULL THEN rank END) AS found, max(CASE WHEN rank = 1 THEN rk.key END) AS top FROM rk LEFT JOIN go ON go.query = rk.query AND go.key = rk.key GROUP BY ALL),
    eb AS (SELECT e.*, b.top AS base_top FROM e LEFT JOIN e b ON b.query = e.query AND b.scorer = 'words')
    SELECT coalesce(suite, '') AS suite, scorer, count(*) AS queries, round(avg(CASE WHEN found <= 10 THEN 1 / log2(found + 1) ELSE 0 END), 6) AS ndcg10, round(avg(CASE WHEN top IS NOT DISTINCT FROM base_top THEN 1.0 ELSE 0 END), 6) AS same_first FROM eb GROUP BY GROUPING SETS ((suite, scorer), (scorer))"""


@query("scorer_compare", _SCORERS_SQL)
def scorer_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scorers of each question's pool, the shared words and the cosine, by suite and for all."""
    cosine = two_lists(spark, sf_dir).filter("list = 1").select("query", "key", F.col("score").alias("cosine"))
    pool = scored_pool(spark, sf_dir).join(cosine, ["query", "key"], "left").join(table(spark, sf_dir, "questions").groupBy(F.col("id").alias("query")).agg(F.min("source").alias("suite")), "query")
    each = F.explode(F.create_map(F.lit("words"), F.round("score", 9), F.lit("cosine"), F.round(F.coalesce("cosine", F.lit(0.0)), 9)))
    scores = pool.select("suite", "query", "key", each.alias("scorer", "score"))
    gold = table(spark, sf_dir, "questions").select(F.col("id").alias("query"), F.explode("gold.section").alias("key")).filter("key is not null")
    out = arms.compare_scorers(scores, gold, "words")
    return out.select("suite", "scorer", "queries", F.round("ndcg10", 6).alias("ndcg10"), F.round("same_first", 6).alias("same_first"))


@query("sign_test", _SQL + """, p AS (SELECT b.correctness - a.correctness AS d FROM r a JOIN r b USING (qid, rep) WHERE a.arm = 'without' AND b.arm = 'with'), c AS (SELECT count(*) FILTER (WHERE d > 0) AS better, count(*) FILTER (WHERE d < 0) AS worse FROM p)
    SELECT better, worse, round(least(1.0, 2 * list_sum(list_transform(generate_series(greatest(better, worse), better + worse), lambda i: factorial(CAST(better + worse AS INT))::DOUBLE / factorial(CAST(i AS INT))::DOUBLE / factorial(CAST(better + worse - i AS INT))::DOUBLE)) / pow(2, better + worse)), 5) AS p FROM c""")
def sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark)
    pairs = runs.filter("arm = 'without'").select("qid", "rep", F.col("correctness").alias("a")).join(runs.filter("arm = 'with'").select("qid", "rep", F.col("correctness").alias("b")), ["qid", "rep"])
    return evaluate.sign_test(pairs.select((F.col("b") - F.col("a")).alias("diff"))).withColumn("p", F.round("p", 5))
