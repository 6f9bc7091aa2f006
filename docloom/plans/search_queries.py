"""Retrieval over sections (questions as queries) and over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import STOP_WORDS, query_terms
from docloom.operators import index, models, search
from docloom.operators.documents import each_text
from docloom.plans.dialects import both
from docloom.plans.porter_sql import stem_ctes
from docloom.plans.registry import Query, query
from docloom.session import once, stored, table

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOK = r"list_filter(regexp_extract_all(lower(regexp_replace({}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+'), lambda t: length(t) > 1)"
_FOLDED = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"

#: Searches take as queries all questions that have an id, against all sections. Some reports over them take only every
#: question whose number is divisible by 20; their SQL is stated so, and of_all() states it for all questions.
_ALL = "asked AS (SELECT DISTINCT id, question FROM questions WHERE id IS NOT NULL)"
_EVERY_20TH = "asked AS (SELECT DISTINCT id, question FROM questions WHERE CAST(regexp_extract(id, '[0-9]+$') AS BIGINT) % 20 = 0)"
ASKED_SQL = r"""
    """ + _EVERY_20TH + r""",
    qt AS (SELECT DISTINCT id AS query, unnest(""" + _TOK.format("question") + r""") AS word FROM asked),
    s AS (SELECT id, min(heading_path) AS heading_path, min(text) AS text FROM sections GROUP BY id),
    each AS (SELECT id, 2.0::DOUBLE AS w, unnest(""" + _FOLDED.format("heading_path") + r""") AS word FROM s UNION ALL SELECT id, 1.0, unnest(""" + _FOLDED.format("text") + r""") FROM s),
    vocabulary AS (SELECT DISTINCT word FROM (SELECT word FROM each UNION ALL SELECT word FROM qt)), """ + stem_ctes("vocabulary") + r""",
    terms AS (SELECT DISTINCT query, stem AS term FROM qt JOIN stems USING (word) WHERE word NOT IN (""" + _STOP + r"""))"""

BM25_SQL = "WITH " + ASKED_SQL + r""",
    post AS (SELECT id, stem AS term, sum(w) AS tf FROM each JOIN stems USING (word) GROUP BY ALL),
    len AS (SELECT s.id, coalesce(n, 0) AS dl FROM s LEFT JOIN (SELECT id, count(*) AS n FROM each GROUP BY id) USING (id)),
    n AS (SELECT count(*) AS n, sum(dl) AS total FROM len),
    df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    hits AS (SELECT query, post.id AS key, sum(
            CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END
            * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (total / n)))) AS score
        FROM terms JOIN post USING (term) JOIN df USING (term) JOIN len ON len.id = post.id CROSS JOIN n GROUP BY ALL),
    bm25 AS (SELECT * FROM (SELECT query, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, key) AS rank, key, score FROM hits) WHERE rank <= 50)"""  # fmt: skip


def of_all(sql: str) -> str:
    return sql.replace(_EVERY_20TH, _ALL)


def sections_once(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """(id, *columns), heading_path and text unless said otherwise: one row a section, of each column the least value. Only
    the rows of ids that stand more than once are shuffled; those ids are few, and where they aren't, the planner joins."""
    columns = columns or ("heading_path", "text")
    rows = table(spark, sf_dir, "sections").select("id", *columns)
    again = once(spark, ("again", sf_dir), lambda: stored(table(spark, sf_dir, "sections").groupBy(F.col("id").alias("again")).count().filter("count > 1").select("again"), 1))
    same = F.col("id").eqNullSafe(F.col("again"))
    several = rows.join(again, same, "left_semi").groupBy("id").agg(*[F.min(c).alias(c) for c in columns])
    return rows.join(again, same, "left_anti").union(several)


def section_index(spark: SparkSession, sf_dir: str) -> index.KeywordIndex:
    """The keyword index of the sections, built once a session."""
    return once(spark, ("index", sf_dir), lambda: index.build(sections_once(spark, sf_dir), "id", {"heading_path": 2.0, "text": 1.0}))


def section_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, v) of the sections by the stand-in encoder, encoded once a session."""
    said = F.concat(F.coalesce("heading_path", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return once(spark, ("vectors", sf_dir), lambda: stored(models.embed(sections_once(spark, sf_dir).select("id", said.alias("said")), "id", "said", models.Letters())))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, question) of all questions; one without an id has no key that its results could stand under."""
    return table(spark, sf_dir, "questions").filter("id is not null").select(F.col("id").alias("query"), "question").distinct()


def every_20th(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).filter(F.regexp_extract("query", "[0-9]+$", 0).cast("bigint") % 20 == 0)


def bm25(spark: SparkSession, sf_dir: str, k: int = search.DEPTH, of: Query = every_20th) -> DataFrame:
    terms = index.asked_terms(of(spark, sf_dir).select("query", query_terms(F.col("question")).alias("terms")), "terms")
    return index.rank(section_index(spark, sf_dir), terms, k)


@query("bm25_topk", of_all(BM25_SQL) + " SELECT query, rank, key AS section_id, round(score, 6) AS score FROM bm25 WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(spark, sf_dir, 10, asked).select("query", "rank", F.col("key").alias("section_id"), F.round("score", 6).alias("score"))


@query("keyword_index", "WITH " + ASKED_SQL + " SELECT stem AS term, count(DISTINCT id) AS df, sum(w) AS tf FROM each JOIN stems USING (word) GROUP BY stem")
def keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of the stored index with their number of sections and weighted frequency."""
    i = section_index(spark, sf_dir)
    return i.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


# Embeddings: every vector whose number is divisible by 20 is a query against all vectors.
_UNIT_SQL = """WITH v AS (SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    dense AS (SELECT * FROM (SELECT query, key, label, cosine, row_number() OVER (PARTITION BY query ORDER BY round(cosine, 9) DESC, key) AS rank
        FROM (SELECT q.vec_id AS query, v.vec_id AS key, v.label, round(list_cosine_similarity(q.e, v.e), 9) AS cosine FROM v q, v WHERE q.vec_id % 20 = 0)) WHERE rank <= 50)"""


def dense(spark: SparkSession, sf_dir: str, k: int = search.DEPTH) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").distinct()
    return search.dense_topk(v.select(F.col("vec_id").alias("key"), F.col("embedding").alias("v")), v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v")), k)


@query("dense_topk", _UNIT_SQL + " SELECT query, rank, key, round(cosine, 6) AS score FROM dense WHERE rank <= 20")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir, 20).withColumn("score", F.round("score", 6))


def two_lists(spark: SparkSession, sf_dir: str, of: Query = every_20th) -> DataFrame:
    """The two rankings of all sections for each of the questions, by keywords (list 0) and by vectors (list 1), 50 deep, as
    (query, list, key, rank, score)."""

    def ranked() -> DataFrame:
        queries = models.embed(of(spark, sf_dir), "query", "question", models.Letters()).withColumnRenamed("key", "query")
        dense_ = search.dense_topk(section_vectors(spark, sf_dir), queries)
        return stored(bm25(spark, sf_dir, of=of).select("query", F.lit(0).alias("list"), "key", "rank", "score").union(dense_.select("query", F.lit(1), "key", "rank", "score")))

    return once(spark, ("lists", sf_dir, of.__name__), ranked)


_LETTERS = "[" + ", ".join(f"CAST(length({{0}}) - length(replace({{0}}, '{c}', '')) AS DOUBLE)" for c in "abcdefghijklmnopqrstuvwxyz") + "]"
_LISTS_SQL = BM25_SQL + ", qv AS (SELECT id, " + _LETTERS.format("x") + " AS v FROM (SELECT id, lower(question) AS x FROM asked)), sv AS (SELECT id, " + _LETTERS.format("x") + r""" AS v FROM (SELECT id, lower(concat(coalesce(heading_path, ''), chr(10), coalesce(text, ''))) AS x FROM s)),
    cosines AS (SELECT qv.id AS query, sv.id AS key, coalesce(CASE WHEN list_sum(qv.v) > 0 AND list_sum(sv.v) > 0 THEN list_cosine_similarity(qv.v, sv.v) END, 0) AS score FROM qv, sv),
    dense AS (SELECT * FROM (SELECT query, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, key) AS rank, key, score FROM cosines) WHERE rank <= 50),
    lists AS (SELECT query, 0 AS list, key, rank, score FROM bm25 UNION ALL SELECT query, 1, key, rank, score FROM dense)"""
_HYBRID_SQL = _LISTS_SQL + """, f AS (SELECT query, key, sum(1.0 / (60 + rank)) AS score, min(list * 1000 + rank) AS first FROM lists GROUP BY ALL),
    h AS (SELECT query, key, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, first) AS rank FROM f)"""


def hybrid(lists: DataFrame) -> DataFrame:
    return search.rrf(lists.withColumn("weight", F.lit(1.0)))


@query("rrf_fusion", of_all(_HYBRID_SQL) + " SELECT query, rank, key, round(score, 6) AS score FROM h")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid(two_lists(spark, sf_dir, asked)).withColumn("score", F.round("score", 6))


#: Symbols as records of their own: their label and file.
_CODE_SQL = _LISTS_SQL + r""", c AS (SELECT id, min(coalesce(label, '') || ' ' || coalesce(source_file, '')) AS said FROM nodes GROUP BY id),
    ceach AS (SELECT id, unnest(""" + _FOLDED.format("said") + r""") AS word FROM c), cq AS (SELECT DISTINCT query, word FROM qt WHERE word NOT IN (""" + _STOP + r""")),
    cv AS (SELECT DISTINCT word FROM (SELECT word FROM ceach UNION ALL SELECT word FROM cq)), """ + stem_ctes("cv", "cstems").replace("p0 ", "r0 ").replace("p0)", "r0)").replace("p1 ", "r1 ").replace("p1)", "r1)").replace("p2 ", "r2 ").replace("p2)", "r2)").replace("p3 ", "r3 ").replace("p3)", "r3)").replace("p4 ", "r4 ").replace("p4)", "r4)").replace("p5 ", "r5 ").replace("p5)", "r5)").replace("p6 ", "r6 ").replace("p6)", "r6)").replace("p7 ", "r7 ").replace("p7)", "r7)") + r""",
    cterms AS (SELECT DISTINCT query, stem AS term FROM cq JOIN cstems USING (word)), cpost AS (SELECT id, stem AS term, count(*)::DOUBLE AS tf FROM ceach JOIN cstems USING (word) GROUP BY ALL),
    clen AS (SELECT c.id, coalesce(n, 0) AS dl FROM c LEFT JOIN (SELECT id, count(*) AS n FROM ceach GROUP BY id) USING (id)), cn AS (SELECT count(*) AS n, sum(dl) AS total FROM clen), cdf AS (SELECT term, count(*) AS df FROM cpost GROUP BY term),
    chits AS (SELECT query, cpost.id AS key, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (total / n)))) AS score
        FROM cterms JOIN cpost USING (term) JOIN cdf USING (term) JOIN clen ON clen.id = cpost.id CROSS JOIN cn GROUP BY ALL),
    cvec AS (SELECT id, """ + _LETTERS.format("x") + r""" AS v FROM (SELECT id, lower(said) AS x FROM c)),
    ccos AS (SELECT qv.id AS query, cvec.id AS key, coalesce(CASE WHEN list_sum(qv.v) > 0 AND list_sum(cvec.v) > 0 THEN list_cosine_similarity(qv.v, cvec.v) END, 0) AS score FROM qv, cvec),
    four AS (SELECT query, list, 'text:' || key AS key, rank, 1.4 AS w FROM lists
        UNION ALL SELECT * FROM (SELECT query, 2 AS list, 'code:' || key, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, key) AS rank, 0.6 FROM chits) WHERE rank <= 50
        UNION ALL SELECT * FROM (SELECT query, 3 AS list, 'code:' || key, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, key) AS rank, 0.6 FROM ccos) WHERE rank <= 50),
    f AS (SELECT query, key, sum(w / (60 + rank)) AS score, min(list * 1000 + rank) AS first FROM four GROUP BY ALL)"""


@query("four_list_rrf", of_all(_CODE_SQL) + " SELECT query, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, first) AS rank, key, round(score, 6) AS score FROM f")
def four_list_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of the keyword and the vector ranking of sections and of symbols, texts at trust 0.7 and code at 0.3, each
    weight doubled."""
    code = table(spark, sf_dir, "nodes").select("id", F.concat(F.coalesce("label", F.lit("")), F.lit(" "), F.coalesce("source_file", F.lit(""))).alias("said")).groupBy("id").agg(F.min("said").alias("said"))
    terms = index.asked_terms(asked(spark, sf_dir).select("query", query_terms(F.col("question")).alias("terms")), "terms")
    words = index.rank(index.build(code, "id", {"said": 1.0}), terms)
    queries = models.embed(asked(spark, sf_dir), "query", "question", models.Letters()).withColumnRenamed("key", "query")
    near = search.dense_topk(stored(models.embed(code, "id", "said", models.Letters())), queries)
    of = lambda df, n, kind, w: df.select("query", (F.lit(n) if isinstance(n, int) else F.col(n)).alias("list"), F.concat(F.lit(kind), "key").alias("key"), "rank", F.lit(w).alias("weight"))
    lists = of(two_lists(spark, sf_dir, asked), "list", "text:", 1.4).union(of(words, 2, "code:", 0.6)).union(of(near, 3, "code:", 0.6))
    return search.rrf(lists).withColumn("score", F.round("score", 6))


@query("rerank_pool", of_all(_LISTS_SQL) + """, f AS (SELECT query, key, min(list * 1000 + rank) AS first FROM lists WHERE rank <= 30 GROUP BY ALL)
    SELECT query, row_number() OVER (PARTITION BY query ORDER BY first) AS position, key FROM f""")
def rerank_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ordered_union(two_lists(spark, sf_dir, asked), search.POOL)


@query("candidates", _LISTS_SQL + """, f AS (SELECT query, key, min(list * 1000 + rank) AS first FROM lists WHERE rank <= 50 GROUP BY ALL)
    SELECT query, row_number() OVER (PARTITION BY query ORDER BY first) AS position, key FROM f""")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ordered_union(two_lists(spark, sf_dir), search.DEPTH)


_GATE_SQL = _HYBRID_SQL + """, gate AS (SELECT query, max(CASE WHEN list = 0 THEN key END) AS first_bm25, max(CASE WHEN list = 1 THEN key END) AS first_dense, coalesce(max(CASE WHEN list = 0 THEN key END) = max(CASE WHEN list = 1 THEN key END), false) AS agree
    FROM lists WHERE rank = 1 GROUP BY query)"""


def gated(lists: DataFrame) -> DataFrame:
    """(query, first_bm25, first_dense, agree); a list without a first result agrees with nothing."""
    first = lists.filter("rank = 1").groupBy("query").agg(F.max(F.when(F.col("list") == 0, F.col("key"))).alias("first_bm25"), F.max(F.when(F.col("list") == 1, F.col("key"))).alias("first_dense"))
    return first.withColumn("agree", F.coalesce(F.col("first_bm25") == F.col("first_dense"), F.lit(False)))


@query("rerank_gate", _GATE_SQL + " SELECT * FROM gate")
def rerank_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query, whether both rankings have the same first result, so that the costly scorer isn't needed."""
    return gated(two_lists(spark, sf_dir))


@query("rerank_share", of_all(_GATE_SQL) + " SELECT count(*) AS queries, round(avg(CASE WHEN agree THEN 0.0 ELSE 1.0 END), 6) AS reranked FROM gate")
def rerank_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(two_lists(spark, sf_dir, asked)).agg(F.count("*").alias("queries"), F.round(F.avg(F.when(F.col("agree"), 0.0).otherwise(1.0)), 6).alias("reranked"))


# The scorer: the share of the question's words in the better of two windows of 384 words of a section.
_SPLIT = r"list_filter(regexp_split_to_array({}, '[ \t\r\n]'), lambda x: x <> '')"
_SCORE_SQL = _GATE_SQL + """, pool AS (SELECT query, key, min(list * 1000 + rank) AS first FROM lists WHERE rank <= 30 GROUP BY ALL),
    w AS (SELECT query, key, first, list_distinct(""" + _SPLIT.format("lower(question)") + ") AS q, " + _SPLIT.format("coalesce(text, '')") + """ AS l FROM pool JOIN asked ON asked.id = pool.query JOIN s ON s.id = pool.key),
    sc AS (SELECT query, key, first, greatest(len(list_intersect(q, list_transform(l[1:384], lambda x: lower(x)))), CASE WHEN len(l) > 384 THEN len(list_intersect(q, list_transform(l[257:640], lambda x: lower(x)))) ELSE 0 END) / CAST(greatest(len(q), 1) AS DOUBLE) AS score FROM w)"""


def scored_pool(spark: SparkSession, sf_dir: str, of: Query = every_20th) -> DataFrame:
    """(query, key, position, score) of the pool of each question by the stand-in scorer, scored once a session."""

    def run() -> DataFrame:
        pool = stored(search.ordered_union(two_lists(spark, sf_dir, of), search.POOL))
        texts = sections_once(spark, sf_dir, "text").withColumnRenamed("id", "key").join(pool.select("key").distinct(), "key", "left_semi")
        pairs = pool.join(of(spark, sf_dir), "query").join(texts, "key")  # texts last, so that they are shuffled once
        return stored(models.score(pairs, models.SharedWords()).join(pool, ["query", "key"]).select("query", "key", "position", "score"))

    return once(spark, ("pool", sf_dir, of.__name__), run)


@query("pool_scores", _SCORE_SQL + " SELECT query, key, round(score, 6) AS score FROM sc")
def pool_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_pool(spark, sf_dir).select("query", "key", F.round("score", 6).alias("score"))


@query("score_cache", _SCORE_SQL + """, t AS (SELECT DISTINCT question, coalesce(text, '') AS text, rank FROM lists JOIN asked ON asked.id = query JOIN s ON s.id = key WHERE rank <= 2 AND list = 0),
    c AS (SELECT question, text, min(rank) AS rank FROM t GROUP BY ALL)
    SELECT (SELECT count(*) FROM c WHERE rank = 1) AS first_scored, (SELECT count(*) FROM c WHERE rank = 2) AS then_scored, (SELECT count(*) FROM c) AS held, least((SELECT count(*) FROM c), 50) AS kept""")
def score_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns through the cache, over the best and over the two best sections of each question: the second scores only
    what the first hasn't. Of what is held then, at most 50 are kept."""
    texts = sections_once(spark, sf_dir, "text").withColumnRenamed("id", "key")
    pairs = stored(two_lists(spark, sf_dir).filter("list = 0 and rank <= 2").join(every_20th(spark, sf_dir), "query").join(texts, "key"))
    _, one, cache = models.score_cached(pairs.filter("rank = 1"), models.SharedWords(), None, 1)
    _, two, cache = models.score_cached(pairs, models.SharedWords(), cache, 2)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    out = count(one, "first_scored")
    for df, name in ((two, "then_scored"), (cache, "held"), (models.newest(cache, 50), "kept")):
        out = out.crossJoin(F.broadcast(count(df, name)))  # one row each
    return out


@query("length_batches", _SCORE_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """, nn AS (SELECT query, key, first, greatest(1, least(len(l), 384)) AS n FROM w),
    o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n, first) AS r FROM nn),
    g AS (SELECT query, r, n, 0 AS batch, 1 AS held FROM o WHERE r = 1 UNION ALL
        SELECT o.query, o.r, o.n, CASE WHEN (g.held + 1) * o.n <= 2048 THEN g.batch ELSE g.batch + 1 END, CASE WHEN (g.held + 1) * o.n <= 2048 THEN g.held + 1 ELSE 1 END FROM g JOIN o ON o.query = g.query AND o.r = g.r + 1)
    SELECT query, batch, count(*) AS texts, CAST(max(n) AS BIGINT) AS longest FROM g GROUP BY ALL""")
def length_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The padded batches in which each question's pool is scored, by the first window of its texts. A pool is at most 60
    texts, so gathering it is bounded."""
    texts = sections_once(spark, sf_dir).select(F.col("id").alias("key"), F.greatest(F.lit(1), F.least(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t\r\n]"), lambda x: x != "")), F.lit(models.WINDOW))).alias("n"))
    pools = search.ordered_union(two_lists(spark, sf_dir), search.POOL).join(texts, "key").groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "n"))), lambda x: x["n"]).alias("lengths"))
    cut = lambda query_, lengths: [(query_, i, len(b), max(lengths[j] for j in b)) for i, b in enumerate(models.batches_by_length(lengths))]
    return each_text(pools, ["query", "lengths"], "query string, batch int, texts bigint, longest bigint", cut)


_MODES_SQL = _SCORE_SQL + """, r AS (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, first) AS rank FROM sc),
    rr AS (SELECT h.query, h.key, row_number() OVER (PARTITION BY h.query ORDER BY r.rank IS NULL, r.rank, h.rank) AS rank FROM h LEFT JOIN r USING (query, key)),
    l3 AS (SELECT query, list, key, rank FROM lists UNION ALL SELECT query, 2, key, rank FROM r),
    a AS (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY round(sum(1.0 / (60 + rank)), 9) DESC, min(list * 1000 + rank)) AS rank FROM l3 GROUP BY query, key),
    modes AS (SELECT query, 'bm25' AS mode, rank, key FROM lists WHERE list = 0 UNION ALL SELECT query, 'dense', rank, key FROM lists WHERE list = 1 UNION ALL SELECT query, 'hybrid', rank, key FROM h UNION ALL SELECT query, 'fast', rank, key FROM h
        UNION ALL SELECT query, 'rerank', rank, key FROM rr UNION ALL SELECT query, 'all', rank, key FROM a
        UNION ALL SELECT query, 'accurate', h.rank, key FROM h JOIN gate USING (query) WHERE agree UNION ALL SELECT query, 'accurate', rr.rank, key FROM rr JOIN gate USING (query) WHERE NOT agree)"""


def by_mode(spark: SparkSession, sf_dir: str, of: Query = every_20th) -> DataFrame:
    """(query, mode, rank, key) of every mode, the one that users call fast beside hybrid. The scorer is a stand-in; only
    queries whose two rankings disagree need it in mode accurate."""
    return search.by_mode(two_lists(spark, sf_dir, of), scored_pool(spark, sf_dir, of))


@query("rank_modes", of_all(_MODES_SQL) + " SELECT * FROM modes WHERE rank <= 10")
def rank_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_mode(spark, sf_dir, asked).filter("rank <= 10")


@query("auto_k", _UNIT_SQL + """, z AS (SELECT query, rank, exp(cosine * 20 / 0.75 - max(cosine * 20 / 0.75) OVER (PARTITION BY query)) AS w FROM dense),
    m AS (SELECT query, rank, sum(w) OVER (PARTITION BY query ORDER BY rank ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY query) AS m FROM z)
    SELECT query, CAST(coalesce(min(CASE WHEN rank <= 5 AND round(m, 9) >= 0.94 THEN rank END), 5) AS BIGINT) AS k FROM m GROUP BY query""")
def auto_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.auto_k(dense(spark, sf_dir).withColumnRenamed("score", "cosine"))


@query("cross_domain_merge", """WITH v AS (SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    d AS (SELECT query, domain, key, cosine, row_number() OVER (PARTITION BY query, domain ORDER BY round(cosine, 9) DESC, key) AS rank FROM (SELECT q.vec_id AS query, v.label AS domain, v.vec_id AS key, round(list_cosine_similarity(q.e, v.e), 9) AS cosine FROM v q, v WHERE q.vec_id % 20 = 0 AND v.label IS NOT NULL) QUALIFY rank <= 50),
    f AS (SELECT query, domain, key, rank, min(cosine) OVER (PARTITION BY query, domain ORDER BY rank ROWS UNBOUNDED PRECEDING) AS floor FROM d)
    SELECT query, rank, CAST(domain AS VARCHAR) AS domain, key, floor FROM (SELECT query, row_number() OVER (PARTITION BY query ORDER BY round(floor, 9) DESC, rank, CAST(domain AS VARCHAR), key) AS rank, domain, key, round(floor, 6) AS floor FROM f) WHERE rank <= 10""")
def cross_domain_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label as a domain with a search of its own; one list by the least cosine so far within the domain."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("domain")).distinct()
    domains = sorted(r[0] for r in v.select("domain").filter("domain is not null").distinct().collect())  # the registry of domains
    vectors = v.select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"), "domain")
    hits = search.dense_by_domain(vectors, v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v")), domains)
    return search.cross_domain_merge(hits.withColumnRenamed("score", "cosine"), 10).withColumn("floor", F.round("floor", 6))


@query("prompt_gate", _LISTS_SQL + r""", b AS (SELECT query, max(score) AS cosine FROM lists WHERE list = 1 GROUP BY query), p AS (SELECT id AS query, question AS text FROM asked UNION ALL SELECT * FROM (VALUES ('x1', '/clear all of it'), ('x2', 'ok then'), ('x3', NULL), ('x4', 'a question nobody asked'), ('x5', ' yes do it ')) AS t(query, text)),
    c AS (SELECT * FROM b UNION ALL SELECT 'x5', 0.2)
    SELECT query, CASE WHEN coalesce(trim(text), '') = '' OR starts_with(trim(text), '/') OR len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) < 3 THEN 'command or short prompt' WHEN cosine IS NULL THEN 'nothing found' WHEN cosine < 0.34 THEN 'too far' END AS reason FROM p LEFT JOIN c USING (query)""")
def prompt_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 20th question, which are searched for and found, and five prompts that are turned away for each reason."""
    more = spark.createDataFrame([("x1", "/clear all of it"), ("x2", "ok then"), ("x3", None), ("x4", "a question nobody asked"), ("x5", " yes do it ")], "query string, text string")
    best = two_lists(spark, sf_dir).filter("list = 1").select("query", F.col("score").alias("cosine")).union(spark.createDataFrame([("x5", 0.2)], "query string, cosine double"))
    return search.prompt_gate(every_20th(spark, sf_dir).withColumnRenamed("question", "text").union(more), best)


@query("rank_window", _UNIT_SQL + " SELECT query, rank, key FROM dense WHERE rank BETWEEN 3 AND 30")
def rank_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks 3 to 30, from which negatives are drawn."""
    return dense(spark, sf_dir, 30).filter("rank >= 3").select("query", "rank", "key")


@query("dense_negatives", _UNIT_SQL + """, own AS (SELECT vec_id, label FROM v)
    SELECT query, row_number() OVER (PARTITION BY query ORDER BY rank) AS position, key FROM dense JOIN own ON own.vec_id = query
    WHERE dense.label IS DISTINCT FROM own.label AND dense.rank <= 30""")
def dense_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near vectors of another label: first the 30 nearest, then the filter."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label").distinct()
    near = dense(spark, sf_dir, 30).join(labels.withColumnsRenamed({"vec_id": "key", "label": "a"}), "key").join(labels.withColumnsRenamed({"vec_id": "query", "label": "b"}), "query")
    return near.filter(~F.col("a").eqNullSafe(F.col("b"))).select("query", F.expr("cast(row_number() over (partition by query order by rank) as bigint)").alias("position"), "key")


@query("fn_filter", _UNIT_SQL + """, p AS (SELECT query, max(cosine) AS pos FROM dense WHERE key <> query GROUP BY query)
    SELECT query, key, round(cosine, 6) AS cosine FROM dense JOIN p USING (query) WHERE key <> query AND rank <= 30 AND round(cosine, 9) < round(0.95 * pos, 9)""")
def fn_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives that aren't as near to the query as 95 % of the nearest other vector, which stands for the positive."""
    d = dense(spark, sf_dir).filter("key <> query")
    pos = d.groupBy("query").agg(F.max("score").alias("pos"))
    return d.filter("rank <= 30").join(pos, "query").filter(F.round("score", 9) < F.round(0.95 * F.col("pos"), 9)).select("query", "key", F.round("score", 6).alias("cosine"))


both("anisotropy", """
    SELECT count(*) AS n, round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1.0)), 6) AS mean_cosine FROM (
        SELECT p, sum(x / norm) AS s, count(*) AS n FROM (SELECT vec_id, p, x, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS norm
            FROM (SELECT vec_id, p, CAST(x AS DOUBLE) AS x FROM embeddings LATERAL VIEW posexplode(embedding) t AS p, x)) GROUP BY p)""",
    """
    SELECT count(*) AS n, round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1.0)), 6) AS mean_cosine FROM (
        SELECT p, sum(x / norm) AS s, count(*) AS n FROM (SELECT vec_id, p, x, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS norm
            FROM (SELECT vec_id, unnest(generate_series(1, len(embedding))) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)) GROUP BY p)""")

@query("parity", """SELECT label, count(*) AS n, max(CASE WHEN abs(a - b) <= 1e-4 THEN 0 ELSE 1 END) AS broken, round(max(abs(a - b)), 5) AS max_diff FROM (
    SELECT label, list_sum(list_transform(e, lambda x: x * x)) AS a, list_sum(list_transform(e, lambda x: CAST(CAST(x AS FLOAT) * CAST(x AS FLOAT) AS DOUBLE))) AS b FROM (SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)) GROUP BY label""")
def parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in single precision against the same in double: per label their number, whether any is off by more than
    1e-4, and the largest difference. The scores are the squared norms of the vectors."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding").distinct()
    summed = lambda f: F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + f(x))
    scores = v.select("label", "vec_id", summed(lambda x: x.cast("double") * x.cast("double")).alias("reference"), summed(lambda x: (x.cast("float") * x.cast("float")).cast("double")).alias("score"))
    return search.parity(scores, ["label"]).withColumn("max_diff", F.round("max_diff", 5))
