"""The queries of the problems tagged llm, over their whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, forms, leaks, mixture, near, overlap, pairs, split
from docloom.llm.words import word_array
from docloom.session import table


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions with their split trimmed and in lower case."""
    q = table(spark, sf_dir, "questions")
    return q.withColumn("split", F.lower(F.trim("split")))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_oversized(table(spark, sf_dir, "sections"), "id", "text", "line_start").withColumnRenamed("id", "section_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).select("section_id").distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces themselves."""
    return _pieces(spark, sf_dir).distinct()


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _questions(spark, sf_dir).withColumn("words", word_array(F.col("question")))
    return overlap.split_overlaps(q, "id", "split", "words", "train", ["dev", "test"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir).select(F.least("train_key", "key").alias("id_a"), F.greatest("train_key", "key").alias("id_b")).filter("id_a <> id_b").distinct()


def p2_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per eval split and source: its questions, those that also stand in train, and the pairs."""
    held_out = _questions(spark, sf_dir).filter(F.col("split").isin("dev", "test")).select("id", "split", "source").distinct()
    found = _overlaps(spark, sf_dir).groupBy(F.col("key").alias("id"), "split").agg(F.count("*").alias("pairs"))
    return (
        held_out.join(found, ["id", "split"], "left")
        .groupBy("split", "source")
        .agg(F.count("*").alias("questions"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    )


def _near(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    docs = table(spark, sf_dir, "docs").select("id", word_array(F.col("path")).alias("words"))
    return {
        "section": near.near_texts(table(spark, sf_dir, "sections"), "id", "text"),
        "doc": near.near_sets(docs, "id", "words"),
    }


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, other = (near.pairs_of(g).select(F.lit(k).alias("kind"), "id_a", "id_b") for k, g in _near(spark, sf_dir).items())
    return one.union(other)


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups: one row for each section or doc that is alike to another."""
    one, other = (g.select(F.lit(k).alias("kind"), F.col("key").alias("id"), F.col("group").alias("group_id")) for k, g in _near(spark, sf_dir).items())
    return one.union(other)


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = table(spark, sf_dir, "questions").withColumnRenamed("id", "question_id")
    return pairs.broken_pairs(questions, "question_id", "question", "answer", table(spark, sf_dir, "sections"), "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _broken(spark, sf_dir)


def p5_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective questions per source and defect."""
    sources = table(spark, sf_dir, "questions").select(F.col("id").alias("question_id"), "source").distinct()
    return _broken(spark, sf_dir).join(sources, "question_id").groupBy("source", "defect").agg(F.count("*").alias("questions"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = _questions(spark, sf_dir).filter(F.col("split").isin("dev", "test"))
    texts = held_out.select(F.col("id").alias("question_id"), F.explode(F.concat(F.array("answer"), F.coalesce("evidence", F.array().cast("array<string>")))).alias("said"))
    sections = table(spark, sf_dir, "sections").select(F.col("id").alias("section_id"), "text")
    return leaks.find_leaks(sections, "section_id", "text", texts, "question_id", "said")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("section_id", "question_id").distinct()


def p6_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections with leaks, without the leaked passages."""
    sections = table(spark, sf_dir, "sections").select(F.col("id").alias("section_id"), "text").distinct()
    return leaks.remove_leaks(sections, "section_id", "text", _leaks(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixture.mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source", table(spark, sf_dir, "mix_targets"))


def p8_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn, with their number of copies."""
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mix(spark, sf_dir)[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forms.alike_pairs(forms.one_form(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return found.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text in its one form, null where nothing is visible."""
    out = forms.one_form(table(spark, sf_dir, "documents"), "doc_id", "text", with_text=True)
    return out.select(F.col("key").alias("doc_id"), F.when(F.col("form").isNotNull(), F.col("text")).alias("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_by_source": p2_by_source,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p5_found": p5_found,
    "p5_by_source": p5_by_source,
    "p6_found": p6_found,
    "p6_cleaned": p6_cleaned,
    "p7_ids": p7_ids,
    "p8_sample": p8_sample,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_forms": p9_forms,
}

_P2_PAIRS = r"""
        WITH w AS (SELECT DISTINCT id, lower(trim(split)) AS split,
                          list_distinct(regexp_extract_all(lower(question), '[\p{L}\p{N}]+')) AS w FROM questions),
        t AS (SELECT id, split, w, unnest(w) AS term FROM w),
        common AS (SELECT a.id AS a, b.id AS b, b.split, len(any_value(a.w)) + len(any_value(b.w)) AS n, count(*) AS o
                   FROM t a JOIN t b USING (term) WHERE a.split = 'train' AND b.split IN ('dev', 'test') GROUP BY a.id, b.id, b.split),
        pairs AS (SELECT a, b, split FROM common WHERE o >= 0.7 * (n - o))"""

#: Where SQL can say the same over whole tables in bounded time.
SQL: dict[str, str] = {
    "p1_found": r"""
        SELECT DISTINCT id AS section_id FROM sections
        WHERE length(text) > 4000 OR len(regexp_extract_all(text, '[^ \t\r\n]+')) > 300""",
    "p2_found": _P2_PAIRS + """
        SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM pairs WHERE a <> b""",
    "p2_by_source": _P2_PAIRS + """, n AS (SELECT b AS id, split, count(*) AS pairs FROM pairs GROUP BY ALL)
        SELECT q.split, q.source, count(*) AS questions, count(n.pairs) AS overlapping, CAST(coalesce(sum(n.pairs), 0) AS BIGINT) AS pairs
        FROM (SELECT DISTINCT id, lower(trim(split)) AS split, source FROM questions WHERE lower(trim(split)) IN ('dev', 'test')) q
        LEFT JOIN n ON n.id = q.id AND n.split = q.split GROUP BY ALL""",
    "p6_found": r"""
        WITH s AS (SELECT DISTINCT id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM sections),
        q AS (SELECT DISTINCT id, unnest(list_append(coalesce(evidence, []), answer)) AS said FROM questions
              WHERE lower(trim(split)) IN ('dev', 'test')),
        qw AS (SELECT id, regexp_extract_all(lower(said), '[\p{L}\p{N}]+') AS w FROM q),
        sg AS (SELECT DISTINCT id, unnest([w[i:i + 12] for i in range(1, len(w) - 11)]) AS g FROM s),
        qg AS (SELECT DISTINCT id, unnest([w[i:i + 12] for i in range(1, len(w) - 11)]) AS g FROM qw)
        SELECT DISTINCT sg.id AS section_id, qg.id AS question_id FROM sg JOIN qg USING (g)""",
}
