"""Curation of documents and the leakage gate against the evaluation questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import curate
from docloom.plans.dialects import both
from docloom.plans.registry import query
from docloom.session import table

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
_KEY = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
_PARAS = r"""p AS (SELECT doc_id, no - 1 AS no, paragraph, """ + _KEY.format("paragraph") + r""" AS k FROM (
        SELECT doc_id, unnest(generate_series(1, len(l))) AS no, unnest(l) AS paragraph FROM (
            SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n[ \t]*\n'), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM documents)))"""  # fmt: skip


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


#: The rewrites of a text in the other engine's dialect, which knows no look-around and no reference to a group.
_SQL_SCRUB = [
    (r"(?:/Users|/home)/[A-Za-z0-9._-]+", "~"), (r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", "<PRIVATE_KEY>"),
    (r"\b(sk|pk|rk)-[A-Za-z0-9_-]{16,}", "<SECRET>"), (r"\b(ghp|gho|ghu|ghs|github_pat)_[A-Za-z0-9_]{20,}", "<SECRET>"), (r"\bxox[abprs]-[A-Za-z0-9-]{10,}", "<SECRET>"),
    (r"\bAKIA[0-9A-Z]{16}\b", "<SECRET>"), (r"\bAIza[0-9A-Za-z_-]{30,}", "<SECRET>"), (r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "<SECRET>"),
    (r"(?i)(bearer\s+)[A-Za-z0-9._-]{16,}", r"\1<SECRET>"), (r"(?i)\b(api[_-]?key|token|secret|password|passwd|auth)(\s*[:=]\s*[\"']?)[^\s\"'`]{8,}", r"\1\2<SECRET>"),
    (r"\b[A-Za-z0-9+/_-]{40,}={0,2}($|[^\p{L}\p{N}_/])", r"<SECRET>\1"), (r"\b[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]*[\p{L}\p{N}_]", "<EMAIL>"),
]
_SQL_BLOCK = r"(?m)^{0}[^\n]*\n((?:(?:[^{1}\n][^\n]*|{1}[^{1}\n][^\n]*|{1}{1}[^{1}\n][^\n]*|{1}|{1}{1}|)\n){{0,40}})(?:(?:[^{1}\n][^\n]*|{1}[^{1}\n][^\n]*|{1}{1}[^{1}\n][^\n]*|{1}|{1}{1}|)\n)*{0}[ \t]*$"
_SQL_CODE = [*[(rf"(?m)^{f}[^\n]*\n{f}[ \t]*$", f"{f}\n\n{f}") for f in ("```", "~~~")], *[(_SQL_BLOCK.format(f, f[0]), f"{f}\n\\1{f}") for f in ("```", "~~~")]]
_SQL_CLEAN = [
    (r"\r\n", "\n"), (r"(?s)\A---\n.*?\n---\n", ""), (r"(?s)<!--.*?-->", ""), *_SQL_CODE, (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]+)\]\([^)]*\)", r"\1"),
    (r"https?://[^\s\x{a0}\x{2005}\x{2007}-\x{2009}\x{202f}\x{3000}]+", "URL"), (r"</?[A-Za-z][^>]{0,200}>", ""), (r"(?m)^\.\. [\p{L}\p{N}_:-]+::.*$", ""), (r"(?m)^[\s|:+=-]{3,}$", ""),
    *_SQL_SCRUB, (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"^[\s\x{a0}\x{2005}\x{2007}-\x{2009}\x{202f}\x{3000}]+|[\s\x{a0}\x{2005}\x{2007}-\x{2009}\x{202f}\x{3000}]+$", ""),
]


def _rewritten(column: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        said = ["'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in (pattern, to)]
        column = f"regexp_replace({column}, {said[0]}, {said[1]}, 'g')"
    return column


#: Words that a keyword query leaves out, as the survey lists them.
_SQL_STOP = "'a','an','and','are','as','at','be','by','can','do','does','for','from','has','have','how','i','in','is','it','its','of','on','or','the','this','to','was','what','when','where','which','who','why','will','with','there','their','they','them','into','via','any','all','our','we','you','your'"


@query("tokenize", r"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+'), lambda t: length(t) > 1), ' ') AS tokens FROM documents")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@query("query_terms", r"""SELECT id, term FROM (SELECT DISTINCT id, unnest(list_filter(regexp_extract_all(lower(regexp_replace(question, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+'), lambda t: length(t) > 1)) AS term FROM questions)
    WHERE term NOT IN (""" + _SQL_STOP + ")")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "questions").select("id", F.explode(T.query_terms(F.col("question"))).alias("term")).distinct()


@query("grams13", r"SELECT DISTINCT doc_id, md5(unnest(list_transform(generate_series(1, greatest(len(w) - 12, 0)), lambda i: array_to_string(w[i:i + 12], ' ')))) AS gram FROM (SELECT doc_id, " + _WORDS.format("text") + " AS w FROM documents)")
def grams13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.explode(T.ngrams(T.unicode_words(F.col("text")), 13)).alias("g")).select("doc_id", F.md5("g").alias("gram")).distinct()


@query("shingles5", r"SELECT doc_id, CAST(len(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END)) AS INTEGER) AS shingles FROM (SELECT doc_id, " + _WORDS.format("text") + " AS w FROM documents WHERE text IS NOT NULL)")
def shingles5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).filter("text is not null").select("doc_id", F.size(T.shingles(T.unicode_words(F.col("text")), 5)).alias("shingles"))


@query("scrub", "SELECT doc_id, text FROM (SELECT doc_id, text AS was, " + _rewritten("text", _SQL_SCRUB) + " AS text FROM documents) WHERE text <> was")
def scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in which a secret was replaced."""
    return _docs(spark, sf_dir).select("doc_id", T.scrub(F.col("text")).alias("t"), "text").filter("t <> text").select("doc_id", F.col("t").alias("text"))


@query("clean_text", "SELECT doc_id, " + _rewritten("text", _SQL_CLEAN) + " AS text FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query("capped_code", "SELECT doc_id, md5(t) AS text FROM (SELECT doc_id, text, " + _rewritten("text", [(r"\r\n", "\n"), *_SQL_CODE]) + " AS t FROM documents) WHERE t <> text")
def capped_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the cap of their code blocks changes."""
    capped = T.capped_code(F.regexp_replace("text", "\r\n", "\n"))
    return _docs(spark, sf_dir).select("doc_id", "text", capped.alias("t")).filter("t <> text").select("doc_id", F.md5("t").alias("text"))


@query("latin_share", r"SELECT doc_id, round(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / CAST(greatest(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 1) AS DOUBLE), 6) AS share FROM documents")
def latin_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(T.latin_share(F.col("text")), 6).alias("share"))


@query("paragraphs", "WITH " + _PARAS + " SELECT doc_id, CAST(no AS INTEGER) AS no, paragraph FROM p")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.paragraphs(_docs(spark, sf_dir), "doc_id", "text").withColumnRenamed("key", "doc_id")


_DEDUP = "WITH " + _PARAS + """, kept AS (SELECT doc_id, no, paragraph FROM (
    SELECT *, row_number() OVER (PARTITION BY CASE WHEN length(k) >= 40 THEN k ELSE doc_id || '/' || no END ORDER BY doc_id, no) AS r FROM p) WHERE r = 1)"""


def _deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.dedup_paragraphs(_docs(spark, sf_dir), "doc_id", "text", []).withColumnRenamed("key", "doc_id")


@query("para_dedup", _DEDUP + " SELECT doc_id, CAST(no AS INTEGER) AS no, md5(paragraph) AS paragraph FROM kept")
def para_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deduped(spark, sf_dir).select("doc_id", "no", F.md5("paragraph").alias("paragraph"))


@query("clean_docs", _DEDUP + """ SELECT kept.doc_id, CAST(count(*) AS BIGINT) AS paragraphs, CAST(sum(length(paragraph)) AS BIGINT) AS n_chars FROM kept
    GROUP BY kept.doc_id HAVING sum(length(paragraph)) >= 300""")
def clean_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least 300 characters left after the dedup; those that fall short still own their paragraphs."""
    return _deduped(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("paragraph")).alias("n_chars")).filter("n_chars >= 300")


@query("clean_counts", _DEDUP + r""", c AS (SELECT doc_id, sum(length(paragraph)) AS n FROM kept GROUP BY doc_id)
    SELECT d.source, CASE WHEN d.text IS NULL OR trim(d.text, ' ') = '' THEN 'empty' WHEN coalesce(n, 0) < 300 THEN 'short' ELSE 'kept' END AS reason, count(*) AS documents
    FROM documents d LEFT JOIN c USING (doc_id) GROUP BY GROUPING SETS ((d.source, reason), (reason))""")
def clean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _deduped(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.length("paragraph")).alias("n"))
    reason = F.when(F.col("text").isNull() | (F.trim("text") == ""), "empty").when(F.coalesce("n", F.lit(0)) < 300, "short").otherwise("kept")
    rows = _docs(spark, sf_dir).join(left, "doc_id", "left").withColumn("reason", reason)
    return rows.groupingSets([["source", "reason"], ["reason"]], "source", "reason").agg(F.count("*").alias("documents"))


_SENT = r"""s AS (SELECT doc_id, no, s FROM (SELECT doc_id, unnest(generate_series(1, len(l))) AS no, unnest(l) AS s FROM (
    SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \t\r\n]+([A-Z`("''])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS l FROM documents))
    WHERE len(list_filter(regexp_split_to_array(s, '[ \t\r\n]+'), lambda w: w <> '')) BETWEEN 8 AND 64 AND length(regexp_replace(s, '[^A-Za-z]', '', 'g')) * 2 > length(s))"""


def _prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(curate.sentences(F.col("text"))).alias("no", "s")).filter(curate.prose(F.col("s")))


@query("prose_sentences", "WITH " + _SENT + " SELECT doc_id, count(*) AS sentences, CAST(sum(length(s)) AS BIGINT) AS n_chars FROM s GROUP BY doc_id")
def prose_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prose(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("s")).alias("n_chars"))


@query("sent_dedup", "WITH " + _SENT + """ SELECT md5(lower(s)) AS sentence, doc_id FROM (SELECT s, doc_id, row_number() OVER (PARTITION BY lower(s) ORDER BY md5('7|' || doc_id), no) AS r FROM s) WHERE r = 1""")
def sent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence once, from the first document in a shuffled order that the seed fixes."""
    rows = _prose(spark, sf_dir)
    first = rows.groupBy(F.md5(F.lower("s")).alias("sentence")).agg(F.min(F.struct(F.md5(F.concat(F.lit("7|"), F.col("doc_id").cast("string"))).alias("o"), "no", "doc_id")).alias("f"))
    return first.select("sentence", "f.doc_id")


_HASH_ORDER = "md5('11|' || doc_id)"


def _hash_order() -> list:
    return [F.md5(F.concat(F.lit("11|"), F.col("doc_id").cast("string")))]


@query("cap_per_source", f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_HASH_ORDER}) AS r FROM documents) WHERE r <= 30")
def cap_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.cap_per(_docs(spark, sf_dir).select("doc_id", "source"), ["source"], _hash_order(), 30)


@query("synth_budget", f"""SELECT doc_id, n FROM (SELECT doc_id, length(text) AS n, coalesce(sum(length(text)) OVER (ORDER BY {_HASH_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
        FROM documents WHERE source = 'translations' AND text IS NOT NULL)
    WHERE used < 0.25 * (SELECT sum(length(text)) FROM documents WHERE source <> 'translations')""")
def synth_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one source, taken as synthetic, until they reach a quarter of the others' characters."""
    docs = _docs(spark, sf_dir).select("doc_id", "source", F.length("text").alias("n"))
    others = docs.filter("source <> 'translations'").agg((F.sum("n") * 0.25).alias("budget"))
    rows = docs.filter("source = 'translations' and n is not null").crossJoin(F.broadcast(others))
    return curate.running_budget(rows, ["source"], _hash_order(), "n", F.col("budget")).select("doc_id", "n")


@query("balance_budget")
def balance_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, documents in hashed order while they fit into 12 % of all characters."""
    docs = _docs(spark, sf_dir).filter("text is not null").select("source", "doc_id", F.length("text").alias("n"), _hash_order()[0].alias("o"))
    total = docs.agg(F.sum("n")).first()[0] or 0
    return curate.greedy_budget(docs, "source", ["o"], "n", 0.12 * total).select("doc_id", "source", "n")


_GATE = r"""WITH w AS (SELECT id AS section_id, component AS source, """ + _WORDS.format("text") + r""" AS w FROM sections),
    g AS (SELECT DISTINCT section_id, source, unnest(list_transform(generate_series(1, len(w) - 12), lambda i: array_to_string(w[i:i + 12], ' '))) AS gram FROM w WHERE len(w) >= 13),
    b AS (SELECT gram FROM g GROUP BY gram HAVING count(DISTINCT source) >= 2),
    qw AS (SELECT DISTINCT id, """ + _WORDS.format("said") + r""" AS w FROM (SELECT id, question AS said FROM questions UNION ALL SELECT id, answer FROM questions UNION ALL SELECT id, unnest(evidence) FROM questions)),
    r AS (SELECT DISTINCT id, unnest(list_transform(generate_series(1, len(w) - 12), lambda i: array_to_string(w[i:i + 12], ' '))) AS gram FROM qw WHERE len(w) >= 13),
    hit AS (SELECT section_id, source, count(*) AS hits FROM g WHERE gram NOT IN (SELECT gram FROM b) AND gram IN (SELECT gram FROM r) GROUP BY ALL)"""  # fmt: skip


def _grams(spark: SparkSession, sf_dir: str, hashed: bool = True) -> DataFrame:
    return curate.gram_rows(table(spark, sf_dir, "sections").select("id", "component", "text").distinct(), "id", "component", "text", hashed=hashed)


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "questions")
    said = F.explode(F.concat(F.array("question", "answer"), F.coalesce("evidence", F.array().cast("array<string>"))))
    return curate.gram_rows(q.select("id", "source", said.alias("said")), "id", "source", "said").select(F.col("unit").alias("id"), "gram").distinct()


@query("leakage_gate", _GATE + " SELECT section_id, source, hits FROM hit WHERE hits >= 3")
def leakage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.leakage_gate(_grams(spark, sf_dir), _reference(spark, sf_dir).select("gram")).withColumnRenamed("unit", "section_id")


@query("gate_hits", _GATE + " SELECT source, count(*) AS units, CAST(sum(hits) AS BIGINT) AS hits FROM hit GROUP BY source")
def gate_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = curate.leakage_gate(_grams(spark, sf_dir), _reference(spark, sf_dir).select("gram"), 1)
    return hits.groupBy("source").agg(F.count("*").alias("units"), F.sum("hits").alias("hits"))


@query("boilerplate_grams", _GATE + " SELECT md5(gram) AS gram FROM b")
def boilerplate_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.boilerplate(_grams(spark, sf_dir, False)).select(F.md5("gram").alias("gram"))


@query("overlap_report", _GATE + " SELECT g.source, count(DISTINCT g.section_id) AS sections, count(DISTINCT r.id) AS questions, count(DISTINCT gram) AS grams FROM g JOIN r USING (gram) GROUP BY g.source")
def overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    both_ = _grams(spark, sf_dir).join(_reference(spark, sf_dir), "gram")
    return both_.groupBy("source").agg(F.countDistinct("unit").alias("sections"), F.countDistinct("id").alias("questions"), F.countDistinct("gram").alias("grams"))


@query("gram_set_info", _GATE + " SELECT first AS id, count(*) AS new_grams FROM (SELECT gram, min(id) AS first FROM r GROUP BY gram) GROUP BY first")
def gram_set_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grams that each question brings first, questions in order of their id."""
    return _reference(spark, sf_dir).groupBy("gram").agg(F.min("id").alias("id")).groupBy("id").agg(F.count("*").alias("new_grams"))


@query("eligible_sections", r"""WITH s AS (SELECT DISTINCT id, text FROM sections WHERE len(list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '')) BETWEEN 60 AND 400),
    w AS (SELECT id, """ + _WORDS.format("text") + r""" AS w FROM s), g AS (SELECT DISTINCT id, unnest(list_transform(generate_series(1, len(w) - 12), lambda i: array_to_string(w[i:i + 12], ' '))) AS gram FROM w WHERE len(w) >= 13),
    qw AS (SELECT DISTINCT """ + _WORDS.format("answer") + r""" AS w FROM questions), r AS (SELECT DISTINCT unnest(list_transform(generate_series(1, len(w) - 12), lambda i: array_to_string(w[i:i + 12], ' '))) AS gram FROM qw WHERE len(w) >= 13)
    SELECT DISTINCT id AS section_id FROM s WHERE id NOT IN (SELECT id FROM g WHERE gram IN (SELECT gram FROM r))""")
def eligible_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of 60 to 400 words without any run of 13 words of an answer."""
    n = F.size(F.filter(F.split("text", "[ \t\r\n]+"), lambda w: w != ""))
    s = table(spark, sf_dir, "sections").select("id", "text").filter(n.between(60, 400)).distinct()
    answers = curate.gram_rows(table(spark, sf_dir, "questions").select("id", "source", "answer"), "id", "source", "answer").select("gram").distinct()
    leaked = curate.gram_rows(s.withColumn("source", F.lit("")), "id", "source", "text").join(answers, "gram", "left_semi").select(F.col("unit").alias("id")).distinct()
    return s.join(leaked, "id", "left_anti").select(F.col("id").alias("section_id")).distinct()


both("count_units", "SELECT source, count(*) AS documents, CAST(sum(CHARS(text)) AS BIGINT) AS n_chars FROM documents GROUP BY source")
both("mix_share", """SELECT source, n_chars, round(n_chars / CAST(sum(n_chars) OVER () AS DOUBLE), 6) AS share FROM (
    SELECT source, CAST(sum(CHARS(text)) AS BIGINT) AS n_chars FROM documents GROUP BY source) ORDER BY n_chars DESC, source LIMIT 15""")
both("content_hash", "SELECT doc_id, sha2(text, 256) AS sha FROM documents", "SELECT doc_id, sha256(text) AS sha FROM documents")
both("hash_split", """SELECT id, CASE WHEN (aggregate(split(sha2(id, 256), ''), 0, (a, c) -> a + if(c = '', 0, CAST(conv(c, 16, 10) AS INT)))) % 3 = 0 THEN 'dev' ELSE 'test' END AS part FROM (SELECT DISTINCT id FROM questions)""",
     """SELECT id, CASE WHEN CAST(list_sum(list_transform(string_split(sha256(id), ''), lambda c: instr('0123456789abcdef', c) - 1)) AS BIGINT) % 3 = 0 THEN 'dev' ELSE 'test' END AS part FROM (SELECT DISTINCT id FROM questions)""")
both("corpus_stats", r"""SELECT coalesce(lower(lang), 'none') AS lang, count(*) AS documents, CAST(sum(LEN(SPLIT(text, '\n'))) AS BIGINT) AS n_lines, CAST(sum(octet_length(text)) AS BIGINT) AS n_bytes,
    CAST(sum(LEN(regexp_extract_all(text, RX'[^ \t\r\n]+', 0))) AS BIGINT) AS n_words FROM documents WHERE text IS NOT NULL GROUP BY 1""",
    r"""SELECT coalesce(lower(lang), 'none') AS lang, count(*) AS documents, CAST(sum(LEN(string_split(text, chr(10)))) AS BIGINT) AS n_lines, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes,
    CAST(sum(LEN(regexp_extract_all(text, '[^ \t\r\n]+', 0))) AS BIGINT) AS n_words FROM documents WHERE text IS NOT NULL GROUP BY 1""")
both("embed_text", "SELECT DISTINCT id, md5(concat(coalesce(heading_path, ''), chr(10), coalesce(text, ''))) AS text_sha FROM sections")
both("light_stem", r"""SELECT word, CASE WHEN length(word) > 4 THEN regexp_replace(word, RX'(ing|ed|es|s)$', '') ELSE word END AS stem FROM (
    SELECT DISTINCT word FROM (SELECT EACH(regexp_extract_all(lower(text), RX'[a-z]+', 0)) AS word FROM documents))""")
both("preview", "SELECT doc_id, CASE WHEN CHARS(text) > 80 THEN concat(left(text, 80), ' … +', CAST(CHARS(text) - 80 AS STRING)) ELSE text END AS preview FROM documents",
     "SELECT doc_id, CASE WHEN CHARS(text) > 80 THEN concat(left(text, 80), ' … +', CAST(CHARS(text) - 80 AS VARCHAR)) ELSE text END AS preview FROM documents")
both("docstrings", r"""SELECT doc_id, md5(lower(p)) AS opening FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY lower(p) ORDER BY doc_id) AS r FROM (
    SELECT doc_id, regexp_extract(text, RX'^[^\n]+', 0) AS p FROM documents) WHERE LEN(regexp_extract_all(p, RX'[^ \t\r\n]+', 0)) >= 8) WHERE r = 1""")
both("code_share", r"""SELECT id, round(sum(CASE WHEN fenced THEN n ELSE 0 END) / CAST(greatest(sum(n), 1) AS DOUBLE), 6) AS share FROM (
    SELECT id, length(line) AS n, sum(CASE WHEN line LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY no ROWS UNBOUNDED PRECEDING) % 2 = 1 OR line LIKE '```%' AS fenced
    FROM (SELECT id, posexplode(split(replace(text, '\r\n', '\n'), '\n')) AS (no, line) FROM (SELECT DISTINCT id, text FROM sections))) GROUP BY id""",
    r"""SELECT id, round(sum(CASE WHEN fenced THEN n ELSE 0 END) / CAST(greatest(sum(n), 1) AS DOUBLE), 6) AS share FROM (
    SELECT id, length(line) AS n, sum(CASE WHEN line LIKE '```%' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY no ROWS UNBOUNDED PRECEDING) % 2 = 1 OR line LIKE '```%' AS fenced
    FROM (SELECT id, unnest(generate_series(1, len(l))) AS no, unnest(l) AS line FROM (SELECT id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM (SELECT DISTINCT id, text FROM sections)))) GROUP BY id""")
both("lines", r"SELECT id, CAST(LEN(SPLIT(text, '\n')) AS BIGINT) AS n_lines FROM (SELECT DISTINCT id, text FROM sections)", "SELECT id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM (SELECT DISTINCT id, text FROM sections)")
