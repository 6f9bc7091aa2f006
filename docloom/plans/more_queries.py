"""The rest of the inventory: small reports and guards over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.plans.dialects import both
from docloom.plans.registry import query
from docloom.session import table

both("src_lines", r"SELECT doc_id, CAST(sum(CASE WHEN MATCHES(line, RX'[^ \t\r]') THEN 1 ELSE 0 END) AS BIGINT) AS filled FROM (SELECT doc_id, EACH(SPLIT(text, '\n')) AS line FROM documents) GROUP BY doc_id",
     r"SELECT doc_id, CAST(sum(CASE WHEN MATCHES(line, RX'[^ \t\r]') THEN 1 ELSE 0 END) AS BIGINT) AS filled FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
both("src_vectors", "SELECT vec_id, label, CAST(LEN(embedding) AS BIGINT) AS dimensions FROM embeddings")
both("unlisted_rows", "SELECT q.id FROM (SELECT DISTINCT id, component FROM questions) q LEFT JOIN (SELECT DISTINCT component FROM docs) d ON q.component = d.component WHERE d.component IS NULL")
both("admitted_rows", "SELECT DISTINCT q.id FROM questions q WHERE lower(trim(q.split)) = 'train' AND q.component IN (SELECT component FROM docs WHERE component IS NOT NULL)")
both("split_replay", """SELECT id, CASE WHEN r <= 20 THEN 'validation' ELSE 'train' END AS part FROM (SELECT id, row_number() OVER (PARTITION BY source ORDER BY md5(concat('13|', id)), id) AS r FROM (SELECT DISTINCT id, source FROM questions WHERE lower(trim(split)) = 'train'))""")
both("iso_times", "SELECT DISTINCT id, DAY(commit_time, YMD) AS day, DAY(commit_time, YM_) AS month FROM docs WHERE commit_time IS NOT NULL")
both("session_seconds", "SELECT user_id, round((max(MICROS(ts)) - min(MICROS(ts))) / CAST(1000000 AS DOUBLE), 1) AS seconds FROM events GROUP BY user_id")
both("percentiles", "SELECT event_type, round(percentile(value, 0.025), 6) AS low, round(percentile(value, 0.975), 6) AS high FROM events GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high FROM events GROUP BY event_type")
both("counter_map", "SELECT user_id, array_join(array_sort(collect_list(concat(event_type, '=', CAST(n AS STRING)))), ',') AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id",
     "SELECT user_id, array_to_string(list_sort(list(concat(event_type, '=', CAST(n AS VARCHAR)))), ',') AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id")
both("path_tails", """SELECT DISTINCT source_file, array_join(slice(p, -k, k), '/') AS tail FROM (SELECT source_file, p, EACH(SERIES(1, least(4, size(p)))) AS k FROM (SELECT source_file, SPLIT(source_file, '/') AS p FROM nodes WHERE source_file IS NOT NULL))""",
     """SELECT DISTINCT source_file, array_to_string(p[len(p) - k + 1:], '/') AS tail FROM (SELECT source_file, p, unnest(generate_series(1, least(4, len(p)))) AS k FROM (SELECT source_file, string_split(source_file, '/') AS p FROM nodes WHERE source_file IS NOT NULL))""")
both("first_by_order", "SELECT doc_id, min(ordinal) AS first, max(ordinal) AS last, count(DISTINCT id) AS n FROM sections GROUP BY doc_id")
both("archive_beyond", "SELECT id, component FROM (SELECT id, component, row_number() OVER (PARTITION BY component ORDER BY commit_time DESC NULLS LAST, id) AS r FROM (SELECT DISTINCT id, component, commit_time FROM docs)) WHERE r > 20")
both("late_links", "SELECT DAY(built_at, YM_) AS month, count(*) AS links, count(*) FILTER (WHERE loaded_at > built_at + INTERVAL '1' DAY) AS late FROM (SELECT DISTINCT * FROM links) WHERE built_at IS NOT NULL GROUP BY 1")
both("recorded_words", r"SELECT id, CAST(coalesce(words, 0) AS BIGINT) AS recorded, CAST(LEN(regexp_extract_all(text, RX'[^ \t\r\n]+', 0)) AS BIGINT) AS counted FROM (SELECT DISTINCT id, words, text FROM sections) WHERE coalesce(words, 0) <> LEN(regexp_extract_all(text, RX'[^ \t\r\n]+', 0))")
both("heading_depth", "SELECT component, level, count(DISTINCT id) AS sections FROM sections GROUP BY CUBE (component, level)")
both("session_errors", "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type <> 'error') AS fine FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'error') > 0")


@query("shingle_overlap", r"""WITH w AS (SELECT DISTINCT id, regexp_extract_all(lower(question), '[\p{L}\p{N}_]+') AS q, regexp_extract_all(lower(answer), '[\p{L}\p{N}_]+') AS a FROM questions WHERE answer IS NOT NULL)
    SELECT id, CAST(len(list_intersect(list_transform(generate_series(1, greatest(len(q) - 1, 0)), lambda i: q[i] || ' ' || q[i + 1]), list_transform(generate_series(1, greatest(len(a) - 1, 0)), lambda i: a[i] || ' ' || a[i + 1]))) AS INTEGER) AS shared FROM w""")
def shingle_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pairs that a question and its answer share."""
    q = table(spark, sf_dir, "questions").filter("answer is not null").select("id", T.unicode_words(F.col("question")).alias("q"), T.unicode_words(F.col("answer")).alias("a")).distinct()
    return q.select("id", F.size(F.array_intersect(T.ngrams(F.col("q"), 2), T.ngrams(F.col("a"), 2))).alias("shared"))
