"""Relational queries written once and run by both engines.

A text uses the words below where the engines differ; everything else is plain SQL that both accept. The Spark side runs
over the tables of sf_dir as temporary views, so Catalyst plans it like any DataFrame.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from docloom.plans.registry import QUERIES, SQL
from docloom.session import table

#: word -> (Spark, DuckDB)
WORDS = {
    "RX'": ("r'", "'"),
    "/*g*/": ("", ", 'g'"),
    "EACH(": ("explode(", "unnest("),
    "SPLIT(": ("split(", "string_split("),
    "LEN(": ("size(", "len("),
    "GLUE(": ("array_join(", "array_to_string("),
    "MATCHES(": ("regexp_like(", "regexp_matches("),
    "STARTS(": ("startswith(", "starts_with("),
    "ENDS(": ("endswith(", "ends_with("),
    "DAY(": ("date_format(", "strftime("),
    "YMD": ("'yyyy-MM-dd'", "'%Y-%m-%d'"),
    "YM_": ("'yyyy-MM'", "'%Y-%m'"),
    "LIST(": ("collect_list(", "list("),
    "SORTED(": ("array_sort(", "list_sort("),
    "UNIQUE(": ("array_distinct(", "list_distinct("),
    "SERIES(": ("sequence(", "generate_series("),
    "CHARS(": ("char_length(", "length("),
    "MICROS(": ("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ", "epoch_us("),
    "JSONGET(": ("get_json_object(", "json_extract_string("),
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings docs sections nodes links unresolved questions mix_targets".split()


def said_in(text: str, engine: int) -> str:
    for word, sides in WORDS.items():
        text = text.replace(word, sides[engine])
    return text


def both(name: str, text: str, duck: str | None = None) -> None:
    """Registers a query by its text; duck where the other engine needs a text of its own."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in used:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(said_in(text, 0))

    if name in QUERIES:
        raise ValueError(f"two queries are named {name}")
    QUERIES[name], SQL[name] = run, said_in(duck or text, 1)


def said(columns: str, rows: list[tuple]) -> str:
    """Rows worked out by hand, as SQL."""
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({columns})"
