"""Readers of files and logs, with explicit schemas."""

from __future__ import annotations

import contextlib
import io
import json
import sqlite3
import subprocess
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import stored

#: Folders that a scan leaves out.
SKIPPED = ["node_modules", ".git", "build", "dist", "vendor", "__pycache__", ".venv", "target"]


def text_files(spark: SparkSession, root: str, suffixes: list[str], excluded: list[str] = SKIPPED) -> DataFrame:
    """(path, modified, text) of the files below root with one of the suffixes, outside the excluded folders; path is
    relative to root. Hidden folders are left out."""
    hidden = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/.github")  # the one hidden folder that a scan doesn't skip
    roots = [root, *[f"{root}/.github"] * hidden.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hidden)]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").load(roots)
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + root.rstrip("/") + "/", "")
    folders = F.slice(F.split(relative, "/"), 1, F.size(F.split(relative, "/")) - 1)
    bad = F.exists(folders, lambda x: x.isin(excluded) | (x.startswith(".") & (x != ".github")))
    return files.filter(~bad).select(relative.alias("path"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines (gzip too); lines that don't parse are left out."""
    rows = spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter("_bad is null").drop("_bad")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines that aren't blank."""
    return spark.read.text(path).filter(F.trim("value") != "")


def tracked_files(spark: SparkSession, root: str) -> DataFrame:
    """(path): the files of a checkout that git knows or would take (cached and others, without the ignored), relative to
    root. The listing of one checkout is made on the driver, where it lies; LookupError if it is no checkout or git is
    missing, so the caller can walk the folder instead."""
    try:
        run = subprocess.run(["git", "-C", root, "ls-files", "-co", "--exclude-standard", "-z"], capture_output=True, check=True)
    except (OSError, subprocess.CalledProcessError) as e:
        raise LookupError(f"no git listing of {root}") from e
    names = sorted({n for n in run.stdout.decode("utf-8", "surrogateescape").split("\0") if n})
    return spark.createDataFrame([(n,) for n in names], "path string")


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """(path, at): the newest commit of each file, from a written git log of format %x01%ct with names. Each commit is one
    record of the file, cut at the byte 1, so a log of any length is read in parallel."""
    commits = spark.read.option("lineSep", "\x01").text(path).filter("value <> ''")
    parts = F.split("value", "\n")
    names = commits.select(F.element_at(parts, 1).cast("bigint").alias("at"), F.explode(F.slice(parts, 2, F.size(parts))).alias("path")).filter(F.trim("path") != "")
    return names.groupBy("path").agg(F.timestamp_seconds(F.max("at")).alias("at"))


def vectors(spark: SparkSession, path: str, keys: str = "ids", values: str = "vecs") -> DataFrame:
    """(key, v) of NumPy archives, each with an array of keys and a matrix of as many rows. One archive is one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    yield pa.RecordBatch.from_arrays([pa.array(z[keys].astype(str).tolist(), pa.string()), pa.array(z[values].astype(np.float32).tolist(), pa.list_(pa.float32()))], names=["key", "v"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "key string, v array<float>")


def transcripts(spark: SparkSession, path: str, offsets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The new whole lines (file, line, row) of growing files of JSON lines, line from 1, and the offsets (file, bytes, lines) to
    go on from; offsets: those of the last read. A line without an end yet waits for the next read; one that is no JSON
    object is left out but counted. A file that became shorter is read anew."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content", F.col("length"))
    held = offsets if offsets is not None else spark.createDataFrame([], "file string, bytes bigint, lines bigint")
    at = files.join(held, "file", "left").withColumn("again", F.coalesce(F.col("bytes") <= F.col("length"), F.lit(False)))
    at = at.select("file", F.when(F.col("again"), F.col("bytes")).otherwise(0).alias("bytes"), F.when(F.col("again"), F.col("lines")).otherwise(0).alias("lines"), "content")
    fresh = F.expr("substring(content, cast(bytes + 1 as int))")
    # The part up to the last line end; byte by byte text, so that offsets stay those of the file.
    whole = F.regexp_extract(F.decode(fresh, "ISO-8859-1"), r"(?s)\A.*\n", 0)
    cut = stored(at.select("file", "bytes", "lines", whole.alias("said")))
    after = cut.select("file", (F.col("bytes") + F.length("said")).alias("bytes"), (F.col("lines") + F.length("said") - F.length(F.replace("said", F.lit("\n"), F.lit("")))).alias("lines"))
    each = cut.filter("said <> ''").select("file", "lines", F.posexplode(F.split(F.regexp_replace(F.decode(F.encode("said", "ISO-8859-1"), "UTF-8"), r"\n\z", ""), "\n")).alias("i", "row"))
    rows = each.filter(F.coalesce(F.expr("try_parse_json(row) is not null"), F.lit(False)) & F.trim("row").startswith("{"))
    return rows.select("file", (F.col("lines") + F.col("i") + 1).alias("line"), "row"), after


def sqlite_rows(spark: SparkSession, paths: list[str], table: str, schema: str) -> DataFrame:
    """The rows of a table of SQLite files, with the columns of schema. One file is one task, read without a lock; the
    executors must reach the files. A file without the table has no rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema), prefers_large_types=False)
    wanted = ", ".join(f'"{n}"' for n in arrow.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)) as db:
                    if not db.execute("select 1 from sqlite_master where name = ?", (table,)).fetchone():
                        continue
                    at = db.execute(f'select {wanted} from "{table}"')
                    while rows := at.fetchmany(5_000):
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInArrow(run, schema)


def settings_file(path: str, strict: bool = True, required: tuple[str, ...] = ()) -> dict:
    """A JSON object from a file on the driver. Missing or without a required key: FileNotFoundError or ValueError if
    strict, else what there is."""
    try:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
    except FileNotFoundError:
        if strict:
            raise
        return {}
    if not isinstance(held, dict) or (strict and [k for k in required if k not in held]):
        raise ValueError(f"{path}: needs an object with {', '.join(required) or 'settings'}")
    return held


def sentences(spark: SparkSession, parts: list[tuple[str, str]], least_words: int = 5) -> DataFrame:
    """(text) from files of several formats, given as (format, path): json lines with `text` or `tokens`, parquet with
    `text`, plain text."""
    out = None
    for kind, path in parts:
        if kind == "json":
            df = json_lines(spark, path, "text string, tokens array<string>").select(F.coalesce("text", F.array_join("tokens", " ")).alias("text"))
        else:
            df = spark.read.parquet(path).select("text") if kind == "parquet" else spark.read.text(path).select(F.col("value").alias("text"))
        out = df if out is None else out.union(df)
    return out.filter(F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")) >= least_words)
