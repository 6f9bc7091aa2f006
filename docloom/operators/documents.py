"""Operators whose semantics need a state machine over one text; they run in Arrow batches, one text at a time."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import markdown
from docloom.functions.text import excerpt
from docloom.session import stored


def each_text(df: DataFrame, columns: list[str], schema: str, f: Callable[..., list[tuple]]) -> DataFrame:
    """f(*values of columns) -> rows; one output row for each, in the given schema. No shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema), prefers_large_types=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for values in zip(*(c.to_pylist() for c in batch.columns)) for r in f(*values)]
            columns_ = zip(*rows) if rows else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), field.type) for c, field in zip(columns_, arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def split_documents(docs: DataFrame, most_words: int = 300) -> DataFrame:
    """(id, ordinal, level, heading_path, line_start, line_end, text) of docs (id, path, text); the path's suffix picks
    the dialect. Null texts give no row."""

    def run(key, path, text):
        name = (path or "").rsplit("/", 1)[-1]
        suffix = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ".md"
        for i, (level, heads, a, b, body) in enumerate(markdown.sections(text, suffix, most_words) if text else []):
            yield key, i, level, " > ".join([name, *heads]), a, b, body

    kind = docs.schema["id"].dataType.simpleString()
    return each_text(docs, ["id", "path", "text"], f"id {kind}, ordinal int, level int, heading_path string, line_start int, line_end int, text string", run)


def excerpts(hits: DataFrame, most_words: int = 60, others: list[str] = ()) -> DataFrame:
    """(query, rank, key, excerpt, *others) of hits (query, rank, key, question, text, *others). Null texts give an empty
    excerpt."""
    said = excerpt(F.coalesce("text", F.lit("")), F.coalesce("question", F.lit("")), most_words)
    return hits.select("query", "rank", "key", said.alias("excerpt"), *others)


def context_packs(blocks: DataFrame, budget: int = 2000) -> DataFrame:
    """(query, blocks, context): the blocks (query, rank, block) of each query in order of rank within the budget. The
    ranking bounds a query's blocks, so gathering them is bounded too."""
    gathered = blocks.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]).alias("all"))
    q = blocks.schema["query"].dataType.simpleString()

    def run(query, all_):
        taken = markdown.pack(all_, budget)
        return [(query, len(taken), "\n\n".join(taken))]

    return each_text(gathered, ["query", "all"], f"query {q}, blocks int, context string", run)


def hcl_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks (component, path, folder, kind, key, first, last) and the edges (component, source, target, relation) of
    HCL files (component, path, text): a file contains its blocks; a module uses the folder its source names, if files
    stand in it or below; a block refers to those of its own folder that it names. Null texts have no blocks. Blocks are
    named by folder/key, files by their path."""

    def run(component, path, text):
        folder = posixpath.dirname(path)
        for b in markdown.hcl_blocks(text) if text else []:
            uses = posixpath.normpath(posixpath.join(folder, b.source)) if b.source and b.source.startswith(".") else None
            yield component, path, folder, b.kind, b.key, b.first, b.last, uses, b.references

    kind = "component string, path string, folder string, kind string, key string, first int, last int, uses string, refs array<string>"
    blocks = stored(each_text(files.filter("path is not null"), ["component", "path", "text"], kind, run))
    named = F.concat_ws("/", F.when(F.col("folder") != "", F.col("folder")), "key")
    contains = blocks.select("component", F.col("path").alias("source"), named.alias("target"), F.lit("contains").alias("relation"))
    parts = F.split(F.col("path"), "/")
    folders = files.filter(F.size(parts) > 1).select("component", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("uses")).distinct()
    uses = blocks.filter("uses is not null").join(folders, ["component", "uses"]).select("component", named.alias("source"), F.col("uses").alias("target"), F.lit("uses").alias("relation"))
    asked = blocks.select("component", "folder", named.alias("source"), F.explode("refs").alias("key"))
    refers = asked.join(blocks.select("component", "folder", "key").distinct(), ["component", "folder", "key"]).select("component", "source", named.alias("target"), F.lit("references").alias("relation"))
    return blocks.drop("uses", "refs"), contains.union(uses).union(refers).distinct()
