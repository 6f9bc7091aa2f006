"""Walks over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.session import stored


def hops(edges: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(vertex, hops): undirected hop distance from the sources (vertex), up to `most`. Each round joins the frontier
    only and is written to the shared folder; the walk ends early when the frontier is empty."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    seen = stored(sources.filter("vertex is not null").distinct().withColumn("hops", F.lit(0)))
    for i in range(1, most + 1):
        frontier = seen.filter(F.col("hops") == i - 1).select(F.col("vertex").alias("a"))
        new = both.join(frontier, "a").select(F.col("b").alias("vertex")).distinct().join(seen.select("vertex"), "vertex", "left_anti")
        new = stored(new.withColumn("hops", F.lit(i)))
        if new.isEmpty():
            break
        seen = seen.union(new)
    return seen


def expand(hits: DataFrame, edges: DataFrame, most: int, decay: float) -> DataFrame:
    """(vertex, score): hits (vertex, score) and their first `most` neighbours at `decay` times the score."""
    near = hits.join(edges.withColumnRenamed("a", "vertex"), "vertex")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("vertex").orderBy("b"))).filter(F.col("r") <= most)
    both = hits.select("vertex", "score").union(near.select(F.col("b").alias("vertex"), F.col("score") * decay))
    return both.groupBy("vertex").agg(F.max("score").alias("score"))


def containment(files: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (id, kind, file) and edges (source, target, relation) of a code graph: every folder of the files (path), the
    files in them and the symbols (id, file, owner), which a file contains, or which belong as methods to the symbol
    `owner`. Folders are dir:path, the root dir:."""
    parts = F.split("path", "/")
    paths = files.select("path").filter("path is not null and path <> ''").distinct()
    up = lambda c: F.concat(F.lit("dir:"), F.regexp_replace(c, "/?[^/]*$", ""))
    folders = paths.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("d")).distinct()
    none = F.lit(None).cast("string")
    nodes = folders.select(F.concat(F.lit("dir:"), "d").alias("id"), F.lit("dir").alias("kind"), none.alias("file"))
    nodes = nodes.union(paths.select("path", F.lit("file"), "path")).union(symbols.select("id", F.lit("symbol"), "file"))
    edges = folders.filter("d <> ''").select(up(F.col("d")).alias("source"), F.concat(F.lit("dir:"), "d").alias("target"), F.lit("contains").alias("relation"))
    edges = edges.union(paths.select(up(F.col("path")), "path", F.lit("contains")))
    edges = edges.union(symbols.select(F.coalesce("owner", "file"), "id", F.when(F.col("owner").isNull(), "contains").otherwise("method")))
    return nodes.distinct(), edges.distinct()


def updated(nodes: DataFrame, edges: DataFrame, gone: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph after files changed: what belongs to the files in gone (file) is taken out with all edges at it, the new nodes
    and edges are put in, edges whose ends don't exist fall away, and what is left empty is pruned."""
    kept = nodes.join(gone.select("file").distinct(), "file", "left_anti").select("id", "kind", "file")
    nodes = stored(kept.union(new_nodes.select("id", "kind", "file")).dropDuplicates(["id"]))
    ids = nodes.select("id")
    edges = edges.union(new_edges).distinct().join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return pruned(nodes, edges.select("source", "target", "relation"))


def pruned(nodes: DataFrame, edges: DataFrame, most_rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """The graph without folders that contain nothing and settings (kind env) that nothing refers to, to the fixed point. A
    round takes out one level of folders and is written, so the lineage is cut."""
    nodes, edges = stored(nodes), stored(edges)
    for _ in range(most_rounds):
        holds = edges.filter("relation = 'contains'").select(F.col("source").alias("id"))
        used = edges.select(F.col("target").alias("id"))
        empty = nodes.filter("kind = 'dir' and id <> 'dir:'").join(holds, "id", "left_anti").union(nodes.filter("kind = 'env'").join(used, "id", "left_anti")).select("id")
        empty = stored(empty)
        if empty.isEmpty():
            return nodes, edges
        nodes = stored(nodes.join(empty, "id", "left_anti"))
        edges = stored(edges.join(empty.withColumnRenamed("id", "source"), "source", "left_anti").join(empty.withColumnRenamed("id", "target"), "target", "left_anti").select("source", "target", "relation"))
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def all_hops(edges: DataFrame, most: int) -> DataFrame:
    """(a, b, hops): the undirected hop distance of all pairs of different vertices up to `most` hops. What comes out is the
    square of the neighbourhoods; each round extends only the pairs that the last one found."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct())
    seen = new = stored(both.withColumn("hops", F.lit(1)))
    for i in range(2, most + 1):
        step = new.select("a", F.col("b").alias("m")).join(both.select(F.col("a").alias("m"), "b"), "m").filter("a <> b").select("a", "b").distinct()
        new = stored(step.join(seen, ["a", "b"], "left_anti").withColumn("hops", F.lit(i)))
        if new.isEmpty():
            break
        seen = seen.union(new)
    return seen


def hop_pairs(pairs: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b) that lie at most `most` hops apart, with their hops; a vertex and itself are 0 apart. Walks start at
    the pairs' ends only and keep, from each, what is `most` hops away."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    seen = new = stored(pairs.select(F.col("a").alias("s"), F.col("a").alias("v")).distinct().withColumn("hops", F.lit(0)))
    for i in range(1, most + 1):
        step = new.join(both, new["v"] == both["a"]).select("s", F.col("b").alias("v")).distinct()
        new = stored(step.join(seen, ["s", "v"], "left_anti").withColumn("hops", F.lit(i)))
        if new.isEmpty():
            break
        seen = seen.union(new)
    return pairs.join(seen.select(F.col("s").alias("a"), F.col("v").alias("b"), "hops"), ["a", "b"])


def relation_facts(nodes: DataFrame, edges: DataFrame, wording: dict[str, str], most: int = 10) -> DataFrame:
    """(folder, place, fact): up to `most` sentences of each folder on how its symbols and files relate to others, by the
    wording of their relation with {a} and {b}; in the order of a hash. Relations without a wording give none."""
    folder = F.regexp_replace("file", "/?[^/]*$", "")
    short = lambda c: F.regexp_extract(c, "[^/.:]*[^/:]*$", 0)
    said = F.coalesce(*[F.when(F.col("relation") == k, F.replace(F.replace(F.lit(v), F.lit("{a}"), short("source")), F.lit("{b}"), short("target"))) for k, v in wording.items()])
    rows = edges.join(nodes.filter("file is not null").select(F.col("id").alias("source"), folder.alias("folder")), "source").select("folder", said.alias("fact")).filter("fact is not null").distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("folder").orderBy(F.xxhash64("fact"), "fact"))).filter(F.col("place") <= most).select("folder", "place", "fact")


def hops_by_query(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(query, vertex, hops): what lies within `most` undirected hops of any of a query's starts (query, vertex), nearest
    first found. Each round extends only what the last one found and is written."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    seen = new = stored(starts.filter("vertex is not null").select("query", "vertex").distinct().withColumn("hops", F.lit(0)))
    for i in range(1, most + 1):
        step = new.join(both, new["vertex"] == both["a"]).select("query", F.col("b").alias("vertex")).distinct()
        new = stored(step.join(seen, ["query", "vertex"], "left_anti").withColumn("hops", F.lit(i)))
        if new.isEmpty():
            break
        seen = seen.union(new)
    return seen
