"""Code graphs: containment, updates, pruning, distances and facts, over a small graph, and components of the links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import graph
from docloom.operators.components import connected_components
from docloom.plans.dialects import said
from docloom.plans.event_queries import _EDGES as _LINK_EDGES
from docloom.plans.event_queries import _edges
from docloom.plans.registry import query
from docloom.session import table

_FILES = ["app/core/jobs.py", "app/core/deep/one.py", "app/ui/form.ts", "README.md"]
_SYMBOLS = [("Job", "app/core/jobs.py", None), ("Job.run", "app/core/jobs.py", "Job"), ("one", "app/core/deep/one.py", None), ("form", "app/ui/form.ts", None)]
_MORE = [("Job.run", "one", "calls"), ("form", "Job", "uses"), ("one", "env:DEEP", "reads"), ("form", "env:UI", "reads")]


def _graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    files, symbols = spark.createDataFrame([(f,) for f in _FILES], "path string"), spark.createDataFrame(_SYMBOLS, "id string, file string, owner string")
    nodes, edges = graph.containment(files, symbols)
    env = spark.createDataFrame([("env:DEEP", "env", None), ("env:UI", "env", None), ("env:NONE", "env", None)], "id string, kind string, file string")
    return nodes.union(env), edges.union(spark.createDataFrame(_MORE, "source string, target string, relation string"))


_CONTAINS = [
    ("dir:", "dir:app"), ("dir:app", "dir:app/core"), ("dir:app/core", "dir:app/core/deep"), ("dir:app", "dir:app/ui"), ("dir:", "README.md"), ("dir:app/core", "app/core/jobs.py"), ("dir:app/core/deep", "app/core/deep/one.py"), ("dir:app/ui", "app/ui/form.ts"),
    ("app/core/jobs.py", "Job"), ("app/core/deep/one.py", "one"), ("app/ui/form.ts", "form"),
]


@query("graph_build", said("source, target, relation", [*[(a, b, "contains") for a, b in _CONTAINS], ("Job", "Job.run", "method"), *_MORE]))
def graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark)[1]


@query("graph_update", said("id, kind", [
    ("dir:", "dir"), ("dir:app", "dir"), ("dir:app/core", "dir"), ("dir:app/ui", "dir"), ("README.md", "file"), ("app/core/jobs.py", "file"), ("app/ui/form.ts", "file"), ("Job", "symbol"), ("Job.stop", "symbol"), ("form", "symbol"), ("env:UI", "env"),
]))
def graph_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file is removed with its folder and setting, another loses a method and gets a new one."""
    nodes, edges = _graph(spark)
    make = spark.createDataFrame
    fresh = make([("app/core/jobs.py", "file", "app/core/jobs.py"), ("Job", "symbol", "app/core/jobs.py"), ("Job.stop", "symbol", "app/core/jobs.py")], "id string, kind string, file string")
    new = make([("dir:app/core", "app/core/jobs.py", "contains"), ("app/core/jobs.py", "Job", "contains"), ("Job", "Job.stop", "method"), ("Job.stop", "nowhere", "calls")], "source string, target string, relation string")
    return graph.updated(nodes, edges, make([("app/core/deep/one.py",), ("app/core/jobs.py",)], "file string"), fresh, new)[0].select("id", "kind")


@query("prune_empty", said("id", [("env:NONE",), ("env:X",), ("dir:a",), ("dir:a/b",), ("dir:a/b/c",), ("dir:d/e",)]))
def prune_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is pruned from a graph with folders that hold nothing but empty folders."""
    nodes = spark.createDataFrame([("dir:", "dir", None), *[(f"dir:{d}", "dir", None) for d in ("a", "a/b", "a/b/c", "d", "d/e")], ("d/f.py", "file", "d/f.py"), ("env:NONE", "env", None), ("env:X", "env", None), ("env:Y", "env", None)], "id string, kind string, file string")
    edges = spark.createDataFrame([("dir:", "dir:a", "contains"), ("dir:a", "dir:a/b", "contains"), ("dir:a/b", "dir:a/b/c", "contains"), ("dir:", "dir:d", "contains"), ("dir:d", "dir:d/e", "contains"), ("dir:d", "d/f.py", "contains"), ("d/f.py", "env:Y", "reads")], "source string, target string, relation string")
    return nodes.select("id").exceptAll(graph.pruned(nodes, edges)[0].select("id"))


_WALK = f"WITH RECURSIVE e AS ({said('a, b', [(a, b) for a, b in _CONTAINS] + [('Job', 'Job.run')] + [(a, b) for a, b, _ in _MORE])}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT a, b, 1 AS hops FROM u UNION SELECT w.a, u.b, w.hops + 1 FROM w JOIN u ON u.a = w.b WHERE w.hops < 4), h AS (SELECT a, b, min(hops) AS hops FROM w WHERE a <> b GROUP BY a, b)"


def _plain(spark: SparkSession) -> DataFrame:
    return _graph(spark)[1].select(F.col("source").alias("a"), F.col("target").alias("b"))


@query("all_hops", _WALK + " SELECT a, b, hops FROM h")
def all_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of all pairs up to four hops."""
    return graph.all_hops(_plain(spark), 4)


@query("keyword_walk", _WALK.replace("w.hops < 4", "w.hops < 3") + """, k AS (SELECT query, vertex FROM (VALUES ('run jobs', 'Job.run'), ('run jobs', 'app/core/jobs.py'), ('ui form', 'form'), ('ui form', 'app/ui/form.ts'), ('ui form', 'dir:app/ui')) AS t(query, vertex)),
    r AS (SELECT query, vertex, 0 AS hops FROM k UNION ALL SELECT k.query, h.b, h.hops FROM k JOIN h ON h.a = k.vertex) SELECT query, vertex, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY query, vertex""")
def keyword_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything within three hops of the up to three nodes whose names share most words with a question; a node must
    share one. Ties go to the lesser name."""
    nodes, edges = _graph(spark)
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))
    asked = spark.createDataFrame([("run jobs",), ("ui form",), ("nothing here",)], "query string").select("query", F.explode(words(F.col("query"))).alias("w"))
    named = nodes.filter("kind <> 'env'").select(F.col("id").alias("vertex"), F.explode(words(F.col("id"))).alias("w"))
    met = asked.join(named, "w").groupBy("query", "vertex").agg(F.count("*").alias("n"))
    best = met.withColumn("r", F.expr("row_number() over (partition by query order by n desc, vertex)")).filter("r <= 3")
    return graph.hops_by_query(edges.select(F.col("source").alias("a"), F.col("target").alias("b")), best, 3)


@query("hop_pairs", _WALK + " SELECT a, b, CAST(hops AS INTEGER) AS hops FROM h WHERE hops <= 3 AND a IN ('Job', 'form') AND b IN ('one', 'README.md', 'env:UI') UNION ALL SELECT 'one', 'one', 0")
def hop_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of some pairs those at most three hops apart."""
    pairs = spark.createDataFrame([(a, b) for a in ("Job", "form") for b in ("one", "README.md", "env:UI")] + [("one", "one"), ("one", "gone")], "a string, b string")
    return graph.hop_pairs(pairs, _plain(spark), 3)


@query("relation_facts", said("folder, fact", [("app/core", "Job.run calls one."), ("app/ui", "form uses Job."), ("app/core/deep", "one reads DEEP."), ("app/ui", "form reads UI.")]))
def relation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark)
    return graph.relation_facts(nodes, edges, {"calls": "{a} calls {b}.", "uses": "{a} uses {b}.", "reads": "{a} reads {b}."}).select("folder", "fact")


@query("graph_parts", "WITH RECURSIVE " + _LINK_EDGES.replace(", src AS (SELECT min(a) AS s FROM e)", "") + """, walk AS (SELECT a AS v, a AS m FROM u UNION SELECT u.b, walk.m FROM walk JOIN u ON u.a = walk.v WHERE u.b > walk.m)
    SELECT v AS vertex, min(m) AS component FROM walk GROUP BY v""")
def graph_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The connected part of every section and node that a link has."""
    return connected_components(_edges(spark, sf_dir))


@query("section_parts", """WITH s AS (SELECT DISTINCT doc_id, id, ordinal FROM sections) SELECT 's:' || id AS vertex, least(min('s:' || id) OVER (PARTITION BY doc_id), 'd:' || doc_id) AS component FROM s UNION SELECT 'd:' || doc_id, least(min('s:' || id) OVER (PARTITION BY doc_id), 'd:' || doc_id) FROM s""")
def section_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the graph of documents and their sections: a document with all its sections."""
    s = table(spark, sf_dir, "sections").filter("doc_id is not null and id is not null")
    return connected_components(s.select(F.concat(F.lit("d:"), "doc_id").alias("a"), F.concat(F.lit("s:"), "id").alias("b")).distinct())
