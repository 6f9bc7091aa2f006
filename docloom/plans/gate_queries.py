"""Sources, the stage gate and trees of notes: small cases with every branch, and the gate over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import provenance, trees
from docloom.plans.curate_queries import _GATE
from docloom.plans.dialects import said
from docloom.plans.registry import query
from docloom.session import table

_REV = "a" * 40
_KIND = "id string, kind string, role string, url string, hf_id string, revision string, license string, sha256 string, local_dir string, aliases array<string>"
_SOURCES = [
    ("oss:lib", "oss", "train", "https://forge.example/o/lib", None, _REV, "MIT", None, "/oss/lib", ["oss/lib"]), ("oss:held", "oss", "heldout", "https://forge.example/o/held", None, _REV, "MIT", None, "/oss/held/", []),
    ("hf:set", "hf", "train", None, "o/set", _REV, "MIT", None, None, ["set"]), ("oss:inner", "oss", "train", "https://forge.example/o/in", None, _REV, "MIT", None, "/oss/lib/inner", None),
]
_BAD = [
    ("a", "oss", "train", "http://x", None, _REV, "MIT", None, None, None), ("b", "hf", "train", None, None, _REV, "MIT", None, None, None), ("c", "url", "train", "http://x", None, "1", "MIT", None, None, None), ("d", "other", "user", None, None, "1", None, None, "/home/u/Downloads/x", None),
    ("e", "url", "train", "http://x", None, "1", "MIT", "ff", None, None), ("e", "url", "train", "http://x", None, "1", "MIT", "ff", None, None), (None, "repo", "train", None, None, "1", "MIT", None, None, None),
]


def _sources(spark: SparkSession, rows: list = _SOURCES) -> DataFrame:
    return spark.createDataFrame(rows, _KIND)


@query("source_problems", said("id, problem", [
    ("a", "needs an https address and a pinned commit"), ("b", "needs the dataset's name and a pinned revision"), ("c", "needs an address and the archive's hash"), ("d", "missing license"), ("d", "unknown kind"), ("d", "unknown role"), ("d", "folder of a home"),
    ("e", "duplicate id"), ("?", "missing id"),
]))
def source_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A source without an id is named ? and lacks it.
    bad = _sources(spark, _BAD)
    found = provenance.spec_problems(bad.filter("id is not null"))
    return found.union(bad.filter("id is null").select(F.lit("?"), F.lit("missing id")))


@query("source_names", said("name, id, refused", [("set", "hf:set", None), ("oss:lib", "oss:lib", None), ("oss/lib", "oss:lib", None), ("oss:held", "oss:held", "role heldout"), ("local/Downloads", "local/Downloads", "not listed")]))
def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(x,) for x in ("set", "oss:lib", "oss/lib", "oss:held", "local/Downloads", "set")], "name string")
    return provenance.resolved(names, _sources(spark))


@query("source_paths", said("path, id, refused", [
    ("/oss/lib/docs/index.md", "oss:lib", None), ("/oss/lib/inner/a.md", "oss:inner", None), ("/oss/held/docs/index.md", "oss:held", "role heldout"), ("/elsewhere/notes.md", None, "under no source"), ("/oss/lib/Downloads/x.md", "oss:lib", "denied path"),
    ("/oss/library/x.md", None, "under no source"),
]))
def source_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = ["/oss/lib/docs/index.md", "/oss/lib/inner/a.md", "/oss/held/docs/index.md", "/elsewhere/notes.md", "/oss/lib/Downloads/x.md", "/oss/library/x.md"]
    return provenance.sources_of_paths(spark.createDataFrame([(p,) for p in paths], "path string"), _sources(spark), [provenance.HOME, "acme-client"])


_PRIVATE = "the billing service retries every failed webhook three times before it pages the on call engineer and writes the failure to the audit table"
_EVAL = "to register a custom filter you add a function to the environment filters mapping under the name used in templates and then call it"
_PUBLIC = "a public paragraph about parsing command line options with a decorator and typed parameters " * 2
_COMMON = "permission is hereby granted free of charge to any person who obtains a copy of this software and its notes"
_UNITS = [(0, "oss:lib", _PUBLIC), (1, "oss:lib", "intro " + _PRIVATE), (2, "hf:set", "x " + _EVAL), (3, "oss:lib", _COMMON), (4, "hf:set", "AcmeCorp: " + _COMMON), (5, "hf:set", None), (6, "hf:set", "short text of acmecorporation")]


def _units(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    return spark.createDataFrame(_UNITS, "unit int, source string, text string"), texts(_EVAL, None), texts(_PRIVATE, _COMMON)


@query("stage_verdicts", said("unit, source, private_hits, eval_hits, kept", [(0, "oss:lib", 0, 0, True), (1, "oss:lib", 12, 0, True), (2, "hf:set", 0, 12, False), (3, "oss:lib", 0, 0, True), (4, "hf:set", 0, 0, True), (5, "hf:set", 0, 0, True), (6, "hf:set", 0, 0, True)]))
def stage_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.gate(*_units(spark))[0]


@query("stage_gate", said("mode, ok, units, kept, private_hits, eval_hits, boilerplate", [("drop", False, 7, 6, 1, 1, 8), ("drop clean", True, 6, 5, 0, 1, 8), ("verify clean", False, 6, 6, 0, 1, 8)]))
def stage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, evaluation, private = _units(spark)
    clean = units.filter("unit <> 1")
    of = lambda mode, u, drop: provenance.gate(u, evaluation, private, drop)[1].select(F.lit(mode).alias("mode"), "*")
    return of("drop", units, True).union(of("drop clean", clean, True)).union(of("verify clean", clean, False))


@query("private_terms", said("unit, marker", [(4, 1)]))
def private_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.marked_texts(_units(spark)[0], ["nobody", "acmecorp"])


@query("stage_manifest", said("id, kind, revision, license, n_docs, n_chars", [("oss:lib", "oss", _REV, "MIT", 3, len(_PUBLIC) + 6 + len(_PRIVATE) + len(_COMMON)), ("hf:set", "hf", _REV, "MIT", 4, 2 + len(_EVAL) + 10 + len(_COMMON) + 29)]))
def stage_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.manifest(_units(spark)[0].replace("hf:set", "set", ["source"]), _sources(spark))


@query("manifest_checks", said("file, problem", [("b.txt", "sha256 mismatch"), ("b.txt", "gate not passed"), ("b.txt", "missing created"), ("b.txt", "local:Downloads: not listed"), ("c.txt", "no such file"), ("c.txt", "hf:set: other revision"), ("c.txt", "hf:set: missing license")]))
def manifest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a.txt", "1", "t", True, "oss:lib", _REV, "MIT"), ("b.txt", "1", None, False, "oss:lib", _REV, "MIT"), ("b.txt", "1", None, False, "local:Downloads", _REV, "MIT"), ("c.txt", "1", "t", True, "hf:set", "other", "")]
    at = spark.createDataFrame(rows, "file string, sha256 string, created string, gate_ok boolean, id string, revision string, license string")
    return provenance.manifest_problems(at, _sources(spark), spark.createDataFrame([("a.txt", "1"), ("b.txt", "2")], "file string, sha256 string"))


@query("gate_report", _GATE + """ SELECT (SELECT count(*) FROM hit WHERE hits >= 3) = 0 AS ok, (SELECT count(DISTINCT id) FROM sections) AS units, (SELECT count(DISTINCT id) FROM sections) AS kept, 0::BIGINT AS private_hits,
    (SELECT count(*) FROM hit WHERE hits >= 3) AS eval_hits, (SELECT count(*) FROM b) AS boilerplate""")
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over all sections in verify mode, with all questions, answers and evidence as evaluation texts."""
    q = table(spark, sf_dir, "questions")
    texts = q.select(F.explode(F.concat(F.array("question", "answer"), F.coalesce("evidence", F.array().cast("array<string>")))).alias("text")).distinct()
    units = table(spark, sf_dir, "sections").select(F.col("id").alias("unit"), F.coalesce("component", F.lit("")).alias("source"), "text").distinct()
    return provenance.gate(units, texts, texts.limit(0), drop=False)[1]


_OK = "---\nname: A\ndescription: about a\n---\nbody"
_RO = "---\nname: A\ndescription: d\nread_only: true\n---\nold"
_CHANGES = [
    ("notes/a.md", _OK, None), ("b.md", "body", None), ("notes/MEMORY.md", _OK, None), ("c.md", "---\nname: A\ndescription: d\ntype: x\n---\n", None), ("d.md", "---\nname:\ndescription: d\n---\n", None), ("e.md", _RO.replace("old", "new"), _RO), ("f.md", _RO, None),
    ("g.md", "---\nname: A", None), ("h.md", "---\nname: A\nname: B\n---\n", None), ("i.md", _OK, _RO.replace("true", "no")), ("j.md", _RO, _RO.replace("true", "no")), ("MEMORY.md", "# map", None), ("k.md", "", None), ("l.md", "---\n---\nx", None),
]


@query("note_problems", said("path, problem", [
    ("b.md", "missing front matter"), ("notes/MEMORY.md", "an index has no front matter"), ("c.md", "unknown key type"), ("d.md", "name is empty"), ("e.md", "file is read_only"), ("f.md", "read_only can't be set"), ("g.md", "front matter isn't closed"),
    ("h.md", "duplicate key name"), ("h.md", "missing description"), ("i.md", "read_only can't be removed"), ("j.md", "read_only can't be changed"), ("k.md", "missing front matter"), ("l.md", "missing name"), ("l.md", "missing description"),
]))
def note_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.change_problems(spark.createDataFrame(_CHANGES, "path string, content string, previous string"))


@query("frontmatter", said("path, key, value", [("notes/a.md", "name", "A"), ("notes/a.md", "description", "about a"), ("e.md", "name", "A"), ("e.md", "description", "d: with colon"), ("e.md", "read_only", "true")]))
def frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("notes/a.md", _OK), ("e.md", _RO.replace("description: d", "description: d: with colon")), ("none.md", "x\n---\na: b\n---\n"), ("open.md", "---\na: b"), ("empty.md", "---\n---\n"), ("null.md", None)]
    df = spark.createDataFrame(rows, "path string, text string")
    return df.select("path", F.explode(trees.fields(F.col("text"))).alias("f")).select("path", "f.*")


@query("note_rendered", said("path, text, again", [("a", "---\nname: N one\ndescription: -\n---\n\nbody\n", "body\n"), ("b", "---\nname: a - b\ndescription: d\n---\n\n# T\n\nx\n", "# T\n\nx\n")]))
def note_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([("a", " N\n one", None, "\nbody\n\n"), ("b", "a --- b", "d", "# T\n\nx")], "path string, name string, description string, text string")
    out = df.select("path", trees.rendered(F.col("name"), F.col("description"), F.col("text")).alias("text"))
    return out.withColumn("again", trees.body(F.col("text")))


@query("tree_problems", said("path, problem", [
    ("notes/a.md", "missing index of notes"), ("x/y/z/deep.md", "missing index of x"), ("x/y/z/deep.md", "depth 3 of 2"), ("core.md", "50 characters of 40"), ("notes/a.md", "30 characters of 20"), ("", "root holds 53 characters of 45"), ("link.md", "no regular file"),
    ("p/q/r.md", "missing index of p/q"),
]))
def tree_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("MEMORY.md", "100644", 3), ("core.md", "100644", 50), ("notes/a.md", "100644", 30), ("x/y/z/deep.md", "100644", 1), ("link.md", "120000", 9), ("code.py", "100644", 999), ("p/MEMORY.md", "100644", 1), ("p/q/r.md", "100644", 1)]
    return trees.tree_problems(spark.createDataFrame(rows, "path string, mode string, n_chars bigint"), 2, 40, 45, [("notes/*.md", 20), ("**/r.md", None)])


@query("split_at_headings", said("path, part, text", [("a", 0, "intro\n## A\nx\n"), ("a", 1, "## B\nlonger than it may be\n"), ("a", 2, "## C\n"), ("b", 0, "short")]))
def split_at_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", "intro\n## A\nx\n## B\nlonger than it may be\n## C\n"), ("b", "short"), ("c", None), ("d", "")]
    return trees.cut_at_headings(spark.createDataFrame(rows, "path string, text string"), 20)


@query("fil_binary", said("id", [("b",), ("d",)]))
def fil_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More than one replacement character in a hundred; exactly one in a hundred isn't."""
    rows = [("a", "x" * 99 + "�"), ("b", "x" * 98 + "�"), ("c", "plain"), ("d", "��"), ("e", ""), ("f", None)]
    return spark.createDataFrame(rows, "id string, text string").filter(T.is_binary(F.col("text"))).select("id")


@query("secret_path", said("path", [(p,) for p in (".kamal/secrets", "deploy/.env", "certs/api.key", "pnpm-lock.yaml", "config/.env.local", "keys/id_rsa", "A/TOKENS.txt")]))
def secret_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [".kamal/secrets", "deploy/.env", "certs/api.key", "pnpm-lock.yaml", "config/.env.local", "keys/id_rsa", "A/TOKENS.txt", "config/deploy.yml", "deploy/.env.example", "deploy/.env.sample", "deploy/backup.sh", "my.environment"]
    return spark.createDataFrame([(r,) for r in rows], "path string").filter(F.col("path").rlike(T.SECRET_LIKE))


@query("stale_builds", said("domain, reason", [("never", "never built"), ("moved", "head moved"), ("edited", "file changed")]))
def stale_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = spark.createDataFrame
    builds = make([("fresh", "/f", "h1", 100), ("never", "/n", None, None), ("moved", "/m", "h1", 100), ("elsewhere", "/e", "h1", 100), ("edited", "/d", "h1", 100)], "domain string, root string, head string, built bigint")
    heads = make([("/f", "h1"), ("/m", "h2"), ("/e", "h2"), ("/d", "h1")], "root string, head string")
    files = make([("/f", "h1", "a.md", 50, True), ("/m", "h2", "a.md", 120, True), ("/e", "h1", "a.md", 60, True), ("/d", None, "b.md", 130, False), ("/f", None, "c.md", 90, False)], "root string, head string, path string, modified bigint, committed boolean")
    return provenance.stale_builds(builds, heads, files)


@query("forget_plan", said("path, kind", [("/out/a", "folder"), ("/repo/a/hook", "hook")]))
def forget_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", "/out/a", "folder"), ("a", "/repo/shared/hook", "hook"), ("a", "/repo/a/hook", "hook"), ("b", "/out/b", "folder"), ("b", "/repo/shared/hook", "hook")]
    return provenance.forget_plan(spark.createDataFrame(rows, "domain string, path string, kind string"), "a")


@query("reuse_questions", said("question, old_id, new_id", [("q1", "o1", "n1"), ("q2", "o1", "n1"), ("q4", "o4", "n4")]))
def reuse_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept with the same path, heading and text; dropped with another path or text."""
    kind = "id string, path string, heading string, text string"
    old = spark.createDataFrame([("o1", "a.md", "H", "t"), ("o2", "a.md", "H", "gone"), ("o3", "moved.md", "H", "t"), ("o4", "c.md", None, "t")], kind)
    new = spark.createDataFrame([("n1", "a.md", "H", "t"), ("n2", "a.md", "H", "t"), ("n3", "b.md", "H", "t"), ("n4", "c.md", None, "t"), ("n5", "c.md", "", "t")], kind)
    return provenance.carried_over(spark.createDataFrame([("q1", "o1"), ("q2", "o1"), ("q3", "o2"), ("q4", "o4"), ("q5", "o3"), ("q6", "none")], "question string, id string"), old, new)


@query("check_sources", said("id, pinned, found", [("oss:held", _REV, "b" * 40), ("oss:inner", _REV, None)]))
def check_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.moved_sources(_sources(spark), spark.createDataFrame([("oss:lib", _REV), ("oss:held", "b" * 40)], "id string, head string"))
