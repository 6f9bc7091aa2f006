"""Where corpus units may come from, and the gate that keeps evaluation and private texts out of a stage.

Sources are rows (id, kind, role, url, hf_id, revision, license, sha256, local_dir, aliases); units are rows (unit, source,
text). Reports hold numbers of units and counts, never texts or terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.curate import boilerplate, gram_rows
from docloom.session import stored

#: Kinds and roles of sources, folders of a home.
KINDS = "oss hf book url".split()
ROLES = "train heldout dev".split()
HOME = r"^~|(^|/)(Users|home)/|(^|/)(Desktop|Documents|Downloads|Dropbox[^/]*)(/|$)"
HEX40 = "^[0-9a-f]{40}$"


class StageRejected(ValueError):
    """A stage that holds what it may not hold."""


def _listed(rows: DataFrame, key: str, checks: list[Column]) -> DataFrame:
    """(key, problem), one row for each check that isn't null."""
    return rows.select(key, F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def spec_problems(sources: DataFrame, kinds: list[str] = KINDS, roles: list[str] = ROLES) -> DataFrame:
    """(id, problem): what is wrong with the list of sources. Every source needs an id, kind, role, license and revision of
    its own; a clone or book an https address and a pinned commit, a hub dataset its name and revision, a download the hash
    of the archive; and no folder of somebody's home."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    missing = [F.when(empty(c), f"missing {c}") for c in ("id", "kind", "role", "license", "revision")]
    pinned = F.coalesce(F.col("revision").rlike(HEX40), F.lit(False))
    checks = [
        *missing,
        F.when(~F.coalesce(F.col("kind").isin(kinds), F.lit(False)), "unknown kind"),
        F.when(~F.coalesce(F.col("role").isin(roles), F.lit(False)), "unknown role"),
        F.when(F.col("kind").isin("oss", "book") & ~(F.coalesce(F.col("url").startswith("https://"), F.lit(False)) & pinned), "needs an https address and a pinned commit"),
        F.when((F.col("kind") == "hf") & ~(~empty("hf_id") & pinned), "needs the dataset's name and a pinned revision"),
        F.when((F.col("kind") == "url") & ~(F.coalesce(F.col("url").startswith("http"), F.lit(False)) & ~empty("sha256")), "needs an address and the archive's hash"),
        F.when(F.col("local_dir").rlike(HOME), "folder of a home"),
    ]
    twice = sources.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("duplicate id").alias("problem"))
    return _listed(sources.withColumn("id", F.coalesce("id", F.lit("?"))), "id", checks).union(twice.filter("id is not null"))


def resolved(names: DataFrame, sources: DataFrame, roles: list[str] = ("train",)) -> DataFrame:
    """(name, id, refused) of names (name): the source an id or alias stands for, and why it may not be used, if so."""
    aliases = sources.select(F.explode("aliases").alias("name"), F.col("id").alias("of")).groupBy("name").agg(F.min("of").alias("of"))
    ids = sources.groupBy("id").agg(F.max("role").alias("role"))
    known = ids.select(F.col("id").alias("name"), F.lit(True).alias("is_id"))
    said = names.select("name").distinct().join(known, "name", "left").join(aliases, "name", "left")
    said = said.select("name", F.when(F.col("is_id"), F.col("name")).otherwise(F.coalesce("of", "name")).alias("id")).join(ids, "id", "left")
    why = F.when(F.col("role").isNull(), "not listed").when(~F.col("role").isin(*roles), F.concat(F.lit("role "), "role"))
    return said.select("name", "id", why.alias("refused"))


def sources_of_paths(paths: DataFrame, sources: DataFrame, denied: list[str], roles: list[str] = ("train",)) -> DataFrame:
    """(path, id, refused) of absolute paths (path): the source whose folder holds it, the deepest if several do; refused if
    the path matches a denied pattern, lies under no source, or under one of another role. By the folders a path lies
    in, so no path is held against all sources."""
    parts = F.split("path", "/")
    above = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("folder"))
    held = above.join(sources.select(F.regexp_replace("local_dir", "/+$", "").alias("folder"), "id", "role"), "folder")
    best = held.groupBy("path").agg(F.max(F.struct(F.length("folder").alias("n"), "id", "role")).alias("s"))
    bad = F.lit(False)
    for pattern in denied:
        bad = bad | F.col("path").rlike(f"(?i){pattern}")
    why = F.when(bad, "denied path").when(F.col("s").isNull(), "under no source").when(~F.col("s.role").isin(*roles), F.concat(F.lit("role "), "s.role"))
    return paths.select("path").distinct().join(best, "path", "left").select("path", F.col("s.id").alias("id"), why.alias("refused"))


def marked_texts(units: DataFrame, terms: list[str]) -> DataFrame:
    """(unit, marker): the units that have a private term as a word, by the term's place in the list; the term isn't told."""
    text = F.lower("text")
    hits = [F.when(text.rlike(r"(?<![a-z0-9])\Q" + t.lower().replace(r"\E", "") + r"\E(?![a-z0-9])"), F.lit(i)) for i, t in enumerate(terms)]
    return units.select("unit", F.explode(F.array_compact(F.array(*hits))).alias("marker")).distinct() if terms else units.select("unit", F.lit(0).alias("marker")).limit(0)


def gate(units: DataFrame, evaluation: DataFrame, private: DataFrame, drop: bool = True, private_least: int = 3, eval_least: int = 3, n: int = 13) -> tuple[DataFrame, DataFrame]:
    """The verdicts (unit, source, private_hits, eval_hits, kept) and one row (ok, units, kept, private_hits, eval_hits,
    boilerplate). Runs of n words that two sources of the stage share don't count. A unit with private_least private runs
    fails the stage; one with eval_least runs of an evaluation text is dropped, or, with drop false, fails it too.

    evaluation, private: (text). The stage's runs are read once; only those of the two references are shuffled on, but
    for the count of boilerplate."""
    runs = stored(gram_rows(units, "unit", "source", "text", n))
    of = lambda texts: gram_rows(texts.withColumns({"unit": F.lit(0), "source": F.lit("")}), "unit", "source", "text", n).select("gram").distinct()
    wanted = of(evaluation).withColumn("e", F.lit(1)).join(of(private).withColumn("p", F.lit(1)), "gram", "full")
    common = stored(boilerplate(runs))
    met = runs.join(wanted, "gram").join(common, "gram", "left_anti")
    hits = met.groupBy("unit", "source").agg(F.coalesce(F.sum("p"), F.lit(0)).alias("private_hits"), F.coalesce(F.sum("e"), F.lit(0)).alias("eval_hits"))
    verdicts = units.select("unit", "source").distinct().join(hits, ["unit", "source"], "left").fillna(0, ["private_hits", "eval_hits"])
    leaks = F.col("eval_hits") >= eval_least
    verdicts = stored(verdicts.withColumn("kept", ~leaks if drop else F.lit(True)))
    total = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    report = verdicts.agg(F.count("*").alias("units"), total(F.col("kept")).alias("kept"), total(F.col("private_hits") >= private_least).alias("private_hits"), total(leaks).alias("eval_hits"))
    report = report.crossJoin(F.broadcast(common.agg(F.count("*").alias("boilerplate"))))  # one row each
    ok = (F.col("private_hits") == 0) & (F.lit(drop) | (F.col("eval_hits") == 0))
    return verdicts, report.select(ok.alias("ok"), "units", "kept", "private_hits", "eval_hits", "boilerplate")


def finalize(units: DataFrame, sources: DataFrame, evaluation: DataFrame, private: DataFrame) -> DataFrame:
    """The manifest (id, kind, revision, license, n_docs, n_chars) of a stage that is written already. Raises StageRejected
    if a unit's source isn't listed for training, or if any unit overlaps with a private or evaluation text."""
    names = stored(resolved(units.select(F.col("source").alias("name")), sources))
    if refused := names.filter("refused is not null").orderBy("name").limit(5).collect():
        raise StageRejected("; ".join(f"{r.name}: {r.refused}" for r in refused))
    told = gate(units, evaluation, private, drop=False)[1].first()
    if not told.ok:
        raise StageRejected(f"{told.private_hits} units overlap private texts, {told.eval_hits} evaluation texts")
    return manifest(units, sources)


def manifest(units: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, kind, revision, license, n_docs, n_chars) of the sources that the units come from."""
    names = resolved(units.select(F.col("source").alias("name")), sources).filter("refused is null")
    counts = units.join(names.select(F.col("name").alias("source"), "id"), "source").groupBy("id").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"))
    return counts.join(sources.select("id", "kind", "revision", "license").dropDuplicates(["id"]), "id").select("id", "kind", "revision", "license", "n_docs", "n_chars")


def manifest_problems(rows: DataFrame, sources: DataFrame, files: DataFrame) -> DataFrame:
    """(file, problem) of manifests (file, sha256, created, gate_ok, id, revision, license), one row a source, against the
    files (file, sha256) as they are and the list of sources."""
    now = files.select("file", F.col("sha256").alias("now"))
    listed = sources.filter("role = 'train'").select("id", F.col("revision").alias("pinned")).dropDuplicates(["id"])
    at = rows.join(now, "file", "left").join(listed, "id", "left")
    checks = [
        F.when(F.col("now").isNull(), "no such file").when(F.col("now") != F.col("sha256"), "sha256 mismatch"),
        F.when(F.col("created").isNull(), "missing created"),
        F.when(~F.coalesce("gate_ok", F.lit(False)), "gate not passed"),
        *[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.concat("id", F.lit(f": missing {c}"))) for c in ("revision", "license")],
        F.when(F.col("pinned").isNull(), F.concat("id", F.lit(": not listed"))).when(F.col("pinned") != F.coalesce("revision", F.lit("")), F.concat("id", F.lit(": other revision"))),
    ]
    return _listed(at, "file", checks).distinct()


def stale_builds(builds: DataFrame, heads: DataFrame, files: DataFrame) -> DataFrame:
    """(domain, reason) of domains whose build is behind: never built, its repository's head moved and the move touched one of
    its files, or a file that isn't committed is newer than the build.

    builds: (domain, root, head, built), built null if never; heads: (root, head) now; files: (root, head, path, modified,
    committed) of documents and code, committed files with the head that last touched them since the build."""
    none = builds.filter("built is null").select("domain", F.lit("never built").alias("reason"))
    made = builds.filter("built is not null")
    moved = made.join(heads.select("root", F.col("head").alias("now")), "root").filter("now <> head").select("domain", "root", "head")
    touched = files.filter("committed").select("root", F.col("head").alias("by")).distinct()
    moved = moved.join(touched, "root").filter("by <> head").select("domain", F.lit("head moved").alias("reason"))
    newer = made.join(files.filter("not committed").groupBy("root").agg(F.max("modified").alias("modified")), "root").filter("modified > built").select("domain", F.lit("file changed").alias("reason"))
    return none.union(moved).union(newer).distinct()


def forget_plan(holdings: DataFrame, domain: str) -> DataFrame:
    """(path, kind) of what goes with a domain: of its holdings (domain, path, kind) those that no other domain holds."""
    own = holdings.filter(F.col("domain") == domain).select("path", "kind").distinct()
    return own.join(holdings.filter(F.col("domain") != domain).select("path").distinct(), "path", "left_anti").select("path", "kind")


def carried_over(questions: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(question, old_id, new_id) of questions (question, id) whose section stands unchanged in a new build: the same path,
    heading and text, null being equal to null. Sections are (id, path, heading, text); of equal new ones the least id counts."""
    key = lambda df: df.withColumn("_text", F.sha2(F.to_json(F.struct("path", "heading", "text"), {"ignoreNullFields": "false"}), 256))
    there = key(new).groupBy("_text").agg(F.min("id").alias("new_id"))
    held = key(old.join(questions.select("id").distinct(), "id", "left_semi")).select(F.col("id").alias("old_id"), "_text").distinct()
    return questions.withColumnRenamed("id", "old_id").join(held.join(there, "_text").select("old_id", "new_id"), "old_id").select("question", "old_id", "new_id")


def moved_sources(sources: DataFrame, heads: DataFrame) -> DataFrame:
    """(id, pinned, found) of pinned sources whose clone (id, head) is missing or stands at another revision."""
    at = sources.filter("local_dir is not null").select("id", F.col("revision").alias("pinned")).distinct().join(heads.select("id", F.col("head").alias("found")), "id", "left")
    return at.filter(~F.col("pinned").eqNullSafe(F.col("found")))
