"""Folders of Markdown notes with front matter: reading it, writing it, and what is wrong with a change or a tree."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of the front matter, and the index of a folder.
KEYS = ("name", "description", "read_only")
INDEX = "MEMORY.md"

_HEAD = r"(?s)\A---\n(.*?\n)??---(?:\n|\z)"


def fields(text: Column) -> Column:
    """The front matter as an array of structs (key, value), in order; empty without any. Values aren't interpreted."""
    inner = F.split(F.regexp_replace(F.regexp_extract(text, _HEAD, 1), r"\n\z", ""), "\n")
    pairs = F.transform(inner, lambda x: F.struct(F.trim(F.regexp_extract(x, "^[^:]*", 0)).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:?", "")).alias("value")))
    return F.when(text.rlike(_HEAD), F.filter(pairs, lambda x: x["key"] != "")).otherwise(F.array().cast("array<struct<key:string,value:string>>"))


def body(text: Column) -> Column:
    """The text behind the front matter."""
    return F.when(text.rlike(_HEAD), F.regexp_replace(F.regexp_replace(text, _HEAD, ""), r"\A\n+", "")).otherwise(text)


def rendered(name: Column, description: Column, text: Column) -> Column:
    """A note with front matter; values on one line of at most 300 characters, - where there is none."""
    plain = lambda c: F.left(F.replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), F.lit("---"), F.lit("-")), F.lit(300))
    scalar = lambda c: F.when(plain(c) == "", "-").otherwise(plain(c))
    return F.concat(F.lit("---\nname: "), scalar(name), F.lit("\ndescription: "), scalar(description), F.lit("\n---\n\n"), F.regexp_replace(text, r"\A\s+|\s+\z", ""), F.lit("\n"))


def _value(text: Column, key: str) -> Column:
    found = F.filter(fields(F.coalesce(text, F.lit(""))), lambda x: x["key"] == key)
    return F.coalesce(F.try_element_at(found, F.lit(1))["value"], F.lit(""))


def change_problems(files: DataFrame) -> DataFrame:
    """(path, problem) of changed notes (path, content, previous); previous, null for a new one, is what was accepted
    before. An index has no front matter, every other note has it, with a name, a description, known keys, each once and
    filled. read_only is set, changed and removed by nobody, and protects the note."""
    held = F.col("held")
    rows = files.withColumn("held", fields(F.col("content"))).withColumn("protected", _value(F.col("previous"), "read_only"))
    name = F.regexp_extract("path", "[^/]*$", 0)
    opens, closed = F.col("content").rlike(r"\A---(\n|\z)"), F.col("content").rlike(_HEAD)
    keys = F.transform(held, lambda x: x["key"])
    has = lambda k: F.array_contains(keys, k)
    own = _value(F.col("content"), "read_only")
    none = F.array().cast("array<string>")
    one = lambda c, *said: F.when(c, F.array(F.concat(*[F.lit(x) if isinstance(x, str) else x for x in said]))).otherwise(none)
    each = F.flatten(F.transform(held, lambda x, i: F.when(~x["key"].isin(*KEYS), F.array(F.concat(F.lit("unknown key "), x["key"]))).otherwise(F.array_compact(F.array(
        F.when(F.array_position(keys, x["key"]) < i + 1, F.concat(F.lit("duplicate key "), x["key"])),
        F.when((x["key"] != "read_only") & x["value"].isin("", '""', "''"), F.concat(x["key"], F.lit(" is empty"))),
        F.when((x["key"] == "read_only") & F.col("previous").isNull(), F.lit("read_only can't be set")).when((x["key"] == "read_only") & (x["value"] != F.col("protected")), F.lit("read_only can't be changed")),
    )))))
    inner = F.concat(each, *[one(~has(k), f"missing {k}") for k in ("name", "description")], one((F.col("protected") != "") & (own == ""), "read_only can't be removed"))
    problems = (
        F.when(name == INDEX, one(opens, "an index has no front matter"))
        .when(~opens, F.array(F.lit("missing front matter")))
        .when(~closed, F.array(F.lit("front matter isn't closed")))
        .when(F.col("protected") == "true", F.array(F.lit("file is read_only")))
        .otherwise(inner)
    )
    return rows.select("path", F.explode(problems).alias("problem"))


def glob_pattern(pattern: str) -> str:
    """A glob as a regular expression: ? one character and * any number within a folder, **/ any folders, ** anything."""
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(parts.get(t, re.escape(t)) for t in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", pattern)) + "$"


def tree_problems(files: DataFrame, deepest: int | None = None, largest: int | None = None, core: int | None = None, limits: list[tuple[str, int | None]] = ()) -> DataFrame:
    """(path, problem) of a tree of notes (path, mode, n_chars). Every folder with notes in it or below has an index, and so
    has the root; notes are regular files, no deeper than `deepest` and no longer than `largest` or the first of limits
    (glob, characters) that fits; those at the root together are no longer than `core`. Other files don't count."""
    notes = files.filter(F.col("path").endswith(".md"))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    parts = F.split("path", "/")
    above = notes.select("path", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("depth", "folder"))
    indexed = notes.filter(F.regexp_extract("path", "[^/]*$", 0) == INDEX).select(folder.alias("folder")).distinct()
    lacking = above.filter("folder <> ''").join(indexed, "folder", "left_anti").groupBy("path").agg(F.min(F.struct("depth", "folder")).alias("f"))
    out = lacking.select("path", F.concat(F.lit("missing index of "), "f.folder").alias("problem"))
    root = notes.agg(F.max((F.col("path") == INDEX).cast("int")).alias("has"), F.coalesce(F.sum(F.when(~F.contains("path", F.lit("/")) & F.col("mode").startswith("100"), F.col("n_chars"))), F.lit(0)).alias("core"))
    checks = [F.when(F.coalesce("has", F.lit(0)) == 0, "missing index of the root"), F.when(F.col("core") > core, F.concat(F.lit("root holds "), "core", F.lit(f" characters of {core}"))) if core is not None else F.lit(None).cast("string")]
    out = out.union(root.select(F.lit("").alias("path"), F.explode(F.array_compact(F.array(*checks))).alias("problem")))
    limit = F.lit(largest).cast("bigint")
    for pattern, most in reversed(list(limits)):
        limit = F.when(F.col("path").rlike(glob_pattern(pattern)), F.lit(most).cast("bigint")).otherwise(limit)
    depth = F.size(parts) - 1
    regular = F.col("mode").startswith("100")
    checks = [
        F.when(~regular, "no regular file"),
        F.when(regular & (depth > deepest), F.concat(F.lit("depth "), depth, F.lit(f" of {deepest}"))) if deepest is not None else F.lit(None).cast("string"),
        F.when(regular & (F.col("n_chars") > F.col("most")), F.concat("n_chars", F.lit(" characters of "), "most")),
    ]
    return out.union(notes.withColumn("most", limit).select("path", F.explode(F.array_compact(F.array(*checks))).alias("problem")))


def cut_at_headings(files: DataFrame, most: int) -> DataFrame:
    """(path, part, text): the parts of texts (path, text) of at most `most` characters, cut before headings of the second
    level; one that is longer by itself stays whole. Parts are filled in order."""
    pieces = F.filter(F.split("text", r"(?m)(?=^## )"), lambda x: x != "")
    step = lambda held, x: F.when(
        (F.size(held) > 0) & (F.length(F.element_at(held, -1)) + F.length(x) <= most), F.concat(F.slice(held, 1, F.size(held) - 1), F.array(F.concat(F.element_at(held, -1), x)))
    ).otherwise(F.concat(held, F.array(x)))
    packed = F.aggregate(pieces, F.array().cast("array<string>"), step)
    return files.filter("text is not null").select("path", F.posexplode(packed).alias("part", "text"))
