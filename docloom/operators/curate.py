"""Corpus curation: cleaning, first-wins dedup, budgets, caps and the leakage gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import ngram_hashes, paragraph_key, unicode_words
from docloom.functions.text import ngrams as ngrams_of
from docloom.session import stored


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, no, paragraph): the parts between blank lines that aren't blank."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(df[text], r"\r\n?", "\n"), r"\n[ \t]*\n"), lambda p: F.trim(p)), lambda p: p != "")
    return df.select(df[key].alias("key"), F.posexplode(parts).alias("no", "paragraph"))


def first_wins(rows: DataFrame, same: Column, order: list[Column], least: int) -> DataFrame:
    """The rows of which no earlier one in the given total order has the same key; keys shorter than `least` characters
    never count as the same. The first of each key is found by a grouped minimum, which is combined before the shuffle,
    so a line that a third of all documents hold makes no hot task."""
    keyed = rows.withColumn("_same", F.when(F.length(same) >= least, F.xxhash64(same)))
    own = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    keyed = keyed.withColumn("_own", own)
    first = keyed.filter("_same is not null").groupBy("_same").agg(F.min("_own").alias("_first"))
    kept = keyed.join(first, "_same", "left").filter(F.col("_same").isNull() | (F.col("_own") == F.col("_first")))
    return kept.drop("_same", "_own", "_first")


def dedup_paragraphs(df: DataFrame, key: str, text: str, order: list[str], least: int = 40) -> DataFrame:
    """(key, no, paragraph) without the paragraphs that stand in an earlier document (or earlier in the same one)."""
    rows = paragraphs(df, key, text).join(df.select(F.col(key).alias("key"), *order).distinct(), "key")
    return first_wins(rows, paragraph_key(F.col("paragraph")), [F.col(o) for o in order] + [F.col("key"), F.col("no")], least).select("key", "no", "paragraph")


def boilerplate(grams: DataFrame, sources: int = 2) -> DataFrame:
    """(gram): grams that stand in at least that many sources. grams: (source, unit, gram)."""
    return grams.select("gram", "source").distinct().groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") >= sources).select("gram")


def gram_rows(units: DataFrame, unit: str, source: str, text: str, n: int = 13, hashed: bool = True) -> DataFrame:
    """(source, unit, gram): the distinct runs of n words of each unit, as 64-bit hashes or as text."""
    ngrams = ngram_hashes if hashed else ngrams_of
    return units.select(F.col(source).alias("source"), F.col(unit).alias("unit"), F.explode(F.array_distinct(ngrams(unicode_words(F.col(text)), n))).alias("gram"))


def leakage_gate(grams: DataFrame, reference: DataFrame, least: int = 3) -> DataFrame:
    """(unit, source, hits) of units with at least `least` grams of the reference, boilerplate of the units' sources
    aside. reference: (gram)."""
    # Only grams of the reference matter, so they are picked first and counted by source afterwards.
    met = stored(grams.join(reference.distinct(), "gram", "left_semi"))
    clean = met.join(boilerplate(met), "gram", "left_anti")
    return clean.groupBy("unit", "source").agg(F.count("*").alias("hits")).filter(F.col("hits") >= least)


def running_budget(rows: DataFrame, group: list[str], order: list[Column], size: str, budget: Column) -> DataFrame:
    """The rows before which the sizes of the earlier rows of their group sum to less than the budget."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_used", F.coalesce(F.sum(size).over(before), F.lit(0))).filter(F.col("_used") < budget).drop("_used")


def greedy_budget(rows: DataFrame, group: str, order: list[str], size: str, budget: float, most: int = 1_000_000) -> DataFrame:
    """Ordered fold per group: a row is taken if it fits into what is left of the budget, or if nothing is taken yet; a
    later, smaller row may still fit. Order-dependent, so a group is one task; it streams sorted rows and holds one
    number, whatever the size of the group. rows must have one row per item."""
    import pyarrow as pa

    names = rows.columns
    at, of = names.index(size), names.index(group)

    def run(batches):
        held, used = object(), 0.0
        for batch in batches:
            keep = []
            for g, n in zip(batch.column(of).to_pylist(), batch.column(at).to_pylist()):
                if g != held:
                    held, used = g, 0.0
                ok = used == 0 or used + n <= budget
                used += n if ok else 0
                keep.append(ok)
            yield batch.filter(pa.array(keep, pa.bool_()))

    spread = rows.repartition(group).sortWithinPartitions(group, *order)
    return spread.mapInArrow(run, rows.schema)


def cap_per(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def sentences(text: Column) -> Column:
    """Sentences end after . ! or ? with white space and a capital, backtick, bracket or quote behind it."""
    return F.split(F.regexp_replace(text, "([.!?])[ \t\r\n]+([A-Z`(\"'])", "$1\u0001$2"), "\u0001")


def prose(sentence: Column) -> Column:
    """8 to 64 words, more than half of the characters letters."""
    n = F.size(F.filter(F.split(sentence, "[ \t\r\n]+"), lambda w: w != ""))
    return n.between(8, 64) & (F.length(F.regexp_replace(sentence, "[^A-Za-z]", "")) * 2 > F.length(sentence))


def running_before(rows: DataFrame, group: str, key: str, value: Column, width: int = 10_000) -> DataFrame:
    """rows with `before`: the sum of value over the rows of the group with a smaller number in key (distinct within a group).
    In two steps, over slices of `width` numbers and within a slice, so a large group isn't one task. A null group is one."""
    sliced = rows.withColumn("_value", F.coalesce(value, F.lit(0))).withColumn("_slice", F.floor(F.col(key) / width)).withColumn("_group", F.coalesce(F.col(group).cast("string"), F.lit("\0")))
    sums = sliced.groupBy("_group", "_slice").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_group", "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_group", "_slice").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    placed = sliced.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0))).join(sums, ["_group", "_slice"])
    return placed.withColumn("before", F.col("_base") + F.col("_within")).drop("_value", "_slice", "_group", "_base", "_within")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `number` from 1 in a total order over all of them: a range partitioning, written once, and the places within
    each range behind the counts of those before."""
    ranged = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_place", place).join(before, "_range").withColumn("number", F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def code_share(text: Column) -> Column:
    """The share of a text's characters on lines between fences, the fences' own among them; 0 for an empty text."""
    step = lambda held, line: F.when(line.startswith("```"), F.struct((~held["inside"]).alias("inside"), (held["code"] + F.length(line)).alias("code"))).otherwise(
        F.struct(held["inside"].alias("inside"), (held["code"] + F.when(held["inside"], F.length(line)).otherwise(0)).alias("code"))
    )
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")
    total = F.aggregate(lines, F.lit(0), lambda n, line: n + F.length(line))
    code = F.aggregate(lines, F.struct(F.lit(False).alias("inside"), F.lit(0).alias("code")), step, lambda held: held["code"])
    return F.when(total > 0, code / total).otherwise(0.0)


def masked(tokens: Column, key: Column, share: float, mask: str = "[MASK]", seed: int = 0) -> Column:
    """The tokens with about `share` of them replaced, each by a hash of the seed, the key and its place."""
    limit = int(share * 1_000_000)
    return F.transform(tokens, lambda t, i: F.when(F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key, i)), 1, 8), 16, 10).cast("bigint"), F.lit(1_000_000)) < limit, mask).otherwise(t))


def resolved_settings(defaults: DataFrame, file: DataFrame, environment: DataFrame) -> DataFrame:
    """(name, value, origin, problem) of settings: the environment before the file before the default, as text. defaults:
    (name, value, kind, choices), kind one of int, float, bool, str; a value that isn't of its kind, or none of the choices,
    gives way to the default and is told as a problem. Bools come out as true or false."""
    given = defaults.join(file.select("name", F.col("value").alias("f")), "name", "left").join(environment.select("name", F.col("value").alias("e")), "name", "left")
    raw = F.trim(F.coalesce("e", "f"))
    truth = F.when(F.lower(raw).isin("1", "true", "on", "yes"), "true").when(F.lower(raw).isin("0", "false", "off", "no"), "false")
    typed = F.when(F.col("kind") == "int", F.expr("cast(try_cast(_raw as bigint) as string)")).when(F.col("kind") == "float", F.expr("cast(try_cast(_raw as double) as string)")).when(F.col("kind") == "bool", F.col("_truth")).otherwise(F.col("_raw"))
    rows = given.withColumn("_raw", raw).withColumn("_truth", truth).withColumn("typed", typed)
    fits = F.col("choices").isNull() | F.array_contains("choices", F.col("typed"))
    problem = F.when(F.col("_raw").isNull(), None).when(F.col("typed").isNull(), F.concat(F.lit("no "), "kind")).when(~fits, "not a choice")
    ok = F.col("_raw").isNotNull() & problem.isNull()
    origin = F.when(ok & F.col("e").isNotNull(), "environment").when(ok, "file").otherwise("default")
    return rows.select("name", F.when(ok, F.col("typed")).otherwise(F.col("value")).alias("value"), origin.alias("origin"), problem.alias("problem"))
