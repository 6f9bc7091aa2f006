"""Problem 8: mixing sources to target shares, by systematic sampling.

The size of the mix is the tokens of all listed sources; each source is to give its share of it. Every text of a source
has the same expected number of copies: wanted tokens over the tokens of the source's texts, at most max_repeats. The
texts of a source stand in order of size, the longest first. Their expected copies are prefix-summed, weighed by size, and
one random offset is added; each time the sum has passed another text of the present size, a copy comes out. What is left
at the end of a size goes on to the next smaller one, so a long text that falls in or out is made up for by the shorter
ones, and a source is off by about its shortest text.

The prefix sum is taken in two steps. First over the sizes of each source, of which there are few: how many copies its
texts of one size give together. Then over the texts of that size at random: those copies are spread evenly over their
places, after another offset, so each text comes out the expected number of times rounded down or up. Places are numbered
by slices of the hash of about SLICE_ROWS texts, so a source that holds a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.bpe import DEFAULT_VOCABULARY, count_tokens
from docloom.session import stored

#: Texts that one task numbers at a time, on average.
SLICE_ROWS = 10_000


def counted(docs: DataFrame, key: str, text: str, source: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, source, said, n_tokens) written once; said, of 128 bits, identifies the text."""
    rows = docs.select(F.col(key).alias("key"), F.trim(F.col(source)).alias("source"), F.unhex(F.md5(text)).alias("said"), F.col(text).alias("text"))
    return stored(count_tokens(rows, "key", "text", ["source", "said"], vocabulary))


def plan(tokens: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts to draw from, (key, source, n_tokens), and per listed source what is there and what is wanted."""
    goals = targets.select(F.trim("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))
    listed = tokens.join(goals.select("source"), "source")
    copies = stored(listed.groupBy("source", "said", "n_tokens").agg(F.min("key").alias("key"), F.count("*").alias("documents")))
    whole = Window.partitionBy(F.lit(0))  # over the listed sources, one row each
    there = copies.groupBy("source").agg(F.sum("documents").alias("documents"), F.sum(F.col("documents") * F.col("n_tokens")).alias("source_tokens"), F.sum("n_tokens").alias("held_tokens"))
    wanted = goals.join(there, "source", "left").fillna(0, ["documents", "source_tokens", "held_tokens"])
    wanted = wanted.withColumn("total", F.sum("source_tokens").over(whole)).withColumn("target_tokens", F.col("target_share") * F.col("total"))
    # A text of several sources is drawn for the one that is shortest of texts, so that its copies keep to one cap.
    need = wanted.select("source", (F.col("target_tokens") / F.greatest("held_tokens", F.lit(1))).alias("need"))
    best = copies.join(need, "source").groupBy("said").agg(F.max(F.struct("need", "source", "n_tokens", "key")).alias("t"))
    texts = stored(best.select("t.key", "t.source", "t.n_tokens").filter("n_tokens > 0"))
    drawn_from = texts.groupBy("source").agg(F.count("*").alias("texts"), F.sum("n_tokens").alias("text_tokens"))
    wanted = wanted.drop("held_tokens").join(drawn_from, "source", "left").fillna(0, ["texts", "text_tokens"])
    rate = F.when(F.col("text_tokens") > 0, F.least(F.col("target_tokens") / F.col("text_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return texts, wanted.withColumn("rate", rate)


def _unit(*parts: Column) -> Column:
    """A random number from 0 up to 1, the same for the same parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1_000_003)) / 1_000_003


def _copies_by_size(sizes: pd.DataFrame) -> pd.DataFrame:
    """The sizes of one source (source, n_tokens, n, rate, max_repeats, offset) with the copies of each."""
    sizes = sizes.sort_values("n_tokens", ascending=False)
    out, left = [], 0.0
    for size, n, rate, most, offset in zip(sizes["n_tokens"], sizes["n"], sizes["rate"], sizes["max_repeats"], sizes["offset"]):
        due = rate * n * size + left
        copies = min(max(math.floor(due / size + offset + 1e-9), 0), most * n)
        left = due - copies * size
        out.append(copies)
    return sizes.assign(copies=out)[["source", "n_tokens", "n", "copies"]]


def sample(texts: DataFrame, wanted: DataFrame, seed: int = 0) -> DataFrame:
    """(key, source, n_tokens, copies) of the texts that come out at least once. texts: (key, source, n_tokens > 0), wanted:
    (source, rate, max_repeats)."""
    sizes = texts.groupBy("source", "n_tokens").agg(F.count("*").alias("n")).join(wanted.select("source", "rate", "max_repeats"), "source")
    sizes = sizes.withColumn("offset", _unit(F.lit(seed), "source")).withColumn("max_repeats", F.col("max_repeats").cast("bigint"))
    sizes = sizes.groupBy("source").applyInPandas(_copies_by_size, "source string, n_tokens bigint, n bigint, copies bigint")
    sizes = stored(sizes.filter("copies > 0").withColumn("slices", F.floor(F.col("n") / SLICE_ROWS) + 1))
    h = F.xxhash64(F.lit(seed), "key")
    drawn = stored(texts.join(sizes, ["source", "n_tokens"]).withColumn("h", h).withColumn("slice", F.pmod(F.col("h"), F.col("slices"))))
    of = ["source", "n_tokens", "slice"]
    before = Window.partitionBy("source", "n_tokens").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = drawn.groupBy(*of).agg(F.count("*").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held")
    placed = drawn.withColumn("within", F.row_number().over(Window.partitionBy(*of).orderBy("h", "key"))).join(slices, of)
    place, offset = F.col("before") + F.col("within"), F.pmod(F.xxhash64(F.lit(seed), F.lit("size"), "source", "n_tokens"), F.col("n"))
    # All texts of a size come out base times, and one more for each whole number that the places of the rest cross.
    placed = placed.withColumn("place", place).withColumn("offset", offset).withColumn("rest", F.pmod(F.col("copies"), F.col("n"))).withColumn("base", F.floor(F.col("copies") / F.col("n")))
    copies = F.col("base") + F.expr("(place * rest + offset) div n - ((place - 1) * rest + offset) div n")
    return placed.select("key", "source", "n_tokens", copies.cast("int").alias("copies")).filter("copies > 0")


def mix(docs: DataFrame, key: str, text: str, source: str, targets: DataFrame, seed: int = 0, vocabulary: str = DEFAULT_VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The sample (key, source, n_tokens, copies) and the report, one row per row of targets: (source, target_share,
    max_repeats, documents, texts, source_tokens, target_tokens, drawn, mixed_tokens, share_of_total, actual_share).

    targets: (source, target_share, max_repeats), one row a source. Sources are compared without blanks around them;
    documents of no or an unlisted source take no part. A text counts once for drawing, however many documents have it: under
    its least key of one source, the one with the highest wanted share of its tokens if it stands in several, so it is
    used at most max_repeats times; all its documents count in the total. Null and empty texts have no tokens and aren't
    drawn. A source that can't reach its share within max_repeats stays short, and the others keep theirs. A null share
    counts as 0, a null max_repeats as 1."""
    texts, wanted = plan(counted(docs, key, text, source, vocabulary), targets)
    wanted = stored(wanted)
    out = sample(texts, wanted, seed)
    got = out.groupBy("source").agg(F.sum("copies").alias("drawn"), F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"))
    report = wanted.join(got, "source", "left").fillna(0, ["drawn", "mixed_tokens"])
    share = lambda of: F.when(of > 0, F.col("mixed_tokens") / of).otherwise(0.0)
    report = report.select(
        "source", "target_share", "max_repeats", "documents", "texts", "source_tokens", "target_tokens", "drawn", "mixed_tokens",
        share(F.col("total")).alias("share_of_total"), share(F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))).alias("actual_share"),
    )
    return out.withColumnRenamed("key", key), report
