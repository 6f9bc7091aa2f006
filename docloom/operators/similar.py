"""Exact set-similarity join by prefix filtering.

Equal sets are one class, so copies are compared once. The items of a class stand rarest first; if two sets of n and m
items have a Jaccard similarity of t, at least t n of the one's items are in the other, so both share one of their first
n - ceil(t n) + 1 items. Only those are shuffled. At an item that stands at places i and j of the two orders, at most
1 + min(n - i, m - j) items can be common from there on; candidates that this or their sizes rule out go at once, the
others are verified. The sets of a frequent item are cut into blocks, each held against all of them, so no item is one
task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.codes import told_apart
from docloom.session import stored

#: Sets of one item that a task holds against all sets of the item.
BLOCK = 4096


def classes_of(df: DataFrame, key: str, items: str) -> tuple[DataFrame, DataFrame]:
    """(key, rep) and (rep, items): rep is the least key with the same set. items names an array of 64-bit hashes. Null
    and empty sets are left out."""
    sets = df.select(F.col(key).alias("key"), F.array_sort(F.array_distinct(items)).alias("items")).filter(F.size("items") > 0)
    coded = told_apart(stored(sets.withColumn("code", F.xxhash64("items")).withColumn("check", F.xxhash64(F.lit(7), "items"))), "code", "check")
    classes = stored(coded.groupBy("code").agg(F.min("key").alias("rep"), F.first("items").alias("items")))
    return coded.select("key", "code").join(classes.select("code", "rep"), "code").select("key", "rep").distinct(), classes.select("rep", "items")


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): pairs a < b of representatives whose sets have at least that Jaccard similarity. sets:
    (rep, items) as classes_of gives them."""
    each = sets.select("rep", F.size("items").alias("n"), F.explode("items").alias("item"))
    df = each.groupBy("item").agg(F.count("*").alias("df")).filter("df > 1")  # an item of one set has no partner
    shared = each.join(df, "item").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("by_df"))
    # Items of one set come first in the order; they use up the prefix without being listed.
    length = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1 - (F.col("n") - F.size("by_df"))
    listed = shared.withColumn("k", length).filter("k > 0").withColumn("first", F.col("n") - F.size("by_df"))
    listed = listed.select("rep", "n", "first", F.posexplode(F.slice("by_df", F.lit(1), F.col("k"))).alias("at", "x"))
    listed = listed.select("rep", "n", "x.item", (F.col("first") + F.col("at")).alias("at"), F.ceil(F.col("x.df") / BLOCK).cast("int").alias("blocks"))
    of = lambda s, rep: [F.col("rep").alias(rep), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "at")]]
    x = listed.select("item", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), *of("a", "a"))
    y = listed.select("item", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *of("b", "b"))
    needed = F.lit(threshold / (1 + threshold)) * (F.col("n_a") + F.col("n_b")) - 1e-9
    most = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + F.least("at_a", "at_b")
    sizes = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")
    met = x.join(y, ["item", "block"]).filter((F.col("a") < F.col("b")) & sizes & (most >= needed)).select("a", "b").distinct()
    full = met.join(sets.select(F.col("rep").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("items").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    s = common / (F.size("x") + F.size("y") - common)
    return full.select("a", "b", s.alias("similarity")).filter(F.col("similarity") >= threshold - 1e-12)
