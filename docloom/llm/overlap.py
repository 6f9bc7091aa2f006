"""Problem 2: the same or almost the same records in different splits, by a weighted cosine join.

Each record is a unit vector over its distinct words. Terms are put in one order, rarest first. A record enters the
inverted lists of its first terms only, up to where what follows can no longer reach the threshold: the bound on the rest
is the lesser of its norm, without the terms that the other side lacks, and of the sum of weight times the term's largest
weight on the other side. Two records within the threshold share at least one listed term (if the one whose list ends
earlier shared none, all common terms would lie in its rest). At their first shared term, all they have in common lies in
both rests, so the product of the two norms must reach the threshold. Candidates that this, their sizes or their largest
weights rule out go at once; the others get exact dot products.

Records with the same words are one vector, so copies, however many, are one entry of each list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.operators.codes import told_apart
from docloom.session import stored


def weighted(classes: DataFrame, weighting: str) -> DataFrame:
    """(side, code, term, w, n, mw): unit vectors of classes (side, code, words). weighting "unit": every word weighs the
    same; "idf": by the logarithm of the inverse share of vectors that have it."""
    each = classes.select("side", "code", F.size("words").alias("n"), F.explode("words").alias("term"))
    if weighting == "unit":
        w = 1 / F.sqrt(F.col("n").cast("double"))
        return each.select("side", "code", "term", w.alias("w"), "n", w.alias("mw"))
    if weighting != "idf":
        raise ValueError(weighting)
    counts = each.groupBy("term").agg(F.count("*").alias("df"))
    total = classes.agg(F.count("*").alias("total"))  # one row
    raw = each.join(counts, "term").crossJoin(F.broadcast(total)).withColumn("raw", F.log1p(F.col("total") / F.col("df")))
    norms = raw.groupBy("side", "code").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"), F.max("raw").alias("top"))
    return raw.join(norms, ["side", "code"]).select("side", "code", "term", (F.col("raw") / F.col("norm")).alias("w"), "n", (F.col("top") / F.col("norm")).alias("mw"))


def cosine_join(classes: DataFrame, threshold: float, weighting: str = "unit") -> DataFrame:
    """(code_left, code_right, cosine) of all pairs of a left and a right vector of cosine at least `threshold`.
    classes: (side, code, words), side "left" or "right", words an array of distinct terms; empty ones match nothing."""
    vectors = stored(weighted(classes, weighting))
    stats = vectors.groupBy("term").agg(
        F.count("*").alias("df"),
        F.max(F.when(F.col("side") == "left", F.col("w"))).alias("max_left"),
        F.max(F.when(F.col("side") == "right", F.col("w"))).alias("max_right"),
    )
    other = F.coalesce(F.when(F.col("side") == "left", F.col("max_right")).otherwise(F.col("max_left")), F.lit(0.0))
    rest = Window.partitionBy("side", "code").orderBy("df", "term").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    shared = vectors.join(stats, "term").withColumn("other", other).filter("other > 0")
    bounded = shared.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(rest))).withColumn("bound", F.least("norm", F.sum(F.col("w") * F.col("other")).over(rest)))
    listed = bounded.filter(F.col("bound") >= threshold - 1e-9).select("side", "code", "term", "n", "mw", "norm")
    of = lambda side: listed.filter(F.col("side") == side).select("term", *[F.col(c).alias(f"{c}_{side}") for c in ("code", "n", "mw", "norm")])
    most = F.least("n_left", "n_right") * F.col("mw_left") * F.col("mw_right")
    candidates = of("left").join(of("right"), "term").filter((most >= threshold - 1e-9) & (F.col("norm_left") * F.col("norm_right") >= threshold - 1e-9)).select("code_left", "code_right").distinct()
    whole = vectors.groupBy("side", "code").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("v"))
    full = lambda side: whole.filter(F.col("side") == side).select(F.col("code").alias(f"code_{side}"), F.col("v").alias(f"v_{side}"))
    both = candidates.join(full("left"), "code_left").join(full("right"), "code_right")
    common = F.array_intersect(F.map_keys("v_left"), F.map_keys("v_right"))
    dot = F.aggregate(common, F.lit(0.0), lambda acc, t: acc + F.col("v_left")[t] * F.col("v_right")[t])
    return both.select("code_left", "code_right", dot.alias("cosine")).filter(F.col("cosine") >= threshold - 1e-9)


def split_overlaps(rows: DataFrame, key: str, split: str, words: str, train: str, held_out: list[str], jaccard: float = 0.7) -> DataFrame:
    """(train_key, key, split, similarity): pairs of a record of the train split and one of a held-out split whose
    distinct words in both, divided by those in either, are at least `jaccard`.

    For sets of sizes a and b, such a pair has o >= j (a + b) / (1 + j) words in common and so a cosine of at least
    2 j / (1 + j) under equal weights; the join takes that threshold, and the share itself is then counted exactly.
    Splits are compared as given (the caller normalises them); null and other splits take no part, nor do records
    without words. Repeated rows count once. Other columns are ignored."""
    rows = rows.select(F.col(key).alias("key"), F.col(split).alias("split"), F.array_sort(F.array_distinct(words)).alias("words"))
    rows = rows.filter(F.col("split").isin(train, *held_out) & (F.size("words") > 0)).distinct()
    side = F.when(F.col("split") == train, "left").otherwise("right")
    members = stored(rows.select(side.alias("side"), "split", F.xxhash64("words").alias("code"), F.xxhash64(F.lit(7), "words").alias("check"), "key", "words"))
    members = told_apart(members, "code", "check")
    classes = stored(members.groupBy("side", "code").agg(F.first("words").alias("words")))
    near = cosine_join(classes, 2 * jaccard / (1 + jaccard))
    of = lambda s: classes.filter(F.col("side") == s).select(F.col("code").alias(f"code_{s}"), F.col("words").alias(f"words_{s}"))
    both = near.join(of("left"), "code_left").join(of("right"), "code_right")
    common = F.size(F.array_intersect("words_left", "words_right"))
    either = F.size("words_left") + F.size("words_right") - common
    alike = both.filter(common >= F.lit(jaccard) * either).select("code_left", "code_right", (common / either).alias("similarity"))
    left = members.filter("side = 'left'").select(F.col("code").alias("code_left"), F.col("key").alias("train_key"))
    right = members.filter("side = 'right'").select(F.col("code").alias("code_right"), "key", "split")
    return alike.join(left, "code_left").join(right, "code_right").select("train_key", "key", "split", "similarity").distinct()
