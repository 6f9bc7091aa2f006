"""Problem 3: near-duplicates with small edits, by meet-in-the-middle ball hashing.

Texts. The set of runs of three words is signed by min-hash; five symbols at a time make a fingerprint, a set of five
(slot, symbol) elements. Two fingerprints that differ in one slot are at distance 2 (one element gone, one come); every
fingerprint emits all its variants at distance 1, half of that radius, by leaving out one element, and two within the
radius meet at a common variant. With 12 fingerprints, a pair at the threshold of 0.6 meets with probability 0.993, one
at 0.65 with 0.9988 and one at 0.7 with 0.9999; unrelated texts meet very rarely, as four symbols must agree. Variants
are shuffled, colliding pairs deduplicated, screened by their whole signatures and then verified exactly.

Small sets (paths). A fingerprint is the rarest words of the set, floor((1 - t) n) + 2 of them. If two sets are alike,
at most floor((1 - t) n) of either's words miss from the other, so the fingerprints have two words in common; every
fingerprint emits all variants that leave two of its words, and alike sets always meet. This part is exact.

Sets that are the same are one class from the beginning, so a group of copies, however large, is one member. A bucket of
more than BUCKET members isn't paired out: its members are tied to its least one, and after a first round of components
only the members outside the component of the least one are held against the whole bucket, which finds the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.words import BLOCK, hashed, mixed, pairs_within, per_text, runs, words
from docloom.operators.codes import told_apart
from docloom.operators.components import connected_components
from docloom.session import stored

FINGERPRINTS, SLOTS, SHINGLE, BUCKET = 12, 5, 3, 64
SYMBOLS = FINGERPRINTS * SLOTS
#: Of 60 symbols a pair at 0.6 shares 36 on average (deviation 3.8); fewer than this many: probability under 1e-5.
LEAST_AGREEING = 20

_FACTORS = np.random.default_rng(20).integers(1, 2**63, SYMBOLS, dtype=np.uint64) | np.uint64(1)


def signed(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (key, code, check, n, symbols): code and check are hashes of the set of shingles, n its size, symbols
    its 60 min-hash symbols of 16 bits. Texts of fewer than least_words words give no row."""
    for batch in per_text(batches, 1024):
        h, starts = hashed([words(t) for t in batch.column(1).to_pylist()])
        shingles, inside = runs(h, starts, SHINGLE)
        kept = [r for r in np.flatnonzero(np.diff(starts) >= least_words).tolist()]
        sets = [np.unique(shingles[starts[r] : starts[r + 1]][inside[starts[r] : starts[r + 1]]]) for r in kept]
        sizes = np.array([len(s) for s in sets], np.int64)
        symbols, code, check = np.zeros((len(kept), SYMBOLS), np.uint16), np.zeros(len(kept), np.uint64), np.zeros(len(kept), np.uint64)
        if kept:
            joined, at = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]])
            code = mixed(np.add.reduceat(mixed(joined), at) + sizes.astype(np.uint64))
            check = mixed(np.add.reduceat(mixed(joined ^ _FACTORS[0]), at))
            for k, factor in enumerate(_FACTORS):
                low = np.minimum.reduceat((joined * factor) >> np.uint64(16), at)
                symbols[:, k] = mixed(low).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(code.view(np.int64)), pa.array(check.view(np.int64)), pa.array(sizes.astype(np.int32)), pa.array([s.tobytes() for s in symbols], pa.binary())], names=["key", "code", "check", "n", "symbols"])


def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, symbols) -> (variant, code), one row for each fingerprint and left-out slot."""
    for batch in per_text(batches, 4096):
        symbols = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, FINGERPRINTS, SLOTS).astype(np.uint64)
        slots = mixed(symbols + (np.arange(SYMBOLS, dtype=np.uint64).reshape(FINGERPRINTS, SLOTS) << np.uint64(20)))
        out = mixed(slots.sum(2)[:, :, None] - slots + (np.arange(SYMBOLS, dtype=np.uint64).reshape(FINGERPRINTS, SLOTS) << np.uint64(48)))
        code = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), SYMBOLS)
        yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1).view(np.int64)), pa.array(code)], names=["variant", "code"])


def meetings(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b, hot): the pairs a < b of codes that meet in a variant. A bucket of more than `bucket` codes gives pairs with
    its least code only, and a row with a = b = the variant and hot true. Rows stream through sorted by variant, so a
    task holds one small bucket, or the least code of a large one, at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_variant, held, n_held, last = None, [], 0, None

        def ended() -> list[tuple[int, int, bool]]:
            return [(x, y, False) for x, y in combinations(held, 2)] if n_held <= bucket else []

        for batch in batches:
            v, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            out: list[tuple[int, int, bool]] = []
            cuts = np.flatnonzero(np.diff(v)) + 1
            edges = np.concatenate([[0], cuts, [len(v)]])
            # Buckets of one row that can't go on from the last batch or into the next need no look.
            for k in np.flatnonzero((np.diff(edges) > 1) | (np.arange(len(edges) - 1) == 0) | (np.arange(len(edges) - 1) == len(edges) - 2)).tolist():
                a, b = int(edges[k]), int(edges[k + 1])
                if a == b:
                    continue
                if held_variant is None or v[a] != held_variant:
                    out += ended()
                    held_variant, held, n_held, last = v[a], [], 0, None
                for code in c[a:b].tolist():
                    if code == last:
                        continue
                    last = code
                    n_held += 1
                    if n_held <= bucket:
                        held.append(code)
                    else:
                        if n_held == bucket + 1:
                            out += [(held[0], x, False) for x in held[1:]] + [(int(held_variant), int(held_variant), True)]
                        out.append((held[0], code, False))
            yield _pairs(out)
        yield _pairs(ended())

    spread = rows.repartition("variant").sortWithinPartitions("variant", "code")
    return spread.mapInArrow(run, "a bigint, b bigint, hot boolean").distinct()


def _pairs(rows: list[tuple[int, int, bool]]) -> pa.RecordBatch:
    a, b, hot = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(hot, pa.bool_())], names=["a", "b", "hot"])


def rest_of_hot(met: DataFrame, rows: DataFrame, verified: DataFrame, held: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """Pairs of hot buckets that the ties to the least code haven't settled: each member outside that code's component
    with each member of another component. None where there is no hot bucket.

    held: (code, ...) what of a member decides on a pair; keep takes the pairs with these columns as *_a and *_b and leaves
    those that may be alike. It runs where the pairs are made, so what is shuffled is the members of a bucket, block by
    block, and the pairs that are left."""
    hot = met.filter("hot").select(F.col("a").alias("variant"))
    if hot.isEmpty():
        return None
    parts = connected_components(verified)
    members = rows.join(hot, "variant").distinct().join(parts.withColumnRenamed("vertex", "code"), "code", "left")
    members = members.withColumn("component", F.coalesce("component", "code"))
    least = members.groupBy("variant").agg(F.min(F.struct("code", "component")).alias("first"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = members.join(least, "variant").select("variant", "code", "component", "blocks", (F.col("component") != F.col("first.component")).alias("apart"))
    members = stored(members.join(held, "code"))
    of = lambda s: [F.col(c).alias({"code": s}.get(c, f"{c}_{s}")) for c in members.columns if c not in ("variant", "blocks")]
    one = members.filter("apart").select("variant", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int").alias("block"), *of("a"))
    other = members.select("variant", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *of("b"))
    pairs = one.join(other, ["variant", "block"]).filter("component_a <> component_b and (a < b or not apart_b)")
    return stored(keep(pairs).distinct())


def _agree(pairs: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(a, b, key_a, key_b) of the pairs (a, b, key_*, n_*, symbols_*) whose sizes and signatures allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for i in (4, 5))
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "key_a", "key_b"]).filter(pa.array((x == y).sum(1) >= LEAST_AGREEING))

    pairs = pairs.filter(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    return pairs.select("a", "b", "key_a", "key_b", "symbols_a", "symbols_b").mapInArrow(run, f"a bigint, b bigint, key_a {kind}, key_b {kind}")


def with_both(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) with the columns of held (code, ...) for either, as *_a and *_b."""
    of = lambda s: held.select(*[F.col(c).alias({"code": s}.get(c, f"{c}_{s}")) for c in held.columns])
    return pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")


def shared(threshold: float) -> Callable[[DataFrame], DataFrame]:
    """Leaves the pairs (a, b, words_a, words_b) of sets with that share of their words in common."""
    common = lambda: F.size(F.array_intersect("words_a", "words_b"))
    return lambda pairs: pairs.filter(common() >= F.lit(threshold) * (F.size("words_a") + F.size("words_b") - common())).select("a", "b")


def _alike(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts have that share of their shingles in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in per_text(batches, 512):
            ok = []
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = (set(zip(w, w[1:], w[2:])) for w in (words(s), words(t)))
                ok.append(len(x & y) >= threshold * len(x | y))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = stored(pairs)
    needed = pairs.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct()
    texts = stored(texts.join(needed, "key", "left_semi").distinct())
    of = lambda s: texts.select(F.col("key").alias(f"key_{s}"), F.col("text").alias(f"text_{s}"))
    full = pairs.join(of("a"), "key_a").join(of("b"), "key_b")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def near_texts(df: DataFrame, key: str, text: str, threshold: float = 0.6, least_words: int = 20) -> DataFrame:
    """(key, group): each row whose text is alike to another row's, with the group it is connected to (the least key of
    it); rows alike to none don't appear. Texts are alike if the distinct runs of three words in both, divided by those
    in either, are at least `threshold`. Texts of fewer than least_words words (null and empty ones too) are left out.
    Rows of one key and one text count once; a key with several texts is alike to whatever any of them is alike to.
    Other columns are ignored."""
    kind = df.schema[key].dataType.simpleString()
    texts = df.select(df[key].alias("key"), df[text].alias("text"))
    prints = stored(texts.mapInArrow(lambda x: signed(x, least_words), f"key {kind}, code bigint, check bigint, n int, symbols binary"))
    prints = told_apart(prints, "code", "check")
    classes = stored(prints.groupBy("code").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("symbols").alias("symbols")))
    rows = classes.select("code", "symbols").mapInArrow(variants, "variant bigint, code bigint")
    met = stored(meetings(rows))
    agree = lambda pairs: _agree(pairs, kind, threshold)
    edges = stored(_alike(agree(with_both(met.filter("not hot"), classes)), texts, threshold).distinct())
    rest = rest_of_hot(met, rows, edges, classes, agree)
    if rest is not None:
        edges = stored(edges.union(_alike(rest, texts, threshold)).distinct())
    return grouped(prints.select("key", "code").distinct(), edges)


def grouped(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, group) of members (key, code) whose code has an edge or several keys. A key with several codes ties them."""
    ties = members.join(members.groupBy("key").agg(F.min("code").alias("a"), F.max("code").alias("z")).filter("a < z"), "key").select("a", F.col("code").alias("b"))
    parts = connected_components(edges.select("a", "b").union(ties))
    named = members.join(parts.withColumnRenamed("vertex", "code"), "code", "left").select("key", F.coalesce("component", "code").alias("part"))
    named = named.distinct()
    groups = named.groupBy("part").agg(F.min("key").alias("group"), F.count("*").alias("n")).filter("n > 1")
    return named.join(groups, "part").select("key", "group")


def near_sets(df: DataFrame, key: str, words_of: str, threshold: float = 0.7) -> DataFrame:
    """(key, group) as near_texts gives it, for small sets: words_of names an array column; rows are alike if the
    distinct words in both, divided by those in either, are at least `threshold`. Null and empty arrays are left out."""
    sets = df.select(df[key].alias("key"), F.array_sort(F.array_distinct(df[words_of])).alias("words")).filter(F.size("words") > 0)
    members = stored(sets.select("key", F.xxhash64("words").alias("code"), F.xxhash64(F.lit(7), "words").alias("check"), "words").distinct())
    members = told_apart(members, "code", "check")
    classes = members.groupBy("code").agg(F.first("words").alias("words"))
    classes = stored(classes)
    each = classes.select("code", F.explode("words").alias("word"), F.size("words").alias("n"))
    counts = each.groupBy("word").agg(F.count("*").alias("df"))
    rare = each.join(counts, "word").groupBy("code", "n").agg(F.array_sort(F.collect_list(F.struct("df", F.xxhash64("word").alias("h")))).alias("by_df"))
    cut = F.slice("by_df", 1, F.least(F.col("n"), F.floor((1 - threshold) * F.col("n") + 1e-9).cast("int") + 2))
    prints = rare.select("code", F.transform(cut, lambda x: x["h"]).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for code, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = mixed(np.array(h, np.int64).view(np.uint64))
                i, j = np.triu_indices(len(x), 1)
                found += [(v, code) for v in mixed(x[i] + x[j]).view(np.int64).tolist()]
            v, c = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(c, pa.int64())], names=["variant", "code"])

    rows = prints.mapInArrow(run, "variant bigint, code bigint")
    met = stored(meetings(rows))

    alike = shared(threshold)
    edges = stored(alike(with_both(met.filter("not hot"), classes)))
    rest = rest_of_hot(met, rows, edges, classes, alike)
    if rest is not None:
        edges = stored(edges.union(rest).distinct())
    return grouped(members.select("key", "code"), edges)


def pairs_of(groups: DataFrame) -> DataFrame:
    """(id_a, id_b): all pairs id_a < id_b of keys in one group, for a result that is those pairs. Their number is the
    square of a group's size; a large group is held block by block against itself, in as many tasks."""
    return pairs_within(groups, "group", "key")
