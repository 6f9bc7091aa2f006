"""Batch retrieval: keyword ranking, vector similarity, rank fusion, adaptive result sizes.

A batch of questions is one job; every operator carries the query's key. Ties end in the record's key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.session import stored


K1, B, RRF_K, DEPTH, POOL = 1.2, 0.75, 60, 50, 30


def top(scored: DataFrame, k: int) -> DataFrame:
    """(query, rank, key, score): the k best rows of each query, ties by key. Rounded, so that equal scores tie."""
    best = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "key")
    return scored.withColumn("rank", F.row_number().over(best).cast("bigint")).filter(F.col("rank") <= k).select("query", "rank", "key", "score")


class Best:
    """The k best records of each of n queries, of any number of records; ties by key. Scores count as rounded to nine
    digits. least: the worst score that a query holds once it holds k."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.least, self.most, self.size = k, np.full(n, -np.inf), max(2 * n * k, 1 << 19), 0
        self.parts: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

    def add(self, query: np.ndarray, score: np.ndarray, keys: pa.Array, record: np.ndarray) -> None:
        """Pairs of a query and a record, by their places; a pair comes once."""
        on = np.flatnonzero(np.round(score, 9) >= self.least[query])
        for a in range(0, len(on), self.most):
            some = on[a : a + self.most]
            self.parts.append((query[some], score[some], keys.take(pa.array(record[some]))))
            self.size += len(some)
            if self.size > self.most:
                self.trim()

    def trim(self) -> None:
        if not self.parts:
            return
        query, score = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        keys = pa.concat_arrays([p[2] for p in self.parts])
        coded = keys.dictionary_encode()
        place = np.empty(len(coded.dictionary), np.int64)
        place[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(place))
        code = place[coded.indices.to_numpy()] if not keys.null_count else np.append(place, -1)[coded.indices.fill_null(len(place)).to_numpy()]
        rounded = np.round(score, 9)
        order = np.lexsort((code, -rounded, query))
        sorted_ = query[order]
        at = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
        last = order[at == self.k - 1]
        self.least[query[last]] = rounded[last]
        kept = order[at < self.k]
        self.parts, self.size = [(query[kept], score[kept], keys.take(pa.array(kept)))], len(kept)

    def rows(self, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        self.trim()
        for query, score, keys in self.parts:
            for a in range(0, len(query), 10_000):
                b = a + 10_000
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(query[a:b])), keys[a:b], pa.array(score[a:b])], names=["query", "key", "score"])


def cut(batches: Iterator[pa.RecordBatch], first: int = 256, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of `size` rows at most, the first ones smaller, so that most rows meet queries that hold good scores."""
    for whole in batches:
        at = 0
        while at < whole.num_rows:
            yield whole.slice(at, first)
            at, first = at + first, min(size, 4 * first)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = DEPTH, block: int = 2048) -> DataFrame:
    """(query, rank, key, score) by cosine. vectors: (key, v), queries: (query, v). The stated queries are gathered in
    blocks of about `block` rows, by hash, each block goes once over all vectors as a matrix product, and each task keeps
    its own k best before anything is shuffled. Of several blocks each is ranked and written before the next is sent, so
    one is held at a time. Null vectors and vectors of norm 0 have no partner."""
    asked = queries.filter("v is not null").select("query", "v")
    n_blocks = asked.count() // block + 1
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(n_blocks)))
    gathered = blocks.groupBy("block").agg(F.collect_list("query").alias("ids"), F.collect_list("v").alias("vs"))
    kind = queries.schema["query"].dataType.simpleString(), vectors.schema["key"].dataType.simpleString()
    sc = vectors.sparkSession.sparkContext
    rows = vectors.filter("v is not null").select("key", "v").coalesce(sc.defaultParallelism)
    out = []
    for row in gathered.toLocalIterator():
        held = sc.broadcast((list(row["ids"]), _unit(np.array(row["vs"], np.float64))))
        near = top(rows.mapInArrow(_scored(held, k), f"query {kind[0]}, key {kind[1]}, score double"), k)
        if n_blocks > 1:
            near = stored(near)
            held.destroy()
        out.append(near)
    if not out:
        return vectors.select(F.lit(None).cast(kind[0]).alias("query"), F.lit(0).cast("bigint").alias("rank"), "key", F.lit(0.0).alias("score")).limit(0)
    whole = out[0]
    for other in out[1:]:
        whole = whole.union(other)
    return whole


def dense_by_domain(vectors: DataFrame, queries: DataFrame, domains: list[str], k: int = DEPTH) -> DataFrame:
    """(query, domain, rank, key, score): a search of its own in each of the registered domains. vectors: (key, v, domain)."""
    out = None
    for domain in domains:
        one = dense_topk(vectors.filter(F.col("domain") == domain), queries, k).select("query", F.lit(domain).alias("domain"), "rank", "key", "score")
        out = one if out is None else out.union(one)
    if out is None:
        raise ValueError("no domain is registered")
    return out


def prompt_gate(prompts: DataFrame, best: DataFrame, least_words: int = 3, least_cosine: float = 0.34) -> DataFrame:
    """(query, reason) of prompts (query, text): why nothing is added to a prompt, null where something is: a command or a
    short prompt isn't searched for, nothing was found, or the best cosine (query, cosine) is too low."""
    bare = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    n = F.size(F.filter(F.split(bare, r"\s+"), lambda w: w != ""))
    worth = F.coalesce((bare != "") & ~bare.startswith("/") & (n >= least_words), F.lit(False))
    top_ = best.groupBy("query").agg(F.max("cosine").alias("cosine"))
    why = F.when(~worth, "command or short prompt").when(F.col("cosine").isNull(), "nothing found").when(F.col("cosine") < least_cosine, "too far")
    return prompts.join(top_, "query", "left").select("query", why.alias("reason"))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat, n = column.flatten(), len(column)
    if flat.null_count or len(flat) % n or pc.any(pc.not_equal(pc.list_value_length(column), len(flat) // n)).as_py():
        return np.array(column.to_pylist(), np.float64)
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _scored(held, k: int, some: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = held.value
        best = Best(len(ids), k)
        for batch in cut(batches):
            v, keys = _unit(_matrix(batch.column(1))).T, batch.column(0)
            for a in range(0, len(q), some):
                s = q[a : a + some] @ v
                cells = np.flatnonzero(s >= best.least[a : a + some, None] - 1e-9)
                best.add(a + cells // s.shape[1], np.round(s.ravel()[cells], 9), keys, cells % s.shape[1])
        yield from best.rows(pa.array(ids))

    return run


def rrf(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query, rank, key, score): reciprocal rank fusion of lists (query, list, key, rank, weight); list is the list's
    number. Ties go to the key that stands in the earlier list, then to its better rank there."""
    fused = lists.groupBy("query", "key").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    best = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "first.list", "first.rank")
    return fused.select("query", F.row_number().over(best).cast("bigint").alias("rank"), "key", "score")


def ordered_union(lists: DataFrame, depth: int) -> DataFrame:
    """(query, position, key): the distinct keys of the first `depth` of each list, lists in their order."""
    first = lists.filter(F.col("rank") <= depth).groupBy("query", "key").agg(F.min(F.struct("list", "rank")).alias("first"))
    return first.select("query", F.row_number().over(Window.partitionBy("query").orderBy("first.list", "first.rank")).cast("bigint").alias("position"), "key")


def auto_k(ranked: DataFrame, temperature: float = 0.75, scale: float = 20, mass: float = 0.94, most: int = 5) -> DataFrame:
    """(query, k): how many of the first `most` results a query needs, so that the softmax of its cosines over all its
    candidates reaches `mass`; `most` where it doesn't. ranked: (query, rank, cosine)."""
    own = Window.partitionBy("query")
    z = F.col("cosine") * scale / temperature
    weight = F.exp(z - F.max(z).over(own))
    share = ranked.withColumn("z", weight).withColumn("p", F.col("z") / F.sum("z").over(own))
    running = share.withColumn("m", F.sum("p").over(own.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    k = F.coalesce(F.min(F.when((F.col("rank") <= most) & (F.round("m", 9) >= mass), F.col("rank"))), F.lit(most))
    return running.groupBy("query").agg(k.cast("bigint").alias("k"))


def cross_domain_merge(hits: DataFrame, k: int) -> DataFrame:
    """(query, rank, domain, key, floor): results of several domains in one list by the least cosine so far within the
    domain, then by rank in it. hits: (query, domain, rank, key, cosine)."""
    within = Window.partitionBy("query", "domain").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    floored = hits.withColumn("floor", F.min("cosine").over(within))
    best = Window.partitionBy("query").orderBy(F.desc(F.round("floor", 9)), "rank", "domain", "key")
    return floored.select("query", F.row_number().over(best).cast("bigint").alias("rank"), "domain", "key", "floor").filter(F.col("rank") <= k)


def by_mode(lists: DataFrame, pool: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(query, mode, rank, key). lists: (query, list, key, rank), 0 by keywords and 1 by vectors; pool: (query, key,
    position, score). hybrid (fast): the fusion of both; rerank: the pool by score, then the rest of the fusion; all: the
    fusion of both and the scored pool; accurate: hybrid where both have the same first result, else rerank."""
    ranked = lambda df, *order: df.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)).cast("bigint"))
    lists = lists.select("query", "list", "key", "rank")
    fused = rrf(lists.withColumn("weight", F.lit(1.0))).select("query", "key", "rank")
    scored = ranked(pool, F.desc(F.round("score", 9)), "position").select("query", "key", F.col("rank").alias("scored"))
    rerank = ranked(fused.withColumnRenamed("rank", "fused").join(scored, ["query", "key"], "left"), F.col("scored").isNull(), "scored", "fused").select("query", "key", "rank")
    three = lists.union(scored.select("query", F.lit(2), "key", "scored"))
    whole = rrf(three.withColumn("weight", F.lit(1.0))).select("query", "key", "rank")
    first = lists.filter("rank = 1").groupBy("query").agg(F.max(F.when(F.col("list") == 0, F.col("key"))).alias("a"), F.max(F.when(F.col("list") == 1, F.col("key"))).alias("b"))
    agree = first.select("query", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("agree"))
    chosen = fused.join(agree.filter("agree"), "query", "left_semi").union(rerank.join(agree.filter("not agree"), "query", "left_semi"))
    of = lambda df, mode: df.select("query", F.lit(mode).alias("mode"), "rank", "key")
    out = of(lists.filter("list = 0"), "bm25").union(of(lists.filter("list = 1"), "dense"))
    for df, mode in ((fused, "hybrid"), (fused, "fast"), (rerank, "rerank"), (whole, "all"), (chosen, "accurate")):
        out = out.union(of(df, mode))
    return out


def parity(scores: DataFrame, by: list[str], most: float = 1e-4) -> DataFrame:
    """(*by, n, broken, max_diff) of scores (*by, reference, score): how far the scores are from a saved reference, and
    1 where one is off by more than `most`. Pairs with a null are left out."""
    off = F.abs(F.col("reference") - F.col("score"))
    return scores.filter(off.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.max(F.when(off <= most, 0).otherwise(1)).alias("broken"), F.max(off).alias("max_diff"))


def softmax(rows: DataFrame, group: str, z: str, temperature: float = 1.0) -> DataFrame:
    """rows with `p`, the softmax of z over the group, shifted by its largest. The largest and the sum are aggregates joined
    back, so a large group isn't one task; a null group is a group."""
    top_ = rows.groupBy(F.col(group).alias("_g")).agg(F.max(z).alias("_top"))
    shifted = rows.join(top_, F.col("_g").eqNullSafe(F.col(group))).withColumn("_w", F.exp((F.col(z) - F.col("_top")) / temperature)).drop("_g", "_top")
    sums = shifted.groupBy(F.col(group).alias("_g")).agg(F.sum("_w").alias("_sum"))
    return shifted.join(sums, F.col("_g").eqNullSafe(F.col(group))).withColumn("p", F.col("_w") / F.col("_sum")).drop("_g", "_w", "_sum")


def mean_pool(tokens: Column, keep: Column, dimensions: int) -> Column:
    """The unit vector of the mean of the kept token vectors; zeros if none is kept or their mean is zero."""
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("v"), keep.alias("k")), lambda x: x["k"]), lambda x: x["v"])
    total = F.aggregate(kept, F.array_repeat(F.lit(0.0), dimensions), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    norm = F.sqrt(F.aggregate(total, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(total, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))
