"""Operators against plain Python."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions.text import query_terms, tokens
from docloom.operators import curate, evaluate, graph, links, search, similar
from docloom.operators.components import connected_components
from docloom.sources.store import Store


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, x) for x in range(2001, 2050)]
    parent = {v: v for e in edges for v in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    tied = {v for a, b in edges if a != b for v in (a, b)}
    df = spark.createDataFrame([*edges, (None, 1), (5, 5)], "a bigint, b bigint")
    assert {tuple(r) for r in connected_components(df).collect()} == {(v, top(v)) for v in tied}
    assert connected_components(df.limit(0)).count() == 0


def test_dense_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, [0.0] * 5), (901, None)], "key bigint, v array<double>")
    q = df.filter("key < 7").withColumnRenamed("key", "query")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for block in (3, 100):
        got = {(r.query, r.rank): r.key for r in search.dense_topk(df, q, 5, block).collect()}
        for i in range(7):
            assert [got[i, k] for k in range(1, 6)] == np.argsort(-(unit @ unit[i]), kind="stable")[:5].tolist()
    assert search.dense_topk(df, q.limit(0), 5).count() == 0


def test_fusion_and_k(spark):
    lists = spark.createDataFrame([(1, 0, "x", 1, 1.0), (1, 0, "y", 2, 1.0), (1, 1, "y", 1, 1.0), (1, 1, "z", 2, 1.0)], "query int, list int, key string, rank int, weight double")
    assert [r.key for r in search.rrf(lists).orderBy("rank").collect()] == ["y", "x", "z"]
    assert [r.key for r in search.ordered_union(lists, 2).orderBy("position").collect()] == ["x", "y", "z"]
    rows = [(q, i + 1, c) for q, cs in enumerate([[0.9, 0.3, 0.2], [0.5] * 8, [0.8, 0.79, 0.78, 0.1]]) for i, c in enumerate(cs)]
    assert [r.k for r in search.auto_k(spark.createDataFrame(rows, "query int, rank int, cosine double")).orderBy("query").collect()] == [1, 5, 3]
    hits = spark.createDataFrame([(1, "a", 1, "p", 0.5), (1, "a", 2, "q", 0.9), (1, "b", 1, "r", 0.7)], "query int, domain string, rank int, key string, cosine double")
    assert [r.key for r in search.cross_domain_merge(hits, 3).orderBy("rank").collect()] == ["r", "p", "q"]


def test_dedup_is_idempotent_and_first_wins(spark):
    long = "the same paragraph that is long enough to count as one"
    rows = [(1, f"{long}\n\nown one"), (2, f"{long.upper()}!\n\nown two"), (3, "short\n\nshort"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    out = curate.dedup_paragraphs(df, "id", "text", []).collect()
    assert sorted((r.key, r.no) for r in out) == [(1, 0), (1, 1), (2, 1), (3, 0), (3, 1)]


def test_gate(spark):
    words = [f"w{i}" for i in range(30)]
    units = spark.createDataFrame([(1, "s1", " ".join(words)), (2, "s1", "clean text"), (3, "s2", " ".join(f"b{i}" for i in range(20))), (4, "s3", " ".join(f"b{i}" for i in range(20)))], "u int, s string, t string")
    grams = curate.gram_rows(units, "u", "s", "t")
    reference = curate.gram_rows(units.filter("u in (1, 3)"), "u", "s", "t").select("gram")
    assert [(r.unit, r.hits) for r in curate.leakage_gate(grams, reference).collect()] == [(1, 18)]
    assert curate.leakage_gate(grams, reference.limit(0)).count() == 0


def test_budgets(spark):
    df = spark.createDataFrame([("a", 1, 8), ("a", 2, 5), ("a", 3, 2), ("b", 1, 50), ("b", 2, 1)], "g string, o int, n int")
    assert sorted((r.g, r.o) for r in curate.greedy_budget(df, "g", ["o"], "n", 10).collect()) == [("a", 1), ("a", 3), ("b", 1)]
    assert sorted((r.g, r.o) for r in curate.running_budget(df, ["g"], [F.col("o")], "n", F.lit(10)).collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_similar_sets(spark):
    rng = np.random.default_rng(4)
    rows = [(f"k{i:03}", [f"x{x}" for x in rng.choice(14, int(rng.integers(1, 9)), replace=False)]) for i in range(120)] + [("n", None), ("e", [])]
    df = spark.createDataFrame(rows, "key string, words array<string>").select("key", F.transform("words", lambda x: F.xxhash64(x)).alias("items"))
    members, sets = similar.classes_of(df, "key", "items")
    got = {(r.a, r.b) for r in similar.similar_sets(sets, 0.6).collect()}
    reps = {}
    for k, x in rows:
        if x:
            reps.setdefault(frozenset(x), k)
    want = {tuple(sorted((reps[a], reps[b]))) for a, b in itertools.combinations(reps, 2) if len(a & b) >= 0.6 * len(a | b)}
    assert got == want
    assert {r.key: r.rep for r in members.collect()} == {k: reps[frozenset(x)] for k, x in rows if x}


def test_links(spark):
    nodes = spark.createDataFrame([("n1", "charge_invoice()", "pay/src/a.py", "function", "pay"), ("n2", "charge_invoice()", "web/src/b.py", "function", "web"), ("n3", "a.py", "pay/src/a.py", "file", "pay")], "id string, label string, source_file string, kind string, component string")
    s = spark.createDataFrame([("s", "pay", "Call `charge_invoice` or src/a.py."), ("t", "other", "Call `charge_invoice`."), ("u", "pay", None)], "id string, component string, text string")
    got = {(r.section_id, r.mention, r.node_id, r.confidence) for r in links.link_sections(s, nodes)[0].collect()}
    assert got == {("s", "charge_invoice", "n1", "EXTRACTED"), ("s", "src/a.py", "n3", "EXTRACTED"), ("t", "charge_invoice", "n1", "AMBIGUOUS"), ("t", "charge_invoice", "n2", "AMBIGUOUS")}


def test_statistics(spark):
    diffs = spark.createDataFrame([(i, x) for i, x in enumerate([1.0] * 8 + [-1.0, 0.0, None])], "id int, diff double")
    r = evaluate.sign_test(diffs).first()
    assert (r.better, r.worse) == (8, 1) and r.p == pytest.approx(2 * (1 + 9) / 2**9)
    b = evaluate.bootstrap(diffs.repartition(2), "id", 500).first()
    assert b.n == 10 and b.mean == pytest.approx(0.7) and b.low < 0.7 < b.high
    assert evaluate.bootstrap(diffs.repartition(7), "id", 500).first() == b
    assert evaluate.bootstrap(diffs.limit(0), "id", 50).first().low is None
    assert evaluate.sign_test(diffs.limit(0)).first().p == 1.0


def test_hops(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (2, 2)], "a int, b int")
    assert sorted(map(tuple, graph.hops(edges, spark.createDataFrame([(1,)], "vertex int"), 2).collect())) == [(1, 0), (2, 1), (3, 2)]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(LookupError):
        store.read("t")
    assert [store.publish({"t": spark.range(n)}) for n in (3, 5)] == [1, 2]
    assert store.read("t").count() == 5 and store.rollback() == 1 and store.read("t").count() == 3
    assert store.publish({"t": spark.range(7)}) == 3 and store.read("t").count() == 7
