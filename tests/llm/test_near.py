import itertools

import numpy as np

from docloom.llm import near
from docloom.llm.words import words


def groups(alike, keys):
    parent = {k: k for k in keys}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(keys), 2):
        if alike(a, b):
            parent[top(a)] = top(b)
    return {frozenset(k for k in keys if top(k) == r) for r in keys if sum(top(k) == r for k in keys) > 1}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.group, set()).add(r.key)
    assert all(min(v) == g for g, v in out.items())
    return {frozenset(v) for v in out.values()}


def shares(a, b, t):
    return len(a & b) >= t * len(a | b)


def test_texts(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"word{i}" for i in range(3000)]
    base = [list(rng.choice(vocabulary, 60)) for _ in range(12)]
    rows = []
    for i in range(90):
        w = list(base[i % 12])
        for _ in range(rng.integers(0, 5)):
            w[rng.integers(len(w))] = str(rng.choice(vocabulary))
        rows.append((f"s{i:03}", " ".join(w), "x", 1))
    rows += [("e1", None, "x", 1), ("e2", "", "x", 1), ("e3", "only a few words", "x", 1), ("e4", "only a few words", "x", 1)]
    rows += rows[:3] + [(f"copy{i}", rows[0][1].upper(), "x", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, text string, key string, code int")
    sets = {k: set(zip(w, w[1:], w[2:])) for k, t, *_ in rows if len(w := words(t)) >= 20}
    assert found(near.near_texts(df, "id", "text")) == groups(lambda a, b: shares(sets[a], sets[b], 0.6), sets)
    assert near.near_texts(df.limit(0), "id", "text").count() == 0


def test_hot_bucket_is_settled_exactly(spark, monkeypatch):
    """With buckets of two, nearly all pairs go through the ties to the least code and the second round."""
    run = near.meetings
    monkeypatch.setattr(near, "meetings", lambda rows: run(rows, 2))
    rng = np.random.default_rng(6)
    rows = [(f"k{i:02}", ["a", "b", "c", "d", "e", f"x{rng.integers(3)}", f"y{rng.integers(3)}", f"z{rng.integers(4)}"]) for i in range(60)] + [("n", None), ("m", [])]
    df = spark.createDataFrame(rows, "id string, w array<string>")
    sets = {k: set(w) for k, w in rows if w}
    assert found(near.near_sets(df, "id", "w", 0.7)) == groups(lambda a, b: shares(sets[a], sets[b], 0.7), sets)


def test_pairs_and_bounds(spark):
    df = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "g"), ("d", "h")], "key string, group string")
    assert sorted(map(tuple, near.pairs_of(df).collect())) == [("a", "b"), ("a", "c"), ("b", "c")]
