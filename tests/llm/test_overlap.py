import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm.overlap import cosine_join, split_overlaps

SCHEMA = "id string, split string, words array<string>, code int, side string"


def test_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(250):
        base = rng.choice(40, 8, replace=False) if rng.random() < 0.6 or not rows else [int(w[1:]) for w in rows[rng.integers(len(rows))][2]]
        w = {f"w{x}" for x in base}
        if rng.random() < 0.5:
            w ^= {f"w{rng.integers(40)}"}
        rows.append((f"q{i:03}", rng.choice(["train", "dev", "test"]), sorted(w), 0, "x"))
    rows += [("hot", "train", ["w1", "w2"], 0, "x")] * 3 + [(f"c{i}", "dev", ["w1", "w2"], 0, "x") for i in range(9)]
    rows += [("n1", None, ["w1", "w2"], 0, "x"), ("n2", "dev", None, 0, "x"), ("n3", "train", [], 0, "x")]
    got = {(r.train_key, r.key) for r in split_overlaps(spark.createDataFrame([(a, str(b) if b else None, c, d, e) for a, b, c, d, e in rows], SCHEMA), "id", "split", "words", "train", ["dev", "test"]).collect()}
    train, held = [r for r in rows if r[1] == "train" and r[2]], [r for r in rows if r[1] in ("dev", "test") and r[2]]
    j = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    assert got == {(a[0], b[0]) for a in train for b in held if j(a[2], b[2]) >= 0.7 - 1e-12}


@pytest.mark.parametrize("weighting", ["unit", "idf"])
def test_cosine(spark, weighting):
    rng = np.random.default_rng(2)
    rows = [("left" if i % 2 else "right", i, [f"t{x}" for x in set(rng.zipf(1.5, 7).clip(0, 30))]) for i in range(80)]
    df = spark.createDataFrame(rows, "side string, code bigint, words array<string>")
    n, df_of = len(rows), {}
    for _, _, w in rows:
        for t in w:
            df_of[t] = df_of.get(t, 0) + 1
    weight = lambda t: 1.0 if weighting == "unit" else np.log1p(n / df_of[t])
    norm = lambda w: np.sqrt(sum(weight(t) ** 2 for t in w))
    cos = lambda a, b: sum(weight(t) ** 2 for t in set(a) & set(b)) / norm(a) / norm(b)
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == "left" and b[0] == "right" and cos(a[2], b[2]) >= 0.6}
    assert {(r.code_left, r.code_right) for r in cosine_join(df, 0.6, weighting).collect()} == want


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert split_overlaps(df, "id", "split", "words", "train", ["dev"]).count() == 0
    assert df.select(F.lit(1)).count() == 0
