"""Problem 4 against a plain look at every life of every key."""

from datetime import datetime, timedelta

import numpy as np

from docloom.operators import orphans as O
from docloom.operators.orphans import Bitmap, bare_key, bare_name, orphans

REFS = "domain string, key string, at timestamp_ntz, row bigint, born string, code int"
LIVES = "domain string, key string, born timestamp_ntz, gone timestamp_ntz, period string"
DAY = datetime(2024, 5, 10)


def test_each_case(spark):
    lives = [("n", "a", DAY, None, "x"), ("n", "b", DAY, DAY + timedelta(5), "x"), ("n", "b", DAY + timedelta(8), None, "x"), ("n", "c", None, None, "x"), ("m", "a2", DAY, None, "x"), (None, None, None, None, None)]
    refs = [
        ("n", "a", DAY, 1, "", 0), ("n", "a", DAY - timedelta(microseconds=1), 2, "", 0), ("n", "b", DAY + timedelta(5), 3, "", 0), ("n", "b", DAY + timedelta(9), 4, "", 0),
        ("n", "c", datetime(1999, 1, 1), 5, "", 0), ("n", "zz", DAY, 6, "", 0), ("n", None, DAY, 7, "", 0), ("n", "a", None, 8, "", 0), ("m", "a", DAY, 9, "", 0), ("n", "zz", DAY, 6, "", 0),
    ]
    out = orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(lives, LIVES), ["row"]).collect()
    assert sorted((r.row, r.period) for r in out) == [(2, "2024-05"), (3, "2024-05"), (6, "2024-05"), (6, "2024-05"), (9, "2024-05")]


def test_empty_tables(spark):
    refs, lives = spark.createDataFrame([("n", "a", DAY, 1, "", 0)], REFS), spark.createDataFrame([], LIVES)
    assert orphans(refs, lives, ["row"]).count() == 1
    assert orphans(refs.limit(0), lives, ["row"]).count() == 0


def test_random_with_a_hot_key(spark):
    rng = np.random.default_rng(3)
    key = lambda: "hot" if rng.random() < 0.33 else f"k{rng.integers(30)}"
    lives = [("n", key(), DAY + timedelta(int(rng.integers(-90, 90))), DAY + timedelta(int(rng.integers(-90, 90))), "") for _ in range(60)]
    refs = [("n", key(), DAY + timedelta(int(rng.integers(-99, 99))), i, "", 0) for i in range(900)]
    want = {i for _, k, at, i, _, _ in refs if not any(k == q and a <= at < b for _, q, a, b, _ in lives)}
    assert {r.row for r in orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(lives, LIVES), ["row"]).collect()} == want


def test_names(spark):
    df = spark.createDataFrame([(" `foo(a, b)`. ",), ("'x.py':",), (".bar()",), (" Ab ",), (None,)], "s string")
    assert [r[0] for r in df.select(bare_name(df.s)).collect()] == ["foo", "x.py", "bar", "Ab", None]
    assert [r[0] for r in df.select(bare_key(df.s)).collect()][3] == "ab"


def test_bitmaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 200_000, n)) for n in (0, 1, 50, 3_000, 40_000, 150_000)]
    for a in sets:
        for b in sets:
            assert Bitmap.of(a).and_not(Bitmap.of(b)).places().tolist() == sorted(set(a.tolist()) - set(b.tolist()))
    kinds = {c.dtype for s in sets for c in Bitmap.of(s).held.values()}
    assert kinds == {np.dtype(np.uint16), np.dtype(np.uint8)}


def test_no_parents_many_ranges(spark, monkeypatch):
    """Ranges are counted by both sides: references alone are spread too."""
    monkeypatch.setattr(O, "RANGE_KEYS", 16)
    refs = spark.createDataFrame([("n", f"k{i % 300}", DAY, i, "", 0) for i in range(600)], REFS)
    lives = spark.createDataFrame([("n", f"k{i}", None, None, "") for i in range(0, 300, 3)], LIVES)
    assert {r.row for r in orphans(refs, lives, ["row"]).collect()} == {i for i in range(600) if i % 300 % 3}
    assert orphans(refs, lives.limit(0), ["row"]).count() == 600
