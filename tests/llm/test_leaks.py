import numpy as np

from docloom.llm.leaks import find_leaks, remove_leaks
from docloom.llm.words import words


def test_against_brute_force(spark):
    rng = np.random.default_rng(7)
    tests = [(f"q{i}", " ".join(rng.choice(list("abcdefgh"), 30)), 1) for i in range(20)] + [("q0", "second text of the key with at least thirteen words in it so there is a run", 1), ("qn", None, 1), ("qe", "", 1)]
    train = [(f"s{i}", " ".join(rng.choice(list("abcdefgh"), 40)), "h") for i in range(30)]
    for i in range(10):
        w = tests[i][1].split()
        train.append((f"t{i}", f"Before this; {', '.join(w[3 : 15 + i % 3])}! After_{i}.", "h"))
    train += [("n", None, "h"), ("e", "", "h"), train[-1], ("long", "x " * 50_000 + tests[2][1].upper(), "h")]
    df, q = spark.createDataFrame(train, "id string, text string, run string"), spark.createDataFrame(tests, "qid string, said string, h int")
    got = find_leaks(df, "id", "text", q, "qid", "said")
    grams = lambda t: {tuple(w[i : i + 13]) for i in range(len(w) - 12)} if (w := words(t)) else set()
    want = {(a, b) for a, t, _ in train for b, s, _ in tests if grams(t) & grams(s)}
    assert {(r.id, r.qid) for r in got.collect()} == want
    clean = {r.id: r for r in remove_leaks(df.distinct(), "id", "text", got).collect()}
    assert set(clean) == {a for a, _ in want}
    assert clean["t1"].text == "Before this; ! After_1." and clean["t1"].n_removed == 13
    assert find_leaks(df.limit(0), "id", "text", q, "qid", "said").count() == 0
    assert find_leaks(df, "id", "text", q.limit(0), "qid", "said").count() == 0
