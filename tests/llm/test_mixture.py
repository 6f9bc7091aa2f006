import numpy as np

from docloom.llm.mixture import mix, sample


def test_shares_and_caps(spark):
    rng = np.random.default_rng(8)
    docs = [(i, " ".join(["tok"] * int(rng.integers(5, 40))) + f" {i}", str(rng.choice(["big", "mid", " tiny "], p=[0.7, 0.28, 0.02])), 1) for i in range(1500)]
    docs += [(9000 + i, "the same text of tiny", "tiny", 1) for i in range(40)] + [(9100, None, "big", 1), (9101, "", "big", 1), (9102, "x", None, 1), (9103, "x", "unlisted", 1)]
    targets = [("big", 0.4, 1, 0), ("mid", 0.5, 3, 0), ("tiny", 0.05, 2, 0), ("absent", 0.05, 2, 0), ("none", None, None, 0)]
    df, t = spark.createDataFrame(docs, "doc_id bigint, text string, source string, key int"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int, rate int")
    out, report = mix(df, "doc_id", "text", "source", t)
    rows, by = out.collect(), {r.source: r for r in report.collect()}
    assert set(by) == {s for s, *_ in targets} and len({r.doc_id for r in rows}) == len(rows)
    for r in rows:
        assert 1 <= r.copies <= by[r.source].max_repeats
    for s in ("big", "mid"):
        assert abs(by[s].share_of_total - by[s].target_share) < 0.0005
    assert by["tiny"].mixed_tokens == 2 * sum(r.n_tokens for r in rows if r.source == "tiny") and by["tiny"].texts < by["tiny"].documents
    assert by["absent"].mixed_tokens == by["none"].mixed_tokens == 0
    assert abs(sum(r.actual_share for r in by.values()) - 1) < 1e-9
    empty = mix(df.limit(0), "doc_id", "text", "source", t)
    assert empty[0].count() == 0 and empty[1].count() == len(targets)


def test_copies_are_the_rate_rounded(spark):
    texts = spark.range(1000).selectExpr("id as key", "'s' as source", "cast(1 + id % 7 as bigint) as n_tokens")
    wanted = spark.createDataFrame([("s", 2.3, 3)], "source string, rate double, max_repeats int")
    copies = [r.copies for r in sample(texts, wanted).collect()]
    assert set(copies) == {2, 3} and abs(sum(copies) - 2300) <= 1


def test_a_giant_text_and_texts_of_two_sources(spark):
    """One text that is a seventh of its source moves the source by no more than a short text; a text of two sources keeps
    to one cap."""
    docs = [(i, f"word {i} " * (1 + i % 5), "s", 0) for i in range(400)] + [(1000, "giant " * 600, "s", 0)]
    docs += [(2000 + i, f"both {i} " * 3, x, 0) for i in range(30) for x in ("s", "t")] + [(3000 + i, f"many {i}", "u", 0) for i in range(9000)]
    targets = [("s", 0.05, 1), ("t", 0.05, 2), ("u", 0.5, 2)]
    df, t = spark.createDataFrame(docs, "doc_id bigint, text string, source string, key int"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    for seed in range(3):
        out, report = mix(df, "doc_id", "text", "source", t, seed)
        rows, by = out.collect(), {r.source: r for r in report.collect()}
        assert abs(by["s"].mixed_tokens - by["s"].target_tokens) <= 8 and abs(by["u"].mixed_tokens - by["u"].target_tokens) <= 8
        drawn = [r for r in rows if 2000 <= r.doc_id < 3000]
        assert len({r.doc_id for r in drawn}) == len(drawn) and max(r.copies for r in drawn) <= 2


def test_slices_number_like_one_window(spark, monkeypatch):
    from docloom.llm import mixture

    monkeypatch.setattr(mixture, "SLICE_ROWS", 20)
    texts = spark.range(1000).selectExpr("id as key", "'s' as source", "cast(1 + id % 3 as bigint) as n_tokens")
    wanted = spark.createDataFrame([("s", 0.37, 3)], "source string, rate double, max_repeats int")
    rows = sample(texts, wanted).collect()
    assert {r.copies for r in rows} == {1} and abs(sum(r.n_tokens for r in rows) - 0.37 * 1999) <= 2
