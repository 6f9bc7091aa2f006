"""Rankings of many questions over many records: exact, and only the best of each task are shuffled."""

import math

import numpy as np

from docloom import plans
from docloom.operators import index, mining, search
from docloom.plans.registry import QUERIES
from docloom.plans.search_queries import section_index


def shuffled(spark):
    """Records that all stages so far wrote to a shuffle."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def bm25(docs, asked, k):
    """The best k of each question by the formula, ties by key."""
    mean, out = sum(map(len, docs.values())) / len(docs), {}
    df = {t: sum(t in d for d in docs.values()) for d in docs.values() for t in d}
    for q, terms in asked.items():
        scores = {}
        for key, d in docs.items():
            for t in {t for t in terms if t in d}:
                tf, idf = d.count(t), math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5))
                scores[key] = scores.get(key, 0) + (idf if idf > 0 else 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        for rank, (key, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k], 1):
            out[q, rank] = key, round(s, 6)
    return out


def test_many_questions_shuffle_only_their_best(spark):
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i % 26)}{i // 26}x" for i in range(300)]
    odds = 1 / np.arange(1, 301)
    docs = {f"d{i:05}": list(rng.choice(words, int(rng.integers(3, 30)), p=odds / odds.sum())) for i in range(1500)}
    docs |= {f"e{i:05}": d for i, d in enumerate(list(docs.values())[:300])} | {f"f{i:05}": ["same", "text"] for i in range(700)} | {"none": []}
    asked = {f"q{i:03}": list(rng.choice(words, int(rng.integers(1, 9)), p=odds / odds.sum())) for i in range(150)} | {"ties": ["same"], "absent": ["zzzz"]}
    at = index.build(spark.createDataFrame([(k, " ".join(d)) for k, d in docs.items()], "id string, t string").repartition(3), "id", {"t": 1.0})
    terms = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query string, term string")
    before = shuffled(spark)
    got = {(r.query, r.rank): (r.key, round(r.score, 6)) for r in index.rank(at, terms, 5).collect()}
    assert got == bm25(docs, asked, 5)
    # 5 a question and task, and the terms; not the pairs of a question and a record that share a term, of which there are 130,000.
    assert shuffled(spark) - before < 10_000
    assert {(r.query, r.rank): (r.key, round(r.score, 6)) for r in index.rank(at, terms, 5, block=40).collect()} == got


def test_vectors_that_tie_shuffle_only_the_first(spark):
    n = 4000
    df = spark.range(n).selectExpr("concat('k', lpad(id, 5, '0')) AS key", "if(id % 2 = 0, array(0D, 0D), array(1D, 0D)) AS v").repartition(4)
    q = spark.createDataFrame([(f"q{i}", [1.0, 0.0] if i else [0.0, 0.0]) for i in range(30)], "query string, v array<double>")
    before = shuffled(spark)
    got = {(r.query, r.rank): (r.key, r.score) for r in search.dense_topk(df, q, 3).collect()}
    assert got == {(f"q{i}", r): (f"k{2 * r - 1 if i else r - 1:05}", float(bool(i))) for i in range(30) for r in (1, 2, 3)}
    assert shuffled(spark) - before < n + 30 + 3 * 30 * 4 + 1000  # not the 60,000 pairs at a cosine of 1


def test_kinds_shuffle_only_their_best(spark):
    n = 1200
    keys = [(f"k{i:04}", f"doc{i // 4}" if i % 11 else None, ["a", "b", None][i % 3], i % 5 == 0, i % 7 != 0) for i in range(n)]
    texts = {k[0]: ["common", f"w{i % 37}", f"w{i % 13}", *["pad"] * (i % 4)] for i, k in enumerate(keys)}
    asked = {f"q{i:02}": ["common", f"w{i % 37}"] for i in range(60)}
    queries = [(f"q{i:02}", keys[i * 9][0], keys[i * 9][1], keys[i * 9][2], [True, False, None][i % 3 if i % 2 else 1]) for i in range(60)]
    at = index.build(spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "id string, t string").repartition(2), "id", {"t": 1.0})
    terms = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query string, term string")
    all_ = {}
    for (q, _), (key, _s) in bm25(texts, asked, n).items():
        all_.setdefault(q, []).append(key)
    of, want = {k[0]: k for k in keys}, {}
    for q, positive, doc, scope, prose in queries:
        for key in all_.get(q, []):
            _, d, s, changes, long = of[key]
            kind = "sibling" if d and d == doc else None if not (s and s == scope) else "book" if prose else "changelog" if changes else "doc"
            if long and key != positive and kind and len(want.setdefault((q, kind), [])) < 5:
                want[q, kind].append(key)
    before, got = shuffled(spark), {}
    found = mining.candidates_by_kind(at, terms, spark.createDataFrame(queries, "query string, positive string, doc string, scope string, prose boolean"), spark.createDataFrame(keys, "key string, doc string, scope string, changelog boolean, long boolean"), 5)
    for r in sorted(found.collect(), key=lambda r: r.place):
        got.setdefault((r.query, r.kind), []).append(r.key)
    assert got == want and {k for _, k in got} == {"sibling", "book", "changelog", "doc"}
    assert shuffled(spark) - before < 15_000  # not the 72,000 pairs that share a term


def test_pairs_with_positives_are_not_shuffled(spark):
    texts = spark.range(200).selectExpr("concat('k', id) AS key", "if(id = 7, null, concat_ws(' ', transform(sequence(1, 12), i -> concat('w', if(id >= 100 and i < 12, id - 100, id), '_', i)))) AS text")
    ranked = spark.range(2000).selectExpr("concat('q', floor(id / 100)) AS query", "id % 100 + 1 AS rank", "concat('k', id % 100) AS key")
    positives = spark.range(2000).selectExpr("concat('q', floor(id / 100)) AS query", "concat('k', 100 + id % 100) AS key").filter("key <> 'k103'").union(spark.createDataFrame([("q0", "k3")], "query string, key string"))
    before = shuffled(spark)
    left = {(r.query, r.key) for r in mining.unlike_positives(ranked, positives, texts).collect()}
    # All but k3 (whose copy is no positive) and k7 (a null text, unlike its copy) are near-copies of a positive; k3 is one itself in q0.
    assert left == {(f"q{i}", k) for i in range(20) for k in ("k3", "k7")} - {("q0", "k3")}
    assert shuffled(spark) - before < 60_000  # not the 200,000 pairs of a candidate and a positive


def asked_sections(spark, tmp_path):
    """6,000 sections and their index, ten asked questions; the hits of each as {(query, rank): (key, text)}."""
    docs = {f"s{i:04}": ["common", f"w{i % 97}x", f"w{i % 13}x", *["pad"] * (i % 4)] for i in range(6000)}
    asked = {f"q{20 * i}": ["common", f"w{i}x"] for i in range(10)}
    rows = [(k, f"{k}.md", " ".join(d)) for k, d in docs.items()]
    spark.createDataFrame([*rows, *rows[:500], ("s0007", "s0007.md", "zzz")], "id string, path string, text string").selectExpr("*", "cast(null AS string) AS heading_path").write.parquet(str(tmp_path / "sections.parquet"))
    spark.createDataFrame([*[(q, " ".join(t)) for q, t in asked.items()], ("q7", "common")], "id string, question string").write.parquet(str(tmp_path / "questions.parquet"))
    plans.load()
    section_index(spark, str(tmp_path))
    return {at: (key, " ".join(docs[key])) for at, (key, _) in bm25(docs, asked, 10).items()}


def without_broadcasts(spark, name, sf_dir):
    """The rows of a query, planned as over tables too large to broadcast, and the records that it shuffled."""
    before, kept = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return QUERIES[name](spark, sf_dir).collect(), shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_excerpts_shuffle_only_the_sections_hit(spark, tmp_path):
    want = asked_sections(spark, tmp_path)
    rows, moved = without_broadcasts(spark, "excerpt", str(tmp_path))
    assert len(rows) == 100 and {(r.query, r.rank): (r.key, r.excerpt) for r in rows} == want
    assert moved < 3000  # not the 6,501 sections with their texts


def test_packs_store_no_texts_and_take_a_hit_once(spark, tmp_path):
    want = asked_sections(spark, tmp_path)
    spark.createDataFrame([("q0", "W0x common")], "id string, question string").write.mode("append").parquet(str(tmp_path / "questions.parquet"))
    held = len(spark.sparkContext._docloom_stored)
    rows, moved = without_broadcasts(spark, "context_pack", str(tmp_path))
    # The two texts of q0 give the same ten hits, each once a text.
    packs = {q: "\n\n".join(f"[{key}.md] \n{text}" for (of, _), (key, text) in sorted(want.items()) if of == q for _ in range(2 if q == "q0" else 1)) for q, _ in want}
    assert {r.query: r.context for r in rows} == packs and {r.query: r.blocks for r in rows} == {q: 20 if q == "q0" else 10 for q in packs}
    assert moved < 3000 and not any("text" in spark.read.parquet(to).columns for to in spark.sparkContext._docloom_stored[held:])
