"""Searches answer every question, whatever its id."""

import pytest

from docloom import plans
from docloom.plans.registry import QUERIES

IDS = ["q1", "q2", "q20", "q37", "plain"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """40 sections of ten documents, five questions that each have a gold section, and two symbols."""
    at = tmp_path_factory.mktemp("all")
    text = lambda i: " ".join(["common", f"topic{i % 5}x", *[f"w{i}n{j}x" for j in range(30)]])
    sections = [(f"s{i:02}", f"d{i // 4}", "ab"[i % 2], f"{'changelog' if i % 8 == 7 else 'doc'}{i // 4}.md", None, text(i)) for i in range(40)]
    spark.createDataFrame(sections, "id string, doc_id string, component string, path string, heading_path string, text string").write.parquet(str(at / "sections.parquet"))
    gold = lambda i: [(sections[i][3], [1, 9], sections[i][0])]
    questions = [(q, ["handbook-qa", "forum-qa"][i % 2], "ab"[i % 2], f"common topic{i}x", gold(i)) for i, q in enumerate(IDS)]
    spark.createDataFrame([*questions, questions[0]], "id string, source string, component string, question string, gold array<struct<path: string, lines: array<int>, section: string>>").write.parquet(str(at / "questions.parquet"))
    spark.createDataFrame([("n1", "common", "a.py"), ("n2", "topic1x", "b.py")], "id string, label string, source_file string").write.parquet(str(at / "nodes.parquet"))
    plans.load()
    return str(at)


@pytest.mark.parametrize("name", ["bm25_topk", "excerpt", "context_pack", "rrf_fusion", "rerank_pool", "four_list_rrf", "rank_modes", "hard_negatives", "neg_groups", "assemble_groups"])
def test_each_question_has_its_rows(spark, tables, name):
    assert {r["query"] for r in QUERIES[name](spark, tables).collect()} == set(IDS)


def test_rerank_share_counts_each_question(spark, tables):
    assert QUERIES["rerank_share"](spark, tables).first()["queries"] == len(IDS)


def test_mode_table_counts_each_question(spark, tables):
    assert {r["queries"] for r in QUERIES["mode_table"](spark, tables).collect()} == {len(IDS)}
