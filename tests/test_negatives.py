"""Groups of negatives for questions whose ranking yields fewer than seven."""

from docloom import plans
from docloom.plans.registry import QUERIES


def test_short_groups_are_padded(spark, tmp_path):
    own = [(f"own{i:02}", "own.md", "a", None, f"worker restarts queue worker{i}") for i in range(15)]
    others = [(f"hit{i}", "hit.md", "a", None, "worker restarts and says much else about lanterns, ropes, sails and so on") for i in range(3)] + [(f"a{i}", "a.md", "a", None, f"lantern{i}") for i in range(9)]
    small = [("b0", "b.md", "b", None, "lantern"), ("b1", "b.md", "b", None, "rope")]
    sections = own + others + small
    spark.createDataFrame(sections, "id string, path string, component string, heading_path string, text string").write.parquet(str(tmp_path / "sections.parquet"))
    rows = [("q20", "a", "worker restarts queue", [("own.md",)]), ("q40", "b", "zeppelin", [("b.md",)]), ("q60", None, "zeppelin", []), ("q61", "a", "lantern0", [])]
    spark.createDataFrame(rows, "id string, component string, question string, gold array<struct<path: string>>").write.parquet(str(tmp_path / "questions.parquet"))
    plans.load()
    got = {r["query"]: r["negatives"] for r in QUERIES["neg_groups"](spark, str(tmp_path)).collect()}
    assert got.keys() == {"q20", "q40", "q60"} and all(len(set(n)) == len(n) == 7 for n in got.values())
    of = {r[0]: r for r in sections}
    assert {of[x][1] for x in got["q20"]} <= {"hit.md", "a.md"}
    assert not any(x.startswith("b") for x in got["q40"])
