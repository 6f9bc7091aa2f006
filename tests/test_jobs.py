"""Jobs for new questions over more sections than the sample of identifier questions takes."""

from docloom import plans
from docloom.plans.registry import QUERIES


def test_section_jobs(spark, tmp_path):
    spark.range(10_050).selectExpr("concat('s', id) AS id", "concat('p', id, '.md') AS path", "if(id = 7, null, concat('text ', id)) AS text").write.parquet(str(tmp_path / "sections.parquet"))
    spark.range(5).selectExpr("concat('q', id) AS id", "array(named_struct('section', concat('s', id)), named_struct('section', cast(null AS string))) AS gold").write.parquet(str(tmp_path / "questions.parquet"))
    plans.load()
    rows = QUERIES["section_jobs"](spark, str(tmp_path)).collect()
    normal, ident = ([r.id for r in rows if r.kind == kind] for kind in ("normal", "ident"))
    assert sorted(normal) == sorted(f"s{i}" for i in range(5, 10_050))
    assert len(set(ident)) == len(ident) == 10_000 and {"s0", "s1", "s2", "s3", "s4"} & set(ident)
