"""Readers."""

import gzip
import json
import sqlite3
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.sources import code, files


def test_files(spark, tmp_path):
    for name in ("a.md", "src/b.py", "node_modules/c.md", ".hidden/d.md", ".github/e.md", "src/f.bin"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"text of {name}\n\n")
    got = {r.path: r.text for r in files.text_files(spark, str(tmp_path), [".md", ".py"]).collect()}
    assert set(got) == {"a.md", "src/b.py", ".github/e.md"} and got["a.md"] == "text of a.md\n\n"
    assert files.lines(spark, str(tmp_path / "a.md")).count() == 1


def test_json_lines(spark, tmp_path):
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write(json.dumps({"id": 1, "text": "a"}) + "\nbroken {\n" + json.dumps({"id": 2}) + "\n")
    assert sorted((r.id, r.text) for r in files.json_lines(spark, str(tmp_path), "id int, text string").collect()) == [(1, "a"), (2, None)]


def test_commit_times(spark, tmp_path):
    (tmp_path / "log").write_text("\x01300\n\na\nb\n\x01200\n\na\nc\n")
    assert {r.path: r.t for r in files.commit_log(spark, str(tmp_path / "log")).select("path", F.unix_seconds("at").alias("t")).collect()} == {"a": 300, "b": 300, "c": 200}


def test_tracked_files(spark, tmp_path):
    for name, text in (("a.md", "x"), ("src/b.py", "x"), ("skip.log", "x"), (".gitignore", "*.log\n")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    with pytest.raises(LookupError):
        files.tracked_files(spark, str(tmp_path / "src" / "gone"))
    subprocess.run(["git", "-C", str(tmp_path), "init", "-q"], check=True)
    assert {r.path for r in files.tracked_files(spark, str(tmp_path)).collect()} == {".gitignore", "a.md", "src/b.py"}


def test_vectors(spark, tmp_path):
    np.savez(tmp_path / "v.npz", ids=np.array(["a", "b"]), vecs=np.array([[1.0, 2.0], [3.0, 4.0]]))
    assert {r.key: list(r.v) for r in files.vectors(spark, str(tmp_path / "*.npz")).collect()} == {"a": [1.0, 2.0], "b": [3.0, 4.0]}


def test_transcripts_go_on(spark, tmp_path):
    at = tmp_path / "s.jsonl"
    at.write_text('{"a": 1}\nbroken\n{"a": "ü"}\n{"a": 3')
    rows, offsets = files.transcripts(spark, str(at))
    assert [(r.line, json.loads(r.row)["a"]) for r in rows.orderBy("line").collect()] == [(1, 1), (3, "ü")]
    held = [tuple(r) for r in offsets.collect()]
    at.write_text(at.read_text() + "}\n[4]\n")
    rows, offsets = files.transcripts(spark, str(at), spark.createDataFrame(held, offsets.schema))
    assert [(r.line, r.row) for r in rows.collect()] == [(4, '{"a": 3}')]
    held = [tuple(r) for r in offsets.collect()]
    assert held[0][1:] == (len(at.read_bytes()), 5)
    assert files.transcripts(spark, str(at), spark.createDataFrame(held, offsets.schema))[0].count() == 0
    at.write_text("{}\n")
    assert files.transcripts(spark, str(at), spark.createDataFrame(held, offsets.schema))[0].count() == 1


def test_sqlite_and_settings(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "x.db")
    db.execute("create table sections (id text, n integer)")
    db.executemany("insert into sections values (?, ?)", [("a", 1), ("b", None)])
    db.commit()
    sqlite3.connect(tmp_path / "y.db").close()
    got = files.sqlite_rows(spark, [str(tmp_path / "x.db"), str(tmp_path / "y.db")], "sections", "id string, n bigint").collect()
    assert sorted(map(tuple, got)) == [("a", 1), ("b", None)]
    (tmp_path / "s.json").write_text('{"terms": []}')
    assert files.settings_file(str(tmp_path / "s.json"), required=("terms",)) == {"terms": []} and files.settings_file(str(tmp_path / "none"), strict=False) == {}
    with pytest.raises(FileNotFoundError):
        files.settings_file(str(tmp_path / "none"))
    with pytest.raises(ValueError):
        files.settings_file(str(tmp_path / "s.json"), required=("paths",))


CODE = '"""What the module does.\n\nMore."""\n\n\nclass Job(Base):\n    """One job."""\n\n    def run(self, a, *rest, k=1, **more):\n        """Runs it.\n        Twice."""\n        def inner(): pass\n\n    def _hidden(self): pass\n\n\nasync def start(x, /, y):\n    pass\n'


def test_code(spark):
    df = spark.createDataFrame([("app/jobs.py", CODE), ("bad.py", "def ("), ("none.py", None), ("x.md", CODE)], "path string, text string")
    got = {r.name: r for r in code.symbols(df).collect()}
    assert {k: (r.kind, r.owner, r.first) for k, r in got.items()} == {"Job": ("class", None, 6), "Job.run": ("method", "Job", 9), "Job.run.inner": ("nested", "Job.run", 12), "Job._hidden": ("method", "Job", 14), "start": ("function", None, 17)}
    assert got["Job.run"].signature == "run(self, a, *rest, k, **more)" and got["Job.run"].label == ".run()" and got["Job"].doc == "One job."
    text = code.api_reference(df).first().text
    assert text == "# Module `app.jobs`\n\nWhat the module does.\n\n## class `app.jobs.Job`, a subclass of `Base`\n\nOne job.\n\n- `Job.run(self, a, *rest, k, **more)`: Runs it.\n\n## `app.jobs.start(x, y)`"
    rows = spark.createDataFrame([("a.b.c", False, 1, "d", "a.b.d"), ("a.b.c", False, 2, None, "a"), ("a.b", True, 1, "d", "a.b.d"), ("a", False, 3, "x", None), ("a.b", False, 0, "x.y", "x.y")], "m string, p boolean, l int, n string, want string")
    assert all(r.got == r.want for r in rows.withColumn("got", code.imported(F.col("m"), F.col("p"), F.col("l"), F.col("n"))).collect())


def test_sentences(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"tokens": ["a", "b", "c", "d", "e"]}) + "\n" + json.dumps({"text": "too short"}))
    (tmp_path / "b.txt").write_text("one two three four five six\nno\n")
    out = files.sentences(spark, [("json", str(tmp_path / "a.json")), ("text", str(tmp_path / "b.txt"))])
    assert {r.text for r in out.collect()} == {"a b c d e", "one two three four five six"}
