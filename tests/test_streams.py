"""Streams run to their end over small folders, trigger by trigger; the store through a crash; clean-up of tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docloom import session
from docloom.sources.store import Store, write_gated
from docloom.streaming import events as E

DAY = datetime(2024, 1, 1)


def feed(spark, tmp_path, batches):
    """A stream over one file for each batch, in order."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(n, DAY + timedelta(minutes=m), u, kind, 1.0, None) for n, m, u, kind in rows], E.SCHEMA)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
    source = spark.readStream.schema(E.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    return source.withColumn("at", F.col("ts").cast("timestamp"))


def run(stream, mode, tmp_path, name="out"):
    return E.drained(stream, mode, str(tmp_path / f"{name}-at"), str(tmp_path / name)).collect()


def test_tool_state_is_kept_and_forgotten(spark, tmp_path):
    day = 24 * 60
    batches = [[(1, 0, 1, "s"), (2, 5, 1, "e"), (3, 6, 1, "s"), (4, 7, 2, "e")], [(5, 10, 1, "e"), (6, 11, 2, "s")], [(7, 40 * day, 3, "s")], [(8, 41 * day, 3, "s")]]
    rows = run(E.running_tools(feed(spark, tmp_path, batches), "s", "e", "1 day", "7 days"), "update", tmp_path)
    last = {}
    for r in sorted(rows, key=lambda r: r.batch):
        last[r.user_id] = r
    assert (last[1].open, last[1].done, last[1].ended) == (0, 2, True) and (last[2].open, last[2].done, last[2].ended) == (1, 0, True)
    assert (last[3].open, last[3].done, last[3].ended) == (2, 0, False)


def test_sessions_windows_and_durations(spark, tmp_path):
    rows = [(1, 0, 1, "s"), (2, 10, 1, "e"), (3, 100, 1, "s"), (4, 20, 2, "e"), (5, 25, 2, "s")]
    got = run(E.sessions(feed(spark, tmp_path / "a", [rows]), "30 minutes"), "complete", tmp_path / "a")
    assert sorted((r.user_id, r.events) for r in got) == [(1, 1), (1, 2), (2, 2)]
    got = run(E.windowed(feed(spark, tmp_path / "b", [rows])), "complete", tmp_path / "b")
    assert sorted((r.window.start.hour, r.event_type, r.n) for r in got) == [(0, "e", 2), (0, "s", 2), (1, "s", 1)]
    late = [(9, 3 * 24 * 60, 9, "x")]
    got = run(E.durations(feed(spark, tmp_path / "c", [rows, late, late]), "s", "e", "1 day"), "append", tmp_path / "c")
    assert {(r.event_id, r.ended is not None) for r in got} >= {(1, True)}
    got = run(E.once(feed(spark, tmp_path / "d", [rows, rows]), ["event_id"]), "append", tmp_path / "d")
    assert sorted(r.event_id for r in got) == [1, 2, 3, 4, 5]


def test_store_through_a_crash(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"))
    assert store.publish({"t": spark.range(3)}) == 1
    with monkeypatch.context() as m:
        m.setattr(Store, "_flip", lambda *_: (_ for _ in ()).throw(OSError("crash")))
        with pytest.raises(OSError):
            store.publish({"t": spark.range(9)})
    # A crash before the flip leaves the build before; the next build takes its place.
    assert store.read("t").count() == 3 and store.publish({"t": spark.range(4)}) == 2 and store.read("t").count() == 4
    one, two = store._pointer(), store._pointer()
    store._flip(one)
    with pytest.raises(RuntimeError):
        store._flip(two)
    for n in range(5, 9):
        store.publish({"t": spark.range(n)})
    assert len(store._turns()) == 2 and store.read("t").count() == 8


def test_gated_parts(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", "a"), (2, "val", "b"), (3, "train", "c")], "id int, part string, text string")
    counts = write_gated(df, "part", str(tmp_path / "out"), spark.createDataFrame([(3,), (3,)], "id int"), "id")
    assert counts == {"train": 1, "val": 1} and {r.id for r in spark.read.json(str(tmp_path / "out")).collect()} == {1, 2}


def test_forget(spark, tmp_path):
    at = session.stored(spark.range(3))
    assert session.once(spark, ("x",), lambda: 1) == 1 and at.count() == 3
    made = session.once(spark, ("y",), lambda: session.stored(spark.range(5)))
    assert session.once(spark, ("y",), lambda: 1 / 0).count() == 5
    session.discard(made)
    assert session.once(spark, ("y",), lambda: session.stored(spark.range(6))).count() == 6
    assert session.forget(spark) >= 1 and session.forget(spark) == 0
    assert session.once(spark, ("x",), lambda: 2) == 2
