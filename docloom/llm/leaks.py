"""Problem 6: passages of evaluation texts inside training texts.

All runs of 13 words of the evaluation texts are hashed into a bit table of bounded size, which goes to all executors.
Training texts are scanned window by window against it. The windows that hit are joined with the hashes themselves; the
pairs of texts that share a hash are then compared word for word, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.words import WORD, bit_table, bits_for, hashed, looked_up, per_text, runs, words
from docloom.session import stored

WINDOW = 13


def test_windows(tests: DataFrame, key: str, text: str, n: int = WINDOW) -> DataFrame:
    """(h, key): the hash of each run of n words of each test text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in per_text(batches):
            h, starts = hashed([words(t) for t in batch.column(1).to_pylist()])
            windows, inside = runs(h, starts, n)
            row = np.repeat(np.arange(batch.num_rows), np.diff(starts))[inside]
            yield pa.RecordBatch.from_arrays([pa.array(windows[inside].view(np.int64)), batch.column(0).take(pa.array(row))], names=["h", key])

    return tests.select(tests[key], tests[text]).mapInArrow(run, f"h bigint, `{key}` {tests.schema[key].dataType.simpleString()}")


def scan(train: DataFrame, key: str, text: str, table: Broadcast, n: int = WINDOW) -> DataFrame:
    """(h, key): the windows of the training texts whose hash may be in the bit table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = looked_up(table.value)
        for batch in per_text(batches):
            h, starts = hashed([words(t) for t in batch.column(1).to_pylist()])
            windows, inside = runs(h, starts, n)
            at = np.flatnonzero(inside)
            at = at[may(windows[at])]
            row = np.searchsorted(starts, at, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(windows[at].view(np.int64)), batch.column(0).take(pa.array(row))], names=["h", key])

    return train.select(train[key], train[text]).mapInArrow(run, f"h bigint, `{key}` {train.schema[key].dataType.simpleString()}")


def _with_keys(train: DataFrame, key: str, text: str, pairs: DataFrame) -> DataFrame:
    """(key, _mine): the training texts whose key may be in pairs, by a bit table of the keys, so that few others are
    shuffled for the join."""
    keys = pairs.select(F.xxhash64(key).alias("h")).distinct()
    table = bit_table(keys, "h", bits_for(keys.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = looked_up(table.value)
        for batch in batches:
            kept = may(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays(batch.columns[1:], names=[key, "_mine"]).filter(pa.array(kept))

    rows = train.select(F.xxhash64(train[key]).alias("h"), train[key], train[text].alias("_mine")).filter("_mine is not null")
    return rows.mapInArrow(run, f"`{key}` {train.schema[key].dataType.simpleString()}, _mine string")


def _in_common(batches: Iterator[pa.RecordBatch], n: int, key: str, test_key: str) -> Iterator[pa.RecordBatch]:
    """(key, test, text, test text) -> (key, test, run): the runs of n words that stand in both, word for word."""
    for batch in per_text(batches, 512):
        row, said, seen = [], [], {}
        for i, (t, s) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            mine, theirs = (seen[x] if x in seen else seen.setdefault(x, _runs_of(x, n)) for x in (t, s))
            found = mine & theirs
            row += [i] * len(found)
            said += found
        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row, pa.int64())) for c in batch.columns[:2]), pa.array(said, pa.string())], names=[key, test_key, "run"])


def _runs_of(text: str, n: int) -> set[str]:
    w = words(text)
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}


def find_leaks(train: DataFrame, key: str, text: str, tests: DataFrame, test_key: str, test_text: str, n: int = WINDOW) -> DataFrame:
    """(key, test_key, run): each run of n words of a training text that stands unbroken in a test text, once.

    Windows travel as hashes; the words of the two texts are fetched only for pairs that share one, and compared there.
    Case and what stands between words don't matter. Texts of fewer than n words and null or empty ones have no runs.
    Repeated rows count once. tests may have several texts (rows) of one key. Other columns are ignored.
    """
    kind, test_kind = train.schema[key].dataType.simpleString(), tests.schema[test_key].dataType.simpleString()
    # Each test text by itself: a key may have several.
    tests = stored(tests.select(F.col(test_key).alias("_test"), F.col(test_text).alias("_said")).filter("_said is not null").distinct().withColumn("_text", F.unhex(F.md5("_said"))))
    windows = stored(test_windows(tests, "_text", "_said", n).distinct())
    table = bit_table(windows, "h", bits_for(windows.count()))
    pairs = stored(scan(train, key, text, table, n).distinct().join(windows, "h").select(key, "_text").distinct())
    table.unpersist()
    held = _with_keys(train, key, text, pairs).distinct()
    both = pairs.join(held, key).join(tests, "_text").select(key, "_test", "_mine", "_said")
    found = both.mapInArrow(lambda x: _in_common(x, n, key, test_key), f"`{key}` {kind}, `{test_key}` {test_kind}, run string")
    return found.distinct()


def remove_leaks(train: DataFrame, key: str, text: str, leaks: DataFrame) -> DataFrame:
    """(key, text, n_removed): the training texts with leaks, without the words of the leaked runs and what stands
    between them; n_removed counts words. leaks: as find_leaks returns it. Every row of train with a leak is kept, even
    if nothing of its text is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for t, held in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = [m.span() for m in WORD.finditer(t)]
                said = [t[a:b].lower() for a, b in spans]
                n, held, gone = len(held[0].split(" ")), set(held), np.zeros(len(spans) + 1, np.int64)
                for i in range(len(said) - n + 1):
                    if " ".join(said[i : i + n]) in held:
                        gone[i] += 1
                        gone[i + n] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                out, at, i = [], 0, 0
                while i < len(spans):
                    if gone[i]:
                        j = i
                        while j + 1 < len(spans) and gone[j + 1]:
                            j += 1
                        out.append(t[at : spans[i][0]])
                        at, i = spans[j][1], j
                    i += 1
                texts.append("".join(out) + t[at:])
                counts.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=[key, "text", "n_removed"])

    held = leaks.select(key, "run").distinct().groupBy(key).agg(F.collect_set("run").alias("_held"))
    rows = train.select(train[key], train[text].alias("_text")).filter("_text is not null").join(held, key)
    return rows.select(key, "_text", "_held").mapInArrow(run, f"`{key}` {train.schema[key].dataType.simpleString()}, text string, n_removed int")
