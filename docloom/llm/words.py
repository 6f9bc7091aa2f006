"""Words, word runs and fixed-size bit tables, shared by the problems of this package."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.codes import bit_table, bits_for, looked_up  # noqa: F401

#: A longest run of letters and digits of any script; _ is no word character.
WORD = re.compile(r"[^\W_]+")

#: The same for the JVM.
WORD_JVM = r"[\p{L}\p{N}]+"

#: Words whose hash a worker keeps; when full, the store starts anew.
KEPT_WORDS = 500_000

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_JVM), F.lit(0))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


_HASHES = _Hashes()


def hashed(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of a batch in one array, and where each text begins in it (with the end)."""
    starts = np.cumsum([0] + [len(t) for t in texts])
    out = np.fromiter((h for t in texts for h in map(_HASHES.__getitem__, t)), np.uint64, starts[-1])
    return out, starts


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _ODD[1]
    return h ^ (h >> np.uint64(29))


def runs(h: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n consecutive words that lie within one text: (hash by first position, mask of the
    positions at which a run begins)."""
    if len(h) < n:
        return np.zeros(len(h), np.uint64), np.zeros(len(h), bool)
    out, size = np.zeros(len(h), np.uint64), len(h) - n + 1
    for j in range(n):
        out[:size] = out[:size] * _ODD[0] + h[j : j + size]
    inside = np.arange(len(h)) + n <= np.repeat(starts[1:], np.diff(starts))
    return mixed(out), inside


def per_text(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that arrays over all words of a batch stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Rows of a group that one task holds against the whole group.
BLOCK = 1024


def pairs_within(rows: DataFrame, group: str, key: str, others: list[str] = ()) -> DataFrame:
    """(id_a, id_b, and *_a, *_b of the others): all pairs id_a < id_b of rows of one group, for results that are those
    pairs. A group is cut into blocks of about BLOCK rows by the hash of the key, each held against the whole group, so
    one that holds a third of all rows is spread over as many tasks as it has blocks. A null group has no pairs."""
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks")).filter(F.col(group).isNotNull())
    sized = rows.join(sizes, group)
    of = lambda s: [F.col(key).alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in others]]
    a = sized.select(group, F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int").alias("_block"), *of("a"))
    b = sized.select(group, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), *of("b"))
    return a.join(b, [group, "_block"]).filter("id_a < id_b").drop(group, "_block")
