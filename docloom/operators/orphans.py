"""Problem 4: references to records that do not exist, by compressed bitmaps per key range and period.

A key travels as a code of 128 bits instead of its text. Codes fall into ranges; within a range each gets an integer, its
place in the range's dictionary. References are first reduced to distinct (code, period), with the first and last moment
they were made in it. For each range and period there are two bitmaps over the dictionary: keys referred to, and keys
with a life that covers all those moments. A bitmap is kept in containers of 65,536 places, each a sorted array while it
is sparse and bits where it isn't. Reference AND NOT parent leaves the keys that are missing at some moment; their bits
are decoded back to codes. They go back to the references with the lives of the key, and each row is decided by its own
moment.

A key that a third of all rows refers to is one row per period before anything is shuffled by key. Ranges are counted by
the keys of both sides, so missing keys without any parent are spread like the others. The way back to the rows joins
only missing keys; there the rows of a hot one are split by the skew join, as the other side has one row for it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import stored

#: Rows of both sides per range, on average.
RANGE_KEYS = 32_768

#: A container of 2**16 places is a sorted array up to so many, and a bitmap of 8 KB above.
SPARSE = 4_096

_FOREVER = 2**62


class Bitmap:
    """A set of integers in containers of 2**16 places: a sorted array of 16-bit numbers, or 8 KB of bits."""

    def __init__(self, held: dict[int, np.ndarray]):
        self.held = held

    @classmethod
    def of(cls, places: np.ndarray) -> Bitmap:
        places = np.unique(places)
        high = places >> 16
        starts = np.flatnonzero(np.diff(high, prepend=-1))
        parts = np.split((places & 0xFFFF).astype(np.uint16), starts[1:]) if len(places) else []
        return cls({int(high[s]): cls._packed(p) for s, p in zip(starts, parts)})

    @staticmethod
    def _packed(low: np.ndarray) -> np.ndarray:
        if len(low) <= SPARSE:
            return low
        bits = np.zeros(1 << 16, bool)
        bits[low] = True
        return np.packbits(bits)

    @staticmethod
    def _places(c: np.ndarray) -> np.ndarray:
        return c if c.dtype == np.uint16 else np.flatnonzero(np.unpackbits(c)).astype(np.uint16)

    def and_not(self, other: Bitmap) -> Bitmap:
        out = {}
        for k, mine in self.held.items():
            theirs = other.held.get(k)
            if theirs is None:
                left = mine
            elif mine.dtype == np.uint8 and theirs.dtype == np.uint8:
                left = self._packed(self._places(mine & ~theirs))
            elif theirs.dtype == np.uint8:
                left = mine[(theirs[mine >> 3] >> (7 - (mine & 7)).astype(np.uint8)) & 1 == 0]
            else:
                left = self._packed(np.setdiff1d(self._places(mine), theirs, assume_unique=True))
            if len(left):
                out[k] = left
        return Bitmap(out)

    def places(self) -> np.ndarray:
        parts = [self._places(c).astype(np.int64) + (k << 16) for k, c in sorted(self.held.items())]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _missing(refs: pd.DataFrame, lives: pd.DataFrame) -> pd.DataFrame:
    """One key range: refs (c1, c2, period, first, last), lives (c1, c2, born, gone) in microseconds."""
    codes = np.zeros(len(refs) + len(lives), [("c1", np.int64), ("c2", np.int64)])
    for c in ("c1", "c2"):
        codes[c] = np.concatenate([refs[c].to_numpy(), lives[c].to_numpy()])
    _, places = np.unique(codes, return_inverse=True)
    of_ref, of_life = places[: len(refs)], places[len(refs) :]
    order = np.argsort(of_life, kind="stable")
    of_life, born, gone = of_life[order], lives["born"].to_numpy()[order], lives["gone"].to_numpy()[order]
    first_made, last_made = refs["first"].to_numpy(), refs["last"].to_numpy()
    left: list[np.ndarray] = []
    for rows in refs.groupby("period", sort=False).indices.values():
        at = rows[np.argsort(of_ref[rows])]
        # The lives of the keys referred to in this period, each next to its reference.
        a, b = np.searchsorted(of_life, of_ref[at]), np.searchsorted(of_life, of_ref[at], "right")
        row = np.repeat(at, b - a)
        life = np.arange(len(row)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
        covers = (born[life] <= first_made[row]) & (last_made[row] < gone[life])
        alone = Bitmap.of(of_ref[at]).and_not(Bitmap.of(of_ref[row[covers]])).places()
        left.append(at[np.searchsorted(of_ref[at], alone)])
    kept = np.concatenate(left) if left else np.zeros(0, np.int64)
    from_, to = np.searchsorted(of_life, of_ref[kept]), np.searchsorted(of_life, of_ref[kept], "right")
    out = refs.iloc[kept][["c1", "c2", "period"]].copy()
    out["born"], out["gone"] = ([x[i:j].tolist() for i, j in zip(from_, to)] for x in (born, gone))
    return out


def orphans(refs: DataFrame, lives: DataFrame, keep: list[str]) -> DataFrame:
    """The rows of refs whose key isn't alive at their moment: (domain, key, *keep, period), period as "2024-05".

    refs: (domain, key, at, ...): key is looked up among the lives of the domain; rows with a null key or a null moment
    are no case. lives: (domain, key, born, gone): alive from born up to, not including, gone; a null born is always
    before, a null gone is never. A key may have several lives; one is enough. No lives at all: every reference is a
    case. Repeated rows of refs come out as often as they stand there.
    Other columns are ignored."""
    if {"domain", "key", "period"} & set(keep):
        raise ValueError("domain, key and period come out anyway")
    code = lambda df: df.filter("domain is not null and key is not null").withColumn("c1", F.xxhash64("domain", "key")).withColumn("c2", F.xxhash64(F.lit(7), "key", "domain"))
    moment = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    refs = code(refs.select("domain", "key", "at", F.date_format("at", "yyyy-MM").alias("period"), *[F.col(c).alias(f"_kept_{c}") for c in keep])).filter("at is not null")
    keys = stored(refs.withColumn("_at", moment("at")).groupBy("c1", "c2", "period").agg(F.min("_at").alias("first"), F.max("_at").alias("last")))
    lives = stored(code(lives).select("c1", "c2", F.coalesce(moment("born"), F.lit(-_FOREVER)).alias("born"), F.coalesce(moment("gone"), F.lit(_FOREVER)).alias("gone")).distinct())
    ranges = 1 + (keys.count() + lives.count()) // RANGE_KEYS
    place = F.pmod(F.col("c1"), F.lit(ranges))
    left = keys.withColumn("range", place).groupBy("range").cogroup(lives.withColumn("range", place).groupBy("range"))
    missing = left.applyInPandas(lambda r, p: _missing(r.drop(columns="range"), p.drop(columns="range")), "c1 bigint, c2 bigint, period string, born array<bigint>, gone array<bigint>")
    alive = F.exists(F.arrays_zip("born", "gone"), lambda x: (x["born"] <= F.col("_at")) & (F.col("_at") < x["gone"]))
    return refs.withColumn("_at", moment("at")).join(missing, ["c1", "c2", "period"]).filter(~alive).select("domain", "key", *[F.col(f"_kept_{c}").alias(c) for c in keep], "period")


def bare_key(column: Column) -> Column:
    """A key without blanks around it and in lower case."""
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


def bare_name(column: Column) -> Column:
    """A name without blanks, backticks, quotes and .,:; at both ends, and then without all from the first ( on."""
    ends = r"[\s`'\".,:;‘’“”«»]+"
    return F.regexp_replace(F.regexp_replace(column, rf"^{ends}|{ends}$", ""), r"(?s)\(.*", "")
