"""Codes of 64 bits for texts and sets, told apart by a second one where two share the first; bit tables of such codes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def told_apart(rows: DataFrame, code: str, check: str) -> DataFrame:
    """rows without the column check, a second hash of what code stands for. Where one code has two checks, which a few of
    ten thousand million do, all but the least get a code of both; so equal codes stand for equal things. rows is read
    twice: give a stored one."""
    met = rows.groupBy(code).agg(F.min(check).alias("_least"), F.max(check).alias("_most")).filter("_least <> _most").select(code, "_least")
    if met.isEmpty():
        return rows.drop(check)
    told = rows.join(met, code, "left").withColumn(code, F.when(F.col(check) != F.col("_least"), F.xxhash64(code, check)).otherwise(F.col(code)))
    return told.drop("_least", check)


def bit_table(df: DataFrame, h: str, bits: int) -> Broadcast:
    """A table of 2**bits bits in which the top bits of each 64-bit hash in column h are set, sent to all executors.
    Its size is fixed by the parameter, 2**(bits - 3) bytes, whatever the number of rows: a fuller table lets more rows
    through to the join behind it, and drops none. The bits are set on the executors, 4 KB segment by segment."""
    if not 15 <= bits <= 30:
        raise ValueError("bits must be from 15 to 30")
    at = F.shiftrightunsigned(F.col(h), 64 - bits)
    parts = df.select((at.bitwiseAND(F.lit(32767))).alias("bit"), F.shiftright(at, 15).alias("segment"))
    table = np.zeros(1 << (bits - 3), np.uint8)
    for segment, packed in parts.groupBy("segment").agg(F.bitmap_construct_agg("bit")).toLocalIterator():
        table[segment << 12 : (segment + 1) << 12] = np.frombuffer(bytes(packed), np.uint8)
    return df.sparkSession.sparkContext.broadcast(table.tobytes())


def bits_for(n: int) -> int:
    """Bits of a table in which n hashes fill about one bit in 256, within what bit_table takes."""
    return max(15, min(30, int(n).bit_length() + 8))


def looked_up(table: bytes) -> Callable[[np.ndarray], np.ndarray]:
    """A function that says which hashes may be in the table."""
    held = np.frombuffer(table, np.uint8)
    shift = np.uint64(64 - (len(held).bit_length() + 2))
    return lambda h: (held[(at := (h >> shift).astype(np.int64)) >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def maybe_among(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """rows without most of those whose key isn't in the same column of keys, by a bit table of its hashes; none whose key
    is there is dropped. For a join behind it that would shuffle whole rows. keys is read twice: give a stored one."""
    hashes = keys.select(F.xxhash64(key).alias("h")).distinct()
    table, names = bit_table(hashes, "h", bits_for(hashes.count())), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = looked_up(table.value)
        for batch in batches:
            kept = may(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays(batch.columns[1:], names=names).filter(pa.array(kept))

    return rows.select(F.xxhash64(key), "*").mapInArrow(run, rows.schema)
