"""Versioned tables: each build is a folder of its own; of the pointers, the one of the highest turn names the current build
and the one before it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """A folder of builds. publish() writes all tables of a build and then flips the pointer, so a reader sees a whole
    build; rollback() flips it back. Paths may be of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _turns(self) -> list[int]:
        at = self._path(f"{self.root}/pointers")
        if not self._fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def _pointer(self) -> dict:
        turns = self._turns()
        if not turns:
            return {"turn": 0, "current": 0, "previous": 0, "last": 0}
        return json.loads(self.spark.read.text(f"{self.root}/pointers/{turns[-1]:012d}.json").first()[0])

    def _flip(self, pointer: dict) -> None:
        """Adds a pointer of a higher turn under its final name by one rename, so there is a whole pointer at any moment; the
        older ones but the last are taken away behind it. A second writer of the same turn fails on the rename."""
        pointer["turn"] += 1
        self._fs.mkdirs(self._path(f"{self.root}/pointers"))
        staged = self._path(f"{self.root}/pointers/.{uuid.uuid4().hex}")
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        to = self._path(f"{self.root}/pointers/{pointer['turn']:012d}.json")
        if self._fs.exists(to) or not self._fs.rename(staged, to):
            self._fs.delete(staged, False)
            raise RuntimeError("another build was published meanwhile")
        for turn in self._turns()[:-2]:
            self._fs.delete(self._path(f"{self.root}/pointers/{turn:012d}.json"), False)

    def publish(self, tables: dict[str, DataFrame]) -> int:
        p = self._pointer()
        version = p["last"] + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/v={version}/{name}")
        self._flip(p | {"current": version, "previous": p["current"], "last": version})
        return version

    def read(self, name: str) -> DataFrame:
        version = self._pointer()["current"]
        if not version:
            raise LookupError("nothing is published yet")
        return self.spark.read.parquet(f"{self.root}/v={version}/{name}")

    def rollback(self) -> int:
        p = self._pointer()
        if not p["previous"]:
            raise LookupError("there is no build before this one")
        self._flip(p | {"current": p["previous"], "previous": p["current"]})
        return p["previous"]

    def version(self) -> int:
        return self._pointer()["current"]


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One value a line; the files one after another are in order of the values, which a range partitioning gives. Line ends in
    a value become blanks, null values no line."""
    value = F.regexp_replace(df[column].cast("string"), r"\s*[\r\n]+\s*", " ")
    df.select(value.alias("value")).filter("value is not null").orderBy("value").write.mode("overwrite").text(path)


def write_gated(df: DataFrame, by: str, path: str, rejected: DataFrame, key: str) -> dict[str, int]:
    """The rows that aren't rejected (key) as JSON lines in one folder for each value of `by`, and how many rows each part
    has. Nothing is written over another's parts until all are there: the folder is replaced whole."""
    kept = df.join(rejected.select(key).distinct(), key, "left_anti")
    kept.write.mode("overwrite").partitionBy(by).json(path)
    return {r[0]: r[1] for r in kept.groupBy(by).count().collect()}  # one row a named part


def write_parts(df: DataFrame, by: str, path: str) -> None:
    """JSON lines in one folder for each value of `by`."""
    df.write.mode("overwrite").partitionBy(by).json(path)
