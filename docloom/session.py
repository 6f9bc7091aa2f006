"""Session settings and the helpers that every operator shares."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(name: str = "docloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this engine's settings. A conf given by the caller wins."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    spark = builder.config(map=SETTINGS | conf).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per context, so that they can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_docloom_sent", False):
        return
    root = Path(__file__).resolve().parent
    to = os.path.join(tempfile.mkdtemp(prefix="docloom-code-"), "docloom_code.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(to)
    sc._docloom_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where that is unset (tests on one machine) a
    temporary folder is taken."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not jsc.isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
    return jsc.getCheckpointDir().get()


def stored(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """df written once to the shared folder and read again: cuts the lineage, survives the loss of executors, and keeps
    the columns prunable. It is written once although several parts of a plan use it."""
    spark = df.sparkSession
    ship(spark)
    to = os.path.join(shared_dir(spark), f"stored-{uuid.uuid4().hex}")
    (df.coalesce(partitions) if partitions else df).write.parquet(to)
    spark.sparkContext.__dict__.setdefault("_docloom_stored", []).append(to)
    return spark.read.schema(df.schema).parquet(to)


def forget(spark: SparkSession) -> int:
    """Deletes the tables that stored() wrote in this session, and what was made once a session; results that weren't
    written or collected before can't be read any more. Returns how many folders went."""
    held = spark.sparkContext.__dict__
    held.pop("_docloom_once", None)
    gone = 0
    for to in held.pop("_docloom_stored", []):
        path = spark._jvm.org.apache.hadoop.fs.Path(to)
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by stored()."""
    spark = df.sparkSession
    for name in {os.path.dirname(x) for x in df.inputFiles()}:
        if os.path.basename(name).startswith("stored-"):
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def once(spark: SparkSession, name: tuple, make):
    """What make() gives, made once a session for each name: stored tables that several queries read. Made anew if a folder
    that make() wrote is gone, as when the shared folder was cleared."""
    state = spark.sparkContext.__dict__
    held = state.setdefault("_docloom_once", {})

    def there(to: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(to)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    if name not in held or not all(map(there, held[name][1])):
        before = len(state.setdefault("_docloom_stored", []))
        made = make()
        held[name] = made, state["_docloom_stored"][before:]
    return held[name][0]
