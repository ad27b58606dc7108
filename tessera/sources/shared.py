"""The folder that driver and executors share, and tables that are written in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a side of a join may take, by the count of its rows, to be broadcast.
BROADCAST_BYTES = 8 << 20
#: Scopes that are open, inmost last.
SCOPES: list = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a temporary folder, on one machine only."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return note(spark.read.schema(df.schema).parquet(path), path)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df (a written table: it is counted) for one side of a join, to be broadcast if its rows take no more than limit; else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def per_worker(key: tuple, make):
    """What make() gives, kept for the life of a Python worker: the functions that tasks run come by value, without their module."""
    import sys
    import types

    kept = vars(sys.modules.setdefault("tessera_kept", types.ModuleType("tessera_kept")))
    if key not in kept:
        kept[key] = make()
    return kept[key]


def note(found: DataFrame, path: str) -> DataFrame:
    """found, with the path that it was written to kept for erase() and the open scope."""
    found._tessera_path = path
    if SCOPES:
        SCOPES[-1].made.append(found)
    return found


def erase(*tables: DataFrame) -> None:
    """Delete tables that written() made and that nothing reads any more (others are left alone)."""
    for t in tables:
        if path := vars(t).pop("_tessera_path", None):
            sc = t.sparkSession.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


class scratch:
    """A scope whose tables by written() are deleted at its end, but for those given to keep()."""

    def __enter__(self) -> scratch:
        self.made: list[DataFrame] = []
        self.kept: list[DataFrame] = []
        SCOPES.append(self)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df)
        return df

    def __exit__(self, *_) -> None:
        SCOPES.remove(self)
        erase(*(t for t in self.made if not any(t is k for k in self.kept)))
        if SCOPES:
            SCOPES[-1].made += self.kept
