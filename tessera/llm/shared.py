"""Helpers that several operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..sources.shared import erase, fresh_path, note, scratch, shared_folder, written

__all__ = ["bucketed", "components", "erase", "fresh_path", "let_go", "note", "partitions", "per_worker", "scratch", "shared_folder", "small", "table", "unused", "written"]


#: What a side of a join may take, by the count of its rows, to be broadcast.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucketed(df: DataFrame, column: str, tag: str) -> DataFrame:
    """Write df in the shared folder, bucketed by column: joins on it move the other side only."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    name = "tessera_" + path.rsplit("-", 1)[1]
    df.write.bucketBy(partitions(spark), column).option("compression", "zstd").option("path", path).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # from the catalog only: the files stay, and the plan knows them
    return note(found, path)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df for one side of a join: to be broadcast if its rows, counted now, take no more than limit; else as it is.

    Spark's own choice comes too late where the other side is long: its shuffle has begun by then.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def per_worker(key: tuple, make):
    """What make() gives, kept for the life of a Python worker.

    Functions come to the workers by value, so the globals of their module end with a task: what
    is kept lies in a module of its own.
    """
    import sys
    import types

    kept = vars(sys.modules.setdefault("tessera_worker_cache", types.ModuleType("tessera_worker_cache")))
    if key not in kept:
        kept[key] = make()
    return kept[key]


def let_go() -> None:
    """Forget what per_worker kept: a worker that takes up another operator's task needs the room."""
    import sys

    if kept := sys.modules.get("tessera_worker_cache"):
        for key in [k for k in vars(kept) if isinstance(k, tuple)]:
            del vars(kept)[key]


def unused(name: str, columns: list[str]) -> str:
    """name, or one like it that is none of columns (whatever their case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
