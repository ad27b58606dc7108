"""A folder whose contents are a list of parts: each version of the list is one small file that appears whole.

Readers take the newest list, so what a writer that failed left behind is never seen, and what a
new version no longer names can be deleted. There is one writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _files(spark: SparkSession, path: str):
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(sc._jsc.hadoopConfiguration()), sc._jvm


def current(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(number, contents) of the newest version; (0, {}) if there is none."""
    place, fs, jvm = _files(spark, f"{path}/versions")
    if not fs.exists(place):
        return 0, {}
    names = [f.getPath().getName() for f in fs.listStatus(place)]
    numbers = [int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(("_", "."))]
    if not numbers:
        return 0, {}
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(place, f"{max(numbers)}.json"))
    try:
        return max(numbers), json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, number: int, contents: dict) -> None:
    """Make contents version `number`: written aside, then renamed, which fails if another writer was first."""
    place, fs, jvm = _files(spark, f"{path}/versions")
    fs.mkdirs(place)
    aside, there = jvm.org.apache.hadoop.fs.Path(place, f"_{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(place, f"{number}.json")
    stream = fs.create(aside)
    try:
        stream.write(bytearray(json.dumps(contents), "utf-8"))
    finally:
        stream.close()
    if fs.exists(there) or not fs.rename(aside, there):
        raise RuntimeError(f"{path} has had another writer: version {number} exists")


def new_part(tag: str) -> str:
    return f"{tag}-{uuid.uuid4().hex}"


def drop_parts(spark: SparkSession, path: str, parts: list[str]) -> None:
    for p in parts:
        place, fs, _ = _files(spark, f"{path}/{p}")
        fs.delete(place, True)
