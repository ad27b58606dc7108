"""Groups of rows that share keys and pass an exact test, without all pairs of those that share one.

1. Each row is tested against the least row of every key that it shares (`star_links`): as many
   tests as rows, dealt in chunks, so a key that very many rows share is no single task's.
2. Where a key's rows are in several groups still, those outside its largest group meet all of its
   rows, block by block (`block_links`). Pairs inside a group have nothing left to tell.

Payloads (what the test looks at) move only to where they are tested.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, small, written

CHUNK = 256


class Joined:
    """Groups of numbers that joins merge."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent
        while (up := p.setdefault(x, x)) != x:
            p[x] = p[up] if up in p else up
            x = up
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether x and y were apart until now."""
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of sorted batches, those with equal first `keys` columns together."""
    held: list[tuple] = []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if held and held[-1][:keys] != r[:keys]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def edges_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = (np.array(x, np.int64) for x in (zip(*edges) if edges else ((), ())))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def leader_pairs(posts: DataFrame) -> DataFrame:
    """(a, b, off): each row b of posts (key columns j, key; row, at, grp) with the least row a of a key
    whose group is another; off is how far a's place lies beyond b's."""
    lead = posts.groupBy("j", "key").agg(
        F.min(F.struct("row", "at", "grp")).alias("lead"), F.min("grp").alias("lo"), F.max("grp").alias("hi")
    ).where("lo <> hi").select("j", "key", "lead")
    return posts.join(small(written(lead, "leads"), 48), ["j", "key"]).where("grp <> lead.grp").select(
        F.col("lead.row").alias("a"), F.col("row").alias("b"), (F.col("lead.at") - F.col("at")).cast("long").alias("off")
    ).distinct()


def star_links(pairs: DataFrame, payloads: DataFrame, fits: Callable[[bytes, bytes, int], bool], chunk: int = CHUNK) -> DataFrame:
    """(a, b) for the pairs (a, b, off) whose payloads (row, payload) fit; a task holds one leader's payload at a time."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    members = pairs.join(many, "a").select(
        "a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("role"), F.col("b").alias("row"), "off"
    )
    leaders = many.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), F.col("a").alias("row"), F.lit(0).cast("long").alias("off"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, linked = b"", None
        for batch in batches:
            out = []
            for a, role, row, off, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if not role:
                    lead, linked = payload, None
                elif row != linked and fits(lead, payload, off):
                    out.append((a, row))
                    linked = row
            yield edges_batch(out)

    dealt = small(members.union(leaders), 40).join(payloads, "row").repartition(partitions(pairs.sparkSession), "a", "chunk")
    return dealt.sortWithinPartitions("a", "chunk", "role", "row").select("a", "role", "row", "off", "payload").mapInArrow(run, "a long, b long")


def block_links(posts: DataFrame, payloads: DataFrame, meet: Callable[[list, list], list], chunk: int = CHUNK) -> DataFrame:
    """(a, b) from the keys of posts (j, key, row, at, grp) whose rows are in several groups, after star_links.

    meet(asking, asked) gets lists of (row, at, grp, payload), at most about `chunk` long, and gives
    edges that join what fits. Keys of two rows are left out: their one pair has been tested.
    """
    per = posts.groupBy("j", "key", "grp").agg(F.count("*").alias("c"))
    shards = per.groupBy("j", "key").agg(
        F.sum("c").alias("n"), F.max("c").alias("top"), F.max_by("grp", F.struct("c", "grp")).alias("major"), F.count("*").alias("kinds")
    ).where("kinds > 1 AND n > 2")
    shards = shards.select(
        "j", "key", "major", F.ceil(F.col("n") / chunk).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("top")) / chunk).cast("int").alias("few")
    )
    x = posts.join(small(written(shards, "shards"), 40), ["j", "key"])
    h = F.xxhash64("row")
    asking = x.where("grp <> major").withColumn("q", F.pmod(h, F.col("few")).cast("int")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = x.withColumn("t", F.pmod(h, F.col("blocks")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("few") - 1)))
    names = ["j", "key", "q", "t", "role", "row", "at", "grp"]
    rows = asking.withColumn("role", F.lit(0)).select(*names).union(asked.withColumn("role", F.lit(1)).select(*names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches, 4):
            sides = [[r[5:] for r in group if r[4] == role] for role in (0, 1)]
            if all(sides):
                yield edges_batch(meet(*sides))

    dealt = small(rows, 64).join(payloads, "row").select(*names, "payload").repartition(partitions(posts.sparkSession), "j", "key", "q", "t")
    return dealt.sortWithinPartitions(*names[:6]).mapInArrow(run, "a long, b long")


def with_groups(posts: DataFrame, comp: DataFrame | None) -> DataFrame:
    """posts with grp: the component of the row, itself if it has none."""
    if comp is None:
        return posts.withColumn("grp", F.col("row"))
    return posts.join(small(comp, 16), F.col("row") == F.col("node"), "left").withColumn("grp", F.coalesce("component", "row")).drop("node", "component")
