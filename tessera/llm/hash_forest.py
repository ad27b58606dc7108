"""Nearest neighbours by a hash-prefix forest.

Rows are dealt into shards of bounded size. A shard's index holds, for each tree, the rows' hash
strings (signs along orthogonal random directions) as a sorted array. A query descends each tree
to its longest matching prefix by binary search, then all trees ascend together, one bit at a
time, until they have met the wanted share of the shard; what was met is scored exactly. Queries
travel: packed in rows of bounded size they are broadcast, a few rows at a time, to the shards,
which stay where they were written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import table, written

TREES, BITS = 32, 24
SHARD_ROWS = 16384
#: Queries in a packed row, and bytes of such rows that are broadcast at once.
QUERY_ROWS, WAVE_BYTES = 8192, 64 << 20
#: Share of a shard that the trees meet before they stop, to which comes the root of k times the
#: rows: the k-th neighbour is the farther, the larger a share of all rows k is. In 64 dimensions
#: without much structure a neighbour agrees with the query in two signs of three, a stranger in
#: one of two, so recall of 0.9 takes about half of the rows (measured: 0.92 of 500 and of 2000
#: rows, 0.93 of 10,256).
SHARE = 0.5


def directions(dim: int, trees: int = TREES, bits: int = BITS, seed: int = 7) -> list[np.ndarray]:
    """For each tree, directions that are orthogonal in runs of dim."""
    rng = np.random.default_rng(seed)
    return [
        np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-bits // dim))], 1)[:, :bits]
        for _ in range(trees)
    ]


def hash_strings(x: np.ndarray, planes: list[np.ndarray]) -> np.ndarray:
    """(trees, rows): the signs as integers, first direction highest."""
    powers = 1 << np.arange(planes[0].shape[1] - 1, -1, -1, dtype=np.int64)
    return np.stack([((x @ p) > 0) @ powers for p in planes])


def candidates(code: np.ndarray, codes: np.ndarray, order: np.ndarray, wanted: int, bits: int) -> np.ndarray:
    """Rows that the trees meet, deepest prefixes first, until there are `wanted`.

    code: the query's string in each tree; codes, order: each tree's sorted strings and their rows.
    """
    n = codes.shape[1]
    if wanted >= n:
        return np.arange(n)
    shift = np.arange(bits + 1, dtype=np.int64)  # bits given up
    low = code[:, None] >> shift << shift
    lo = np.stack([np.searchsorted(c, x) for c, x in zip(codes, low)])
    hi = np.stack([np.searchsorted(c, x) for c, x in zip(codes, low + (1 << shift))])
    level = int(np.argmax((hi - lo).sum(0) >= wanted))  # fewer rows than wanted lie below
    met = np.zeros(n, bool)
    for t in range(len(codes)) if level else ():
        met[order[t, lo[t, level - 1] : hi[t, level - 1]]] = True
    for s in range(level, bits + 1):
        for t in range(len(codes)):
            met[order[t, lo[t, s] : hi[t, s]]] = True
            if t % 4 == 3 and np.count_nonzero(met) >= wanted:
                return np.flatnonzero(met)
        if np.count_nonzero(met) >= wanted:
            break
    return np.flatnonzero(met)


def _usable(vec: str, dim: int) -> Column:
    x = F.col(vec)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & (F.size(x) == dim) & finite & F.exists(x, lambda v: v != 0)


def build(rows: DataFrame, dim: int, shards: int, trees: int, bits: int, kind: str) -> DataFrame:
    """One row per shard: ids, vectors (numbers of the given kind), sorted strings and their order, as bytes."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["vec"].to_numpy())
        codes = hash_strings(x.astype(np.float64), directions(dim, trees, bits))
        order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        held = (np.take_along_axis(codes, order, 1).astype(np.int32), order, x.astype(kind), pdf["id"].to_numpy(np.int64))
        return pd.DataFrame([[key[0], *(a.tobytes() for a in held)]], columns=["shard", "codes", "order", "x", "ids"])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    # A number of partitions that is given is kept, so that each shard is a file and a task of its own.
    return dealt.repartition(min(2 * shards, 1 << 14), "shard").groupBy("shard").applyInPandas(run, "shard int, codes binary, order binary, x binary, ids binary")


def pack_queries(rows: DataFrame, blocks: int) -> DataFrame:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        return pd.DataFrame([[key[0], x.tobytes(), pdf["id"].to_numpy(np.int64).tobytes()]], columns=["block", "qx", "qids"])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInPandas(run, "block int, qx binary, qids binary")


def shard_hits(x: np.ndarray, ids: np.ndarray, codes: np.ndarray, order: np.ndarray, qx: np.ndarray, qids: np.ndarray, strings: np.ndarray, k: int, share: float, bits: int) -> list[tuple]:
    """For each query (its place, ids, scores) of the k best of what the shard's trees meet."""
    wanted, out = int(share * len(ids) + np.sqrt(k * len(ids))) + 1, []
    for q in range(len(qids)):
        met = candidates(strings[:, q], codes, order, wanted, bits)
        met = met[ids[met] != qids[q]]
        near = x[met] @ qx[q]
        if len(met) > 4 * k:  # a little more than k: ties at the border stay in
            border = np.partition(near, len(near) - k)[len(near) - k]
            met = met[near >= border - 1e-9 * max(1.0, abs(border))]
        exact = (x[met] * qx[q]).sum(1)
        best = np.lexsort((ids[met], -exact))[:k]
        out.append((q, ids[met][best], exact[best]))
    return out


def search(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           trees: int = TREES, bits: int = BITS, share: float = SHARE, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `queries` holds for, its k nearest found.

    Nearness is the inner product in double precision, ties go to the smaller id, the query's own
    id is no candidate. Null ids and vectors that are null, zero, of another than the usual length
    (of equally usual ones the least) or hold null or non-finite parts take no part; repeated rows
    are candidates as often as they occur, and one query (that of the greatest vector, if they
    differ); an empty table gives no rows; further columns are ignored. Every shard is searched
    through its trees, however few rows it has.
    """
    kind = "f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "f8"
    raw = vectors.withColumn("__q", F.coalesce(queries, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>" if kind == "f4" else "array<double>").alias("vec"), "__q"
    ).where("id IS NOT NULL")
    dim = raw.where("size(vec) > 0").agg(F.mode(F.size("vec"), True)).first()[0] or 1
    rows = raw.where(_usable("vec", dim))
    n, asked = rows.agg(F.count("*"), F.count_if("__q")).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // query_rows))
    index = written(build(rows, dim, shards, trees, bits, kind), "forest")
    packed = written(pack_queries(rows.where("__q").groupBy("id").agg(F.max("vec").alias("vec")), blocks), "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, best = directions(dim, trees, bits), {}
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                x = np.frombuffer(r["x"], kind).reshape(len(ids), dim).astype(np.float64)
                codes, order = (np.frombuffer(r[c], np.int32).reshape(trees, len(ids)) for c in ("codes", "order"))
                qids = np.frombuffer(r["qids"], np.int64)
                qx = np.frombuffer(r["qx"], np.float64).reshape(len(qids), dim)
                # The best of the shards that this task has seen, for the queries that are here at once.
                mine = best.setdefault(r["block"], (qids, [None] * len(qids)))[1]
                for q, found, scores in shard_hits(x, ids, codes, order, qx, qids, hash_strings(qx, planes), k, share, bits):
                    if mine[q] is not None:
                        found, scores = np.concatenate((mine[q][0], found)), np.concatenate((mine[q][1], scores))
                        top = np.lexsort((found, -scores))[:k]
                        found, scores = found[top], scores[top]
                    mine[q] = found, scores
        for qids, mine in best.values():
            cols = np.repeat(qids, [len(f) for f, _ in mine]), *(np.concatenate([m[i] for m in mine]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

    # One after the other, as many packed rows as may be broadcast at once (8 bytes a number, and the id).
    per_wave, found = max(1, WAVE_BYTES // (query_rows * (8 * dim + 8))), None
    for w in range(-(-blocks // per_wave)):
        wave = F.broadcast(packed.where(F.col("block").between(w * per_wave, (w + 1) * per_wave - 1)))
        hits = index.crossJoin(wave).mapInArrow(run, "query_id long, vec_id long, score double")
        found = hits if found is None else found.union(hits)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
