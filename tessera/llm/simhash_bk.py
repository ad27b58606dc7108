"""SimHash near-dedup with BK-trees.

Fingerprints of word shingles are collapsed to distinct values and dealt into shards that share
bit blocks (pigeonhole: values within `radius` bits agree in at least two of radius + 2 blocks).
Each shard of two values or more has a BK-tree (a large one several, of bounded size): children
are keyed by their integer Hamming distance to the parent, and a search follows only edges within
the radius. The trees are broadcast to the shards' values as long as all of them together are
small, which is looked up before; beyond that they are joined by shard and part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linking import Joined, block_links, edges_batch, leader_pairs, star_links, with_groups
from .shared import components, let_go, scratch, small, table, written

SEED = 42
SLAB = 1 << 15
#: Values of one tree, about; and how large all trees together may be to be broadcast.
TREE_VALUES, BROADCAST_BYTES = 4096, 32 << 20
#: Min-hashes of a key, and keys of a document: of two with similarity 0.8, 4 in 100,000 share none.
ROWS, BANDS = 3, 14


class BKTree:
    """Integers under Hamming distance; children keyed by their distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The node of value, put in if new."""
        at = 0 if self.values else -1
        while at >= 0:
            d = (self.values[at] ^ value).bit_count()
            if not d:
                return at
            below = self.children[at].get(d, -1)
            if below < 0:
                self.children[at][d] = len(self.values)
            at = below
        self.values.append(value)
        self.children.append({})
        return len(self.values) - 1

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at most radius away."""
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            kids = self.children[at]
            if kids:
                stack += [kids[k] for k in range(max(1, d - radius), d + radius + 1) if k in kids]
        return found


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle of the lower-cased (A-Z) text, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())],
        np.uint64,
    )


def simhash(h: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of h; 0 for none."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for s in range(0, len(h), SLAB):
        part = h[s : s + SLAB]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each row's whole text, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(shingle_hashes(t.as_py(), k)) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, fp long"
    )


def shard_keys(fp: str, radius: int) -> F.Column:
    """Array of keys, one for each pair of radius + 2 bit blocks: their places and their bits."""
    n = radius + 2
    cuts = [64 * i // n for i in range(n + 1)]
    block = [
        F.shiftrightunsigned(F.col(fp), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts, cuts[1:])
    ]
    return F.array(
        *[
            F.struct(F.lit(c).alias("c"), block[i].alias("x"), block[j].alias("y"))
            for c, (i, j) in enumerate(combinations(range(n), 2))
        ]
    )


def packed_tree(tree: BKTree) -> tuple[bytes, bytes]:
    """Each node's parent (-1: none) and distance to it, in the order of the nodes; a parent comes before its children."""
    parent, edge = np.full(len(tree.values), -1, np.int32), np.zeros(len(tree.values), np.uint8)
    for at, kids in enumerate(tree.children):
        for d, kid in kids.items():
            parent[kid], edge[kid] = at, d
    return parent.tobytes(), edge.tobytes()


def opened_tree(values: list[int], parent: bytes, edge: bytes) -> BKTree:
    tree = BKTree()
    tree.values, tree.children = values, [{} for _ in values]
    for kid, (at, d) in enumerate(zip(np.frombuffer(parent, np.int32).tolist(), np.frombuffer(edge, np.uint8).tolist())):
        if at >= 0:
            tree.children[at][d] = kid
    return tree


def tree_links(values: list[int], ids: list[int], tree: BKTree, tree_ids: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges that join each value with all of the tree's within radius: a forest, not all pairs."""
    joined, edges = Joined(), []
    for v, i in zip(values, ids):
        edges += [(i, tree_ids[node]) for node in tree.within(v, radius) if joined.join(i, tree_ids[node])]
    return edges


def unsigned(values) -> list[int]:
    return np.array(values, np.int64).view(np.uint64).tolist()


def hamming_links(values: DataFrame, radius: int, part: int = TREE_VALUES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Edges (a, b) between the ids of distinct fingerprints (id, fp) that connect all within radius."""
    keyed = values.select("id", "fp", F.explode(shard_keys("fp", radius)).alias("k")).select("k.c", "k.x", "k.y", "fp", "id")
    key = ["c", "x", "y"]
    shared = keyed.groupBy(*key).agg(F.ceil(F.count("*") / part).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1").drop("n")
    dealt = keyed.join(shared, key).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    packed = dealt.groupBy(*key, "part", "parts").agg(F.sort_array(F.collect_list(F.struct("fp", "id"))).alias("m"))  # about `part` values

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for fps in b.column(5).to_pylist():
                tree = BKTree()
                for v in unsigned(fps):
                    tree.add(v)
                made.append(packed_tree(tree))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([m[i] for m in made], pa.binary()) for i in (0, 1))], [*names, "parent", "edge"])

    names = [*key, "part", "parts", "fps", "ids"]
    trees = written(
        packed.select(*key, "part", "parts", F.col("m.fp").alias("fps"), F.col("m.id").alias("ids")).mapInArrow(
            build, "c int, x long, y long, part int, parts int, fps array<long>, ids array<long>, parent binary, edge binary"
        ),
        "trees",
    )
    # Each part of a shard is searched in the shard's trees, those before it and its own.
    asking = trees.select(*key, F.col("part").alias("mine"), F.col("fps").alias("q"), F.col("ids").alias("qi"))
    size = trees.agg(F.sum(F.size("fps") * 21 + 100)).first()[0] or 0
    if size <= broadcast_bytes:
        meetings = asking.join(F.broadcast(trees), key).where("mine >= part")
    else:
        spread = trees.withColumn("mine", F.explode(F.expr("sequence(part, parts - 1)")))
        meetings = asking.join(spread, [*key, "mine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int]] = []
            for q, qi, fps, ids, parent, edge in zip(*(c.to_pylist() for c in b.columns)):
                out += tree_links(unsigned(q), qi, opened_tree(unsigned(fps), parent, edge), ids, radius)
            yield edges_batch(out)

    return meetings.select("q", "qi", "fps", "ids", "parent", "edge").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, k: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row: documents linked at radius or fewer differing bits.

    Null and empty texts have fingerprint 0 and link like any other; repeated rows come back as
    often as they came; null ids are returned and are never a component's least id unless alone;
    an empty table gives an empty result; further columns are ignored. Equal fingerprints are
    collapsed before the search, so a group of copies costs one entry.
    """
    fps = written(fingerprints(docs, k, id_col, text_col), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    # Values are named by themselves: an id may be null or occur with two texts.
    links = hamming_links(distinct.select(F.col("fp").alias("id"), "fp"), radius)
    comp = components(links)
    labelled = distinct.join(comp, distinct.fp == comp.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("group")
    )
    least = labelled.groupBy("group").agg(F.min("least").alias("component_id"))
    of_fp = labelled.join(least, "group").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def op9(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def multipliers(n: int) -> np.ndarray:
    """n odd numbers without anything in common (as SplitMix64 gives them)."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


def band_keys(h: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Keys of a set of shingle hashes: each mixes `rows` min-hashes, the least under as many hashes.

    A multiplication alone is no hash here: what is near zero under one is near it under its
    multiples too, so one shingle would be the least of many, and all keys would hang on it.
    """
    if not len(h):
        return np.zeros(bands, np.int64)
    by, least = multipliers(bands * rows)[:, None], np.full(bands * rows, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for s in range(0, len(h), 512):
        x = h[s : s + 512] * by
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, x.min(1), out=least)
    out = np.zeros(bands, np.uint64)
    for r in range(rows):
        out = (out ^ least[r::rows]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def signatures(rows: DataFrame, k: int) -> DataFrame:
    """(row, doc_id, digest, fp, keys) of (row, doc_id, text): digest of the shingle sequence; SimHash and keys of the set of k-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            digests, fps, keys = [], [], []
            for t in b.column(2):
                h = shingle_hashes(t.as_py(), k)
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                h = np.unique(h)  # repeats do not count in the similarity
                fps.append(simhash(h))
                keys.append(band_keys(h))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(digests), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                ["row", "doc_id", "digest", "fp", "keys"],
            )

    return rows.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, digest binary, fp long, keys array<long>")


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets reach a Jaccard similarity."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def shared_counts(sets: list[np.ndarray]):
    """A function of a set: how many shingles it shares with each of the sets."""
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])[order]

    def counts(mine: np.ndarray) -> np.ndarray:
        out = np.zeros(len(sets), np.int64)
        for s in range(0, len(mine), 4096):
            part = mine[s : s + 4096]
            lo = np.searchsorted(flat, part, "left")
            width = np.searchsorted(flat, part, "right") - lo
            at = np.repeat(lo - np.cumsum(width) + width, width) + np.arange(width.sum())
            out += np.bincount(owner[at], minlength=len(sets))
        return out

    return counts


def similar_in_block(asking: list[tuple], asked: list[tuple], radius: int, similarity: float) -> list[tuple[int, int]]:
    """Edges that join each of `asking` with all of `asked` whose shingle sets are similar enough.

    Both hold (row, fp, grp, shingles). Neighbours in the BK-tree within radius come first, since
    they are most often similar; what is not joined after them is compared exactly as well,
    whatever the distance of the fingerprints.
    """
    sets = [np.frombuffer(r[3], np.uint32) for r in asked]
    sizes, rows, counts = np.array([len(x) for x in sets]), [r[0] for r in asked], None
    joined, edges, tree, held = Joined(), [], BKTree(), []
    for r in [*asking, *asked]:
        joined.join(r[0], r[2])
    for at, v in enumerate(unsigned([r[1] for r in asked])):
        if tree.add(v) == len(held):
            held.append([])
        held[tree.add(v)].append(at)

    def link(i: int, at: int) -> None:
        if joined.join(i, rows[at]):
            edges.append((i, rows[at]))

    for (i, _, _, raw), v in zip(asking, unsigned([r[1] for r in asking])):
        mine = np.frombuffer(raw, np.uint32)
        for node in tree.within(v, radius):
            for at in held[node]:
                if joined.root(i) != joined.root(rows[at]) and similar(mine, sets[at], similarity):
                    link(i, at)
        root = joined.root(i)
        rest = np.array([joined.root(x) != root for x in rows]) & (np.minimum(sizes, len(mine)) >= similarity * np.maximum(sizes, len(mine)))
        if rest.any():
            counts = counts or shared_counts(sets)
            both = counts(mine)
            for at in np.flatnonzero(rest & (both >= similarity * (len(mine) + sizes - both))).tolist():
                link(i, at)
    return edges


def told_apart(docs: DataFrame, row_col: str = "row", id_col: str = "doc_id") -> DataFrame:
    """docs with a number for each row: its id, or where ids are null or used again, the row's place in the
    order of ids, null ids last (written, as it is made once)."""
    used = docs.groupBy(id_col).agg(F.count("*").alias("n"))
    if used.where(F.col(id_col).isNull() | (F.col("n") > 1)).isEmpty():
        return docs.withColumn(row_col, F.col(id_col).cast("long"))
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    order = rows.select(id_col, "__row").orderBy(F.col(id_col).asc_nulls_last(), "__row").select("__row", F.monotonically_increasing_id().alias(row_col))
    return rows.join(written(order, "order"), "__row").drop("__row")


def similar_entries(rows: DataFrame, k: int, similarity: float, radius: int) -> tuple[DataFrame, DataFrame]:
    """For (row, doc_id, text), row numbering them: (row, doc_id, digest) of each, and (digest, group, first) of each digest.

    first (nameless, id, row) is the first of a digest's rows: by id, null ids last, then by row.
    """
    found = written(signatures(rows, k), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), "row")
    entries = written(
        found.groupBy("digest").agg(F.min(first).alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys")),
        "entries",
    ).withColumn("row", F.col("first.row"))
    every = entries.select("row", "fp", F.posexplode("keys").alias("j", "key"))
    several = written(every.groupBy("j", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "shared-keys")
    # at: the fingerprint, which the blocks' trees take.
    posts = written(every.join(small(several, 12), ["j", "key"]).select("j", "key", "row", F.col("fp").alias("at")), "posts")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            s = [np.unique(shingle_hashes(t.as_py(), k).astype(np.uint32)).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.binary())], ["row", "payload"])

    def payloads(needed: DataFrame) -> DataFrame:
        return rows.select("row", "text").join(small(needed.distinct(), 8), "row", "left_semi").mapInArrow(sets, "row long, payload binary")

    def fits(x: bytes, y: bytes, _: int) -> bool:
        return similar(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), similarity)

    comp, links = None, None
    for bands in ("j = 0", "j > 0"):  # most of what is alike shares the first key: the others see what it left
        pairs = leader_pairs(with_groups(posts, comp).where(bands)).select("a", "b", F.lit(0).cast("long").alias("off")).distinct()
        pairs = written(pairs, "pairs")
        new = written(star_links(pairs, payloads(pairs.select(F.col("a").alias("row")).union(pairs.select("b"))), fits), "links")
        links = new if links is None else links.union(new)
        comp = written(components(links), "groups")
    split = written(with_groups(posts, comp), "posts")
    kinds = split.groupBy("j", "key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count("*").alias("n")).where("lo <> hi AND n > 2").select("j", "key")
    needed = written(split.join(small(written(kinds, "kinds"), 12), ["j", "key"], "left_semi"), "open")
    if not needed.isEmpty():
        more = block_links(needed, payloads(needed.select("row")), lambda q, t: similar_in_block(q, t, radius, similarity))
        comp = written(components(links.union(written(more, "links"))), "groups")
    named = entries.join(comp, entries["row"] == comp.node, "left").select("digest", F.coalesce("component", "row").alias("group"), "first")
    return found.select("row", "doc_id", "digest"), named


def similar_groups(
    docs: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = 18, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, component_id) for each row: documents linked by the Jaccard similarity of their k-word shingles.

    Equal shingle sequences are one entry. Documents meet by BANDS keys of ROWS min-hashes each,
    and a pair is linked if the exact similarity of its shingle sets reaches the threshold: each
    is tested against the first of every key that it shares, and where groups are left apart all
    of a key are, by blocks, neighbours in the block's BK-tree of SimHashes (within `radius`)
    first. So the keys alone can lose a link: documents of similarity s share none with a chance
    of (1 - s ** ROWS) ** BANDS, 0.004 % at 0.8, less the closer they are.
    component_id is a group's least id. Null and empty texts are equal to one another; rows with
    null ids are searched like others, come back null and name no group (it is null if it has no
    other id); rows with equal ids are judged each by its own text, and repeated rows come back as
    often as they came; an empty table gives no rows; further columns, whatever their names, are ignored.
    """
    rows = told_apart(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    with scratch() as made:
        found, named = similar_entries(rows, k, similarity, radius)
        named = written(named, "named")
        least = named.groupBy("group").agg(F.min("first.id").alias("component_id"))
        of_digest = named.select("digest", "group").join(least, "group").select("digest", "component_id")
        out = made.keep(written(found.join(of_digest, "digest", "left").select("doc_id", "component_id"), "similar"))
    return out


def later_of_groups(
    docs: DataFrame, row_col: str, k: int = 5, similarity: float = 0.8, radius: int = 18, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(row_col) of all rows of similar_groups but one of each group: that with the least id, null ids last, stays.

    row_col numbers the rows (see told_apart), so rows with null or equal ids are told apart.
    """
    rows = docs.select(F.col(row_col).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with scratch() as made:
        found, named = similar_entries(rows, k, similarity, radius)
        named = written(named, "named")
        stays = named.groupBy("group").agg(F.min("first").alias("first")).select("group", F.col("first.row").alias("stays"))
        of_digest = named.select("digest", "group").join(stays, "group").select("digest", "stays")
        out = found.join(of_digest, "digest").where("row <> stays").select(F.col("row").alias(row_col))
        out = made.keep(written(out, "later"))
    return out
