"""SimHash and suffix-array dedup against brute force."""

import hashlib
import random

import numpy as np
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import simhash_bk as SH
from tessera.llm import suffix_dedup as SD

DOC = "doc_id long, text string"


def brute_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def brute_groups(values, linked):
    names = sorted(values)
    parent = {n: n for n in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if linked(values[a], values[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in names}


@given(st.lists(st.integers(0, 2**12 - 1), min_size=1, max_size=60), st.integers(0, 4), st.integers(0, 2**12 - 1))
def test_bk_tree_finds_all_within_the_radius(values, radius, query):
    tree = SH.BKTree()
    for v in values:
        tree.add(v)
    found = sorted(tree.values[i] for i in tree.within(query, radius))
    assert found == sorted({v for v in values if (v ^ query).bit_count() <= radius})


def test_shingle_hash_is_sparks(spark):
    d = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert int(SH.shingle_hashes("A b  c", 3).view(np.int64)[0]) == d


def test_near_groups(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in SH.near_groups(docs.withColumn("fp", F.lit(1))).collect()}
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    comp = brute_groups(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    assert got == {i: (fps[i], comp[i]) for i in fps}


def test_near_groups_of_close_values(spark):
    """Chains: neighbours two bits apart are one component, and so are bits on block borders."""
    values = [0, 3, 15, 15 | 1 << 63 | 1 << 31, 1 << 40 | 1 << 20 | 1 << 5, (1 << 64) - 1]
    d = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) * 2 for v in values], "id long, fp long")
    links = SH.hamming_links(d, 2).collect()
    comp = brute_groups({v: v for v in values}, lambda a, b: (a ^ b).bit_count() <= 2)
    mask = (1 << 64) - 1
    assert brute_groups({v: v for v in values}, lambda a, b: any({r.a & mask, r.b & mask} == {a, b} for r in links)) == comp


def test_near_groups_edges(spark):
    rows = [(5, None), (4, ""), (3, "  \n"), (None, "x y z"), (9, "X y  z"), (7, "one"), (7, "one"), (8, "w " * 30000), (6, "w " * 30001)]
    got = sorted(SH.near_groups(spark.createDataFrame(rows, DOC)).select("doc_id", "component_id").collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(5, 3), (4, 3), (3, 3), (None, 9), (9, 9), (7, 7), (7, 7), (8, 6), (6, 6)], key=str)
    assert SH.near_groups(spark.createDataFrame([], DOC)).count() == 0


def test_similar_groups(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {r.doc_id: frozenset(SH.shingle_hashes(r.text, 5).tolist()) for r in docs.collect()}
    comp = brute_groups(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    assert {r.doc_id: r.component_id for r in SH.similar_groups(docs).collect()} == comp
    rows = [(2, None), (1, ""), (None, "a b c d e f"), (3, "a b c d e f"), (4, "q"), (4, "q")]
    got = sorted(SH.similar_groups(spark.createDataFrame(rows, DOC)).collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(2, 1), (1, 1), (None, 3), (3, 3), (4, 4), (4, 4)], key=str)
    assert SH.similar_groups(spark.createDataFrame([], DOC)).count() == 0


def test_keys_of_similar_sets_are_as_good_as_said():
    """Of sets of similarity s one in 1 / (1 - s ** ROWS) ** BANDS pairs shares no key, also where an element is extreme under one hash."""
    rng = np.random.default_rng(12)
    lost, expected = 0, 0.0
    for i in range(6000):
        n = int(rng.integers(40, 300))
        k = max(1, n // 10)
        x = rng.integers(0, 2**64, n + k, dtype=np.uint64)
        s = (n - k) / (n + k)
        lost += not (SH.band_keys(x[:n]) == SH.band_keys(x[k:])).any()
        expected += (1 - s**SH.ROWS) ** SH.BANDS
    assert expected < 1 and lost <= 2
    text = rng.integers(0, 2**64, 400, dtype=np.uint64)
    text[0] = pow(0x9E3779B97F4A7C15, -1, 2**64)  # 1 under that multiplication, and the least under all its small multiples
    assert (SH.band_keys(text) == SH.band_keys(text[1:])).sum() >= SH.BANDS - 4


def test_similar_groups_of_repeated_and_distant_texts(spark):
    """Repeats do not part a text from the one without them; no distance of fingerprints parts what is similar."""
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(10**6)) for _ in range(n))
    rows = []
    for i in range(40):
        line = text(14)
        rest = text(94)
        rows += [(2 * i, f"{rest} {line}"), (2 * i + 1, f"{rest} {line} " + " ".join([line] * 49))]
    sets = {i: frozenset(SH.shingle_hashes(t, 5).tolist()) for i, t in rows}
    linked = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    comp = brute_groups(sets, linked)
    assert {r.doc_id: r.component_id for r in SH.similar_groups(spark.createDataFrame(rows, DOC)).collect()} == comp
    assert set(comp.values()) == set(range(0, 80, 2))
    # In a block the fingerprints decide nothing: here all differ in every bit or half of them.
    sets = {i: set(rng.sample(range(60 * (i // 5), 60 * (i // 5) + 60), rng.randint(48, 60))) for i in range(60)}
    fps = [(-1 if i & 1 else 0) ^ (0xFFFFFFFF * (i >> 1 & 1)) for i in range(60)]
    block = [(i, fp, i, np.array(sorted(s), np.uint32).tobytes()) for (i, s), fp in zip(sets.items(), fps)]
    edges = SH.similar_in_block(block, block, 18, 0.8)
    assert brute_groups({i: i for i in sets}, lambda a, b: (a, b) in edges or (b, a) in edges) == brute_groups(sets, linked)


def test_large_shards_are_searched_by_parts(spark):
    """Small parts, and no broadcast: the same components."""
    rng = random.Random(5)
    values = list({rng.getrandbits(6) << rng.randrange(58) ^ 0xABCDEF0123456789 for _ in range(400)})
    d = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) * 2 for v in values], "id long, fp long")
    mask = (1 << 64) - 1
    comp = brute_groups({v: v for v in values}, lambda a, b: (a ^ b).bit_count() <= 2)
    for how in ({"part": 7}, {"part": 7, "broadcast_bytes": 0}, {}):
        links = {frozenset((r.a & mask, r.b & mask)) for r in SH.hamming_links(d, 2, **how).collect()}
        assert brute_groups({v: v for v in values}, lambda a, b: frozenset((a, b)) in links) == comp


def test_blocks_after_stars(spark):
    """A large group of near copies whose members are not all alike the first, and a passage in unlike texts, in small blocks."""
    from tessera.llm import linking as LK

    rng = random.Random(11)
    sets, at = {}, 0
    for chain in range(3):
        base = list(range(1000 * chain, 1000 * chain + 100))
        for step in range(40):
            base[rng.randrange(100)] = 10**6 + at
            base[rng.randrange(100)] = 2 * 10**6 + at
            sets[at] = frozenset(base)
            at += 1
    ids = list(sets)
    posts = spark.createDataFrame([(0, 7, i, 0, i) for i in ids], "j int, key long, row long, at long, grp long")
    payloads = spark.createDataFrame([(i, bytearray(np.array(sorted(sets[i]), np.uint32).tobytes())) for i in ids], "row long, payload binary")
    alike, in_block = SH.similar, SH.similar_in_block
    fits = lambda x, y, _: alike(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), 0.8)
    first = LK.star_links(LK.leader_pairs(posts), payloads, fits, chunk=16)
    comp = SH.components(first).checkpoint()
    split = LK.with_groups(posts, comp)
    more = LK.block_links(split, payloads, lambda q, t: in_block(q, t, 18, 0.8), chunk=16)
    links = {frozenset((r.a, r.b)) for r in first.union(more).collect()}
    assert brute_groups({i: i for i in ids}, lambda a, b: frozenset((a, b)) in links) == brute_groups(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))


def brute_removal(rows, size=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - size + 1):
            first[b[k : k + size]] = min(first.get(b[k : k + size], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        c = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if first[b[k : k + size]] < i:
                c[k : k + size] = b"\1" * size
        spans = sum(1 for k in range(len(b)) if c[k] and (k == 0 or not c[k - 1]))
        out.append((i, len(b), sum(c), spans, hashlib.sha256(bytes(x for x, m in zip(b, c) if not m)).hexdigest()))
    return sorted(out, key=str)


def removal(df, **how):
    d = SD.remove_repeats(df, **how)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x.end - x.start)
    return sorted((tuple(r) for r in d.select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256)).collect()), key=str)


def test_removal_of_repeats(spark, sf):
    rng = random.Random(1)
    base = ["".join(rng.choice("abé \n\0") for _ in range(rng.randint(0, 300))) for _ in range(20)]
    rows = {}
    for i in range(250):
        kind = rng.random()
        text = None if kind < 0.1 else "a" * rng.randint(0, 200) if kind < 0.2 else "ab" * rng.randint(0, 100) if kind < 0.3 else "".join(
            rng.choice(base)[rng.randint(0, 100) :][: rng.randint(10, 300)] for _ in range(rng.randint(1, 4))
        )
        rows[rng.randint(0, 10**5)] = text
    rows = list(rows.items())
    assert removal(spark.createDataFrame(rows, DOC).repartition(3).withColumn("kept", F.lit(1)), block_bytes=4000) == brute_removal(rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    whole = brute_removal([tuple(r) for r in docs.collect()])
    assert removal(docs, block_bytes=100000) == whole
    # Blocks smaller than a document; minimisers that two blocks have are dealt on by a second one.
    assert removal(docs, block_bytes=20000, hot_blocks=2) == whole


def test_other_columns_come_along(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text", F.struct("source", "lang", F.col("doc_id").alias("kept")).alias("rest")).repartition(3)
    got = {r.doc_id: (r.kept, r.rest) for r in SD.remove_repeats(rows, block_bytes=50000).collect()}
    plain = {r.doc_id: r.kept for r in SD.remove_repeats(docs).collect()}
    assert {r.doc_id: (plain[r.doc_id], (r.source, r.lang, r.doc_id)) for r in docs.collect()} == {i: (k, tuple(x)) for i, (k, x) in got.items()}


def test_removal_edges(spark):
    long = "x y " * 40
    rows = [(3, long), (3, long), (7, long), (1, None), (2, ""), (None, long), (None, long), (9, "é" * 24 + "a"), (10, "é" * 24 + "a"), (11, "é" * 25)]
    got = [r[:4] for r in removal(spark.createDataFrame(rows, DOC))]
    n = len(long)
    assert got == sorted([(3, n, 0, 0), (3, n, 0, 0), (7, n, n, 1), (1, 0, 0, 0), (2, 0, 0, 0), (None, n, n, 1), (None, n, n, 1), (9, 49, 0, 0), (10, 49, 0, 0), (11, 50, 0, 0)], key=str)
    assert removal(spark.createDataFrame([], DOC)) == []


@given(st.lists(st.text("ab", max_size=40), min_size=1, max_size=8))
def test_intervals_of_equal_strings(texts):
    texts = list(dict.fromkeys(t.encode() for t in texts if len(t) >= 6)) or [b"aaaaaaaa"]
    least = np.arange(len(texts))[::-1].astype(np.int64)
    got = SD.least_by_string(texts, least, 6)
    for t, g in zip(texts, got):
        assert g.tolist() == [min(d for u, d in zip(texts, least) if t[i : i + 6] in u) for i in range(len(t) - 5)]
