import zlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import mixing as M
from tessera.llm import packing as P
from tests.conftest import same_as_sql

DOC = "doc_id long, text string"
ODD = [
    "Straße ÀÉ's İstanbul ΣΑΣ ​ x y 　 \x1c z", "<|endoftext|>foo", "don't I'LL we've 's'd 12,345 a_b\x0bq", "éa ́x", "日本語 テスト",
    "\x00\x01 a\x85b", "", None, "ſK Å", "ªº ²³ ½", "word " * 5000, "Ǆ ŉ", "end. mid,dle, 'tis", "\xad soft",
]


def holds(rows, packed, capacity=2048):
    tok = Tokenizer.from_file(P.default_tokenizer())
    expected = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for n, k in enumerate(range(0, len(ids), capacity)):
            part = ids[k : k + capacity]
            expected.append((i, n, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    found = packed.collect()
    assert sorted(expected, key=str) == sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=str)
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
    return len(by), sum(x[3] for x in expected)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n, total = holds([(r.doc_id, r.text) for r in docs.collect()], P.pack_documents(docs.withColumn("offset", F.lit(1))))
    assert n <= 1.02 * total / 2048 + 1


def test_odd_texts_and_edges(spark):
    rows = [*enumerate(ODD), (None, "a b"), (3, "dup"), (3, "dup")]
    holds(rows, P.pack_documents(spark.createDataFrame(rows, DOC)))
    assert P.pack_documents(spark.createDataFrame([], DOC)).count() == 0
    ids = P.pack_documents(spark.createDataFrame(rows, DOC), with_ids=True).collect()
    assert all(len(r.ids) == 4 * r.length for r in ids)


def test_other_tokenizers_are_not_cut_word_by_word(spark, tmp_path):
    """A tokenizer that splits or normalises in another way goes through itself, and gives its own ids."""
    import glob
    import json
    import os

    path = P.default_tokenizer()
    assert P.by_words(path)
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    rules["normalizer"] = None
    other = str(tmp_path / "other.json")
    with open(other, "w", encoding="utf-8") as f:
        json.dump(rules, f)
    found = [other, *[x for x in glob.glob(os.path.join(os.path.dirname(path), "*.json")) if x != path][:1]]
    for x in found:
        tok, ids = Tokenizer.from_file(x), P.tokenized(x)
        assert not P.by_words(x)
        for t in ODD:
            assert np.frombuffer(ids(t or ""), "<u4").tolist() == tok.encode(t or "", add_special_tokens=False).ids


@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plan_gives_every_document_a_place(counts):
    used, ranks = {}, {n: [] for n in counts}
    for length, rank, n, sequence, offset in P.best_fit_plan(counts, 30):
        for j in range(n):
            used.setdefault(sequence + j, []).append((offset, length))
            ranks[length].append(rank + j)
    assert all(sorted(ranks[n]) == list(range(c)) for n, c in counts.items())
    for s in used.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 30
    # Best-fit decreasing needs at most 11/9 of the best plus one, and no more than that of the volume bound here.
    assert len(used) <= 11 / 9 * max(-(-sum(n * c for n, c in counts.items()) // 30), sum(c for n, c in counts.items() if n > 15)) * 1.5 + 1


def test_mixing_equals_sql(spark, sf):
    same_as_sql(M.op6(spark, sf), M.OP6_SQL, sf)


def test_mixing_edges(spark):
    kind = "doc_id long, text string, source string, taken int"
    rows = [(1, "a b c", None, 0), (1, "a b c", None, 0), (None, None, "x", 0), (2, "", "x", 0), (3, "q w", "y", 0), (4, "z " * 50, "y", 0), (5, "v " * 90, "z", 0)]
    got = M.mix(spark.createDataFrame(rows, kind)).collect()
    by = {}
    for r in got:
        s = by.setdefault(r.source, [r.target, 0, r.source_size])
        s[1] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert len(got) == len(rows) and set(by) == {None, "x", "y", "z"}
    # In code-point order, null last: x weighs 5, y 2, z 1, null 5 again; x has no words and null stops at twice its size.
    assert by[None][0] == 12 and by["x"][:2] == [0, 0]
    assert abs(sum(t for t, _, _ in by.values()) - 1.5 * 148) < 1e-6 and all(t <= 2 * s for t, _, s in by.values())
    assert all(abs(t - k) <= 3 for t, k, _ in by.values())
    assert sorted(map(tuple, M.mix(spark.createDataFrame(rows, kind)).select("doc_id", "taken").collect()), key=str) == sorted(((r.doc_id, r.taken) for r in got), key=str)
    assert M.mix(spark.createDataFrame([], kind)).count() == 0


def test_repeated_rows_share_the_end_of_the_fraction(spark):
    """A hundred rows of one id come near their target together, and so do rows without ids."""
    for ids in ([7] * 100, [None] * 100, list(range(100))):
        rows = [(i, "word " * 4, "s") for i in ids] + [(1000 + i, "w " * 8, "t") for i in range(40)]
        got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        for source in "st":
            mine = [r for r in got if r.source == source]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.5 * 100 and all(r.taken <= 2 * r.size for r in mine)


def test_slices_are_even_for_any_keys(spark):
    """Texts without blanks have low weights and so large keys: no slice holds much more than its share."""
    rows = [(i, "x" * 4000, "s") for i in range(1500)] + [(5000 + i, "good words here ok", "s") for i in range(1500)]
    d = M.sized(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    n = [r["count"] for r in M.sliced(d).groupBy("slice").count().collect()]
    assert len(n) > 25 and max(n) < 3 * 3000 / len(n)
