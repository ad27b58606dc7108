"""Suffix-array dedup: bytes covered by strings that also start in an earlier document.

Texts are packed once into blocks (a table bucketed by block, so that later joins leave the text
where it is). A string of `min_bytes` bytes can repeat only under the same minimiser (the least
hash of the q-grams in it), so the work is dealt by minimiser:

1. each block sends its distinct minimiser hashes, packed, to a hash bucket; the bucket answers
   with one bit for each: whether another document has it too;
2. each block sends the text around the repeated ones, equal pieces once, to their buckets;
   a bucket sorts the suffixes of what it got, and on the Burrows-Wheeler transform derives the
   common prefixes level by level by backward extension, stopping at `min_bytes`: what is then
   still undecided lies inside intervals of equal strings. The least document of each interval
   decides, and one bit for each string goes back to the block;
3. each block marks, covers and cuts.

What moves are packed arrays: a third of a byte for each byte of text, and the repeated text. A
block sends one row to each bucket that it has something for, so there are never more rows than
hashes. A minimiser that many blocks have (a very common line, set in unlike text) is dealt on:
its strings go by a second minimiser too, so its pieces spread over buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import bucketed, let_go, table, written

BLOCK_BYTES = 8 << 20
#: Bytes of text whose minimisers go to one bucket.
BUCKET_BYTES = 16 << 20
#: Suffixes sorted at a time; the pieces of one hash stay together.
SORTED_AT_A_TIME = 1 << 20
#: From so many blocks on that have it, a minimiser is dealt on by a second one.
HOT_BLOCKS = 32
QGRAM = 20
MULTIPLIER = 0x9E3779B97F4A7C15
LAST_ID = np.iinfo(np.int64).max


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.full(n, base, np.uint64))
        down = np.multiply.accumulate(np.full(n, inverse, np.uint64))
    return up, down


POWERS: list[np.ndarray] = []


def qgram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A well mixed hash of the q bytes from each place on: a rolling sum with inverse powers."""
    n = len(data)
    if n < q:
        return np.empty(0, np.uint64)
    step = 1 << 16
    if not POWERS:
        POWERS.extend(_powers(step + 4096))
    up, down = POWERS
    out = np.empty(n - q + 1, np.uint64)
    for s in range(0, len(out), step):  # in slabs that stay in cache
        e = min(s + step, len(out))
        part = data[s : e + q - 1].astype(np.uint64)
        part += np.uint64(1)
        part *= up[: len(part)]
        sums = np.cumsum(part)
        h = sums[q - 1 :].copy()
        h[1:] -= sums[: len(h) - 1]
        h *= down[: len(h)]
        h ^= h >> np.uint64(32)
        h *= np.uint64(MULTIPLIER)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        out[s:e] = h
    return out


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h


def runs(data: np.ndarray, lens: np.ndarray, size: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring strings of `size` bytes with one minimiser: start, count, hash, document."""
    empty = np.empty(0, np.int64)
    if len(data) < size:
        return empty, empty, np.empty(0, np.uint64), empty
    m = sliding_min(qgram_hashes(data, q), size - q + 1)
    ends = np.cumsum(lens)
    change = np.concatenate(([True], m[1:] != m[:-1]))
    # Strings that would cross the end of a document belong to no run.
    first = ends - lens
    change[first[first < len(m)]] = True
    dead = np.maximum(ends - size + 1, first)
    change[dead[dead < len(m)]] = True
    start = np.flatnonzero(change)
    count = np.diff(np.append(start, len(m)))
    doc = np.searchsorted(ends, start, side="right")
    alive = start + size <= ends[doc]
    return start[alive], count[alive], m[start[alive]], doc[alive]


def place(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of a hash and what names it there (the least hashes are small: mixed once more)."""
    with np.errstate(over="ignore"):
        x = h * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return ((x >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64), x.astype(np.uint32)


def pack_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """(block, bytes, ids, nulls, lens, data, rest): whole documents, about block_bytes to a row.

    rest holds the documents' other columns (struct column `rest`, if docs has one) as an Arrow stream.
    """
    others = ["rest"] if "rest" in docs.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        task, n = TaskContext.get().partitionId(), 0

        def emit(ids: list, texts: list[bytes], rest: list[pa.RecordBatch]) -> pa.RecordBatch:
            nulls = np.array([i is None for i in ids], np.bool_)
            stream = pa.BufferOutputStream()
            for x in rest[:1]:
                with pa.ipc.new_stream(stream, x.schema) as out:
                    for y in rest:
                        out.write_batch(y)
            row = [
                (task << 32) + n,
                held,
                np.array([LAST_ID if i is None else i for i in ids], np.int64).tobytes(),
                nulls.tobytes(),
                np.array([len(t) for t in texts], np.int64).tobytes(),
                b"".join(texts),
                stream.getvalue().to_pybytes(),
            ]
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in zip(row, kinds)], ["block", "bytes", "ids", "nulls", "lens", "data", "rest"]
            )

        ids: list = []
        texts: list[bytes] = []
        rest: list[pa.RecordBatch] = []
        held = 0
        for b in batches:
            since = 0
            for at, (i, t) in enumerate(zip(b.column(0), b.column(1).cast(pa.binary())), 1):
                i, t = i.as_py(), t.as_py() or b""
                ids.append(i)
                texts.append(t)
                held += len(t)
                if held >= block_bytes:
                    yield emit(ids, texts, [*rest, *[b.select(others).slice(since, at - since)] * len(others)])
                    ids, texts, rest, held, n, since = [], [], [], 0, n + 1, at
            if others and since < b.num_rows:
                rest.append(b.select(others).slice(since))
        if ids:
            yield emit(ids, texts, rest)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *others).mapInArrow(
        run, "block long, bytes long, ids binary, nulls binary, lens binary, data binary, rest binary"
    )


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (
        np.frombuffer(row["data"], np.uint8),
        np.frombuffer(row["lens"], np.int64),
        np.frombuffer(row["ids"], np.int64),
    )


def distinct_hashes(h: np.ndarray, ids: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """The distinct (bucket, name) of h in order, whether two documents have it, and the place of each h."""
    b, name = place(h, buckets)
    key = (b.astype(np.uint64) << np.uint64(32)) | name
    order = np.argsort(key, kind="stable")
    k, d = key[order], ids[order]
    new = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.empty(0, bool)
    at = np.flatnonzero(new)
    many = np.maximum.reduceat(d, at) != np.minimum.reduceat(d, at) if len(at) else np.empty(0, bool)
    where = np.empty(len(h), np.int64)
    where[order] = np.cumsum(new) - 1
    return k[at], many, where


def buckets_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted keys: their buckets, the distinct buckets, and where each begins (and the end)."""
    b = (key >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.empty(0, np.int64)
    return b, b[at], np.append(at, len(b))


def send_hashes(rows: Iterator[pa.RecordBatch], size: int, q: int, buckets: int) -> Iterator[pa.RecordBatch]:
    let_go()
    for batch in rows:
        for row in batch.to_pylist():
            data, lens, ids = _opened(row)
            _, _, h, doc = runs(data, lens, size, q)
            key, many, _ = distinct_hashes(h, ids[doc], buckets)
            _, full, cut = buckets_of(key)
            name, spans = key.astype(np.uint32), list(zip(cut[:-1], cut[1:]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(full), row["block"], np.int64)),
                    pa.array(full.astype(np.int32)),
                    pa.array([name[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([np.packbits(many[a:b]).tobytes() for a, b in spans], pa.binary()),
                ],
                ["block", "bucket", "names", "many"],
            )


def answer_hashes(rows: pd.DataFrame, hot: int = HOT_BLOCKS) -> pd.DataFrame:
    """Two bits for each name that a block sent: whether another document has it too, and whether `hot` blocks have it."""
    names = [np.frombuffer(x, np.uint32) for x in rows["names"]]
    many = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(n)).astype(bool) for x, n in zip(rows["many"], names)]
    every = np.concatenate(names)
    order = np.argsort(every, kind="stable")
    s = every[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(s)))
    held = (times > 1) | np.logical_or.reduceat(np.concatenate(many)[order], at)
    bits, often = np.empty(len(s), bool), np.empty(len(s), bool)
    bits[order] = held[np.cumsum(new) - 1]
    often[order] = (times >= hot)[np.cumsum(new) - 1]
    cuts = np.cumsum([0] + [len(n) for n in names])
    return pd.DataFrame(
        {
            "block": rows["block"],
            "bucket": rows["bucket"],
            "bits": [np.packbits(bits[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])],
            "hot": [np.packbits(often[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])],
        }
    )


def _answered(row: dict, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct hash of a block, the bits that its bucket answered: repeated, hot."""
    b, _, _ = buckets_of(key)
    out = np.zeros((2, len(key)), bool)
    for x in row["answers"] or ():
        lo, hi = np.searchsorted(b, x["bucket"], "left"), np.searchsorted(b, x["bucket"], "right")
        for i, name in enumerate(("bits", "hot")):
            out[i, lo:hi] = np.unpackbits(np.frombuffer(x[name], np.uint8), count=hi - lo)
    return out[0], out[1]


def split_runs(data: np.ndarray, start: np.ndarray, count: np.ndarray, h: np.ndarray, doc: np.ndarray, size: int, q: int) -> tuple:
    """Runs cut where the second minimiser of their strings changes; the hash is then of both."""
    with np.errstate(over="ignore"):
        second = sliding_min(qgram_hashes(data, q) * np.uint64(0xA0761D6478BD642F), size - q + 1)
    owner = np.repeat(np.arange(len(start)), count)
    at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
    v = second[at]
    new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (v[1:] != v[:-1]))))
    mixed = (h[owner[new]] ^ (v[new] >> np.uint64(17))) * np.uint64(MULTIPLIER)
    return at[new], np.diff(np.append(new, len(at))), mixed ^ (mixed >> np.uint64(32)), doc[owner[new]]


def pieces(row: dict, size: int, q: int, buckets: int) -> tuple:
    """The repeated runs of a block, and their distinct pieces of text in the order of bucket and name."""
    data, lens, ids = _opened(row)
    found_runs = runs(data, lens, size, q)
    key, _, where = distinct_hashes(found_runs[2], ids[found_runs[3]], buckets)
    repeated, hot = (bits[where] for bits in _answered(row, key))
    plain, often = ([x[m] for x in found_runs] for m in (repeated & ~hot, repeated & hot))
    if len(often[0]):
        plain = [np.concatenate(x) for x in zip(plain, split_runs(data, *often, size, q))]
    b, name = place(plain[2], buckets)
    key = (b.astype(np.uint64) << np.uint64(32)) | name
    order = np.argsort(key, kind="stable")
    start, count, _, doc = (x[order] for x in plain)
    key = key[order]
    raw = row["data"]
    found: dict[bytes, int] = {}
    of_run = np.fromiter(
        (found.setdefault(raw[s : s + c + size - 1], len(found)) for s, c in zip(start.tolist(), count.tolist())),
        np.int64,
        len(start),
    )
    texts = list(found)
    least = np.full(len(texts), LAST_ID, np.int64)
    np.minimum.at(least, of_run, ids[doc])
    of_piece = np.zeros(len(texts), np.uint64)
    of_piece[of_run] = key
    return start, count, doc, of_run, texts, least, of_piece, lens, ids


def send_pieces(rows: Iterator[pa.RecordBatch], size: int, q: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for row in batch.to_pylist():
            *_, texts, least, key, _, _ = pieces(row, size, q, buckets)
            _, full, cut = buckets_of(key)
            sizes = np.array([len(t) for t in texts], np.uint32)
            name = key.astype(np.uint32)
            spans = [slice(a, b) for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(full), row["block"], np.int64)),
                    pa.array(full.astype(np.int32)),
                    pa.array([name[s].tobytes() for s in spans], pa.binary()),
                    pa.array([sizes[s].tobytes() for s in spans], pa.binary()),
                    pa.array([least[s].tobytes() for s in spans], pa.binary()),
                    pa.array([b"".join(texts[s]) for s in spans], pa.binary()),
                ],
                ["block", "bucket", "names", "sizes", "least", "data"],
            )


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` symbols or more (9 bits a symbol, prefix doubling)."""
    n = len(symbols)
    padded = np.concatenate((symbols.astype(np.uint64), np.zeros(7, np.uint64)))
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key = (key << np.uint64(9)) | padded[i : i + n]
    have = 7
    while True:
        order = np.argsort(key)
        if have >= depth:
            return order
        s = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.concatenate(([True], s[1:] != s[:-1])), dtype=np.uint64)
        later = np.zeros(n, np.uint64)
        if have < n:
            later[: n - have] = rank[have:]
        key = (rank << np.uint64(32)) | later
        have *= 2


def equal_intervals(symbols: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and where in it an interval of suffixes with `size` equal symbols begins.

    Backward extension on the Burrows-Wheeler transform: row j = LF(i) begins with the symbol
    before row i, and the row before j comes from the last row before i with the same symbol;
    so the common prefix of rows j - 1 and j is one more than the least between those two rows.
    Rows are taken breadth first, by increasing common prefix, until `size`; what is left then
    shares `size` symbols or more with the row before it.
    """
    n = len(symbols)
    order = suffix_order(symbols, size + 1)
    bwt = symbols[order - 1]
    source = np.argsort(bwt, kind="stable").astype(np.int32)  # source[j] is the row i with LF(i) = j
    first = bwt[source]
    known = np.concatenate(([True], first[1:] != first[:-1]))
    todo = np.flatnonzero(~known)
    lo, hi = source[todo - 1], source[todo]
    for level in range(1, size):
        if not len(todo):
            break
        below = np.cumsum(known, dtype=np.int32)
        hit = below[hi] > below[lo]
        got = todo[hit]
        if not len(got):
            break
        known[got] = True
        if level % 4 == 0 or len(got) * 4 > len(todo):
            left = ~hit
            todo, lo, hi = todo[left], lo[left], hi[left]
    return order, known


def answer_pieces(rows: pd.DataFrame, size: int) -> pd.DataFrame:
    """One bit for each string in the pieces of a block: whether a document before the piece's least has it."""
    found: dict[bytes, int] = {}
    of: list[np.ndarray] = []
    names: list[int] = []
    for data, sizes, name in zip(rows["data"], rows["sizes"], rows["names"]):
        ends = np.cumsum(np.frombuffer(sizes, np.uint32).astype(np.int64))
        at = []
        for s, e, x in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), np.frombuffer(name, np.uint32).tolist()):
            k = found.setdefault(data[s:e], len(found))
            if k == len(names):
                names.append(x)
            at.append(k)
        of.append(np.array(at, np.int64))
    texts = list(found)
    lens = np.array([len(t) for t in texts], np.int64)
    least = np.full(len(texts), LAST_ID, np.int64)
    own = [np.frombuffer(x, np.int64) for x in rows["least"]]
    for k, d in zip(of, own):
        np.minimum.at(least, k, d)
    # Pieces of one hash stay together; so many hashes are sorted at a time.
    by_name = np.argsort(np.array(names, np.uint32), kind="stable")
    sorted_names = np.array(names, np.uint32)[by_name]
    group = np.flatnonzero(np.concatenate(([True], sorted_names[1:] != sorted_names[:-1], [True])))
    total = np.concatenate(([0], np.cumsum(lens[by_name] + 1)))
    begun: list[np.ndarray | None] = [None] * len(texts)
    g = 0
    while g < len(group) - 1:
        e = int(np.searchsorted(total[group], total[group[g]] + SORTED_AT_A_TIME, side="right")) - 1
        e = min(max(e, g + 1), len(group) - 1)
        take = by_name[group[g] : group[e]]
        for k, v in zip(take.tolist(), least_by_string([texts[k] for k in take], least[take], size)):
            begun[k] = v
        g = e
    bits = [
        np.packbits(np.concatenate([begun[k] < d for k, d in zip(at.tolist(), mine.tolist())])).tobytes()
        for at, mine in zip(of, own)
    ]
    return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "bits": bits})


def least_by_string(texts: list[bytes], least: np.ndarray, size: int) -> list[np.ndarray]:
    """For each string of `size` bytes in each text, the least document of any text that has it."""
    lens = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lens + 1)
    starts = ends - lens - 1
    symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    symbols[ends - 1] = 0
    order, begins = equal_intervals(symbols, size)
    doc = np.repeat(least, lens + 1)
    at = np.flatnonzero(begins)
    low = np.minimum.reduceat(doc[order], at)
    out = np.empty(len(symbols), np.int64)
    out[order] = np.repeat(low, np.diff(np.append(at, len(order))))
    return [out[s : s + n - size + 1] for s, n in zip(starts.tolist(), lens.tolist())]


def cut(rows: Iterator[pa.RecordBatch], size: int, q: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Mark, cover and cut: a row for each document."""
    for batch in rows:
        for row in batch.to_pylist():
            start, count, doc, of_run, texts, least, key, lens, ids = pieces(row | {"answers": row["repeats"]}, size, q, buckets)
            strings = np.array([len(t) - size + 1 for t in texts], np.int64)
            ends = np.cumsum(strings)
            b, _, _ = buckets_of(key)
            bits = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
            for x in row["marks"] or ():
                lo, hi = np.searchsorted(b, x["bucket"], "left"), np.searchsorted(b, x["bucket"], "right")
                if hi > lo:
                    s, e = int(ends[lo] - strings[lo]), int(ends[hi - 1])
                    bits[s:e] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=e - s)
            data = np.frombuffer(row["data"], np.uint8)
            # A string starts at each marked place and covers `size` bytes.
            depth = np.zeros(len(data) + 1, np.int32)
            total = int(count.sum())
            within = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            if total:
                later = np.repeat(ids[doc] > least[of_run], count)
                later |= bits[np.repeat(ends[of_run] - strings[of_run], count) + within]
                depth += np.bincount((np.repeat(start, count) + within)[later], minlength=len(depth)).astype(np.int32)
                depth[size:] -= depth[:-size].copy()
            covered = np.cumsum(depth[:-1]) > 0
            yield _documents(row, data, covered, lens, ids)


def _documents(row: dict, data: np.ndarray, covered: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    last = np.cumsum(lens)
    first = last - lens
    nulls = np.frombuffer(row["nulls"], np.bool_)
    kept, spans = [], []
    for s, e in zip(first.tolist(), last.tolist()):
        c = covered[s:e]
        if not c.any():
            kept.append(row["data"][s:e])
            spans.append([])
            continue
        kept.append(data[s:e][~c].tobytes())
        turn = np.flatnonzero(np.diff(np.concatenate(([0], c.view(np.int8), [0]))))
        spans.append([{"start": a, "end": b} for a, b in turn.reshape(-1, 2).tolist()])
    cols = [
        pa.array(ids, pa.int64(), mask=nulls),
        pa.array(lens, pa.int64()),
        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        pa.array(kept, pa.binary()),
    ]
    names = ["doc_id", "n_bytes", "spans", "kept"]
    if row["rest"]:
        with pa.ipc.open_stream(row["rest"]) as stream:
            cols.append(stream.read_all().combine_chunks().column("rest").combine_chunks())
        names.append("rest")
    return pa.RecordBatch.from_arrays(cols, names)


def remove_repeats(
    docs: DataFrame, min_bytes: int = 50, id_col: str = "doc_id", text_col: str = "text", q: int = QGRAM, block_bytes: int = BLOCK_BYTES, hot_blocks: int = HOT_BLOCKS
) -> DataFrame:
    """(doc_id, n_bytes, spans, kept[, rest]) for each row: text without what an earlier document also has.

    A byte goes if a string of min_bytes bytes over it also starts in a document with a smaller
    id; overlaps count, and strings are judged on the input. Null and empty texts give 0 bytes
    and no spans; null ids count as later than all others and come back null; repeated rows
    (equal ids) are not earlier than one another and both stay; an empty table gives no rows;
    further columns are ignored, but for a struct named rest, which comes along with its row
    without being joined to it. `kept` holds bytes: a cut may fall inside a character.
    """
    if not ("rest" in docs.columns and isinstance(docs.schema["rest"].dataType, StructType)):
        docs = docs.drop("rest")
    blocks = bucketed(pack_blocks(docs, id_col, text_col, block_bytes), "block", "blocks")
    buckets = max(1, -(-(blocks.agg(F.sum("bytes")).first()[0] or 0) // BUCKET_BYTES))
    how = {"size": min_bytes, "q": q, "buckets": buckets}

    asked = blocks.mapInArrow(partial(send_hashes, **how), "block long, bucket int, names binary, many binary")
    answered = asked.groupBy("bucket").applyInPandas(lambda rows: answer_hashes(rows, hot_blocks), "block long, bucket int, bits binary, hot binary")
    repeats = written(
        answered.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits", "hot")).alias("repeats")), "repeats"
    )
    with_repeats = blocks.join(repeats.hint("shuffle_hash"), "block", "left")
    sent = with_repeats.withColumnRenamed("repeats", "answers").mapInArrow(
        partial(send_pieces, **how), "block long, bucket int, names binary, sizes binary, least binary, data binary"
    )
    marks = written(
        sent.groupBy("bucket")
        .applyInPandas(lambda rows: answer_pieces(rows, min_bytes), "block long, bucket int, bits binary")
        .groupBy("block")
        .agg(F.collect_list(F.struct("bucket", "bits")).alias("marks")),
        "marks",
    )
    schema = StructType.fromDDL("doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    if "rest" in docs.columns:
        schema = schema.add("rest", docs.schema["rest"].dataType)
    return with_repeats.join(marks.hint("shuffle_hash"), "block", "left").mapInArrow(partial(cut, **how), schema)


def op2(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.end - s.start).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
