"""Best-fit packing by a plan over the length histogram.

Texts become token ids; documents longer than a sequence are cut into pieces. Only the counts by
length (at most as many as a sequence has tokens) go to the driver, where best-fit decreasing
runs over counts: whole groups of equal sequences take a document of one length each. The plan is
a table of runs of slots, and pieces take their slots by joining on their rank within their length.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, per_worker, table, written

CAPACITY = 2048
CACHED_WORDS = 450_000


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: itself if it prints, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Ids (little-endian unsigned 32 bits) of words without ASCII white space, kept once made.

    Only for a tokenizer that normalises and splits as NORMALIZER and SPLIT say (see by_words): then
    no token spans white space, so a text's ids are those of its words. Words of Latin letters are
    cut as the tokenizer cuts them and only their pieces meet the model; others go through it.
    """

    NORMALIZER = {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    }

    #: Printing characters whose case and composition are the same everywhere.
    LATIN = r"[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u017f]+"
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, limit: int = CACHED_WORDS) -> None:
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.cut, self.pieces, self.letters = regex.compile(self.SPLIT).findall, {}, byte_letters()
        self.latin = regex.compile(self.LATIN).fullmatch

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        if len(self.pieces) >= self.limit:
            self.pieces.clear()
        if word.isalpha():  # ASCII letters only
            ids = self.piece(word.lower().decode())
        else:
            text = word.decode()
            if self.latin(text) and "<|" not in text:
                text = (text if word.isascii() else unicodedata.normalize("NFC", text)).lower()
                if text.isalpha():
                    ids = self.piece(text)
                elif text[-1] in ".," and text[:-1].isalpha():
                    ids = self.piece(text[:-1]) + self.piece(text[-1])
                else:
                    ids = b"".join(map(self.piece, self.cut(text)))
            else:
                found = self.tokenizer.encode(text, add_special_tokens=False).ids
                ids = struct.pack(f"<{len(found)}I", *found)
        self[word] = ids
        return ids

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            plain = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            found = [t.id for t in self.tokenizer.model.tokenize(plain)]
            ids = self.pieces[piece] = struct.pack(f"<{len(found)}I", *found)
        return ids


def by_words(path: str) -> bool:
    """Whether a tokenizer file is one whose texts may be tokenized word by word."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    split, letters = {"type": "Split", "pattern": {"Regex": WordIds.SPLIT}, "behavior": "Removed", "invert": True}, rules["pre_tokenizer"] or {}
    parts = letters.get("pretokenizers", [])
    return (
        rules["normalizer"] == WordIds.NORMALIZER and len(parts) == 2 and parts[0] == split
        and parts[1]["type"] == "ByteLevel" and not parts[1]["add_prefix_space"] and not parts[1].get("use_regex", True)
        and all(not re.search(r"\s", t["content"]) and t["content"].startswith("<|") for t in rules["added_tokens"])
    )


def tokenized(path: str):
    """A function from a text to its ids: word by word where the tokenizer allows that, else by the tokenizer itself."""
    if by_words(path):
        words = WordIds(path)
        return lambda text: b"".join(map(words.__getitem__, text.encode().split()))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def ids(text: str) -> bytes:
        found = tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    return ids


def token_pieces(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], part): each document's ids and end_id, cut at capacity.

    Ranks within a length are counted in parts, so that a frequent length is no single task's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = per_worker(("ids", tokenizer_path), lambda: tokenized(tokenizer_path))
        end, step = struct.pack("<I", end_id), 4 * capacity
        for b in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = ids_of(t.as_py() or "") + end
                for n, s in enumerate(range(0, len(ids), step)):
                    part = ids[s : s + step]
                    for col, x in zip(rows, (i, n, s // 4, len(part) // 4, zlib.crc32(part), part)):
                        col.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            cols = [pa.array(c, k) for c, k in zip(rows, kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(cols[: 5 + with_ids], names[: 5 + with_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .mapInArrow(run, schema)
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(partitions(docs.sparkSession))).cast("int"))
    )


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs of slots (length, rank from, count, sequence from, offset).

    The documents of `length` with ranks from `rank` on take the same offset in successive sequences.
    """
    plan, next_sequence = [], 0
    free: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, count)
    rooms: list[int] = []  # in order

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in free:
                bisect.insort(rooms, room)
                free[room] = []
            free[room].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):  # new sequences, each filled with this length as far as it goes
                per = capacity // length
                if left >= per:
                    n = left // per
                    for j in range(per):
                        plan.append((length, rank + j * n, n, next_sequence, j * length))
                    leave(capacity - per * length, next_sequence, n)
                    rank, left, next_sequence = rank + per * n, left - per * n, next_sequence + n
                    continue
                plan.append((length, rank, 1, next_sequence, 0))
                leave(capacity - length, next_sequence, 1)
                rank, left, next_sequence = rank + 1, left - 1, next_sequence + 1
                continue
            room = rooms[k]
            first, n = free[room].pop()
            take = min(n, left)
            if take < n:
                free[room].append((first + take, n - take))
            if not free[room]:
                del free[room]
                rooms.pop(k)
            plan.append((length, rank, take, first, capacity - room))
            leave(room - length, first, take)
            rank, left = rank + take, left - take
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset: no sequence over capacity, each gapless from 0."""
    spark = pieces.sparkSession
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("held"))
    counts = dict(by_part.groupBy("length").agg(F.sum("held")).collect())  # at most `capacity` rows
    runs = spark.createDataFrame(best_fit_plan(counts, capacity), "length long, rank long, n long, sequence long, offset long")
    # A run of slots is cut at the borders of the parts, so that the join is one on equality.
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    slots = (
        by_part.withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
        .join(runs, "length")
        .where("rank < before + held AND rank + n > before")
        .withColumn("lo", F.greatest("rank", "before") - F.col("before"))
        .withColumn("hi", F.least(F.expr("rank + n"), F.expr("before + held")) - F.col("before"))
        .groupBy("length", "part")
        .agg(F.array_sort(F.collect_list(F.struct("lo", "hi", F.expr("sequence + before + lo - rank").alias("sequence"), "offset"))).alias("slots"))
    )
    ranked = pieces.withColumn(
        "rank_in_part", F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece")) - 1
    )
    slot = F.element_at(F.filter("slots", lambda s: (s.lo <= F.col("rank_in_part")) & (F.col("rank_in_part") < s.hi)), 1)
    return (
        ranked.join(slots, ["length", "part"])
        .withColumn("slot", slot)
        .select(
            *[c for c in pieces.columns if c != "part"],
            (F.col("slot.sequence") + F.col("rank_in_part") - F.col("slot.lo")).alias("sequence_id"),
            F.col("slot.offset").alias("offset"),
        )
    )


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    Null and empty texts are the end id alone; null ids and repeated rows are packed like any
    other; an empty table gives no rows; further columns are ignored. Only texts longer than a
    sequence are cut.
    """
    path = tokenizer_path or default_tokenizer()
    return pack(written(token_pieces(docs, path, capacity, end_id, with_ids, id_col, text_col), "pieces"), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
