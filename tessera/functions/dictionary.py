"""Which words of a dictionary occur in texts: an Aho-Corasick automaton for each bounded part of the dictionary.

The dictionary goes to the texts: a part of it at a time is broadcast, and every text is read
once for each part, whatever the number of its words. Texts are neither cut up nor shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import per_worker, written

#: Bytes of words in a part, about: what the driver holds and each task keeps at once.
PART_BYTES = 4 << 20
#: Characters of words that a task adds to texts before it passes them on, about.
YIELD_BYTES = 4 << 20


def parts(words: DataFrame, by: str, word: str, part_bytes: int = PART_BYTES) -> Iterator[list]:
    """The rows of words, part by part, in order of `by`: those of one value of it are together, and a part holds about part_bytes of `word`."""
    size = words.agg(F.sum(F.octet_length(word) + 16)).first()[0] or 0
    n = int(size // part_bytes) + 1
    dealt = written(words.repartitionByRange(n, by).withColumn("__part", F.spark_partition_id()), "words") if n > 1 else words
    for i in range(n):
        if found := dealt.where(F.col("__part") == i).drop("__part").collect() if n > 1 else words.collect():
            yield found


def automaton(words: list[str]):
    made = ahocorasick.Automaton()
    for i, w in enumerate(words):
        made.add_word(w, i)
    made.make_automaton()
    return made


def with_group_words(texts: DataFrame, low: Column, words: DataFrame, out: str) -> DataFrame:
    """texts with `out`: for each group that has a word in the text, its words that are not in it, in order of
    (group_id, pos, word), joined by spaces; empty where there are none.

    low: the lower-cased text. words: group_id, pos, word, low. A text of many groups gets many
    words, so a task passes on rows as soon as they come to YIELD_BYTES, however many it is given at once.
    """
    d = texts.withColumn(out, F.lit(""))
    for part in parts(words.select("group_id", "pos", "word", "low").distinct(), "group_id", "low"):
        sent = texts.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in part]))
        told = d.withColumn("__low", low)
        d = told.mapInArrow(missing_words(sent, YIELD_BYTES), d.schema)
    return d


def missing_words(sent, yield_bytes: int):
    """For with_group_words: adds to the last column but one by the last, which is dropped; sent: a name and the rows of a part, broadcast."""

    def make():
        groups, lows = {}, {}
        for row in sent.value[1]:
            groups.setdefault(row[0], []).append(row[1:])
        order = sorted(groups, key=lambda g: (g is not None, g))
        listed = [[(word, key) for _, word, key in sorted(groups[g], key=lambda w: (w[0] is not None, w[0], w[1]))] for g in order]
        for at, of_group in enumerate(listed):
            for _, key in of_group:
                lows.setdefault(key, set()).add(at)
        return automaton(list(lows)), list(lows.items()), listed

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, lows, listed = per_worker(("group words", sent.value[0]), make)

        def one(before: str, text: str | None) -> str:
            here = {i for _, i in made.iter(text)} if text else set()
            said = {lows[i][0] for i in here}
            hit = sorted(set().union(*(lows[i][1] for i in here)))
            return " ".join([before] * (before != "") + [word for at in hit for word, key in listed[at] if key not in said])

        for batch in batches:
            kept, begin, grown, size = batch.num_columns - 2, 0, [], 0
            for i in range(batch.num_rows):
                grown.append(one(batch.column(kept)[i].as_py(), batch.column(kept + 1)[i].as_py()))
                size += len(grown[-1])
                if size > yield_bytes or i + 1 == batch.num_rows:
                    cut = batch.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*cut.columns[:kept], pa.array(grown, pa.string())], batch.schema.names[: kept + 1])
                    begin, grown, size = i + 1, [], 0

    return missing


def holders(entries: DataFrame, fields: list[str], pos: str, words: DataFrame, limit: int) -> DataFrame | None:
    """(word, pos): for each of the distinct words (column word), the first `limit` entries that hold it in a field; None without words.

    A task keeps no more than limit entries of a word.
    """
    found = None
    lows = entries.select(F.col(pos).cast("long").alias("pos"), *[F.lower(f).alias(f) for f in fields])
    for part in parts(words, "word", "word"):
        sent = entries.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [r["word"] for r in part]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            name, known = sent.value
            made, best = per_worker(("holders", name), lambda: automaton(known)), {}
            for batch in batches:
                for at, *texts in zip(*(c.to_pylist() for c in batch.columns)):
                    for i in {i for t in texts if t for _, i in made.iter(t)}:
                        kept = best.setdefault(i, [])
                        kept.append(at)
                        if len(kept) > 4 * limit:
                            best[i] = sorted(kept)[:limit]
            rows = [(known[i], at) for i, kept in best.items() for at in sorted(kept)[:limit]]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([at for _, at in rows], pa.int64())], ["word", "pos"])

        hits = lows.mapInArrow(run, "word string, pos long")
        found = hits if found is None else found.union(hits)
    return found
