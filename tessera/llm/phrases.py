"""Phrase collocations by dynamic itemset counting.

Texts are dealt over shards that are scanned in a cycle, one a step. A phrase of k words becomes
active at the end of the step in which both of its phrases of k - 1 words have reached the
threshold, whatever shard that is, and is counted in each of the steps of the one full cycle that
follows; so phrases of all lengths are counted side by side and most are known to be rare before
they are ever looked for. What has reached the threshold is marked, with its step, in a table of
fixed size that every task has. Phrases that share a mark are activated with the first of them: too
early at worst, and for one full cycle all the same, so every count is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import erase, fresh_path, note, per_worker, small, table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_COUNT, LONGEST, TOP, SHARDS = 100, 5, 2000, 3
#: The table of marks has 2^MARK_BITS places of a byte; where phrases outgrow it more are counted than need be.
MARK_BITS = 24
#: Bytes of text that are worked on at once.
BLOCK = 2 << 20
#: Bytes that end a piece, and blanks between its words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Of the two hashes that tell words apart.
FACTORS = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)
#: A top list is taken in so many parts before it is taken of their tops.
PARTS = 64
#: A phrase's length, the step it became active in and the step it reached the threshold in (0: not yet) travel as one number.
SCHEMA = "lang string, phrase string, h long, p long, n long"
K, A, R = "CAST(shiftright(p, 8) & 255 AS INT)", "CAST(shiftright(p, 16) AS INT)", "CAST(p & 255 AS INT)"


def kinds() -> np.ndarray:
    """For each byte: 0 inside a word, 1 a blank, 2 the end of a piece."""
    found = np.zeros(256, np.uint8)
    found[list(BLANKS)], found[list(ENDS)] = 1, 2
    return found


def blocks(kind: np.ndarray, offsets: np.ndarray, size: int = BLOCK, reach: int = LONGEST - 1) -> Iterator[tuple[int, int, int]]:
    """(begin, owned, end): parts of a buffer of texts, each text ending with the end of a piece.

    Whole texts as far as size allows. A longer one is cut after a blank or the end of a piece, and
    its part goes on to the end of reach more words; phrases that start before owned are the part's.
    """
    begin, last = int(offsets[0]), int(offsets[-1])
    while begin < last:
        stop = int(offsets[np.searchsorted(offsets, begin + size, "right") - 1])
        if stop > begin:
            yield begin, stop, stop
            begin = stop
            continue
        stop = int(offsets[np.searchsorted(offsets, begin, "right")])
        while begin < stop:
            between = np.flatnonzero(kind[begin:min(begin + size, stop)])
            width = size
            while not len(between):  # one long word
                width *= 2
                between = np.flatnonzero(kind[begin:min(begin + width, stop)])
            owned, width = begin + int(between[-1]) + 1, 256
            while True:
                seen = kind[owned:min(owned + width, stop)]
                ends = np.flatnonzero((seen[:-1] == 0) & (seen[1:] > 0)) + 1
                if len(ends) >= reach or owned + width >= stop:
                    break
                width *= 4
            yield begin, owned, owned + int(ends[reach - 1]) if len(ends) >= reach else stop
            begin = owned


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def powers(factor: int, n: int) -> np.ndarray:
    """factor to the powers 0 to n - 1, modulo 2^64; made once in a worker for blocks of the common size."""
    held = per_worker(("powers", factor), lambda: [np.zeros(0, np.uint64)])
    if len(held[0]) < n:
        held[0] = np.full(max(n, BLOCK), factor, np.uint64)
        held[0][0] = 1
        np.multiply.accumulate(held[0], out=held[0])
    return held[0][:n]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: np.ndarray, factor: int) -> np.ndarray:
    """A hash of 64 bits of each word: a polynomial in factor, from sums over the whole block."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(factor, len(data)), out=sums[1:])
    back = powers(pow(factor, -1, 1 << 64), len(data))[starts]
    return mixed((sums[ends] - sums[starts]) * back + salt)


def grouped(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each kind and how many there are of it; kinds differ in h or in g, which tells equal h apart."""
    order = np.argsort(h)
    hs, gs = h[order], g[order]
    first = np.flatnonzero(np.concatenate(([True], hs[1:] != hs[:-1])))
    if (np.minimum.reduceat(gs, first) != np.maximum.reduceat(gs, first)).any():
        order = np.lexsort((g, h))
        hs, gs = h[order], g[order]
        first = np.flatnonzero(np.concatenate(([True], (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1]))))
    return order[first], np.diff(np.append(first, len(h)))


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts data[start:end]."""
    lengths = ends - starts
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))])


def counts_of_block(
    data: np.ndarray, kind: np.ndarray, owned: int, row_ends: np.ndarray, langs: np.ndarray, names: list[str], salts: np.ndarray,
    marks: np.ndarray, step: int, shards: int, longest: int, bits: int,
) -> Iterator[pa.RecordBatch]:
    """The counts in a block of the phrases that are active in this step, and of all words as the phrase ''."""
    inside = np.concatenate(([False], kind == 0, [False]))
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    if not len(starts):
        return
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    lang = langs[np.searchsorted(row_ends, starts, "right")]
    mine = int(np.searchsorted(starts, owned))
    h1, second = hashes(data, starts, ends, salts[lang], FACTORS[0]), []
    # Words one blank apart, so that a phrase is one slice.
    keep = inside[1:-1].copy()
    keep[ends[ends < len(data)]] = True
    closed = np.where(kind == 0, data, np.uint8(32))[keep]
    width = ends - starts
    begin = np.concatenate(([0], np.cumsum(width + 1)[:-1]))
    shift = np.uint64(64 - bits)

    def found(k: int, at: np.ndarray, h: np.ndarray, a: np.ndarray | None) -> pa.RecordBatch:
        if not second:
            second.append(hashes(data, starts, ends, salts[lang], FACTORS[1]))
        g = second[0][at]
        for i in range(1, k):
            g = mixed(g * np.uint64(0xA0761D6478BD642F) + second[0][at + i])
        rows, n = grouped(h, g)
        first = at[rows]
        phrase = slices(closed, begin[first], begin[first + k - 1] + width[first + k - 1])
        since = np.zeros(len(rows), np.int64) if a is None else a[rows].astype(np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(names, pa.string()).take(pa.array(lang[first])), phrase, pa.array(h[rows].view(np.int64)), pa.array((since << 16) + (k << 8)),
            pa.array(n.astype(np.int64)),
        ], ["lang", "phrase", "h", "p", "n"])

    if step <= shards and mine:
        yield found(1, np.arange(mine), h1[:mine], None)
        of_lang = np.bincount(lang[:mine], minlength=len(names))
        some = np.flatnonzero(of_lang)
        zero = np.zeros(len(some), np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array(names, pa.string()).take(pa.array(some)), pa.array([""] * len(some)), pa.array(zero), pa.array(zero), pa.array(of_lang[some].astype(np.int64)),
        ], ["lang", "phrase", "h", "p", "n"])
    # reached[i]: the step in which the phrase of k - 1 words at word i, and all within it, had been marked; 0 if not.
    h, reached = h1, marks[(h1 >> shift).astype(np.int64)]
    for k in range(2, longest + 1):
        n = len(starts) - k + 1
        if n <= 0:
            return
        active = np.where((reached[:n] > 0) & (reached[1:n + 1] > 0) & (piece[:n] == piece[k - 1:]), np.maximum(reached[:n], reached[1:n + 1]), 0)
        at = np.flatnonzero(active)
        if not len(at):
            return
        hk = mixed(h[at] * np.uint64(0xD6E8FEB86659FD93) + h1[at + k - 1])
        since = active[at]
        now = (since.astype(np.int64) + shards >= step) & (at < mine)
        if now.any():
            yield found(k, at[now], hk[now], since[now])
        marked = marks[(hk >> shift).astype(np.int64)]
        h, reached = np.zeros(n, np.uint64), np.zeros(n, np.uint8)
        h[at] = hk
        reached[at] = np.where(marked > 0, np.maximum(marked, since), 0)


def counter(marks, step: int, shards: int, longest: int, bits: int):
    """For mapInArrow over (lang, text): the counts of this step's active phrases, block by block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen, kind_of = np.frombuffer(marks.value, np.uint8), kinds()
        for batch in batches:
            texts = batch.column(1)
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
            coded = batch.column(0).dictionary_encode()
            langs, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            salts = np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64)
            kind = kind_of[data]
            for begin, owned, end in blocks(kind, offsets, reach=max(1, longest - 1)):
                yield from counts_of_block(
                    data[begin:end], kind[begin:end], owned - begin, offsets[1:] - begin, langs, names, salts, seen, step, shards, longest, bits
                )

    return count


def dealt(docs: DataFrame, text_col: str, lang_col: str, shards: int) -> DataFrame:
    """(lang, text, shard), written by shard: texts lower-cased, each closed by the end of a piece."""
    spark, path = docs.sparkSession, fresh_path(docs.sparkSession, "shards")
    lowered = F.concat(F.translate(text_col, UPPER, LOWER), F.lit("\n"))
    docs.where(F.length(text_col) > 0).select(
        F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), lowered.alias("text"), (F.monotonically_increasing_id() % shards).alias("shard")
    ).write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return note(spark.read.schema("lang string, text string, shard int").parquet(path), path)


def newly_marked(counts: DataFrame, step: int, longest: int, bits: int) -> np.ndarray:
    """The places of the phrases that reached the threshold in this step: a bitmap of 2^bits bits in parts, whatever their number."""
    place = F.shiftrightunsigned("h", 64 - bits) + 1
    new = counts.where((F.expr(R) == step) & F.expr(K).between(1, longest - 1)).select(place.alias("place"))
    parts = new.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    found = [np.zeros(0, np.int64)]
    for part, held in parts.collect():
        found.append(np.flatnonzero(np.unpackbits(np.frombuffer(held, np.uint8), bitorder="little")) + (part - 1) * 8 * len(held))
    return np.concatenate(found)


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST, shards: int = SHARDS, bits: int = MARK_BITS
) -> DataFrame:
    """(lang, phrase, k, n): every phrase of up to longest words that comes min_count times, and as k = 0 the number of all words.

    A step shuffles this step's counts, summed per task, and the counts that are under way; those
    of a finished cycle below the threshold are dropped, those above it are written for good.
    """
    spark = docs.sparkSession
    texts = dealt(docs, text_col, lang_col, shards)
    marks, done, under_way = np.zeros(1 << bits, np.uint8), [], None
    step, last = 0, shards
    while step < last:
        step += 1
        sent = spark.sparkContext.broadcast(marks.tobytes())
        shard = texts.where(F.col("shard") == (step - 1) % shards).select("lang", "text")
        rows = shard.mapInArrow(counter(sent, step, shards, longest, bits), SCHEMA)
        if under_way is not None:
            rows = rows.unionByName(under_way.where(F.expr(A) + shards >= step))
        summed = rows.groupBy("lang", "phrase").agg(F.max("h").alias("h"), F.max("p").alias("p"), F.sum("n").alias("n"))
        over, often = F.expr(A) + shards <= step, F.col("n") >= min_count
        reached = F.when(often & (F.expr(R) == 0), F.col("p") + step).otherwise(F.col("p"))
        now = written(summed.withColumn("p", reached).where(~over | often | (F.expr(K) == 0)), "counts")
        done.append(written(now.where(over).select("lang", "phrase", F.expr(K).alias("k"), "n"), "frequent"))
        new = newly_marked(now, step, longest, bits)
        new = new[marks[new] == 0]
        marks[new] = step
        if len(new):
            last = max(last, step + shards)
        sent.destroy()
        if under_way is not None:
            erase(under_way)
        under_way = now
    erase(texts, under_way)
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return found


def words_of(phrase: Column, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, count), " ")


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, n, score): each phrase of two words or more at its worst cut, in exact integers."""
    total = frequent.where("k = 0").select(F.col("lang").alias("lang_t"), F.col("n").alias("words"))
    part = frequent.where("k > 0").select(F.col("lang").alias("lang_p"), F.col("phrase").alias("part"), F.col("n").alias("count"))
    several = frequent.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"))
    cut = several.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cut = cut.withColumn("left", words_of(F.col("phrase"), F.lit(1), F.col("cut"))).withColumn("right", words_of(F.col("phrase"), F.col("cut") + 1, F.col("k") - F.col("cut")))
    for side, name in (("left", "l"), ("right", "r")):
        of_side = part.select(F.col("lang_p").alias("lang_q"), F.col("part").alias("part_q"), F.col("count").alias(name))
        cut = cut.join(of_side, (F.col("lang") == F.col("lang_q")) & (F.col(side) == F.col("part_q"))).drop("lang_q", "part_q")
    cut = cut.join(small(total, 100), F.col("lang") == F.col("lang_t"))
    exact = F.expr("CAST(a AS DECIMAL(18,0)) * CAST(words AS DECIMAL(18,0)) * CAST(1000 AS DECIMAL(4,0)) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))")
    worst = cut.withColumn("score", exact).groupBy("lang", "phrase", "k", "a", F.col("words").alias("n")).agg(F.min(F.struct("score", "cut", "l", "r")).alias("w"))
    return worst.select("lang", "phrase", "k", "a", "w.l", "w.r", "n", "w.score")


def not_in_longer(phrases: DataFrame) -> DataFrame:
    """phrases without those that a longer one holds which comes as often.

    A phrase comes at least as often as one that holds it, and so does every phrase between the
    two: it is enough to look at those one word longer.
    """
    longer = phrases.where("k > 2")
    inner = F.array(words_of(F.col("phrase"), F.lit(1), F.col("k") - 1), words_of(F.col("phrase"), F.lit(2), F.col("k") - 1))
    held = longer.select(F.col("lang").alias("lang_h"), F.explode(inner).alias("held"), F.col("a").alias("often")).distinct()
    same = (F.col("lang") == F.col("lang_h")) & (F.col("phrase") == F.col("held")) & (F.col("a") == F.col("often"))
    return phrases.join(held, same, "left_anti")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, **how) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score, then count, then spelling.

    Null and empty texts have no words; a null language is und; repeated rows count as often as
    they come; a language without a phrase that is frequent enough has no rows; an empty table
    gives none; ties rank by count and spelling, so ranks are always distinct; other columns are
    ignored, whatever their names.
    """
    docs = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = written(scored(written(frequent_phrases(docs, "text", "lang", **how), "phrases")), "scored")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    left = not_in_longer(found).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    # The first of each part, then of those: no task has a whole language.
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return left.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t
), o AS (
  SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k
), n AS (
  SELECT lang, count(*) AS n FROM o WHERE k = 1 GROUP BY lang
), f AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS a FROM o GROUP BY lang, k, phrase HAVING count(*) >= 100
), c AS (
  SELECT f.lang, f.phrase, f.w, f.k, f.a, x.a AS l, y.a AS r, n.n,
         (1000 * CAST(f.a AS HUGEINT) * n.n) // (CAST(x.a AS HUGEINT) * y.a) AS score,
         row_number() OVER (PARTITION BY f.lang, f.phrase ORDER BY (1000 * CAST(f.a AS HUGEINT) * n.n) // (CAST(x.a AS HUGEINT) * y.a), c.cut) AS place
  FROM f JOIN (SELECT unnest([1, 2, 3, 4]) AS cut) c ON c.cut < f.k JOIN n ON n.lang = f.lang
  JOIN f x ON x.lang = f.lang AND x.phrase = array_to_string(f.w[1:c.cut], ' ')
  JOIN f y ON y.lang = f.lang AND y.phrase = array_to_string(f.w[c.cut + 1:f.k], ' ')
), held AS (
  SELECT DISTINCT lang, a, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, k - m + 2)]) AS phrase
  FROM f, (SELECT unnest([2, 3, 4]) AS m) WHERE k > m
), s AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, c.phrase) AS rank
  FROM c LEFT JOIN held h ON h.lang = c.lang AND h.phrase = c.phrase AND h.a >= c.a
  WHERE c.place = 1 AND h.phrase IS NULL
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM s WHERE rank <= 2000
"""
