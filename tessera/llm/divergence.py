"""Source divergence audit: how the term use of each source differs from the other sources of its language.

Terms are counted per (language, source) group; terms that enough documents of a language have are
kept and numbered in chunks of bounded width. A group's terms with one count are one bitset, its
level. Two groups meet level by level: AND and a popcount give how many terms have this count
here and that count there, and the difference of the two shares is multiplied by it. Terms that a
group lacks are the complement of its levels, so no zero is ever stored. All sums are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .phrases import FACTORS, blocks, hashes, slices
from .shared import small, table, written

MIN_DOCUMENTS, TOP, SMOOTH, SCALE = 30, 50, 5, 1_000_000_000
#: Words of 64 bits in a level of a chunk, terms that are put in order of frequency together, sources of a block.
WORDS, BUCKET_TERMS, BLOCK = 16, 16_384, 8
CHUNK_TERMS = 64 * WORDS
#: Pairs of levels that are tested at once.
CELLS = 1 << 16


def kinds() -> np.ndarray:
    """For each byte: 0 inside a term (ASCII letters and all beyond ASCII), 2 between terms."""
    found = np.zeros(256, np.uint8)
    found[[b for b in range(128) if not chr(b).isalpha()]] = 2
    return found


def by_term(h: np.ndarray, g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of each kind, how many there are of it, and in how many documents, which ascend; kinds differ in h or in g."""
    order = np.argsort(h, kind="stable")
    hs, gs = h[order], g[order]
    new = np.concatenate(([True], hs[1:] != hs[:-1]))
    if (np.minimum.reduceat(gs, np.flatnonzero(new)) != np.maximum.reduceat(gs, np.flatnonzero(new))).any():
        order = np.lexsort((g, h))
        hs, gs = h[order], g[order]
        new = np.concatenate(([True], (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])))
    ds, first = doc[order], np.flatnonzero(new)
    of_doc = new | np.concatenate(([True], ds[1:] != ds[:-1]))
    return order[first], np.diff(np.append(first, len(h))), np.add.reduceat(of_doc, first, dtype=np.int64)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (text, lang, source), each text closed by a line end: term counts, block by block."""
    import xxhash

    kind_of, lower = kinds(), np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    for batch in batches:
        texts, (langs, sources) = batch.column(0), (batch.column(i).dictionary_encode() for i in (1, 2))
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = lower[np.frombuffer(texts.buffers()[2], np.uint8)]
        kind, seen = kind_of[data], np.zeros(0, np.uint64)
        width = len(sources.dictionary)
        group = langs.indices.to_numpy().astype(np.int64) * width + sources.indices.to_numpy()
        lang_names, source_names = langs.dictionary.to_pylist(), sources.dictionary.to_pylist()
        salts = {int(x): xxhash.xxh64_intdigest(f"{lang_names[x // width]}\0{source_names[x % width]}") for x in np.unique(group)}
        salt = np.array([salts[int(x)] for x in group], np.uint64)
        for begin, owned, _ in blocks(kind, offsets, reach=1):
            inside = np.concatenate(([False], kind[begin:owned] == 0, [False]))
            starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
            if begin in offsets:
                seen = seen[:0]  # the terms that earlier blocks of a long text had
            if not len(starts):
                continue
            block, doc = data[begin:owned], np.searchsorted(offsets, starts + begin, "right") - 1
            h, g = (hashes(block, starts, ends, salt[doc], f) for f in FACTORS)
            rows, n, documents = by_term(h, g, doc)
            if owned not in offsets or len(seen):
                documents -= np.isin(h[rows], seen)
                seen = np.union1d(seen, h[rows])
            x = group[doc[rows]]
            yield pa.RecordBatch.from_arrays([
                langs.dictionary.take(pa.array(x // width)), sources.dictionary.take(pa.array(x % width)), slices(block, starts[rows], ends[rows]),
                pa.array(n), pa.array(documents),
            ], ["lang", "source", "term", "count", "documents"])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, count, documents): occurrences, and the documents of the group that have the term."""
    rows = docs.select(
        F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n")), F.coalesce(F.col(lang_col), F.lit("")), F.coalesce(F.col(source_col), F.lit(""))
    )
    each = rows.mapInArrow(counted, "lang string, source string, term string, count long, documents long")
    return each.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * kept)), exactly; null if there are no kept terms."""
    return F.expr(
        f"CASE WHEN {kept} > 0 THEN 1 + (CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + {SMOOTH} AS DECIMAL(20,0)))"
        f" div CAST({total} + {SMOOTH} * {kept} AS DECIMAL(20,0)) END"
    )


def kept_terms(counts: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, term, total, at): the terms that min_documents of the language have; at: source and count, one for each source."""
    found = counts.groupBy("lang", "term").agg(
        F.sum("documents").alias("documents"), F.sum("count").alias("total"), F.collect_list(F.struct("source", "count")).alias("at")
    )
    return found.where(F.col("documents") >= min_documents).drop("documents")


def numbered(kept: DataFrame) -> DataFrame:
    """kept with bucket, chunk and bit: terms of a bucket are in order of frequency, so that a chunk's counts are alike."""
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v")).select(F.col("lang").alias("l"), F.ceil(F.col("v") / BUCKET_TERMS).alias("buckets"))
    with_bucket = kept.join(small(sizes, 100), F.col("lang") == F.col("l")).withColumn("bucket", F.pmod(F.xxhash64("term"), "buckets")).drop("l", "buckets")
    at = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(F.desc("total"), "term")) - 1
    return with_bucket.withColumn("at_", at).withColumn("chunk", F.floor(F.col("at_") / CHUNK_TERMS)).withColumn("bit", F.col("at_") % CHUNK_TERMS).drop("at_")


def level_bits(occurring: DataFrame) -> DataFrame:
    """(lang, bucket, chunk, source, count, bits): the bitset of the terms that a source has count times."""
    words = [f"w{k}" for k in range(WORDS)]
    one = F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")
    each = [F.coalesce(F.bit_or(F.when(F.floor(F.col("bit") / 64) == k, one)), F.lit(0).cast("long")).alias(w) for k, w in enumerate(words)]
    found = occurring.groupBy("lang", "bucket", "chunk", "source", "count").agg(*each)
    return found.withColumn("bits", F.array(*words)).drop(*words)


def joint(a: np.ndarray, b: np.ndarray, pa: np.ndarray, pb: np.ndarray, zero_a: int, zero_b: int, terms: int) -> int:
    """The summed distance of two groups over the terms of a chunk.

    a, b: levels as rows of words; pa, pb: the share at each level; zero_a, zero_b: the share of a
    term that a group lacks. Cells with a zero are what the AND cells leave of a level, or of all terms.
    """
    left_a, left_b = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    both_zero, total = terms - left_a.sum() - left_b.sum(), 0
    step = max(1, CELLS // max(1, len(b)))
    for i in range(0, len(a), step):
        cells = np.bitwise_count(a[i:i + step, None, :] & b[None, :, :]).sum(2, dtype=np.int64)
        total += int((cells * np.abs(pa[i:i + step, None] - pb[None, :])).sum())
        left_a[i:i + step] -= cells.sum(1)
        left_b -= cells.sum(0)
        both_zero += cells.sum()
    total += int((left_a * np.abs(pa - zero_b)).sum()) + int((left_b * np.abs(pb - zero_a)).sum())
    return total + int(both_zero) * abs(zero_a - zero_b)


def distances_in_chunk(rows: pd.DataFrame) -> pd.DataFrame:
    """(lang, source, item, value) of the pairs of sources in a chunk; rows: the levels of two blocks of sources, and a row of count 0 for each source."""
    groups = {}
    for (block, source), g in rows.groupby(["block", "source"], sort=True):
        zero, some = g[g["count"] == 0].iloc[0], g[g["count"] > 0]
        bits = np.array(some["bits"].tolist(), dtype=np.int64).reshape(len(some), WORDS).view(np.uint64)
        groups[source] = (block, bits, some["p"].to_numpy(np.int64), int(zero["p"]), int(zero["terms"]))
    first, names, out = rows["first"].iloc[0], list(groups), []
    within = first == rows["second"].iloc[0]
    for i, x in enumerate(names):
        for y in names[i + 1:]:
            (bx, ax, px, zx, n), (by, ay, py, zy, _) = groups[x], groups[y]
            if within or bx != by:
                value = joint(ax, ay, px, py, zx, zy, n)
                out += [(x, y, value), (y, x, value)]
    found = pd.DataFrame(out, columns=["source", "item", "value"])
    found.insert(0, "lang", rows["lang"].iloc[0])
    return found


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_documents: int = MIN_DOCUMENTS, top: int = TOP
) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the language's other sources (part pair) and its telling terms (part term).

    Null text, lang and source are ''. A group without terms is compared like any other, with all
    counts 0; a language without kept terms gives value 0 for each pair and no terms; a language
    with one source gives no pairs; repeated rows count as often as they come; an empty table
    gives no rows; other columns are ignored, whatever their names. Ties rank by item.

    At scale: occurrences are summed before they move, and only one row per (group, term) does. A
    chunk of CHUNK_TERMS terms with two blocks of sources is a task's, whatever a source's size.
    """
    names = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    kept = written(numbered(written(kept_terms(term_counts(names), min_documents), "kept")), "terms")
    present = names.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    occurring = kept.select("lang", "bucket", "chunk", "bit", "term", "total", F.explode("at").alias("a")).select(
        "lang", "bucket", "chunk", "bit", "term", "total", F.col("a.source").alias("source"), F.col("a.count").alias("count")
    )
    # One row per group; all that follows is joined with it.
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_total"))
    of_group = occurring.groupBy("lang", "source").agg(F.sum("count").alias("group_total"))
    in_order = Window.partitionBy("lang").orderBy("source")
    groups = written(
        present.join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").na.fill(0, ["kept", "lang_total", "group_total"])
        .withColumn("block", F.floor((F.row_number().over(in_order) - 1) / BLOCK)).withColumn("p0", share("0", "group_total", "kept")),
        "groups",
    )
    known = small(groups, 200)
    levels = level_bits(occurring).join(known, ["lang", "source"]).withColumn("p", share("count", "group_total", "kept"))
    sizes = kept.groupBy("lang", "bucket", "chunk").agg(F.count("*").alias("terms"))
    shape = ["lang", "bucket", "chunk", "source", "block", "count", "p", "bits", "terms"]
    nothing = F.array().cast("array<bigint>")
    zeros = sizes.join(known, "lang").withColumn("count", F.lit(0).cast("long")).withColumn("p", F.col("p0")).withColumn("bits", nothing)
    rows = levels.withColumn("terms", F.lit(0).cast("long")).select(shape).unionByName(zeros.select(shape))
    # A row goes to every pair of blocks that its source's is one of.
    blocks = groups.groupBy(F.col("lang").alias("l")).agg(F.max("block").alias("last"))
    dealt = rows.join(small(blocks, 100), F.col("lang") == F.col("l")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    dealt = dealt.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other")).drop("l", "last", "other")
    in_chunks = dealt.groupBy("lang", "bucket", "chunk", "first", "second").applyInPandas(distances_in_chunk, "lang string, source string, item string, value long")
    none_kept = groups.where("kept = 0").select("lang", "source")
    alone = none_kept.join(none_kept.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = in_chunks.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).unionByName(alone.select("lang", "source", "item", "value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    telling = (
        occurring.join(known, ["lang", "source"])
        .withColumn("value", share("count", "group_total", "kept") - share("total", "lang_total", "kept")).where("value > 0")
        .select("lang", "source", F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    )
    both = pairs.withColumn("rank", F.row_number().over(best)).withColumn("part", F.lit("pair")).unionByName(telling.withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", "value", "rank")


def op13(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), o AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS total FROM o GROUP BY lang, term HAVING count(DISTINCT row) >= 30
), c AS (
  SELECT o.lang, source, o.term, count(*) AS n FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL
), g AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(all_n, 0) AS all_n, coalesce(group_n, 0) AS group_n
  FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, count(*) AS v, sum(total) AS all_n FROM k GROUP BY lang) USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS group_n FROM c GROUP BY lang, source) USING (lang, source)
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // CAST(g.group_n + 5 * g.v AS HUGEINT) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * (k.total + 5)) // CAST(g.all_n + 5 * g.v AS HUGEINT) AS q
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0
), r AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pair
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), t AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM t WHERE part = 'pair' OR rank <= 50
"""
