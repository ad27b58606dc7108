"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Each document gets an exponential key, divided by its quality weight; within its source documents
are taken in the order of their keys until their summed sizes reach the budget. Budgets above the
source are met by complete epochs first, then by such a fraction. Sums run in two steps (over
slices of the keys' quantiles, then within a slice), so a source with most of the rows is many tasks'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, table, written

WEIGHTS = (5, 2, 1)
TOTAL, AT_MOST = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_length_quality(text: str, size: Column) -> Column:
    """A quality weight in (0, 1]: 1 at 6 characters a word (blanks included), less away from it."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.coalesce(1 / (1 + F.abs(mean - 6) / 6), F.lit(1.0))


def uniform(id_col: str, seed: str = SEED) -> Column:
    """A number in (0, 1) that the id alone decides."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality: Column | None = None) -> DataFrame:
    """docs with size and key."""
    with_size = docs.withColumn("size", words(text_col))
    q = quality if quality is not None else word_length_quality(text_col, F.col("size"))
    return with_size.withColumn("key", -F.log(uniform(id_col)) / q)


def targets(by_source: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, at_most: int = AT_MOST) -> DataFrame:
    """(source, source_size) with weight and target: shares by weight, none above at_most times its source.

    The caps bind from the least room per weight upwards; the first source that is under its cap
    at the level left for it sets the level of all others. One row per source throughout.
    """
    code_order = Window.orderBy(F.col("source").isNull(), "source")
    numbered = by_source.withColumn("place", F.row_number().over(code_order) - 1)
    cases = F.array(*[F.lit(w) for w in weights])
    w = numbered.withColumn("weight", F.get(cases, F.pmod("place", F.lit(len(weights))))).withColumn(
        "cap", F.col("source_size") * at_most
    )
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (total * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(rising), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(rising), F.lit(0))
    )
    leveled = w.withColumn("level", level).withColumn("under", F.col("cap") > F.col("level") * F.col("weight"))
    final = F.min_by(F.when(F.col("under"), F.col("level")), F.when(F.col("under"), F.col("cap") / F.col("weight"))).over(every)
    return leveled.withColumn("final", final).select(
        "source", "source_size", "weight",
        F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap").cast("double"))).alias("target"),
    )


def sliced(narrow: DataFrame) -> DataFrame:
    """narrow with slice: how many of the source's approximate quantiles lie at or below the key.

    So slices are about equal whatever the keys' range. Equal keys have one slice, and all keys of
    a slice lie below those of the next; how near the quantiles are bears on the work only.
    """
    n = min(4 * partitions(narrow.sparkSession), 256)
    marks = narrow.groupBy("source").agg(F.approx_percentile("key", [i / n for i in range(1, n)], 20 * n).alias("marks"))
    marks = marks.select(F.col("source").alias("__s"), "marks")  # one row per source
    joined = narrow.join(marks, F.col("source").eqNullSafe(F.col("__s")))
    return joined.withColumn("slice", F.size(F.filter("marks", lambda m: m <= F.col("key")))).drop("__s", "marks")


def cuts(narrow: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """Per source: target, whole epochs, and where in the order of (key, id, size) the fraction ends.

    narrow: id, source, size, key. Rows that are alike in all of these share a place in the order;
    those at the end of the fraction (at cut_key, cut_id, cut_size) give cut_words each.
    """
    cut = sliced(narrow)
    sums = cut.groupBy("source", "slice").agg(F.sum("size").alias("held"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    plan = targets(sums.groupBy("source").agg(F.sum("held").alias("source_size")), **how)
    plan = plan.withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long"))
    at = (
        sums.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
        .join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .where("before < rest AND rest <= before + held")
        .select(F.col("source").alias("s"), F.col("slice").alias("sl"), "before", "rest")
    )
    # One slice of each source; repeated rows are counted before they are put in order.
    here = cut.join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("sl")))
    here = here.groupBy("source", "key", F.col(id_col).alias("id"), "size", "before", "rest").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    words_left = F.col("rest") - F.col("before")
    border = (
        here.withColumn("before", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
        .where("before < rest AND rest <= before + size * n")
        .select(
            F.col("source").alias("s"), F.col("key").alias("cut_key"), F.col("id").alias("cut_id"), F.col("size").alias("cut_size"),
            F.floor((2 * words_left + F.col("n")) / (2 * F.col("n"))).cast("long").alias("cut_words"),
        )
    )
    return plan.join(border, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("mix_source"), "source_size", "target", "epochs", "cut_key", "cut_id", "cut_size", "cut_words",
    )


def taken(sized_docs: DataFrame, plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """sized_docs with source_size, target and taken (words the mix takes, repeats counted)."""
    joined = sized_docs.join(plan, F.col("source").eqNullSafe(F.col("mix_source")))
    mine = F.struct(F.col("key").alias("k"), F.col(id_col).alias("i"), F.col("size").alias("n"))
    border = F.struct(F.col("cut_key").alias("k"), F.col("cut_id").alias("i"), F.col("cut_size").alias("n"))
    fraction = (
        F.when(F.col("cut_key").isNull(), F.lit(0))
        .when(mine < border, F.col("size"))
        .when(mine.eqNullSafe(border), F.least("cut_words", "size"))
        .otherwise(F.lit(0))
    )
    return joined.withColumn("taken", (F.col("epochs") * F.col("size") + fraction).cast("long")).drop(
        "mix_source", "cut_key", "cut_id", "cut_size", "cut_words", "key"
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality: Column | None = None, **how) -> DataFrame:
    """docs with size, source_size, target, epochs and taken.

    Null and empty texts have size 0 and nothing taken; a null source is a source of its own,
    the last; null ids are one id; repeated rows (equal id, source, size and key) cannot be told
    apart, so at the end of the fraction each takes an equal part of the words still missing, to
    the nearest word (the sum is off by half a word for each of them at most); an empty table
    gives no rows. Columns named like the new ones are replaced.
    The text is never shuffled: it meets the plan, one row per source.
    """
    new = ("size", "source_size", "target", "epochs", "taken")
    given = [c for c in docs.columns if c.lower() not in new]
    with_size = docs.select(*[F.col(f"`{c}`") for c in given], words(text_col).alias("size"))
    q = quality if quality is not None else word_length_quality(text_col, F.col("size"))
    # The given columns are one from here on, so that their names meet no others.
    rows = with_size.select(
        F.struct(*[F.col(f"`{c}`") for c in given]).alias("row"), F.col(id_col).alias("id"), "source", "size", (-F.log(uniform(id_col)) / q).alias("key")
    )
    narrow = written(rows.select("id", "source", "size", "key"), "sizes")
    return taken(rows, written(cuts(narrow, "id", **how), "cuts"), "id").select("row.*", *new)


def op6(spark, sf_dir: str) -> DataFrame:
    s = sized(table(spark, sf_dir, "documents"))
    narrow = written(s.select("doc_id", "source", "size", "key"), "sizes")
    return taken(narrow, written(cuts(narrow), "cuts")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = """
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         length(text) AS chars
  FROM documents
), k AS (
  SELECT doc_id, source, size,
         -ln((CAST(('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE)
         / coalesce(1 / (1 + abs(chars / CAST(greatest(size, 1) AS DOUBLE) - 6) / 6), 1.0) AS key
  FROM d
), b AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM b
), l AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
             - CAST(coalesce(sum(cap) OVER r, 0) AS DOUBLE))
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER r, 0) AS DOUBLE) AS level
  FROM w WINDOW r AS (ORDER BY cap / CAST(weight AS DOUBLE), place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, first_value(CASE WHEN cap > level * weight THEN level END) OVER
            (ORDER BY CASE WHEN cap > level * weight THEN cap / CAST(weight AS DOUBLE) END NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final
  FROM l
), t AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), coalesce(final * weight, CAST(cap AS DOUBLE))) AS target
  FROM f
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
), r AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs,
         CAST(floor(e.target - e.epochs * e.source_size + 0.5) AS BIGINT) AS rest,
         CAST(coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM r
"""
