"""A corpus from documents to packed sequences, in five stages.

Each stage works on all rows that the one before it kept; its result is written as Parquet in the
shared folder and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, simhash_bk, suffix_dedup, weak_quality
from tessera.llm.shared import erase, fresh_path, note, scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier neither takes for noise nor for abuse.

    Every row is judged by its own text, so null texts (no evidence), null or repeated ids and
    repeated rows are kept or go as such; an empty table gives no rows; all columns of docs come
    back as they were, whatever their names.
    """
    rows = docs.select(F.struct("*").alias("doc"))
    with scratch():
        model = weak_quality.fit(docs, table(spark, sf_dir, "labels"))
    return weak_quality.judged(rows, model, id_col="doc.doc_id", text_col="doc.text", keep_columns=True).where("keep").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8): that with the least id, null ids last.

    Null and empty texts are one group; rows with null or equal ids are told apart, each judged by
    its own text; of repeated rows one stays; an empty table gives no rows.
    """
    rows = simhash_bk.told_apart(docs.select("doc_id", "text", F.struct("*").alias("doc")))
    return rows.join(simhash_bk.later_of_groups(rows, "row"), "row", "left_anti").select("doc.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text without the passages of 50 bytes or more that an earlier document has too; what is left empty goes.

    Earlier is by id; rows with null ids come last, and of those and of rows with equal ids each
    counts as a document of its own. Null, empty and other texts without a repeat stay as they
    are; an empty table gives no rows. n_chars becomes the new length where a text was cut, and
    broken characters at a cut become U+FFFD.
    """
    others = [F.col(c) for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", "text", F.struct(F.struct(*others).alias("doc"), F.col("text").isNull().alias("no_text")).alias("rest"))
    cut = suffix_dedup.remove_repeats(simhash_bk.told_apart(rows), id_col="row")
    whole = F.when(~F.col("rest.no_text"), F.col("kept").cast("string"))
    text = F.when(F.size("spans") > 0, F.make_valid_utf8(F.col("kept").cast("string"))).otherwise(whole)
    found = cut.select((F.size("spans") > 0).alias("cut"), text.alias("text"), F.col("rest.doc").alias("doc")).where("NOT cut OR text RLIKE '\\\\S'")
    new = {"text": F.col("text"), "n_chars": F.when(F.col("cut"), F.length("text").cast("long")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: its epochs, and once more if half of it or more is in the fraction.

    Documents without words (null or empty texts) come once for each whole epoch, and never for a
    fraction; a null source is a source of its own; null and repeated ids and repeated rows are taken by their own sizes; an empty table
    gives no rows.
    """
    found = mixing.mix(docs.select("doc_id", "source", "text", F.struct("*").alias("doc")))
    part = F.col("taken") - F.col("epochs") * F.col("size")
    copies = F.col("epochs") + ((part > 0) & (2 * part >= F.col("size"))).cast("long")
    return found.withColumn("copies", copies).where("copies > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies")))
    ).select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 2048 tokens.

    Null and empty texts are the end id alone; null and repeated ids and repeated rows are packed
    like any other; an empty table gives no rows; further columns are ignored.
    """
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]

#: The first two stages have no SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces. What a stage wrote for its own use goes when its result is written, and that when the next one's is."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        erase(docs)
        docs = note(spark.read.parquet(path), path)
    return docs
