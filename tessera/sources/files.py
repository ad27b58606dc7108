"""Sources and sinks: corpora, cases, dictionaries, audit logs and reports, read and written by Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import erase, small, written

CASE = "id string, question string, expected_refs array<string>, expected_keywords array<string>, forbidden array<string>, blocked boolean, category string, note string"
#: Tables whose rows take long.
TEXTS = ("documents", "pages", "conversations")
# The fields of an audit record.
AUDIT = (
    "session_id string, user_id string, event string, input_sha256 string, input_chars bigint, classification string, redactions map<string,int>, "
    "tools_called array<string>, model string, served_by string, stop_reason string, input_tokens bigint, output_tokens bigint, "
    "cache_read_tokens bigint, cache_creation_tokens bigint, output_sha256 string, output_chars bigint, detail string, timestamp timestamp"
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that comes in fewer pieces than there are cores (so a small one) is spread over them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and df.rdd.getNumPartitions() < cores else df


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): each file as one text, a byte-order mark taken off."""
    d = spark.read.format("binaryFile").load(path)
    return d.select("path", F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^﻿", "").alias("content"))


def _file_lines(spark: SparkSession, path: str) -> DataFrame:
    return _whole(spark, path).select("path", F.posexplode(F.split("content", r"\r\n|\n|\r")).alias("pos", "line")).select("path", (F.col("pos") + 1).alias("line_no"), "line")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of text files, read as splits of bounded size: a number is its place in its split after the lines of the splits before."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"),
        F.make_valid_utf8("value").alias("line"),
    )
    place = F.row_number().over(Window.partitionBy("path", "at").orderBy("id"))
    held = raw.groupBy("path", "at").agg(F.count("*").alias("n"))  # one row for each split
    before = held.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return raw.withColumn("place", place).join(before.drop("n"), ["path", "at"]).select("path", (F.col("before") + F.col("place")).alias("line_no"), "line")


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, source, content) of *.md and *.txt below a folder; files that are not UTF-8 are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").load(folder)
    good = found.where(F.is_valid_utf8(F.col("content").cast("string")))
    root = F.regexp_replace(F.lit(folder.rstrip("/")), r"^file:/*", "/")
    path = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"^[a-z]+:/*", "/")
    return good.select(
        F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1).alias("doc_id"),
        F.regexp_replace(F.substring(path, F.length(root) + 1, F.length(path)), "^/+", "").alias("source"),
        F.regexp_replace(F.col("content").cast("string"), "^﻿", "").alias("content"),
    )


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON-lines file: blank lines and comments skipped, unknown keys dropped, ids q001, q002, … where missing.

    Raises ValueError for broken lines, missing questions, ids that repeat, or no case at all.
    """
    lines = _file_lines(spark, path).withColumn("line", F.trim("line")).where("line <> '' AND NOT line LIKE '#%'")
    parsed = lines.withColumn("c", F.from_json("line", CASE + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})).select("line_no", "c.*")
    # A case file is one file: its cases are numbered in one window.
    numbered = parsed.withColumn("n", F.row_number().over(Window.orderBy("line_no")))
    cases = numbered.select(
        "line_no", F.coalesce("id", F.format_string("q%03d", "n")).alias("case_id"), "question",
        *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("expected_refs", "expected_keywords", "forbidden")],
        F.coalesce("blocked", F.lit(False)).alias("blocked"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("note", F.lit("")).alias("note"), "_bad",
    )
    n, bad, blank, ids = cases.agg(
        F.count("*"), F.min(F.when(F.col("_bad").isNotNull(), F.col("line_no"))), F.min(F.when(F.col("question").isNull(), F.col("line_no"))), F.countDistinct("case_id")
    ).first()
    if bad is not None:
        raise ValueError(f"{path}, line {bad}: no JSON object")
    if blank is not None:
        raise ValueError(f"{path}, line {blank}: no question")
    if not n:
        raise ValueError(f"{path}: no cases")
    if ids != n:
        raise ValueError(f"{path}: an id occurs twice")
    return cases.drop("_bad")


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(pos, term, full, ko, desc) of a JSON object of objects; entries that are none, or empty, are left out; a broken file is empty."""
    each = _whole(spark, path).select(F.from_json("content", "map<string,string>").alias("m")).select(F.posexplode("m").alias("pos", "term", "raw"))
    e = each.withColumn("e", F.from_json("raw", "full string, ko string, desc string")).where(F.trim("raw").startswith("{"))
    fields = [F.coalesce(F.col(f"e.{f}"), F.lit("")).alias(f) for f in ("full", "ko", "desc")]
    return e.select("pos", "term", *fields).where("full <> '' OR ko <> '' OR `desc` <> ''")


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, words) of a JSON object head: [words] or head: word; a broken file is empty, another kind of JSON an error."""
    text = _whole(spark, path)
    kind = text.select(F.left(F.trim("content"), F.lit(1))).first()
    if kind is not None and kind[0] == "[":
        raise ValueError(f"{path}: not an object of words")
    each = text.select(F.from_json("content", "map<string,string>").alias("m")).select(F.posexplode("m").alias("group_id", "head", "raw"))
    words = F.coalesce(F.when(F.trim("raw").startswith("["), F.from_json("raw", "array<string>")), F.array("raw"))
    return each.select("group_id", F.concat(F.array("head"), words).alias("words"))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit records of JSON lines; a line that is no object stays, as event `corrupt` with its number and first 200 characters."""
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    parsed = lines.withColumn("r", F.from_json("line", AUDIT + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r._bad").isNotNull() | F.col("r").isNull() | ~F.trim("line").startswith("{")
    names = [c.split()[0] for c in AUDIT.split(", ") if " " in c]
    return parsed.select(
        "line_no",
        *[F.when(bad, "corrupt").otherwise(F.col("r.event")).alias("event") if n == "event" else F.when(~bad, F.col(f"r.{n}")).alias(n) for n in names],
        F.when(bad, F.left("line", F.lit(200))).alias("raw"),
    )


def append_audit(records: DataFrame, path: str) -> None:
    """Append records as JSON lines. Files appear whole or not at all, so no line is ever cut."""
    records.write.mode("append").json(path)


def write_corpus(docs: DataFrame, path: str, mode: str = "skip") -> DataFrame:
    """Write documents (doc_id, content); mode skip leaves known ids alone, overwrite replaces them, dry_run writes nothing.

    Each doc_id is taken once. Returns (doc_id, status): ok, skipped or failed (no content).
    """
    spark = docs.sparkSession
    once = docs.groupBy("doc_id").agg(F.min("content").alias("content"))
    try:
        known = spark.read.parquet(path).select("doc_id", "content")
        known.first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = spark.createDataFrame([], once.schema)
    there = known.select("doc_id", F.lit(True).alias("known"))
    status = F.when(F.col("content").isNull(), "failed").when(F.lit(mode == "skip") & F.col("known").isNotNull(), "skipped").otherwise("ok")
    judged = once.join(there, "doc_id", "left").withColumn("status", status)
    if mode == "dry_run":
        return judged.select("doc_id", "status")
    # Read twice below: docs, which may take long and fill disks with shuffles, are made once.
    told = written(judged.select("doc_id", "status", F.when(F.col("status") == "ok", F.col("content")).alias("content")), "judged")
    new = told.where("status = 'ok'").select("doc_id", "content")
    result = told.select("doc_id", "status").checkpoint()
    if mode == "overwrite":
        replace_folder(known.join(small(new.select("doc_id"), 40), "doc_id", "left_anti").unionByName(new), path)
    else:
        new.write.mode("append").parquet(path)
    erase(told)
    return result


def replace_folder(df: DataFrame, path: str) -> None:
    """Write df beside path, then put it in its place: a failure leaves the old rows, here or beside, and df may read them."""
    spark = df.sparkSession
    sc = spark.sparkContext
    of = sc._jvm.org.apache.hadoop.fs.Path
    aside, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    df.write.parquet(aside)
    fs = of(path).getFileSystem(sc._jsc.hadoopConfiguration())
    if fs.exists(of(path)) and not fs.rename(of(path), of(old)):
        raise OSError(f"{path} cannot be moved")
    if not fs.rename(of(aside), of(path)):
        fs.rename(of(old), of(path))
        raise OSError(f"{aside} cannot be put in the place of {path}")
    fs.delete(of(old), True)
    spark.catalog.refreshByPath(path)


def write_markdown(sections: DataFrame, titles: DataFrame, path: str, mode: str = "skip") -> DataFrame:
    """Structured documents (doc_id, section_no, section, paragraphs; titles: doc_id, title and perhaps meta) as Markdown into a corpus; returns (doc_id, status)."""
    from ..operators.structure import markdown

    return write_corpus(markdown(sections, titles), path, mode)


def save_report(results: DataFrame, path: str, run_id: str, kind: str) -> None:
    """Keep the rows of a run below path/kind/run_id=…"""
    results.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{path}/{kind}")


def load_report(spark: SparkSession, path: str, run_id: str, kind: str, columns: tuple[str, ...]) -> DataFrame:
    d = spark.read.parquet(f"{path}/{kind}")
    missing = [c for c in columns if c not in d.columns]
    if missing:
        raise ValueError(f"{path}/{kind} is no report: it lacks {', '.join(missing)}")
    return d.where(F.col("run_id") == run_id)
