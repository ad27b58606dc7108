"""What the registered queries read: the given tables, in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import read_table


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """documents as chunks: their source in the title, their language as section and category."""
    return read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"),
        F.concat(F.lit("Source "), "source").alias("title"), F.upper("lang").alias("section"), F.col("lang").alias("category"),
        F.array("source").alias("tags"), "text", "source", F.lit("2024-01-01").alias("effective_date"), F.lit("").alias("version"),
    )


def passages(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def lines(spark: SparkSession, sf: str, per_page: int = 8) -> DataFrame:
    """documents as lines on pages."""
    d = read_table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return d.select("doc_id", (F.floor(F.col("pos") / per_page) + 1).cast("int").alias("page_no"), (F.col("pos") % per_page).alias("line_no"), "text", "pos")


def numbered_lines(spark: SparkSession, sf: str, per_page: int = 8) -> DataFrame:
    """lines with a page number at the foot of each page."""
    d = lines(spark, sf, per_page).drop("pos")
    foot = d.groupBy("doc_id", "page_no").agg(F.lit(per_page).cast("int").alias("line_no"), F.lit("").alias("text"))
    return d.unionByName(foot.withColumn("text", F.concat(F.lit("- "), F.col("page_no").cast("string"), F.lit(" -"))))


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    """documents as Markdown: front matter, a title, and each fifth line a heading."""
    d = read_table(spark, sf, "documents").where("text IS NOT NULL")
    shown = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 2, F.concat(F.lit("## "), x)).otherwise(x))
    front = F.concat(F.lit("---\ntitle: 'Document "), F.col("doc_id").cast("string"), F.lit("'\ntags: a, b\ncategory: text\n---\n# Head\n"))
    return d.select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source"), F.concat(front, F.array_join(shown, "\n")).alias("content"))


#: The marking that a message gets by its place, the level that it means, and what is found of it.
MARKS = (
    ("", 0, ""), ("대외비 ", 1, "대외비"), ("CONFIDENTIAL//REL ", 2, "CONFIDENTIAL"), ("S//NF ", 3, "S//"), ("II급 비밀 ", 3, "II급 비밀"), ("TOP-SECRET//SI ", 4, "TOP-SECRET"),
    ("군사기밀보호법 ", 0, ""), ("12급 비밀 ", 0, ""), ("Ⅱ급비밀 ", 3, "II급비밀"), ("비밀등급: II급 ", 3, "비밀등급: II급"), ("비밀 (III급) ", 2, "비밀 (III급)"), ("극비 ", 4, "극비"),
    ("극비리에 ", 0, ""), ("RESTRICTED ", 1, "RESTRICTED"), ("FOUO ", 1, "FOUO"), ("FOR OFFICIAL USE ONLY ", 1, "FOR OFFICIAL USE ONLY"), ("(TS) ", 4, "(TS)"), ("C//X ", 2, "C//"),
    ("비밀취급인가 갱신 절차 ", 0, ""), ("CLIENT_SECRET ", 0, ""), ("SECRET ", 3, "SECRET"), ("비밀 문서 ", 2, "비밀 문서"), ("III급 기밀 ", 2, "III급 기밀"), ("", 0, ""),
)
#: What follows every third message, and what is left of it.
TAIL, TAIL_MASKED = " 010-1234-5678 a@b.kr", " [휴대전화] [이메일]"


def marked(c: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as messages, some with a marking in front or a tail."""
    place = F.col("conv_id") + F.col("turn")
    mark = F.element_at(F.array(*[F.lit(m) for m, _, _ in MARKS]), (place % len(MARKS) + 1).cast("int"))
    return c.select(
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), F.concat(F.lit("u"), (F.col("conv_id") % 50).cast("string")).alias("user_id"),
        "conv_id", "turn", F.concat(mark, "text", F.when(place % 3 == 0, TAIL).otherwise("")).alias("text"),
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as messages of customers."""
    return marked(read_table(spark, sf, "conversations"))


def users(spark: SparkSession, sf: str) -> DataFrame:
    """customers as users: their key decides role, clearance and whether they are disabled."""
    return read_table(spark, sf, "customer").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("username"), F.when(F.col("c_custkey") % 10 == 0, "admin").otherwise("user").alias("role"),
        (F.col("c_custkey") % 5).cast("int").alias("clearance"), (F.col("c_custkey") % 7 == 0).alias("disabled"), F.col("c_mktsegment").alias("unit"),
    )


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """orders as sessions of customers."""
    return read_table(spark, sf, "orders").select(
        (F.col("o_orderkey") % 5000).cast("string").alias("session_id"), F.concat(F.lit("u"), (F.col("o_orderkey") % 5000 % 97).cast("string")).alias("username"),
        F.col("o_orderpriority").alias("title"), (F.col("o_orderkey") % 9).alias("turns"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("o_orderkey") % 86400).cast("decimal(18,6)"))).alias("updated_at"), "o_orderkey",
    )


SESSIONS_SQL = """SELECT CAST(o_orderkey % 5000 AS VARCHAR) AS session_id, 'u' || CAST(o_orderkey % 5000 % 97 AS VARCHAR) AS username, o_orderpriority AS title,
  o_orderkey % 9 AS turns, o_orderdate AS created_at, o_orderdate + to_seconds(o_orderkey % 86400) AS updated_at, o_orderkey FROM orders"""


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """events as login attempts: an error is a failure, a signup a success."""
    return read_table(spark, sf, "events").where("event_type IN ('error', 'signup')").select(
        F.col("user_id").cast("string").alias("client_key"), F.col("event_id").alias("attempt_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "signup").alias("success")
    )
