"""Queries on sources, sinks and the streams that keep tables: given rows are written, read back and compared with themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import governance as G
from ..operators import sessions as S
from ..operators import structure as D
from ..sources import files as X
from ..sources.files import read_table
from ..sources.shared import fresh_path
from ..streaming import streams as ST
from . import views as V
from .governance_queries import GATED_SQL
from .session_queries import LOCKOUT_SQL
from .structure_queries import D12_SQL, numbered_paragraphs
from .text_queries import INDEX_SQL


def as_files(spark: SparkSession, rows: DataFrame, folder: str) -> None:
    """A short table (path, content) as files below folder."""
    sc = spark.sparkContext
    for r in rows.collect():
        place = sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/{r['path']}")
        out = place.getFileSystem(sc._jsc.hadoopConfiguration()).create(place)
        out.write(bytearray(r["content"].encode()))
        out.close()


def s1(spark, sf):
    """nation as a folder of Markdown and text files, one below another folder for each region."""
    n = read_table(spark, sf, "nation")  # 25 rows at any size
    kind = F.when(F.col("n_nationkey") % 2 == 0, ".md").otherwise(".txt")
    rows = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/"), F.lower("n_name"), kind).alias("path"), F.concat(F.lit("﻿# "), "n_name", F.lit("\n\ntext")).alias("content"))
    folder = fresh_path(spark, "corpus")
    as_files(spark, rows, folder)
    return X.read_corpus(spark, folder).select("doc_id", "source", F.md5("content").alias("content_md5"))


S1_SQL = """SELECT lower(n_name) AS doc_id, 'r' || n_regionkey || '/' || lower(n_name) || CASE WHEN n_nationkey % 2 = 0 THEN '.md' ELSE '.txt' END AS source,
  md5('# ' || n_name || chr(10) || chr(10) || 'text') AS content_md5 FROM nation"""


def s2(spark, sf):
    """The passages as evaluation cases in JSON lines, some with fewer fields."""
    b = read_table(spark, sf, "benchmark").select(
        F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("question"),
        F.when(F.col("item_id") % 2 == 0, F.array("text", F.lit("other"))).alias("expected_refs"), F.when(F.col("item_id") % 5 == 0, True).alias("blocked"),
        F.when(F.col("item_id") % 3 == 0, "third").alias("category"), F.lit("x").alias("not_a_field"),
    )
    path = fresh_path(spark, "cases")
    b.write.json(path)
    return X.read_cases(spark, path).select("case_id", F.md5("question").alias("question_md5"), F.size("expected_refs").cast("long").alias("n_refs"), "blocked", "category")


S2_SQL = """SELECT 'c' || item_id AS case_id, md5(text) AS question_md5, CAST(CASE WHEN item_id % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_refs, item_id % 5 = 0 AS blocked,
  CASE WHEN item_id % 3 = 0 THEN 'third' ELSE '' END AS category FROM benchmark"""


def s3(spark, sf):
    """nation as a glossary in JSON; every fifth entry is empty and left out."""
    n = read_table(spark, sf, "nation")
    entry = F.when(F.col("n_nationkey") % 5 == 4, F.lit("{}")).otherwise(F.to_json(F.struct(F.lower("n_name").alias("full"), F.col("n_regionkey").cast("string").alias("ko"))))
    pairs = F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat(F.to_json(F.array("n_name")), F.lit("|"), entry).alias("e"))))["e"]
    text = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.regexp_replace(e, r'^\[(.*?)\]\|', "$1: ")), ", "), F.lit("}"))
    path = fresh_path(spark, "glossary")
    n.agg(text.alias("value")).coalesce(1).write.text(path)
    return X.read_glossary(spark, path).select(F.col("pos").cast("long").alias("pos"), "term", "full", "ko", "desc")


S3_SQL = """SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS pos, n_name AS term, lower(n_name) AS "full", CAST(n_regionkey AS VARCHAR) AS ko, '' AS "desc"
FROM nation QUALIFY n_nationkey % 5 <> 4"""


def s4(spark, sf):
    """The regions' nations as synonyms in JSON."""
    r = read_table(spark, sf, "nation").groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list(F.lower("n_name")))).alias("words"))
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_regionkey", "words"))), lambda x: F.concat(F.lit('"R'), x["n_regionkey"].cast("string"), F.lit('": '), x["words"])), ", "), F.lit("}"))
    path = fresh_path(spark, "synonyms")
    r.agg(text.alias("value")).coalesce(1).write.text(path)
    return X.read_synonyms(spark, path).select(F.col("group_id").cast("long").alias("group_id"), F.array_join("words", "|").alias("words"))


S4_SQL = """SELECT CAST(n_regionkey AS BIGINT) AS group_id, 'R' || n_regionkey || '|' || string_agg(lower(n_name), '|' ORDER BY lower(n_name)) AS words FROM nation GROUP BY n_regionkey"""


def events_as_audit(spark, sf):
    return read_table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("session_id"), F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("event"),
        F.col("event_id").alias("input_chars"), F.create_map(F.lit("이메일"), (F.col("event_id") % 3).cast("int")).alias("redactions"), F.col("ts").cast("timestamp").alias("timestamp"),
    )


def s5(spark, sf):
    """Events as an audit log of JSON lines; every seventh line is broken, and named as such when read."""
    a = events_as_audit(spark, sf)
    line = F.to_json(F.struct("session_id", "user_id", "event", "input_chars", "redactions"))
    path = fresh_path(spark, "log")
    a.select(F.when(F.col("input_chars") % 7 == 0, F.concat(F.lit("{"), "session_id")).otherwise(line).alias("value")).write.text(path)
    return X.read_audit(spark, path).select("event", "session_id", "input_chars", F.element_at("redactions", "이메일").cast("long").alias("masked"), "raw")


S5_SQL = """SELECT CASE WHEN event_id % 7 = 0 THEN 'corrupt' ELSE event_type END AS event, CASE WHEN event_id % 7 <> 0 THEN CAST(event_id AS VARCHAR) END AS session_id,
  CASE WHEN event_id % 7 <> 0 THEN event_id END AS input_chars, CASE WHEN event_id % 7 <> 0 THEN event_id % 3 END AS masked, CASE WHEN event_id % 7 = 0 THEN '{' || event_id END AS raw FROM events"""


def s6(spark, sf):
    """Events appended to an audit log in two parts, and read with their line numbers: as many, and all different in a file."""
    a, path = events_as_audit(spark, sf), fresh_path(spark, "log")
    for i in (0, 1):
        X.append_audit(a.where(F.col("input_chars") % 2 == i), path)
    d = X.read_audit(spark, path)
    return d.groupBy("event").agg(F.count("*").alias("n"), F.sum("input_chars").alias("chars"), F.min("session_id").alias("first"), F.countDistinct("timestamp").alias("times"))


S6_SQL = """SELECT event_type AS event, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS chars, min(CAST(event_id AS VARCHAR)) AS first, count(DISTINCT date_trunc('millisecond', ts)) AS times FROM events GROUP BY event_type"""


def s7(spark, sf):
    """Documents written, then written again: what is known is skipped, then overwritten."""
    d = read_table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 11 != 0, F.col("text")).alias("content"))
    path = fresh_path(spark, "store")
    first = X.write_corpus(d.where("doc_id % 3 <> 0"), path)
    second = X.write_corpus(d.withColumn("content", F.concat("content", F.lit("!"))), path)
    X.write_corpus(d.where("doc_id % 5 = 0").withColumn("content", F.concat(F.lit("*"), "content")), path, "overwrite")
    kept = spark.read.parquet(path).select(F.col("doc_id").alias("k"), F.md5("content").alias("content_md5"))
    status = second.select("doc_id", "status").join(first.select("doc_id", F.col("status").alias("first")), "doc_id", "left")
    return status.join(kept, status.doc_id == kept.k, "left").select("doc_id", "first", "status", "content_md5")


def s7_markdown(spark, sf):
    """Structured documents written as Markdown with their front matter, twice, and read as sections again."""
    p = numbered_paragraphs(spark, sf)
    none = [F.lit("").alias(k) for k in ("category", "effective_date", "version")]
    named = F.concat(F.lit("Document "), F.col("doc_id").cast("string"))
    meta = F.struct(
        named.alias("title"), *none, F.lit("s.txt").alias("source_file"), F.array(F.lit("x")).alias("tags"), F.create_map().cast("map<string,string>").alias("extra")
    )
    titles = read_table(spark, sf, "documents").select("doc_id", named.alias("title"), meta.alias("meta"))
    path = fresh_path(spark, "store")
    sections = D.structured(p, D.document_modes(p))
    X.write_markdown(sections, titles, path)
    X.write_markdown(sections.where("doc_id % 2 = 0"), titles.where("doc_id % 2 = 0"), path, "overwrite")
    d = spark.read.parquet(path)
    return d.select("doc_id", F.md5("content").alias("content_md5"))


S7_MARKDOWN_SQL = D12_SQL.rsplit("SELECT doc_id, section_no, coalesce(max(name), '') AS section, count(said)", 1)[0] + """SELECT doc_id,
  md5('---' || chr(10) || 'title: Document ' || doc_id || chr(10) || 'source_file: s.txt' || chr(10) || 'tags: x' || chr(10) || '---' || chr(10) || '# Document ' || doc_id || chr(10) || chr(10)
    || coalesce(string_agg(block, chr(10) || chr(10) ORDER BY section_no, part, pos), '') || chr(10)) AS content_md5 FROM documents LEFT JOIN (
  SELECT doc_id, section_no, 0 AS part, 0 AS pos, '## ' || max(name) AS block FROM x GROUP BY doc_id, section_no HAVING max(name) <> ''
  UNION ALL SELECT doc_id, section_no, 1, pos, said FROM x WHERE said IS NOT NULL) USING (doc_id) GROUP BY doc_id"""


S7_SQL = """SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'ok' END END AS first,
  CASE WHEN doc_id % 11 = 0 THEN 'failed' WHEN doc_id % 3 <> 0 THEN 'skipped' ELSE 'ok' END AS status,
  CASE WHEN doc_id % 11 <> 0 THEN md5(CASE WHEN doc_id % 5 = 0 THEN '*' || text WHEN doc_id % 3 <> 0 THEN text ELSE text || '!' END) END AS content_md5 FROM documents"""


def s8(spark, sf):
    """Labels kept as the rows of two runs, one of them read back."""
    d, path = read_table(spark, sf, "labels"), fresh_path(spark, "reports")
    X.save_report(d, path, "one", "labels")
    X.save_report(d.where("quality = 1"), path, "two", "labels")
    return X.load_report(spark, path, "two", "labels", ("doc_id", "quality")).select("doc_id", "toxic", "run_id")


def st5(spark, sf):
    """Changes of sessions as a stream, the latest winning."""
    d = V.sessions(spark, sf).withColumn("updated_at", F.col("updated_at") + F.make_dt_interval(secs=(F.col("o_orderkey") / 1000000).cast("decimal(18,6)")))
    at = fresh_path(spark, "changes")
    d.repartition(3).write.parquet(f"{at}/in")
    ST.upsert_stream(ST.read_stream(spark, f"{at}/in", d.schema), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return ST.latest(spark, f"{at}/out").select("session_id", "username", "title", "turns", "o_orderkey")


ST5_SQL = f"""WITH s AS (SELECT *, updated_at + to_microseconds(o_orderkey) AS moment FROM ({V.SESSIONS_SQL})), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY moment DESC) AS p FROM s)
SELECT session_id, username, title, turns, o_orderkey FROM r WHERE p = 1"""


def st6(spark, sf):
    """Documents as a stream of chunks, indexed as they come, and the index read: postings with what their tokens and the corpus add."""
    at = fresh_path(spark, "index")
    c = V.chunks(spark, sf).select("chunk_id", "title", "section", "tags", "category", "text")
    c.repartition(2).write.parquet(f"{at}/in")
    ST.index_stream(ST.read_stream(spark, f"{at}/in", c.schema), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    i = ST.read_index(spark, f"{at}/out")
    d = i["postings"].join(i["token_stats"], "token").crossJoin(F.broadcast(i["corpus_stats"]))  # one row
    return d.select("token", "chunk_id", "tf", "doc_len", "df", "n", F.round("avg_len", 6).alias("avg_len"))


ST6_SQL = f"WITH {INDEX_SQL} SELECT token, chunk_id, tf, doc_len, df, n, round(avg_len, 6) AS avg_len FROM post JOIN df USING (token), one"


def logins(spark, sf):
    """The attempts of events, judged, with their users and a client."""
    a = V.attempts(spark, sf)
    judged = S.lockouts(a, seconds=864000).select("attempt_id", "locked")
    return a.join(judged, "attempt_id").select(F.col("client_key").alias("username"), F.lit("10.0.0.9").alias("client"), "success", "locked", "ts", "attempt_id")


def c8_logins(spark, sf):
    """The audit rows of logins, counted for each user."""
    d = G.login_audit(logins(spark, sf))
    return d.groupBy("user_id", "event", "detail").agg(F.count("*").alias("n"))


def c8_errors(spark, sf):
    """Conversations whose every fourth turn failed, in the audit trail."""
    m = V.messages(spark, sf).withColumn("error", F.when(F.col("turn") % 4 == 3, "TimeoutError: no answer"))
    return G.split(G.judge(m, V.users(spark, sf), 2))[2].groupBy("event", "detail").agg(F.count("*").alias("n"))


C8_LOGINS_SQL = f"""WITH l AS ({LOCKOUT_SQL}) SELECT CAST(user_id AS VARCHAR) AS user_id, CASE WHEN locked THEN 'login_locked' ELSE 'login_failed' END AS event, 'client=10.0.0.9' AS detail, count(*) AS n
FROM l JOIN events ON event_id = attempt_id WHERE locked OR event_type = 'error' GROUP BY ALL"""
C8_ERRORS_SQL = f"""WITH {GATED_SQL} SELECT CASE WHEN level > max_level THEN 'blocked' WHEN turn % 4 = 3 THEN 'error' ELSE 'chat' END AS event,
  CASE WHEN level > max_level THEN 'classification_marking' WHEN turn % 4 = 3 THEN 'TimeoutError: no answer' END AS detail, count(*) AS n FROM g GROUP BY ALL"""

QUERIES = {
    "s1_read_corpus": (s1, S1_SQL),
    "s2_read_cases": (s2, S2_SQL),
    "s3_read_glossary": (s3, S3_SQL),
    "s4_read_synonyms": (s4, S4_SQL),
    "s5_read_audit": (s5, S5_SQL),
    "s6_append_audit": (s6, S6_SQL),
    "s7_write_corpus": (s7, S7_SQL),
    "s8_reports": (s8, "SELECT doc_id, toxic, 'two' AS run_id FROM labels WHERE quality = 1"),
    "st5_session_stream": (st5, ST5_SQL),
    "s7_markdown_corpus": (s7_markdown, S7_MARKDOWN_SQL),
    "st6_index_stream": (st6, ST6_SQL),
    "c8_login_audit": (c8_logins, C8_LOGINS_SQL),
    "c8_error_audit": (c8_errors, C8_ERRORS_SQL),
}
