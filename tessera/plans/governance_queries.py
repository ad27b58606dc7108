"""Queries on text governance, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import with_normalised
from ..operators import governance as G
from ..operators import sessions as S
from ..sources.files import read_table
from . import views as V

PLACE = f"(conv_id + turn) % {len(V.MARKS)}"


def by_place(values) -> str:
    return f"CASE {PLACE} " + " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(values)) + " END"


LEVEL_SQL, MARK_SQL = by_place(lv for _, lv, _ in V.MARKS), by_place(m for m, _, _ in V.MARKS)
TAILED = "CASE WHEN (conv_id + turn) % 3 = 0 THEN '{}' ELSE '' END"
GATED_SQL = f"""g AS (SELECT conv_id, turn, text, {MARK_SQL} || text || {TAILED.format(V.TAIL)} AS marked, {MARK_SQL} || text || {TAILED.format(V.TAIL_MASKED)} AS masked, {LEVEL_SQL} AS level,
  least(2, coalesce(CAST(c_custkey % 5 AS INT), 2)) AS max_level FROM conversations LEFT JOIN customer ON c_custkey = conv_id % 50)"""
NAME_SQL = "CASE level " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(G.LEVELS)) + " END"


def c1(spark, sf):
    d = G.classify(V.messages(spark, sf))
    return d.select("conv_id", "turn", "level", F.array_join("markings", "|").alias("markings"))


C1_SQL = f"SELECT conv_id, turn, {LEVEL_SQL} AS level, {by_place(found for _, _, found in V.MARKS)} AS markings FROM conversations"


def c3(spark, sf):
    names = list(G.ALIASES)
    d = read_table(spark, sf, "part").select("p_partkey", F.element_at(F.array(*[F.lit(x) for x in [*names, "?"]]), (F.col("p_partkey") % (len(names) + 1) + 1).cast("int")).alias("v"))
    return G.parse_level(d, "v").select("p_partkey", "v", "level")


C3_SQL = (
    "SELECT p_partkey, v, CASE v " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in G.ALIASES.items()) + " END AS level FROM (SELECT p_partkey, ["
    + ", ".join(f"'{k}'" for k in [*G.ALIASES, "?"]) + f"][CAST(p_partkey % {len(G.ALIASES) + 1} + 1 AS INT)] AS v FROM part)"
)


def c4(spark, sf):
    d = G.gate(G.classify(V.messages(spark, sf)), V.users(spark, sf), 2)
    return d.select("conv_id", "turn", "level", "max_level", "blocked")


#: Questions, and whether they only ask what a grade means.
ASKED = (
    ("II급 비밀이 뭐야?", True), ("I급 비밀과 II급 비밀 차이", True), ("SECRET의 정의", True), ("군사기밀이란?", True), ("II급 비밀 문서 요약해 줘", False), ("Ⅲ급 비밀은 무엇인가요?", True),
    ("CONFIDENTIAL 자료를 보내줘", False), ("TOP SECRET 의미", True), ("", False), ("비밀이 뭐야", False),
)
#: What is masked, alone and in what is no match, and what is left (reference rows of the rules).
MASKS = (
    ("집결지 37.5665N 126.9780E 로 이동", "집결지 [좌표] 로 이동"), ("버전 10.1.2.3 릴리스 노트", "버전 10.1.2.3 릴리스 노트"), ("오차 0.001, 0.002", "오차 0.001, 0.002"), ("FY24-12345 예산", "FY24-12345 예산"),
    ("내 번호는 010-1234-5678 이야", "내 번호는 [휴대전화] 이야"), ("tel 02)123-4567", "tel [전화번호]"), ("no. 900101-1234567", "no. [주민등록번호]"), ("a@b.com 10.1.2.3, 192.168.0.1 999", "[이메일] [내부IP], [내부IP] 999"),
    ("host 10.1.2.300", "host 10.1.2.300"), ("at 52S CG 12345 67890", "at [좌표]"), ("at 99S CG 12345 67890", "at 99S CG 12345 67890"), ("at 51S CG 12345 67890", "at 51S CG 12345 67890"), ("at 37.5665, 126.9780", "at [좌표]"),
    ("at 95.1234, 45.6789, 120.4567", "at 95.1234, 45.6789, 120.4567"), ("at 37.5665 126.9780", "at [좌표]"), ("no. 24-12345678", "no. [군번]"), ("펌웨어: 10.2.3.4 그리고 10.2.3.4", "펌웨어: 10.2.3.4 그리고 [내부IP]"),
    ("at 52S CG 1234567", "at 52S CG 1234567"), ("at 90.000, 180.000", "at [좌표]"), ("at 90.001, 100.000", "at 90.001, 100.000"),
)
DIGITS, WIDE = "0123456789", "０１２３４５６７８９"


def listed(spark, sf, rows, name: str):
    """part with a text from a short list by its key."""
    n = F.element_at(F.array(*[F.lit(t) for t, _ in rows]), (F.col("p_partkey") % len(rows) + 1).cast("int"))
    return read_table(spark, sf, "part").select("p_partkey", n.alias(name))


def listed_sql(values) -> str:
    values = list(values)
    quoted = [str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" for v in values]
    return f"CASE p_partkey % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(quoted)) + " END"


def c2(spark, sf):
    d = with_normalised(listed(spark, sf, ASKED, "q"), "q", "view")
    return d.select("p_partkey", G.is_concept_question(F.col("view")).alias("asks"))


def c5_rows(spark, sf):
    """Texts of every rule, between the part's name and brand."""
    d = listed(spark, sf, MASKS, "t").join(read_table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey")
    return G.mask(d.withColumn("text", F.concat("t", F.lit(" | "), "p_brand"))).select("p_partkey", "masked", F.col("mask_total").cast("long").alias("mask_total"))


def c6(spark, sf):
    """The same with digits in full width: masked by what they count as, in the text as it is."""
    d = listed(spark, sf, MASKS, "t").withColumn("text", F.translate("t", DIGITS, WIDE))
    return G.mask(d).select("p_partkey", "masked")


def c5(spark, sf):
    """All rules over all documents."""
    return G.mask(read_table(spark, sf, "documents")).select("doc_id", F.col("mask_total").cast("long").alias("mask_total"), F.md5("masked").alias("masked_md5"))


def c5_email(spark, sf):
    rule = next(r for r in G.RULES if r.label == "이메일")
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", F.md5(F.regexp_replace("text", G.UNICODE + rule.pattern, f"[{rule.label}]")).alias("masked_md5"))


def c7(spark, sf):
    return G.mask_totals(G.mask(read_table(spark, sf, "documents"))).select("label", F.col("n").cast("long").alias("n"))


C7_SQL = r"""WITH m AS (SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '@@', 'g') AS t,
    len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS e FROM documents)
SELECT label, CAST(n AS BIGINT) AS n FROM (SELECT '이메일' AS label, sum(e) AS n FROM m
  UNION ALL SELECT '내부IP', sum(len(list_filter(regexp_extract_all(t, '\b(?:10\.\d{1,3}|172\.(?:1[6-9]|2\d|3[01])|192\.168)\.\d{1,3}\.\d{1,3}\b'),
    lambda a: list_max(list_transform(string_split(a, '.'), lambda o: CAST(o AS INT))) <= 255))) FROM m) WHERE n > 0"""


#: Documents hold e-mail addresses and internal addresses only; other labels would show as a difference.
C5_SQL = r"""WITH m AS (SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[이메일]', 'g') AS t FROM documents),
i AS (SELECT doc_id, regexp_replace(t, '\b(?:10\.OCTET|172\.(?:1[6-9]|2\d|3[01])|192\.168)\.OCTET\.OCTET\b', '[내부IP]', 'g') AS t FROM m)
SELECT doc_id, CAST(len(regexp_extract_all(t, '[[](이메일|내부IP)[]]')) AS BIGINT) AS mask_total, md5(t) AS masked_md5 FROM i""".replace("OCTET", r"(?:25[0-5]|2[0-4]\d|[01]?\d{1,2})")


def governed(spark, sf):
    return G.govern(V.messages(spark, sf), V.users(spark, sf), 2)


def c8(spark, sf):
    a = governed(spark, sf)[2]
    return a.select("session_id", "user_id", "event", "input_sha256", "input_chars", "classification", "detail")


C8_SQL = f"""WITH {GATED_SQL} SELECT 's' || conv_id AS session_id, 'u' || (conv_id % 50) AS user_id, CASE WHEN level > max_level THEN 'blocked' ELSE 'chat' END AS event,
  sha256(trim(marked)) AS input_sha256, CAST(length(trim(marked)) AS BIGINT) AS input_chars, {NAME_SQL} AS classification,
  CASE WHEN level > max_level THEN 'classification_marking' END AS detail FROM g"""


def c9(spark, sf):
    passed, blocked, _ = governed(spark, sf)
    out = passed.select("conv_id", "turn", F.lit("passed").alias("sink"), F.md5("masked").alias("masked_md5"), F.col("mask_total").cast("long").alias("mask_total"))
    return out.union(blocked.select("conv_id", "turn", F.lit("blocked"), F.lit(None).cast("string"), F.lit(0).cast("long")))


C9_SQL = f"""WITH {GATED_SQL} SELECT conv_id, turn, CASE WHEN level > max_level THEN 'blocked' ELSE 'passed' END AS sink, CASE WHEN level <= max_level THEN md5(masked) END AS masked_md5,
  CAST(CASE WHEN level <= max_level AND (conv_id + turn) % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS mask_total FROM g"""


def u11(spark, sf):
    a = governed(spark, sf)[2].withColumn("input_tokens", F.col("input_chars")).withColumn("output_tokens", F.lit(None).cast("long"))
    return S.audit_rollup(a, "user_id", "classification")


U11_SQL = f"""WITH {GATED_SQL} SELECT 'u' || (conv_id % 50) AS user_id, {NAME_SQL} AS classification, count(*) AS records, round(avg(CAST(level > max_level AS INT)), 6) AS blocked_rate,
  CAST(sum(length(trim(marked))) AS BIGINT) AS input_tokens, CAST(NULL AS BIGINT) AS output_tokens, CAST(NULL AS BIGINT) AS cache_read_tokens, CAST(NULL AS BIGINT) AS cache_creation_tokens FROM g GROUP BY ALL"""


def u11_views(spark, sf):
    """All views of the audit trail; its days and tools follow from the lengths of the messages."""
    size = F.col("input_chars")
    tools = F.when(size % 4 == 0, F.array(F.lit("search"), F.lit("search"), F.lit("glossary"))).when(size % 4 == 1, F.array(F.lit("search")))
    day = F.make_timestamp(F.lit(2024), F.lit(1), (1 + size % 3).cast("int"), F.lit(12), F.lit(0), F.lit(0))
    a = governed(spark, sf)[2].withColumns({"timestamp": day, "tools_called": tools, "input_tokens": size.cast("long")})
    return S.audit_views(a).select("view", "day", "event", "user_id", "classification", "key", "records", "blocked_rate", "input_tokens", "output_tokens", "times")


U11_VIEWS_SQL = f"""WITH {GATED_SQL}, a AS (SELECT 'u' || (conv_id % 50) AS user_id, {NAME_SQL} AS classification, CASE WHEN level > max_level THEN 'blocked' ELSE 'chat' END AS event,
  length(trim(marked)) AS size, DATE '2024-01-01' + CAST(length(trim(marked)) % 3 AS INT) AS day, level <= max_level AND (conv_id + turn) % 3 = 0 AS masked FROM g),
v AS (SELECT CASE GROUPING(day, event, user_id, classification) WHEN 15 THEN 'all' WHEN 7 THEN 'day' WHEN 3 THEN 'day and event' WHEN 11 THEN 'event' WHEN 13 THEN 'user' WHEN 12 THEN 'user and label' WHEN 14 THEN 'label' END AS view,
  day, event, user_id, classification, CAST(NULL AS VARCHAR) AS key, count(*) AS records, round(avg(CAST(was AS INT)), 6) AS blocked_rate, CAST(sum(size) AS BIGINT) AS input_tokens FROM (SELECT *, event = 'blocked' AS was FROM a)
  GROUP BY GROUPING SETS ((), (day), (day, event), (event), (user_id), (user_id, classification), (classification)))
SELECT *, CAST(NULL AS BIGINT) AS output_tokens, CAST(NULL AS BIGINT) AS times FROM v
UNION ALL SELECT 'tool', NULL, NULL, NULL, NULL, key, count(*), NULL, NULL, NULL, CAST(sum(n) AS BIGINT) FROM (
  SELECT 'search' AS key, CASE WHEN size % 4 = 0 THEN 2 ELSE 1 END AS n FROM a WHERE size % 4 < 2 UNION ALL SELECT 'glossary', 1 FROM a WHERE size % 4 = 0) GROUP BY key
UNION ALL SELECT 'redaction', NULL, NULL, NULL, NULL, key, count(*), NULL, NULL, NULL, count(*) FROM a, (SELECT unnest(['휴대전화', '이메일']) AS key) WHERE masked GROUP BY key"""


def c6_documents(spark, sf):
    """All documents in other characters: full width forms, dashes, or an invisible sign after each @; an ellipsis and a curly quote at the end."""
    d = read_table(spark, sf, "documents")
    odd = F.when(F.col("doc_id") % 3 == 0, F.translate("text", ODD_FROM, ODD_TO)).when(F.col("doc_id") % 3 == 1, F.replace("text", F.lit("@"), F.lit("@\u200b"))).otherwise(F.col("text"))
    m = G.mask(d.select("doc_id", F.concat(odd, F.lit(" …’")).alias("text")))
    return m.select("doc_id", F.col("mask_total").cast("long").alias("mask_total"), F.md5("masked").alias("masked_md5"))


#: What masks leave, in the characters that the documents of c6_documents are written in.
ODD_FROM, ODD_TO = DIGITS + "-.", WIDE + "–．"
C6_DOCUMENTS_SQL = (
    C5_SQL.rsplit("SELECT doc_id, CAST(len", 1)[0]
    + f"""SELECT doc_id, CAST(len(regexp_extract_all(t, '[[](이메일|내부IP)[]]')) AS BIGINT) AS mask_total,
md5(CASE doc_id % 3 WHEN 0 THEN translate(t, '{ODD_FROM}', '{ODD_TO}') WHEN 1 THEN replace(t, '@', '@' || chr(8203)) ELSE t END || ' …’') AS masked_md5 FROM i"""
)


def s9(spark, sf):
    e = read_table(spark, sf, "events").select(F.col("event_id").alias("session_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("event"))
    return S.last_audit(e, 5000).select("session_id", "event")


SINKS_SQL = f"WITH {GATED_SQL} SELECT conv_id, turn, CASE WHEN level > max_level THEN 'blocked' ELSE 'passed' END AS sink FROM g"

QUERIES = {
    "c1_markings": (c1, C1_SQL),
    "c2_concept_questions": (c2, f"SELECT p_partkey, {listed_sql(a for _, a in ASKED)} AS asks FROM part"),
    "c5_masked_rows": (c5_rows, f"SELECT p_partkey, {listed_sql(m for _, m in MASKS)} || ' | ' || p_brand AS masked, CAST(len(regexp_extract_all({listed_sql(m for _, m in MASKS)}, '[[][^]]+[]]')) AS BIGINT) AS mask_total FROM part"),
    "c6_odd_texts": (c6, f"SELECT p_partkey, translate({listed_sql(m for _, m in MASKS)}, '{DIGITS}', '{WIDE}') AS masked FROM part"),
    "c3_level_aliases": (c3, C3_SQL),
    "c4_clearance_gate": (c4, f"WITH {GATED_SQL} SELECT conv_id, turn, level, max_level, level > max_level AS blocked FROM g"),
    "c5_masking": (c5, C5_SQL),
    "c5_email_masking": (c5_email, r"SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[이메일]', 'g')) AS masked_md5 FROM documents"),
    "c7_mask_totals": (c7, C7_SQL),
    "c8_audit_records": (c8, C8_SQL),
    "c9_governance_pass": (c9, C9_SQL),
    "u11_audit_rollup": (u11, U11_SQL),
    "u11_audit_views": (u11_views, U11_VIEWS_SQL),
    "c6_odd_documents": (c6_documents, C6_DOCUMENTS_SQL),
    "s9_last_audit": (s9, "SELECT event_id AS session_id, event_type AS event FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000"),
}
