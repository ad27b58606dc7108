"""Queries on corpus structuring, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structure as D
from ..sources.files import read_table
from . import views as V

LINES_SQL = "ln AS (SELECT doc_id, text, pos, pos // 8 + 1 AS page_no, pos % 8 AS line_no FROM (SELECT doc_id, unnest(x) AS text, unnest(range(0, len(x))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)))"
STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def d1(spark, sf):
    """The front matter of the documents as Markdown, and the body without it."""
    d = D.with_front_matter(V.markdown(spark, sf))
    return d.select("doc_id", "meta.title", "meta.category", F.array_join("meta.tags", "|").alias("tags"), F.size(F.map_keys("meta.extra")).cast("long").alias("n_extra"), F.md5("body").alias("body_md5"))


MARKED_SQL = f"{LINES_SQL}, mk AS (SELECT doc_id, pos, CASE WHEN pos % 5 = 2 THEN '## ' || text ELSE text END AS text FROM ln)"
D1_SQL = f"""WITH {MARKED_SQL} SELECT doc_id, 'Document ' || doc_id AS title, 'text' AS category, 'a|b' AS tags, CAST(0 AS BIGINT) AS n_extra,
  md5('# Head' || chr(10) || string_agg(text, chr(10) ORDER BY pos)) AS body_md5 FROM mk GROUP BY doc_id"""


def d2(spark, sf):
    """Front matter read, written again and read again."""
    d = D.with_front_matter(V.markdown(spark, sf)).select("doc_id", D.front_matter_text().alias("content"))
    again = D.with_front_matter(d)
    return again.select("doc_id", "content", "meta.title", F.array_join("meta.tags", "|").alias("tags"), "body")


D2_SQL = """SELECT doc_id, '---' || chr(10) || 'title: Document ' || doc_id || chr(10) || 'category: text' || chr(10) || 'tags: a, b' || chr(10) || '---' || chr(10) AS content,
  'Document ' || doc_id AS title, 'a|b' AS tags, '' AS body FROM documents"""


def d4(spark, sf):
    """The sections of the documents as Markdown, before they are cut to size."""
    d = D.sections(D.titled_lines(D.with_front_matter(V.markdown(spark, sf))))
    return d.select("doc_id", F.col("section_no").cast("long").alias("section_no"), "section", F.md5("text").alias("text_md5"))


def d3(spark, sf):
    """Markdown made of the documents, as chunks."""
    c = D.chunks(V.markdown(spark, sf), 1 << 30)
    return c.select("doc_id", F.col("section_no").cast("long").alias("section_no"), "title", "section", F.md5("text").alias("text_md5"), F.array_join("meta.tags", "|").alias("tags"))


SECTIONS_SQL = f"""{LINES_SQL}, h AS (SELECT *, pos % 5 = 2 AS head, CAST(sum(CAST(pos % 5 = 2 AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS section_no FROM ln),
s AS (SELECT doc_id, section_no, coalesce(max({STRIP.format('text')}) FILTER (WHERE head), '') AS section, {STRIP.format("coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (WHERE NOT head), '')")} AS body FROM h GROUP BY ALL)"""
D3_SQL = f"WITH {SECTIONS_SQL} SELECT doc_id, section_no, 'Document ' || doc_id AS title, section, md5(body) AS text_md5, 'a|b' AS tags FROM s WHERE body <> ''"


def packed_sql(keys: str, items: str, limit: int, joiner: str, counts: int, name: str = "pieces") -> str:
    """Greedy packing of ordered items (keys, i from 1, x) into pieces: who begins a piece, found step by step."""
    return f"""pk_{name} AS (SELECT {keys}, i, x, CAST(1 AS BIGINT) AS piece, length(x) AS size FROM {items} WHERE i = 1
  UNION ALL SELECT {', '.join('t.' + k.strip() for k in keys.split(','))}, t.i, t.x,
    p.piece + CASE WHEN p.size + CASE WHEN p.size > 0 THEN {counts} ELSE 0 END + length(t.x) > {limit} THEN 1 ELSE 0 END,
    CASE WHEN p.size + CASE WHEN p.size > 0 THEN {counts} ELSE 0 END + length(t.x) > {limit} THEN length(t.x) ELSE p.size + CASE WHEN p.size > 0 THEN {counts} ELSE 0 END + length(t.x) END
  FROM pk_{name} p JOIN {items} t ON {' AND '.join(f't.{k.strip()} = p.{k.strip()}' for k in keys.split(','))} AND t.i = p.i + 1),
{name} AS (SELECT {keys}, piece, string_agg(x, {joiner} ORDER BY i) AS text FROM pk_{name} GROUP BY {keys}, piece)"""


def d5(spark, sf):
    """The same, cut to the chunk size."""
    c = D.chunks(V.markdown(spark, sf))
    return c.select("doc_id", F.col("section_no").cast("long").alias("section_no"), F.col("part").cast("long").alias("part"), "section", F.md5("text").alias("text_md5"))


#: The sections have no blank lines: each is one paragraph, which is packed by its lines, longer lines by pieces of 1200.
D5_SQL = f"""WITH RECURSIVE {SECTIONS_SQL}, sl AS (SELECT doc_id, section_no, unnest(flatten(list_transform(list_filter(string_split(body, chr(10)), lambda x: x <> ''),
    lambda x: list_transform(range(0, greatest(1, CAST(ceil(length(x) / 1200.0) AS BIGINT))), lambda k: substr(x, k * 1200 + 1, 1200))))) AS x, generate_subscripts(flatten(list_transform(list_filter(string_split(body, chr(10)), lambda x: x <> ''),
    lambda x: list_transform(range(0, greatest(1, CAST(ceil(length(x) / 1200.0) AS BIGINT))), lambda k: substr(x, k * 1200 + 1, 1200)))), 1) AS i FROM s WHERE length(body) > 1200),
{packed_sql("doc_id, section_no", "sl", 1200, "chr(10)", 1, "paras")}, pi AS (SELECT doc_id, section_no, text AS x, piece AS i FROM paras),
{packed_sql("doc_id, section_no", "pi", 1200, "chr(10) || chr(10)", 0)},
every AS (SELECT doc_id, section_no, CAST(0 AS BIGINT) AS part, body AS text FROM s WHERE body <> '' AND length(body) <= 1200 UNION ALL SELECT doc_id, section_no, piece - 1, text FROM pieces)
SELECT doc_id, section_no, part, CASE WHEN count(*) OVER (PARTITION BY doc_id, section_no) > 1 THEN section || ' (' || (part + 1) || ')' ELSE section END AS section, md5(text) AS text_md5
FROM every JOIN (SELECT doc_id, section_no, section FROM s) USING (doc_id, section_no)"""


def d6(spark, sf):
    """Documents as paragraphs of at most 400 characters; a blank line after every third line cuts them."""
    d = V.lines(spark, sf).withColumn("text", F.when(F.col("pos") % 3 == 2, F.concat("text", F.lit("\n"))).otherwise(F.col("text")))
    whole = d.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "text")))["text"], "\n").alias("text"))
    return whole.select("doc_id", F.posexplode(D.paragraphs(F.col("text"), 400)).alias("at", "x")).select("doc_id", F.col("at").cast("long").alias("at"), F.md5("x").alias("x_md5"))


D6_SQL = f"""WITH RECURSIVE {LINES_SQL}, w AS (SELECT doc_id, string_agg(text || CASE WHEN pos % 3 = 2 THEN chr(10) ELSE '' END, chr(10) ORDER BY pos) AS t FROM ln GROUP BY doc_id),
pa AS (SELECT doc_id, unnest(a) AS p, generate_subscripts(a, 1) AS pn FROM (SELECT doc_id, string_split_regex(t, '\\n\\s*\\n') AS a FROM w)),
sl AS (SELECT doc_id, pn, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, pn, flatten(list_transform(list_filter(string_split(p, chr(10)), lambda x: x <> ''),
    lambda x: list_transform(range(0, greatest(1, CAST(ceil(length(x) / 400.0) AS BIGINT))), lambda k: substr(x, k * 400 + 1, 400)))) AS a FROM pa WHERE length(p) > 400)),
{packed_sql("doc_id, pn", "sl", 400, "chr(10)", 1)},
every AS (SELECT doc_id, pn, CAST(1 AS BIGINT) AS piece, p AS x FROM pa WHERE length(p) <= 400 UNION ALL SELECT doc_id, pn, piece, text FROM pieces)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pn, piece) - 1 AS at, md5(x) AS x_md5 FROM every"""


def d7(spark, sf):
    d = D.clean_lines(V.lines(spark, sf))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("text").alias("text_md5"))


D7_SQL = f"WITH {LINES_SQL}, c AS (SELECT doc_id, pos, trim(regexp_replace(text, '[ \\t\u00a0\u3000]+', ' ', 'g')) AS t FROM ln) SELECT doc_id, pos, md5(t) AS text_md5 FROM c WHERE t <> ''"


def d8(spark, sf):
    """Pages with a number at the foot: which lines are left."""
    d = D.strip_page_numbers(V.numbered_lines(spark, sf))
    return d.select("doc_id", F.col("page_no").cast("long").alias("page_no"), F.col("line_no").cast("long").alias("line_no"), (F.col("text") == "").alias("blank"))


D8_SQL = f"""WITH {LINES_SQL} SELECT doc_id, page_no, line_no, text = '' AS blank FROM ln UNION ALL SELECT DISTINCT doc_id, page_no, 8, true FROM ln"""


def d9(spark, sf):
    d = D.merge_lines(D.strip_page_numbers(V.numbered_lines(spark, sf)))
    return d.select("doc_id", F.col("paragraph_no").cast("long").alias("paragraph_no"), F.md5("text").alias("text_md5"))


D9_SQL = f"""WITH {LINES_SQL}, t AS (SELECT doc_id, page_no, line_no, pos, {STRIP.format('text')} AS t FROM ln),
b AS (SELECT *, lag(t) OVER w AS before, lag(page_no) OVER w AS p FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT *, before IS NULL OR p <> page_no OR before = ''
  OR regexp_matches(t, '^(제\\s*\\d+\\s*[조장절관편]|\\d+(?:\\.\\d+)*[.)]\\s|[가-힣][.)]\\s|[①-⑳]|[IVX]+\\.\\s|부칙|별표|별지|\\|)')
  OR regexp_matches(before, '[.。:：;!?)\\]」』”"'']\\s*$|(?:다|음|함|됨|것|임|요)\\.?\\s*$') AS starts FROM b),
n AS (SELECT *, CAST(sum(CAST(starts AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS paragraph_no FROM f WHERE t <> '')
SELECT doc_id, paragraph_no, md5(string_agg(t, ' ' ORDER BY pos)) AS text_md5 FROM n GROUP BY doc_id, paragraph_no"""


def numbered_paragraphs(spark, sf):
    """Lines of documents, some as chapters, articles or numbered headings."""
    d = V.lines(spark, sf)
    mark = (
        F.when((F.col("doc_id") % 3 == 0) & (F.col("pos") % 6 == 1), F.concat(F.lit("제"), (F.col("pos") / 6).cast("int").cast("string"), F.lit("장 총칙")))
        .when((F.col("doc_id") % 3 == 0) & (F.col("pos") % 6 == 3), F.concat(F.lit("제"), F.col("pos").cast("string"), F.lit("조(목적) "), "text"))
        .when((F.col("doc_id") % 3 == 1) & (F.col("pos") % 4 == 1), F.concat((F.col("pos") / 4).cast("int").cast("string"), F.lit(". Scope")))
        .otherwise(F.col("text"))
    )
    return d.select("doc_id", F.col("pos").alias("paragraph_no"), mark.alias("text"))


PARAGRAPHS_SQL = f"""{LINES_SQL}, pa AS (SELECT doc_id, pos, text, CASE WHEN doc_id % 3 = 0 AND pos % 6 = 1 THEN 'chapter' WHEN doc_id % 3 = 0 AND pos % 6 = 3 THEN 'article' WHEN doc_id % 3 = 1 AND pos % 4 = 1 THEN 'numbered' END AS k FROM ln),
mo AS (SELECT doc_id, CASE WHEN count(*) FILTER (WHERE k = 'article') >= 2 THEN 'article' WHEN count(*) FILTER (WHERE k = 'numbered') >= 2 THEN 'numbered' ELSE 'plain' END AS mode FROM pa GROUP BY doc_id)"""


def d10(spark, sf):
    return D.document_modes(numbered_paragraphs(spark, sf))


def d11(spark, sf):
    """What each line looks like: chapter, article, appendix, numbered heading."""
    p = numbered_paragraphs(spark, sf).withColumn("text", F.when(F.col("paragraph_no") % 7 == 6, F.concat(F.lit("별표 "), (F.col("paragraph_no") % 9).cast("string"), F.lit(" 서식"))).otherwise(F.col("text")))
    t = F.col("text")
    return p.select("doc_id", F.col("paragraph_no").cast("long").alias("paragraph_no"), D.is_chapter(t).alias("chapter"), D.is_article(t).alias("article"), D.is_appendix(t).alias("appendix"), D.is_numbered(t).alias("numbered"))


D11_SQL = f"""WITH {PARAGRAPHS_SQL} SELECT doc_id, pos AS paragraph_no, k IS NOT DISTINCT FROM 'chapter' AND pos % 7 <> 6 AS chapter, k IS NOT DISTINCT FROM 'article' AND pos % 7 <> 6 AS article,
  pos % 7 = 6 AS appendix, k IS NOT DISTINCT FROM 'numbered' AND pos % 7 <> 6 AS numbered FROM pa"""


def d12(spark, sf):
    p = numbered_paragraphs(spark, sf)
    return D.structured(p, D.document_modes(p)).select(
        "doc_id", F.col("section_no").cast("long").alias("section_no"), "section", F.size("paragraphs").cast("long").alias("n"), F.md5(F.array_join("paragraphs", "\n")).alias("paragraphs_md5")
    )


D12_SQL = f"""WITH {PARAGRAPHS_SQL},
h AS (SELECT pa.doc_id, pos, mode, CASE WHEN mode = 'article' AND k IN ('chapter', 'article') THEN k WHEN mode = 'numbered' AND k = 'numbered' THEN k END AS kind, k, text FROM pa JOIN mo USING (doc_id)),
c AS (SELECT *, CAST(sum(CAST(kind IS NOT NULL AS INT)) OVER w AS BIGINT) AS section_no, last_value(CASE WHEN kind = 'chapter' THEN '제' || (pos // 6) || '장 총칙' END IGNORE NULLS) OVER w AS chapter
  FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
x AS (SELECT doc_id, section_no, pos, CASE kind WHEN 'chapter' THEN '제' || (pos // 6) || '장 총칙' WHEN 'numbered' THEN (pos // 4) || '. Scope'
    WHEN 'article' THEN coalesce(chapter || ' › ', '') || '제' || pos || '조(목적)' END AS name,
  CASE WHEN kind = 'article' THEN nullif({STRIP.format('text')}, '') WHEN kind IS NULL THEN CASE k WHEN 'chapter' THEN '제' || (pos // 6) || '장 총칙' WHEN 'article' THEN '제' || pos || '조(목적) ' || text WHEN 'numbered' THEN (pos // 4) || '. Scope' ELSE text END END AS said FROM c)
SELECT doc_id, section_no, coalesce(max(name), '') AS section, count(said) AS n, md5(coalesce(string_agg(said, chr(10) ORDER BY pos), '')) AS paragraphs_md5 FROM x GROUP BY doc_id, section_no HAVING coalesce(max(name), '') <> '' OR count(said) > 0"""


def d13(spark, sf):
    p = V.lines(spark, sf).select("doc_id", F.col("pos").alias("paragraph_no"), "text")
    return D.guessed_titles(p, read_table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("stem")))


D13_SQL = f"""WITH {LINES_SQL}, f AS (SELECT doc_id, arg_min(text, pos) AS t FROM ln GROUP BY doc_id)
SELECT doc_id, CASE WHEN length(t) BETWEEN 2 AND 60 AND NOT regexp_matches(t, '(다\\.|다|\\.)$') AND t NOT LIKE '|%' AND NOT regexp_matches(t, '^[-=*_~\\s]{{3,}}$')
  AND NOT regexp_matches(t, '^[A-Za-z_][\\w-]*:\\s') AND NOT regexp_matches(t, '^(\\d+(?:\\.\\d+)+\\.?|\\d+[.)])\\s+(\\S.*)$') THEN t ELSE 'doc-' || doc_id END AS title FROM f"""


def d14(spark, sf):
    c = V.chunks(spark, sf).select(F.col("source").alias("doc_id"), F.col("chunk_id").alias("section_no"), F.lit(0).alias("part"), "title", "source")
    return D.catalogue(c)


def d14_meta(spark, sf):
    """The catalogue of the documents as Markdown, with what their front matter says."""
    c = D.catalogue(D.chunks(V.markdown(spark, sf)))
    return c.select("doc_id", "title", "chunks", "meta.category", F.array_join("meta.tags", "|").alias("tags"), "meta.effective_date", F.size(F.map_keys("meta.extra")).cast("long").alias("n_extra"))


def d14_seen(spark, sf):
    return D.first_seen(V.chunks(spark, sf), "category", "chunk_id")


def d15(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") < 100, "failed").when(F.col("doc_id") % 5 == 0, "skipped").otherwise("ok").alias("status"), F.size(F.split("text", "\n")).alias("sections"))
    return D.ingest_summary(d)


QUERIES = {
    "d1_front_matter": (d1, D1_SQL),
    "d2_rendered_front_matter": (d2, D2_SQL),
    "d4_sections": (d4, f"WITH {SECTIONS_SQL} SELECT doc_id, section_no, section, md5(body) AS text_md5 FROM s WHERE body <> ''"),
    "d6_paragraphs": (d6, D6_SQL),
    "d11_line_kinds": (d11, D11_SQL),
    "d3_titled_sections": (d3, D3_SQL),
    "d5_bounded_chunks": (d5, D5_SQL),
    "d7_clean_lines": (d7, D7_SQL),
    "d8_page_numbers": (d8, D8_SQL),
    "d9_merged_lines": (d9, D9_SQL),
    "d10_document_modes": (d10, f"WITH {PARAGRAPHS_SQL} SELECT doc_id, mode FROM mo"),
    "d12_structure": (d12, D12_SQL),
    "d13_titles": (d13, D13_SQL),
    "d14_catalogue": (d14, "SELECT source AS doc_id, 'Source ' || source AS title, source, count(*) AS chunks FROM documents GROUP BY source"),
    "d14_catalogue_metadata": (d14_meta, D5_SQL.rsplit("SELECT doc_id, section_no, part, CASE", 1)[0] + "SELECT doc_id, 'Document ' || doc_id AS title, count(*) AS chunks, 'text' AS category, 'a|b' AS tags, '' AS effective_date, CAST(0 AS BIGINT) AS n_extra FROM every GROUP BY doc_id"),
    "d14_first_seen": (d14_seen, "SELECT lang AS category, min(doc_id) AS first_seen FROM documents WHERE lang <> '' GROUP BY lang"),
    "d15_ingest_summary": (d15, "SELECT CASE WHEN n_chars < 100 THEN 'failed' WHEN doc_id % 5 = 0 THEN 'skipped' ELSE 'ok' END AS status, count(*) AS files, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS sections FROM documents GROUP BY 1"),
}
