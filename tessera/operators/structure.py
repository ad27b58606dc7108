"""Corpus structuring: lines to paragraphs, sections and chunks, with metadata.

Lines are rows (doc_id, page_no, line_no, text) wherever order within a document matters, so that
windows do the work; folds over arrays are used only inside one section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..sources.shared import small, written

CHUNK_CHARS, HEADING_CHARS = 1200, 60
#: Lines of a document that are one task's in a scan.
BLOCK_LINES = 1 << 16
# Keys of the front matter.
KNOWN = ("title", "category", "effective_date", "version", "source_file", "tags")
U = "(?U)"
STRIP = r"(?U)^\s+|\s+$"
# How headings and page numbers look.
ARTICLE = r"^제\s*(\d+)\s*조(?:\s*의\s*(\d+))?(?=[\s(\[]|$)\s*(?:\(([^)]*)\)|\[([^\]]*)\])?\s*(.*)$"
ARTICLE_REFERENCE = r"^(?:및|또는|내지|부터|까지|에\s|에서\s|의\s|제\s*\d+\s*[조항호])"
CHAPTER = r"^제\s*\d+\s*[장절관편]\s+(\S.*)$"
APPENDIX = r"^(부칙|별표\s*\d*|별지\s*(?:제\s*\d+\s*호)?\s*(?:서식)?)\b.*$"
NUMBERED = r"^(\d+(?:\.\d+)+\.?|\d+[.)])\s+(\S.*)$"
DATE_LINE = r"^\d{2,4}\.\s*\d{1,2}\.(?:\s*\d{1,2}\.?)?(?:\s|$)"
UNIT = r"^(?:km/h|km|cm|mm|m|kg|g|t|ton|톤|L|l|mL|ml|mil|nm|NM|kt|ft|in|%|°|도|시간|분|초)(?=$|[\s/,.)])"
CLAUSE_END = r"(?:다|음|함|됨|임)\.?$|\.$"
LINE_END = r"[.。:：;!?)\]」』”\"']\s*$|(?:다|음|함|됨|것|임|요)\.?\s*$"
HEADING_START = r"^(제\s*\d+\s*[조장절관편]|\d+(?:\.\d+)*[.)]\s|[가-힣][.)]\s|[①-⑳]|[IVX]+\.\s|부칙|별표|별지|\|)"
PAGE_DECORATED = r"^[-–—]\s*\d{1,4}\s*[-–—]$"
PAGE_EDGE = r"^(?:[-–—]?\s*(\d{1,4})\s*[-–—]?|\d{1,4}\s*/\s*\d{1,4}|(?:[Pp]age|[Pp]\.)\s*\d{1,4}|\d{1,4}\s*쪽)$"


def evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once, however often they are used (as in governance)."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, STRIP, "")


def strip_text(c: str) -> Column:
    """strip of a column of whole texts: the pattern, which tries each place of a text, meets only those that begin or end with white space."""
    edges = F.concat(F.left(F.col(c), F.lit(1)), F.right(F.col(c), F.lit(1)))
    return F.when(edges.rlike(U + r"\s"), strip(F.col(c))).otherwise(F.col(c))


# ---- scans ----------------------------------------------------------------------------------------

def scanned(
    lines: DataFrame, order: list[str], block: Column | None, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None, firsts: dict[str, Column] | None = None, ranges: dict[str, Column] | None = None,
) -> DataFrame:
    """lines with values that run along a document, found block by block, so that no document is one task's.

    sums: running sums, the line's own included; lasts: the last value so far that is not null;
    lags: the value of the line before; firsts: the document's first value that is not null;
    ranges: how far a number goes in the document, its greatest less its least. block grows along
    order (columns). Each block is summed up in a row, what comes before a block is carried over
    these rows, and the rest is a window inside the block. Without a block a document is one window.
    """
    sums, lasts, lags, firsts, ranges = sums or {}, lasts or {}, lags or {}, firsts or {}, ranges or {}
    if block is None:
        along = Window.partitionBy("doc_id").orderBy(*order)
        upto, whole = along.rowsBetween(Window.unboundedPreceding, Window.currentRow), along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        found = {n: F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in sums.items()}
        found |= {n: F.last(c, ignorenulls=True).over(upto) for n, c in lasts.items()}
        found |= {n: F.lag(c).over(along) for n, c in lags.items()}
        found |= {n: F.first(c, ignorenulls=True).over(whole) for n, c in firsts.items()}
        found |= {n: F.max(c).over(whole) - F.min(c).over(whole) for n, c in ranges.items()}
        return lines.select("*", *[c.alias(n) for n, c in found.items()])
    cut, place = lines.withColumn("__block", block), F.struct(*order)
    made = [F.sum(c).alias(f"__{n}") for n, c in sums.items()]
    made += [F.max_by(c, F.when(c.isNotNull(), place)).alias(f"__{n}") for n, c in lasts.items()]
    made += [F.max_by(F.struct(c.alias("v")), place).alias(f"__{n}") for n, c in lags.items()]
    made += [F.min_by(c, F.when(c.isNotNull(), place)).alias(f"__{n}") for n, c in firsts.items()]
    made += [F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"__{n}") for n, c in ranges.items()]
    of_doc = Window.partitionBy("doc_id").orderBy("__block")
    earlier, whole = of_doc.rowsBetween(Window.unboundedPreceding, -1), of_doc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = [F.sum(f"__{n}").over(earlier).alias(f"__{n}") for n in sums]
    carried += [F.last(f"__{n}", ignorenulls=True).over(earlier).alias(f"__{n}") for n in [*lasts, *lags]]
    carried += [F.first(f"__{n}", ignorenulls=True).over(whole).alias(f"__{n}") for n in firsts]
    carried += [(F.max(F.col(f"__{n}.hi")).over(whole) - F.min(F.col(f"__{n}.lo")).over(whole)).alias(f"__{n}") for n in ranges]
    carry = cut.groupBy("doc_id", "__block").agg(*made).select(F.col("doc_id").alias("__doc"), F.col("__block").alias("__of"), *carried)
    d = cut.join(carry, F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("__block").eqNullSafe(F.col("__of")))
    inside = Window.partitionBy("doc_id", "__block").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = {n: F.coalesce(F.sum(c).over(upto), F.lit(0)) + F.coalesce(f"__{n}", F.lit(0)) for n, c in sums.items()}
    found |= {n: F.coalesce(F.last(c, ignorenulls=True).over(upto), f"__{n}") for n, c in lasts.items()}
    found |= {n: F.coalesce(F.lag(F.struct(c.alias("v"))).over(inside), f"__{n}")["v"] for n, c in lags.items()}
    found |= {n: F.col(f"__{n}") for n in [*firsts, *ranges]}
    return d.select(*lines.columns, *[c.alias(n) for n, c in found.items()])


def with_document(lines: DataFrame, known: DataFrame, block: Column | None) -> DataFrame:
    """lines with the columns of known (one row for each doc_id), which are first joined to the document's blocks, then to the lines of each."""
    if block is None:
        return lines.join(known, "doc_id")
    cut = lines.withColumn("__block", block)
    told = cut.select("doc_id", "__block").distinct().join(known, "doc_id").select(
        F.col("doc_id").alias("__doc"), F.col("__block").alias("__of"), *[c for c in known.columns if c != "doc_id"]
    )
    return cut.join(told, (F.col("doc_id") == F.col("__doc")) & F.col("__block").eqNullSafe(F.col("__of"))).drop("__block", "__doc", "__of")


def line_block(line: str = "line_no") -> Column:
    return F.floor(F.col(line) / BLOCK_LINES)


def page_block() -> Column:
    """Blocks of lines inside pages, in order."""
    return F.struct(F.col("page_no").alias("p"), line_block().alias("l"))


# ---- front matter --------------------------------------------------------------------------------

def with_front_matter(df: DataFrame, content: str = "content") -> DataFrame:
    """df with meta (title, category, effective_date, version, source_file, tags, extra) and body.

    A key that comes twice has its last value.
    """
    block = r"(?s)^---[ \t]*\n(.*?)\n---[ \t]*\n?"
    text = F.regexp_replace(F.col(content), "^﻿+", "")
    d = df.withColumn("__t", text).withColumn("__front", F.when(F.col("__t").rlike(block), F.regexp_extract("__t", block, 1)))
    lines = F.filter(F.split("__front", "\n"), lambda x: x.contains(":") & ~x.rlike(r"^\s*#"))
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            F.lower(strip(F.substring_index(x, ":", 1))).alias("k"),
            F.regexp_replace(strip(F.regexp_replace(x, r"^[^:]*:", "")), "^['\"]+|['\"]+$", "").alias("v"),
        ),
    )
    d = d.withColumn("__p", F.coalesce(pairs, F.array().cast("array<struct<k:string,v:string>>")))

    def last(key: str) -> Column:
        found = F.filter("__p", lambda p: p["k"] == key)
        return F.coalesce(F.try_element_at(found, F.lit(-1))["v"], F.lit(""))

    tags = F.filter(F.transform(F.split(last("tags"), "[,，]"), strip), lambda t: t != "")
    extra = F.filter("__p", lambda p: ~p["k"].isin(*KNOWN))
    unique = F.aggregate(
        extra, F.create_map().cast("map<string,string>"),
        lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])),
    )
    meta = F.struct(*[last(k).alias(k) for k in KNOWN[:-1]], tags.alias("tags"), unique.alias("extra"))
    body = F.when(F.col("__front").isNotNull(), F.regexp_replace(F.regexp_replace("__t", block, ""), r"^\n+", "")).otherwise(F.col("__t"))
    return d.withColumn("meta", meta).withColumn("body", body).drop("__t", "__front", "__p")


def front_matter_text(meta: str = "meta") -> Column:
    """Rendered front matter; empty values are left out, lists joined by a comma."""
    known = [F.struct(F.lit(k).alias("k"), F.col(f"{meta}.{k}").alias("v")) for k in KNOWN[:-1]]
    tags = F.struct(F.lit("tags").alias("k"), F.array_join(f"{meta}.tags", ", ").alias("v"))
    extra = F.transform(F.map_entries(f"{meta}.extra"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    filled = F.filter(F.concat(F.array(*known, tags), extra), lambda p: p["v"].isNotNull() & (p["v"] != ""))
    lines = F.transform(filled, lambda p: F.concat(p["k"], F.lit(": "), p["v"]))
    return F.concat(F.array_join(F.concat(F.array(F.lit("---")), lines, F.array(F.lit("---"))), "\n"), F.lit("\n"))


# ---- markdown to chunks --------------------------------------------------------------------------

def lines_of(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, line_no, text): a row for each line."""
    return df.select(*keys, F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("line_no", "text"))


def titled_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, text, h1): body lines outside the first H1; later H1 lines become H2.

    docs: doc_id, body. Lines inside fences are no headings. h1 is the document's first H1 or null.
    Without fences any line that looks like an H1 is one, which the text alone tells; documents with
    fences are scanned, block by block.
    """
    d = docs.select("doc_id", strip_text("body").alias("body"))
    return unfenced_lines(d.where(~has_fence())).unionByName(fenced_lines(d.where(has_fence())))


def has_fence() -> Column:
    """Whether a body may hold fences."""
    return F.coalesce(F.col("body").contains("```") | F.col("body").contains("~~~"), F.lit(False))


def with_h1(docs: DataFrame) -> DataFrame:
    """docs with __lines for the body, the place of the first H1 among them (__at, from 1, or null), and h1."""
    cut = docs.select(*[c for c in docs.columns if c != "body"], F.split("body", r"\r\n|\r|\n").alias("__lines"))
    at = F.array_position(F.transform("__lines", lambda x: x.startswith("# ")), True)
    cut = evaluated(cut, __at=F.nullif(at, F.lit(0)))
    return cut.withColumn("h1", strip(F.substring(F.try_element_at("__lines", F.col("__at").cast("int")), 3, 1 << 30)))


def unfenced_lines(docs: DataFrame) -> DataFrame:
    """titled_lines of documents (doc_id, body) without fences: nothing moves."""
    ln = with_h1(docs).select("doc_id", "__at", "h1", F.posexplode("__lines").alias("line_no", "text"))
    ln = ln.where(F.col("__at").isNull() | (F.col("line_no") != F.col("__at") - 1))
    return ln.select("doc_id", "line_no", F.when(F.col("text").startswith("# "), F.concat(F.lit("#"), "text")).otherwise(F.col("text")).alias("text"), "h1")


def fenced_lines(docs: DataFrame) -> DataFrame:
    """titled_lines of any documents (doc_id, body), by scans."""
    ln = lines_of(docs, "body", "doc_id")
    fence = F.col("text").rlike(r"^\s*(?:```|~~~)")
    ln = scanned(ln.withColumn("__fence", fence.cast("int")), ["line_no"], line_block(), sums={"__fences": F.col("__fence")})
    is_h1 = (F.col("__fence") == 0) & (F.col("__fences") % 2 == 0) & F.col("text").startswith("# ")
    first = F.when(F.col("__h1"), F.struct("line_no", strip(F.substring("text", 3, 1 << 30)).alias("title")))
    ln = scanned(ln.withColumn("__h1", is_h1), ["line_no"], line_block(), firsts={"__first": first})
    ln = ln.where(F.col("__first").isNull() | (F.col("line_no") != F.col("__first.line_no")))
    return ln.select("doc_id", "line_no", F.when(F.col("__h1"), F.concat(F.lit("#"), "text")).otherwise(F.col("text")).alias("text"), F.col("__first.title").alias("h1"))


def sections(lines: DataFrame) -> DataFrame:
    """(doc_id, section_no, section, text, and h1 if the lines have it): cut at `## ` lines; sections of blanks only are dropped."""
    told = [c for c in ("h1",) if c in lines.columns]
    headed = lines.withColumn("head", F.col("text").startswith("## "))
    cut = scanned(headed, ["line_no"], line_block(), sums={"section_no": F.col("head").cast("int")})
    return (
        cut.groupBy("doc_id", "section_no")
        .agg(
            F.coalesce(F.max(F.when(F.col("head"), strip(F.substring("text", 4, 1 << 30)))), F.lit("")).alias("section"),
            F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line_no", "text")))).alias("x"), *[F.max(c).alias(c) for c in told],
        )
        .select("doc_id", "section_no", "section", F.array_join("x.text", "\n").alias("text"), *told)
        .withColumn("text", strip_text("text"))
        .where("text <> ''")
    )


def unfenced_sections(docs: DataFrame) -> DataFrame:
    """sections(titled_lines(…)) of documents (doc_id, stripped body, further columns, which stay) without fences: nothing moves."""
    cut = with_h1(docs)

    def shown(x: Column, i: Column) -> Column:
        return F.when(i + 1 == F.col("__at"), F.lit(None)).when(x.startswith("# "), F.concat(F.lit("#"), x)).otherwise(x)

    cut = evaluated(cut, __said=F.filter(F.transform("__lines", shown), lambda x: x.isNotNull())).drop("__lines", "__at")
    heads = F.filter(F.transform("__said", lambda x, i: F.when(x.startswith("## "), i + 1)), lambda i: i.isNotNull())
    cut = evaluated(cut, __heads=heads)

    def section(head: Column, end: Column) -> Column:
        name = F.when(head > 0, strip(F.substring(F.element_at("__said", F.greatest(head, F.lit(1))), 4, 1 << 30))).otherwise("")
        return F.struct(name.alias("section"), F.array_join(F.slice("__said", head + 1, end - head - 1), "\n").alias("text"))

    found = F.zip_with(F.concat(F.array(F.lit(0)), "__heads"), F.concat("__heads", F.array(F.size("__said") + 1)), section)
    kept = [c for c in cut.columns if not c.startswith("__")]
    each = cut.select(*kept, F.posexplode(found).alias("section_no", "__s"))
    each = each.select(*kept, F.col("section_no").cast("long").alias("section_no"), "__s.section", "__s.text")
    return each.withColumn("text", strip_text("text")).where("text <> ''")


def _packed(items: Column, limit: int, joiner: str, joiner_counts: int) -> Column:
    """Greedy packing of an array of strings into an array of joined strings of at most limit characters.

    The fold carries lengths only: where each piece begins. The strings are cut out and joined once.
    """
    first = F.struct(F.array(F.lit(1)).alias("begins"), F.lit(0).alias("size"), F.lit(0).alias("i"))

    def step(a: Column, n: Column) -> Column:
        grown = a["size"] + F.when(a["size"] > 0, joiner_counts).otherwise(0) + n
        full = (grown > limit) & (a["i"] >= F.element_at(a["begins"], -1))
        return F.struct(
            F.when(full, F.array_append(a["begins"], a["i"] + 1)).otherwise(a["begins"]).alias("begins"),
            F.when(full, n).otherwise(grown).alias("size"), (a["i"] + 1).alias("i"),
        )

    def cut(all_: Column, begins: Column) -> Column:
        ends = F.concat(F.slice(begins, 2, F.size(begins)), F.array(F.size(all_) + 1))
        return F.zip_with(begins, ends, lambda b, e: F.array_join(F.slice(all_, b, e - b), joiner))

    def packed(all_: Column) -> Column:
        begins = F.aggregate(F.transform(all_, lambda x: F.length(x)), first, step, lambda a: a["begins"])
        return F.when(F.size(all_) > 0, let(begins, lambda b: cut(all_, b))).otherwise(F.array().cast("array<string>"))

    return let(items, packed)


def paragraphs(text: Column, limit: int = CHUNK_CHARS) -> Column:
    """Split at blank lines; a longer paragraph by lines (joined again up to the limit), a longer line by characters.

    The last piece of a cut line may be joined with the lines after it; the full ones stand alone.
    """
    def slices(line: Column) -> Column:
        n = F.greatest(F.ceil(F.length(line) / limit).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(line, i * limit + 1, F.lit(limit)))

    def long(para: Column) -> Column:
        lines = F.filter(F.split(para, r"\r\n|\r|\n"), lambda x: x != "")
        return _packed(F.flatten(F.transform(lines, slices)), limit, "\n", 1)

    return F.flatten(F.transform(F.split(text, r"(?U)\n\s*\n"), lambda p: F.when(F.length(p) <= limit, F.array(p)).otherwise(long(p))))


def bounded_sections(secs: DataFrame, limit: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, section_no, part, section, text, further columns): longer sections packed from their paragraphs as `name (1)`, `name (2)`."""
    short = F.length("text") <= limit
    packed = _packed(paragraphs(F.col("text"), limit), limit, "\n\n", 0)
    d = secs.withColumn("__pieces", F.when(short, F.array("text")).otherwise(packed))
    told = [c for c in secs.columns if c not in ("doc_id", "section_no", "section", "text")]
    d = d.select("doc_id", "section_no", "section", *told, F.size("__pieces").alias("n"), F.posexplode("__pieces").alias("part", "text"))
    name = F.when(F.col("n") > 1, F.concat("section", F.lit(" ("), (F.col("part") + 1).cast("string"), F.lit(")"))).otherwise(F.col("section"))
    return d.select("doc_id", "section_no", "part", name.alias("section"), "text", *told)


def chunks(docs: DataFrame, limit: int = CHUNK_CHARS) -> DataFrame:
    """Documents (doc_id, source, content) as chunks: doc_id, section_no, part, title, section, text, source, meta.

    The title is that of the front matter, else the first H1, else the id. Documents without fences
    are cut where they are; those with fences are scanned, block by block.
    """
    d = with_front_matter(docs.where("doc_id IS NOT NULL")).select("doc_id", "source", "meta", "body")
    d = written(d.withColumn("body", strip_text("body")), "documents")  # read for those with fences and for those without
    scanned_ones = d.where(has_fence())
    cut = sections(fenced_lines(scanned_ones.select("doc_id", "body"))).join(scanned_ones.drop("body"), "doc_id")
    return (
        bounded_sections(unfenced_sections(d.where(~has_fence())).unionByName(cut), limit)
        .withColumn("title", F.coalesce(F.when(F.col("meta.title") != "", F.col("meta.title")), "h1", F.col("doc_id").cast("string")))
        .select("doc_id", "section_no", "part", "title", "section", "text", "source", "meta")
    )


def catalogue(chunked: DataFrame) -> DataFrame:
    """(doc_id, title, source, chunks, and meta where the chunks have one): one row per document, as its first chunk has it."""
    first = F.struct("section_no", "part")
    told = [F.min_by(c, first).alias(c) for c in ("title", "source", "meta") if c in chunked.columns]
    return chunked.groupBy("doc_id").agg(*told, F.count("*").alias("chunks"))


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values (no empty ones) with where each comes first."""
    return df.where(f"{value} <> ''").groupBy(value).agg(F.min(order).alias("first_seen"))


# ---- lines of extracted documents ----------------------------------------------------------------

def clean_text(c: Column) -> Column:
    return strip(F.regexp_replace(c, "[ \t 　]+", " "))


def clean_lines(lines: DataFrame) -> DataFrame:
    return lines.withColumn("text", clean_text(F.col("text"))).where("text <> ''")


def strip_page_numbers(lines: DataFrame) -> DataFrame:
    """lines (doc_id, page_no, line_no, text), page numbers on the first and last filled line of a page blanked.

    A bare number counts only up to the page count plus 100.
    """
    filled = F.col("text").rlike(r"(?U)\S")
    # The edges of a page are two rows of it, whatever its length; the pages of a document are told by its blocks.
    edges = lines.where(filled).groupBy(F.col("doc_id").alias("__doc"), F.col("page_no").alias("__page")).agg(F.min("line_no").alias("__lo"), F.max("line_no").alias("__hi"))
    edge = edges.select("__doc", "__page", F.explode(F.array_distinct(F.array("__lo", "__hi"))).alias("__line"))
    spanned = scanned(lines, ["page_no", "line_no"], page_block(), ranges={"__pages": F.col("page_no")})
    here = F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("page_no").eqNullSafe(F.col("__page")) & (F.col("line_no") == F.col("__line"))
    d = spanned.join(edge, here, "left")
    flat = strip(F.col("text"))
    bare = F.regexp_extract(flat, PAGE_EDGE, 1)
    number = flat.rlike(PAGE_EDGE) & ((bare == "") | flat.rlike("[-–—]") | (bare.try_cast("int") <= F.col("__pages") + 101))
    return d.withColumn("text", F.when(F.col("__line").isNotNull() & number, "").otherwise(F.col("text"))).drop("__doc", "__page", "__line", "__pages")


def merge_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, paragraph_no, text): a line joins the one before unless a new page, a blank line, a heading start
    or a sentence end stands between; decorated page numbers are left out.

    Whether a sentence ends is seen at the end of the last line alone, so neighbours decide.
    """
    flat = lines.withColumn("text", strip(F.col("text"))).where(~F.col("text").rlike(PAGE_DECORATED))
    order = ["page_no", "line_no"]
    flat = scanned(flat, order, page_block(), lags={"__before": F.struct("text", "page_no")})
    before = F.col("__before.text")
    new_page = F.col("__before.page_no") != F.col("page_no")
    starts = before.isNull() | new_page | (before == "") | F.col("text").rlike(U + HEADING_START) | before.rlike(U + LINE_END)
    d = flat.withColumn("__starts", starts).where("text <> ''")
    d = scanned(d, order, page_block(), sums={"paragraph_no": F.col("__starts").cast("int")})
    return d.groupBy("doc_id", "paragraph_no").agg(F.array_sort(F.collect_list(F.struct("page_no", "line_no", "text"))).alias("x")).select(
        "doc_id", "paragraph_no", F.array_join("x.text", " ").alias("text")
    )


def is_article(p: Column) -> Column:
    labelled = (F.regexp_extract(p, U + ARTICLE, 3) != "") | (F.regexp_extract(p, U + ARTICLE, 4) != "")
    return p.rlike(U + ARTICLE) & (labelled | ~F.regexp_extract(p, U + ARTICLE, 5).rlike(U + ARTICLE_REFERENCE))


def is_chapter(p: Column) -> Column:
    rest = F.regexp_extract(p, U + CHAPTER, 1)
    return p.rlike(U + CHAPTER) & (F.length(p) <= HEADING_CHARS) & ~rest.rlike(U + r"^제\s*\d+\s*[조항호]") & ~rest.rlike(U + CLAUSE_END)


def is_appendix(p: Column) -> Column:
    return p.rlike(U + APPENDIX)


def is_numbered(p: Column) -> Column:
    number, text = F.regexp_extract(p, U + NUMBERED, 1), F.regexp_extract(p, U + NUMBERED, 2)
    measure = number.rlike(r"^\d+\.\d+$") & text.rlike(U + UNIT)
    return (
        p.rlike(U + NUMBERED) & ~p.rlike(U + DATE_LINE) & ~measure & (F.length(p) <= HEADING_CHARS)
        & ~text.rlike(U + r"(다|음|함|됨|임)\.?$") & ~text.startswith("|")
    )


def document_modes(paras: DataFrame) -> DataFrame:
    """(doc_id, mode): article with two article heads or more, else numbered with two such headings, else plain."""
    n = paras.groupBy("doc_id").agg(F.count_if(is_article(F.col("text"))).alias("a"), F.count_if(is_numbered(F.col("text"))).alias("n"))
    return n.select("doc_id", F.when(F.col("a") >= 2, "article").when(F.col("n") >= 2, "numbered").otherwise("plain").alias("mode"))


def guessed_titles(paras: DataFrame, stems: DataFrame) -> DataFrame:
    """(doc_id, title): the first paragraph if it can be a title, else the file's stem (doc_id, stem)."""
    p = F.col("first")
    is_title = (
        F.length(p).between(2, HEADING_CHARS) & ~p.rlike(r"(?:다\.|다|\.)$") & ~p.startswith("|") & ~p.rlike(U + r"^[-=*_~\s]{3,}$")
        & ~p.rlike(U + r"^[A-Za-z_][\w-]*:\s") & ~is_chapter(p) & ~is_article(p) & ~is_appendix(p) & ~p.rlike(U + NUMBERED)
    )
    first = paras.groupBy("doc_id").agg(F.min_by("text", "paragraph_no").alias("first"))
    return stems.join(first, "doc_id", "left").select(
        "doc_id", F.when(p.startswith("# "), strip(F.substring("first", 3, 1 << 30))).when(is_title, p).otherwise(F.col("stem")).alias("title")
    )


def structured(paras: DataFrame, modes: DataFrame) -> DataFrame:
    """(doc_id, section_no, section, paragraphs): paragraphs (doc_id, paragraph_no, text) under their headings.

    In article mode a chapter goes before the names of its articles until the next chapter or an
    appendix, and what follows an article's head on its line is its first paragraph. Lines of
    documents of one block move once, to their document; only those of longer ones are scanned by blocks.
    """
    long = written(paras.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_LINES).select("doc_id"), "long")
    few = small(long, 16)
    if long.isEmpty():
        return _structured(paras, modes, None)
    short = _structured(paras.join(few, "doc_id", "left_anti"), modes, None)
    return short.unionByName(_structured(paras.join(few, "doc_id", "left_semi"), modes, line_block("paragraph_no")))


def _structured(paras: DataFrame, modes: DataFrame, block: Column | None) -> DataFrame:
    order = ["paragraph_no"]
    d = with_document(paras, modes, block)
    flat = F.when(F.col("text").startswith("#"), strip(F.regexp_replace("text", "^#+", ""))).otherwise(F.col("text"))
    d = d.withColumn("s", flat)
    short = F.length(F.substring_index("s", ")", 1)) <= HEADING_CHARS
    by_article = F.col("mode") == "article"
    kind = (
        F.when(by_article & is_chapter(F.col("s")), "chapter")
        .when(by_article & is_article(F.col("s")) & short, "article")
        .when(by_article & is_appendix(F.col("s")) & (F.length("s") <= HEADING_CHARS), "appendix")
        .when((F.col("mode") == "numbered") & is_numbered(F.col("s")), "heading")
        .when(F.col("text").startswith("## "), "heading")
    )
    d = d.withColumn("kind", kind)
    # A later H1 is a heading too: one with a section before it, that is, with any paragraph or heading before it flushed.
    kind = F.col("kind")
    d = scanned(d, order, block, sums={"__seen": kind.isNotNull().cast("int")}, firsts={"__first": F.struct(kind.isNull().alias("plain"))})
    had = (F.col("__seen") >= 2) | ((F.col("__seen") >= 1) & F.col("__first.plain"))
    d = d.withColumn("kind", F.when(kind.isNull() & F.col("text").startswith("# ") & had, "heading").otherwise(kind))
    chapter = F.when(F.col("kind") == "chapter", F.col("s")).when(F.col("kind") == "appendix", F.lit(""))
    d = scanned(d, order, block, lasts={"chapter": chapter}, sums={"section_no": F.col("kind").isNotNull().cast("int")})
    d = d.withColumn("chapter", F.coalesce("chapter", F.lit("")))
    part = lambda i: F.regexp_extract("s", U + ARTICLE, i)
    head = F.concat(F.lit("제"), part(1), F.lit("조"), F.when(part(2) != "", F.concat(F.lit("의"), part(2))).otherwise(""))
    label = F.when(part(3) != "", part(3)).otherwise(part(4))
    article = F.concat(
        F.when(F.col("chapter") != "", F.concat("chapter", F.lit(" › "))).otherwise(""), head,
        F.when(label != "", F.concat(F.lit("("), label, F.lit(")"))).otherwise(""),
    )
    d = d.withColumn("name", F.when(F.col("kind") == "article", article).when(F.col("kind").isNotNull(), F.col("s")))
    said = F.when(F.col("kind") == "article", F.when(strip(part(5)) != "", strip(part(5)))).when(F.col("kind").isNull(), F.col("text"))
    return (
        d.withColumn("said", said).groupBy("doc_id", "section_no")
        .agg(
            F.coalesce(F.max("name"), F.lit("")).alias("section"),
            F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("paragraph_no", "said")))).alias("x"),
        )
        .select("doc_id", "section_no", "section", F.col("x.said").alias("paragraphs"))
        .where("section <> '' OR size(paragraphs) > 0")
    )


def markdown(doc_sections: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, content): front matter (where titles has a meta), `# title`, then `## section` and paragraphs."""
    body = F.flatten(
        F.transform(
            F.array_sort(F.collect_list(F.struct("section_no", "section", "paragraphs"))),
            lambda s: F.concat(F.when(s["section"] != "", F.array(F.concat(F.lit("## "), s["section"]))).otherwise(F.array().cast("array<string>")), s["paragraphs"]),
        )
    )
    b = doc_sections.groupBy("doc_id").agg(body.alias("blocks"))
    head = front_matter_text() if "meta" in titles.columns else F.lit("")
    return titles.join(b, "doc_id", "left").select(
        "doc_id",
        F.concat(head, F.lit("# "), "title", F.lit("\n\n"), F.array_join(F.coalesce("blocks", F.array().cast("array<string>")), "\n\n"), F.lit("\n")).alias("content"),
    )


def ingest_summary(status: DataFrame) -> DataFrame:
    """(status, files, sections) from (doc_id, status, sections)."""
    return status.groupBy("status").agg(F.count("*").alias("files"), F.coalesce(F.sum("sections"), F.lit(0)).cast("long").alias("sections"))
