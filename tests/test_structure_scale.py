"""Documents of many blocks give what they give in one."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import structure as D

LINES = ["# First", "# Later", "## Part", "plain text", "```", "제1장 총칙", "제2조(목적) 이 규정은 다", "제3조(정의)", "부칙", "1. Scope", "", "  ", "ends.", "- 3 -", "7", "2.1 GPS", "~~~", "a | b"]


def made(spark, n=8, seed=5):
    r = random.Random(seed)
    return {f"d{i}": [r.choice(LINES) for _ in range(r.randint(0, 60))] for i in range(n)}


def results(spark, docs):
    whole = spark.createDataFrame([(k, "\n".join(v)) for k, v in docs.items()], "doc_id string, body string")
    lines = spark.createDataFrame([(k, i // 7 + 1, i % 7, i, t) for k, v in docs.items() for i, t in enumerate(v)], "doc_id string, page_no int, line_no int, pos int, text string")
    titled = D.titled_lines(whole)
    paras = lines.where("text <> ''").select("doc_id", F.col("pos").alias("paragraph_no"), "text")
    stripped = D.strip_page_numbers(lines.drop("pos"))
    found = [titled, D.sections(titled), stripped, D.merge_lines(stripped), D.structured(paras, D.document_modes(paras))]
    return [sorted(map(str, f.collect())) for f in found]


def test_scans_over_blocks(spark, monkeypatch):
    docs = made(spark)
    one = results(spark, docs)
    monkeypatch.setattr(D, "BLOCK_LINES", 3)
    assert results(spark, docs) == one
    assert all(one)


def test_lines_of_short_documents_move_once(spark):
    """All that runs along them, their sections and their Markdown come from one shuffle of the lines."""
    r = random.Random(3)
    lines = [(d, i, r.choice(LINES)) for d in range(20) for i in range(30)]
    paras = spark.createDataFrame(lines, "doc_id long, paragraph_no int, text string").where("text <> ''")
    modes = spark.createDataFrame([(d, ("article", "numbered", "plain")[d % 3]) for d in range(20)], "doc_id long, mode string")
    found = D.markdown(D.structured(paras, modes), modes.select("doc_id", F.lit("T").alias("title")))
    assert found.count() == 20
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") <= 3  # the lines, the modes and the titles


def test_scan_against_plain_values(spark, monkeypatch):
    """All kinds of running values, with nulls, ties of documents without an id, and one block or many."""
    r = random.Random(1)
    rows = [(d, i, r.choice([None, 1, 2, 3])) for d in ("a", "b", None) for i in range(23)]
    df = spark.createDataFrame(rows, "doc_id string, line_no int, v int")
    for size in (1, 4, 1000):
        monkeypatch.setattr(D, "BLOCK_LINES", size)
        v = F.col("v")
        got = D.scanned(df, ["line_no"], D.line_block(), {"s": v}, {"l": v}, {"b": v}, {"f": v}, {"r": v}).collect()
        for d in ("a", "b", None):
            mine = [x for k, _, x in rows if k == d]
            some = [x for x in mine if x is not None]
            for x in sorted((g for g in got if g.doc_id == d), key=lambda g: g.line_no):
                upto = [y for y in mine[: x.line_no + 1] if y is not None]
                assert x.s == sum(upto) and x.l == (upto[-1] if upto else None) and x.f == some[0] and x.r == max(some) - min(some)
                assert x.b == (mine[x.line_no - 1] if x.line_no else None)
        assert len(got) == len(rows)


def test_documents_without_fences_are_titled_where_they_are(spark):
    """Texts with no fence give what the scan gives, without a shuffle; blanks of any kind at both ends are cut."""
    docs = {k: [x for x in v if not x.startswith(("```", "~~~"))] for k, v in made(spark, 12, 9).items()}
    texts = [(k, "\n".join(v)) for k, v in docs.items()] + [("n", None), ("e", ""), ("w", "　 \n# A \r\nb\r# C\n "), ("h", "# only")]
    d = spark.createDataFrame(texts, "doc_id string, body string")
    scanned = D.fenced_lines(d.withColumn("body", D.strip(F.col("body"))))
    got = D.titled_lines(d)
    assert sorted(map(str, got.collect())) == sorted(map(str, scanned.select(*got.columns).collect())) != []
    assert "Exchange" not in D.unfenced_lines(d)._jdf.queryExecution().executedPlan().toString()
    stripped = d.select("doc_id", D.strip_text("body").alias("a"), D.strip(F.col("body")).alias("b")).collect()
    assert all(r.a == r.b for r in stripped)


def test_documents_without_fences_are_cut_where_they_are(spark):
    """Their sections are those of the scan, without a shuffle, also where documents with and without fences are mixed."""
    docs = {k: [x for x in v if not x.startswith(("```", "~~~"))] for k, v in made(spark, 12, 11).items()}
    texts = [(k, "\n".join(v)) for k, v in docs.items()] + [("n", None), ("e", ""), ("w", "　 \n# A \r\n## \rb\r# C\n "), ("h", "# only"), ("g", "## G"), ("l", "x\n##  H \n\n y \n## Z")]
    d = spark.createDataFrame(texts, "doc_id string, body string").withColumn("body", D.strip_text("body"))
    got = D.unfenced_sections(d)
    assert sorted(map(str, got.collect())) == sorted(map(str, D.sections(D.fenced_lines(d)).select(*got.columns).collect())) != []
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    mixed = spark.createDataFrame([(k, "s" + k, t) for k, t in texts] + [("f", "sf", "# T\n```\n# no\n```\n## S\nz")], "doc_id string, source string, content string")
    found = {(r.doc_id, r.section_no): (r.source, r.title, r.section, r.text) for r in D.chunks(mixed).collect()}
    assert found["f", 1] == ("sf", "T", "S", "z") and found["w", 1] == ("sw", "A", "", "b")
    assert found["l", 1] == ("sl", "l", "H", "y") and ("n", 0) not in found and ("h", 0) not in found
