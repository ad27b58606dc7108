"""Clashing column names, executors without the package, and what a pipeline leaves behind."""

import os
import subprocess
import sys
import tempfile

import corpus_pipeline
from tessera.llm import link_trust, mixing
from tessera.llm.shared import shared_folder


def test_mix_with_names_of_its_own_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = ["mix_source", "cut_key", "cut_id", "cut_size", "cut_words", "key", "slice", "row", "id", "weight", "s", "n"]
    more = docs.selectExpr("*", *[f"'x' AS {n}" for n in names], "1 AS size")
    plain = {r.doc_id: (r.taken, r.target) for r in mixing.mix(docs).collect()}
    got = mixing.mix(more)
    assert set(got.columns) == set(docs.columns) | set(names) | {"size", "source_size", "target", "epochs", "taken"}
    assert {r.doc_id: (r.taken, r.target) for r in got.collect()} == plain and got.first().mix_source == "x"


def test_judge_with_names_of_its_own_columns(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    names = ["h", "__r", "hit", "of_host", "over", "rule"]
    got = link_trust.judge(pages.selectExpr("*", *[f"'x' AS `{n}`" for n in names]))
    assert {"h", "__r", "hit", "of_host", "over"} <= set(got.columns) and got.where("h = 'x' AND `__r` = 'x' AND hit = 'x'").count() == pages.count()
    plain = {r.page_id: (r.verdict, r.rule) for r in link_trust.judge(pages).collect()}
    assert {r.page_id: (r.verdict, r.rule) for r in got.select("page_id", "verdict", "rule").collect()} == plain


def test_workers_without_the_package():
    """A driver that found the package on a path of its own: nothing of it can be imported where tasks run."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    place = tempfile.mkdtemp(prefix="tessera-far-")
    code = f"""
import sys; sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
    .config("spark.checkpoint.dir", {place!r} + "/shared").config("spark.sql.warehouse.dir", {place!r} + "/warehouse").getOrCreate())
import __spark_entry__ as e
q = e.queries()
for name in ("op7_chroma_fingerprints", "op11_main_text", "op12_phrase_collocations", "op13_source_divergence", "c6_odd_texts", "r5_synonym_expansion", "g1_glossary_lookup", "u10_lockouts"):
    q[name](spark, "/root/testdata/sf0.001").collect()
    print("ran", name, flush=True)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=place, env=env, capture_output=True, text=True, timeout=600)
    assert out.stdout.count("ran ") == 8, out.stderr[-3000:]


def test_pipeline_leaves_its_result_only(spark, sf):
    before = set(os.listdir(shared_folder(spark)))
    assert corpus_pipeline.run(spark, sf).count() > 0
    left = [n for n in set(os.listdir(shared_folder(spark))) - before if not n.startswith(".") and len(n) != 36]
    assert [n.rsplit("-", 1)[0] for n in left] == ["best_fit_packing"]
