import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.operators import sessions as S
from tessera.sources import files as X
from tessera.streaming import streams as ST


def test_corpus(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes("\ufeff# A".encode())
    (tmp_path / "sub" / "b c.txt").write_text("text")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "c.csv").write_text("no")
    rows = {(r.doc_id, r.source, r.content) for r in X.read_corpus(spark, str(tmp_path)).collect()}
    assert rows == {("a", "a.md", "# A"), ("b c", "sub/b c.txt", "text")}


def test_cases(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text('# note\n\n{"id": "x", "question": "a?", "expected_refs": ["r"], "odd": 1}\n{"question": "b?"}\n')
    rows = X.read_cases(spark, str(p)).orderBy("line_no").collect()
    assert [(r.case_id, r.question, r.expected_refs) for r in rows] == [("x", "a?", ["r"]), ("q002", "b?", [])]
    for bad in ('{"id": "x"}', "{oops", '{"id":"x","question":"1"}\n{"id":"x","question":"2"}', "# nothing"):
        p.write_text(bad)
        with pytest.raises(ValueError):
            X.read_cases(spark, str(p))


def test_dictionaries(spark, tmp_path):
    g, s = tmp_path / "g.json", tmp_path / "s.json"
    g.write_text(json.dumps({"AO": {"full": "Area", "ko": "지역"}, "X": {}, "Y": "no", "Z": {"desc": "d"}}))
    assert [(r.term, r.full, r.desc) for r in X.read_glossary(spark, str(g)).orderBy("pos").collect()] == [("AO", "Area", ""), ("Z", "", "d")]
    g.write_text("{broken")
    assert X.read_glossary(spark, str(g)).count() == 0
    s.write_text(json.dumps({"a": ["b", "c"], "d": "e"}))
    assert [r.words for r in X.read_synonyms(spark, str(s)).orderBy("group_id").collect()] == [["a", "b", "c"], ["d", "e"]]
    s.write_text("[1]")
    with pytest.raises(ValueError):
        X.read_synonyms(spark, str(s))


def test_audit(spark, tmp_path):
    p = tmp_path / "audit.jsonl"
    p.write_bytes(b'{"event": "chat", "session_id": "s", "redactions": {"a": 1}}\n\n{bad\n[1]\n{"event": "blocked"}\n{"event": "\xed')
    rows = X.read_audit(spark, str(p)).orderBy("line_no").collect()
    assert [(r.line_no, r.event) for r in rows] == [(1, "chat"), (3, "corrupt"), (4, "corrupt"), (5, "blocked"), (6, "corrupt")]
    assert rows[0].redactions == {"a": 1} and rows[1].raw == "{bad"
    X.append_audit(spark.range(2).select(F.lit("chat").alias("event")), str(tmp_path / "log"))
    X.append_audit(spark.range(1).select(F.lit("chat").alias("event")), str(tmp_path / "log"))
    assert X.read_audit(spark, str(tmp_path / "log")).count() == 3


def test_write_corpus(spark, tmp_path):
    spark.sparkContext.getCheckpointDir() or spark.sparkContext.setCheckpointDir(str(tmp_path / "ck"))
    path = str(tmp_path / "out")
    d = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", None)], "doc_id string, content string")
    assert {r.doc_id: r.status for r in X.write_corpus(d, path, "dry_run").collect()} == {"a": "ok", "b": "failed"}
    assert {r.doc_id: r.status for r in X.write_corpus(d, path).collect()} == {"a": "ok", "b": "failed"}
    e = spark.createDataFrame([("a", "2"), ("c", "3")], "doc_id string, content string")
    assert {r.doc_id: r.status for r in X.write_corpus(e, path).collect()} == {"a": "skipped", "c": "ok"}
    X.write_corpus(e, path, "overwrite")
    assert {r.doc_id: r.content for r in spark.read.parquet(path).collect()} == {"a": "2", "c": "3"}


def test_write_corpus_makes_its_rows_once(spark, tmp_path):
    """However the documents come about: not once for what is written and again for what is returned."""
    spark.sparkContext.getCheckpointDir() or spark.sparkContext.setCheckpointDir(str(tmp_path / "ck"))
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return str(i)

    d = spark.range(10).select(F.col("id").cast("string").alias("doc_id"), text("id").alias("content"))
    for times, mode in enumerate(("skip", "overwrite"), 1):
        assert {r.status for r in X.write_corpus(d, str(tmp_path / "out"), mode).collect()} == {"ok"}
        assert made.value == 10 * times
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_reports(spark, tmp_path):
    X.save_report(spark.range(3).withColumn("hit", F.lit(True)), str(tmp_path), "r1", "retrieval")
    assert X.load_report(spark, str(tmp_path), "r1", "retrieval", ("id", "hit")).count() == 3
    with pytest.raises(ValueError):
        X.load_report(spark, str(tmp_path), "r1", "retrieval", ("nope",))


def test_upsert_and_index_streams_equal_their_batch_forms(spark, tmp_path):
    base = spark.range(30).select(
        (F.col("id") % 7).cast("string").alias("session_id"), (F.col("id") % 7 % 2).cast("string").alias("username"), F.col("id").alias("turns"),
        F.timestamp_seconds(F.col("id")).alias("created_at"), F.timestamp_seconds(F.col("id") * 10).alias("updated_at"),
    )
    for i in range(3):
        base.where(F.col("turns") % 3 == i).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    s = ST.read_stream(spark, f"{tmp_path}/in/*", base.schema)
    ST.upsert_stream(s, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    last = ST.latest(spark, f"{tmp_path}/out")
    batch = S.upsert_sessions(base.limit(0), base)
    # A batch may hold several changes of a session; whatever the batches, the last one counts.
    assert {(r.session_id, r.turns, r.created_at) for r in last.collect()} == {(r.session_id, r.turns, r.created_at) for r in batch.collect()}
    chunks = spark.createDataFrame([(i, "t", "s", ["x"], "c", f"word{i % 3} text") for i in range(9)], "chunk_id long, title string, section string, tags array<string>, category string, text string")
    for i in range(3):
        chunks.where(F.col("chunk_id") % 3 == i).coalesce(1).write.parquet(f"{tmp_path}/chunks/{i}")
    ST.index_stream(ST.read_stream(spark, f"{tmp_path}/chunks/*", chunks.schema), f"{tmp_path}/post", f"{tmp_path}/ck2").awaitTermination()
    from tessera.operators.retrieval import build_index

    names = ["token", "chunk_id", "tf", "doc_len"]
    assert sorted(map(tuple, ST.read_index(spark, f"{tmp_path}/post")["postings"].select(*names).collect())) == sorted(map(tuple, build_index(chunks)["postings"].select(*names).collect()))


def test_index_stream_of_documents(spark, tmp_path):
    """Documents come as Markdown; chunks without a token count in the number and mean length of chunks."""
    docs = [("a", "a.md", "---\ntitle: T\n---\n## S\nalpha beta"), ("b", "b.md", "## !!\n---"), ("c", "c.md", "gamma")]
    for i, d in enumerate(docs):
        spark.createDataFrame([d], "doc_id string, source string, content string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    s = ST.read_stream(spark, f"{tmp_path}/in/*", "doc_id string, source string, content string")
    ST.index_stream(s, f"{tmp_path}/out", f"{tmp_path}/ck", documents=True).awaitTermination()
    i = ST.read_index(spark, f"{tmp_path}/out")
    stats = i["corpus_stats"].first()
    assert stats.n == 3 and abs(stats.avg_len - i["lengths"].agg(F.avg("doc_len")).first()[0]) < 1e-12
    assert {r.token for r in i["token_stats"].collect()} >= {"alpha", "beta", "gamma", "t", "s"}


def folders(path, tag):
    return sorted(n for n in os.listdir(path) if n.startswith(tag))


def test_session_deltas_touch_their_buckets_only(spark, tmp_path, monkeypatch):
    """Batches one by one: what each writes, replays, late and equal changes, and compaction."""
    monkeypatch.setattr(ST, "COMPACT", 3)
    schema = "session_id string, username string, turns long, created_at timestamp, updated_at timestamp"
    out = f"{tmp_path}/out"
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    every = []

    def feed(rows, name, checkpoint="ck"):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        every.extend(rows)
        ST.upsert_stream(ST.read_stream(spark, f"{tmp_path}/in*", schema), out, f"{tmp_path}/{checkpoint}").awaitTermination()

    def state():
        return sorted(map(tuple, ST.latest(spark, out).select("session_id", "username", "turns", "created_at", "updated_at").collect()))

    feed([(f"s{i}", "u", i, at(0), at(i)) for i in range(50)], "in0")
    feed([("s1", "u", 100, at(5), at(500)), ("s1", "u", 101, at(5), at(501))], "in1")
    touched = [sum(f.startswith("bucket=") for f in os.listdir(f"{out}/{d}")) for d in folders(out, "delta")]
    assert len(touched) == 2 and sorted(touched)[0] == 1
    before, n = state(), len(folders(out, "delta"))
    # The same files under another checkpoint change nothing and write no part.
    ST.upsert_stream(ST.read_stream(spark, f"{tmp_path}/in*", schema), out, f"{tmp_path}/other").awaitTermination()
    assert state() == before and len(folders(out, "delta")) == n
    feed([("s2", "u", 7, at(0), at(1)), ("s3", "late", 7, at(-9), at(1))], "in2")  # older: the first adds nothing, the second an earlier start
    assert ("s2", "u", 2, at(0), at(2)) in state() and ("s3", "u", 3, at(-9), at(3)) in state()
    feed([("new", "u", 1, at(0), at(1))], "in3")
    assert len(folders(out, "base")) == 1 and folders(out, "delta") == []
    whole = S.upsert_sessions(spark.createDataFrame([], schema), spark.createDataFrame(every, schema))
    assert state() == sorted(map(tuple, whole.select("session_id", "username", "turns", "created_at", "updated_at").collect()))


def test_index_of_documents_that_change(spark, tmp_path, monkeypatch):
    """Updates and deletions, segments merged on the way: the index is that of what is left."""
    monkeypatch.setattr(ST, "MERGE", 2)
    from tessera.operators.retrieval import build_index

    out, schema = f"{tmp_path}/out", "doc_id string, source string, content string"
    steps = [
        [("a", "a.md", "## S\nalpha beta"), ("b", "b.md", "beta gamma"), ("c", "c.md", "gamma")], [("a", "a.md", "## S\nalpha\n## T\ndelta"), ("d", "d.md", "beta")],
        [("b", "b.md", None)], [("a", "a.md", "epsilon"), ("e", "e.md", None)], [("b", "b.md", "back again")], [("c", "c.md", "gamma gamma")],
    ]
    now = {}
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in{i}")
        ST.index_stream(ST.read_stream(spark, f"{tmp_path}/in*", schema), out, f"{tmp_path}/ck", documents=True).awaitTermination()
        now |= {r[0]: r for r in rows}
        left = spark.createDataFrame([r for r in now.values() if r[2] is not None], schema)
        want, got = build_index(ST.chunk_rows(left)), ST.read_index(spark, out)
        for name, columns in (("postings", ["token", "chunk_id", "tf", "doc_len"]), ("lengths", ["chunk_id", "doc_len"]), ("token_stats", ["token", "df"]), ("corpus_stats", ["n", "avg_len"])):
            assert sorted(map(tuple, got[name].select(*columns).collect())) == sorted(map(tuple, want[name].select(*columns).collect())), (i, name)
    assert len(folders(out, "segment")) < len(steps)


def test_lockout_state_goes_with_a_success(spark, tmp_path):
    rows = [("k", 1, "2024-01-01 00:00:00", False), ("k", 2, "2024-01-01 00:00:01", True), ("j", 3, "2024-01-01 00:00:02", False)]
    d = spark.createDataFrame(rows, "client_key string, attempt_id long, ts string, success boolean").withColumn("ts", F.to_timestamp("ts"))
    d.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = ST.lockout_stream(ST.read_stream(spark, f"{tmp_path}/in", d.schema))
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(p["numRowsTotal"] for p in q.recentProgress[0]["stateOperators"]) == 1  # that of j alone
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_lines_are_numbered_over_splits(spark, tmp_path):
    p = tmp_path / "long.jsonl"
    p.write_text("\n".join(json.dumps({"event": f"e{i}", "input_chars": i}) for i in range(1, 3001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        got = [(r.line_no, r.input_chars) for r in X.read_audit(spark, str(p)).orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, i) for i in range(1, 3001)]
