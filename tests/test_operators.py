"""Operators on small fixtures."""

from pyspark.sql import functions as F

from tessera.functions import domain as G
from tessera.functions import text as T
from tessera.operators import evaluation as E
from tessera.operators import retrieval as R
from tessera.operators import sessions as S
from tessera.operators import structure as D


def test_tokens(spark):
    rows = spark.createDataFrame([("경계근무는 OPORD 5단락",), ("메데박 요청",), ("K-9 3.1",), (None,)], "t string").select(T.tokens(F.col("t"))).collect()
    assert {"경계근무", "경계", "근무", "opord", "5"} <= set(rows[0][0])
    assert "medevac" in rows[1][0]
    assert {"k-9", "k", "9", "k9", "3.1"} <= set(rows[2][0]) and "31" not in rows[2][0]
    assert rows[3][0] == []


def test_normalised(spark):
    d = spark.createDataFrame([("ＡＢ\u200b–c",), ("plain",), (None,)], "t string")
    assert {r.t: r.n for r in T.with_normalised(d, "t", "n").collect()} == {"ＡＢ\u200b–c": "AB-c", "plain": "plain", None: None}


def test_normalised_odd_texts_meet_no_long_pattern(spark):
    """Texts of any kind as the standard library has them; the plan has no pattern of all characters that change."""
    import unicodedata

    from tessera.functions import forms

    texts = ["ascii - only", "é 한글 漢", "ｆｕｌｌ\u200b \u00adｗｉｄｔｈ – x", "e\u0301 ㎏ … ’ ﬁ", "\u1100\u1161", "가\u11a8", "\U000e0041x", "", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    n = T.with_normalised(d, "t", "n").withColumns({"odd": forms.has_odd(F.col("t")), "left": forms.odd_characters(F.col("t"))})
    for r in n.collect():
        want = None if r.t is None else "".join(c for c in unicodedata.normalize("NFKC", r.t).translate(forms.HYPHENS) if unicodedata.category(c) != "Cf")
        assert r.n == want and (r.t is None or r.odd == (r.left != ""))
    plan = T.with_normalised(d, "t", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 10_000


def test_embedder_hook(spark):
    d = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    v = {r.id: r.vector for r in T.embed(d, "id", "text", lambda texts: [[len(t or ""), 0.0] for t in texts]).collect()}
    assert v == {1: [1.0, 0.0], 2: [0.0, 0.0]}


def test_chunks(spark):
    docs = [
        ("a", "a.md", "---\nTitle: '경계 규정'\ntags: 경계, 근무\nx: 1\nx: 2\n# c: d\n---\n\n# 머리\n서문\n## 제1조\n본문\n\n```\n# not\n```\n# 둘째\n끝"),
        ("b", "b.md", "no title\n\n## S\n" + "\n\n".join(f"p{i} " + "x" * 500 for i in range(5))),
        ("c", "c.md", "\ufeff# T\n" + "y" * 3000 + "\nz"), ("d", "d.md", ""),
    ]
    c = D.chunks(spark.createDataFrame(docs, "doc_id string, source string, content string")).orderBy("doc_id", "section_no", "part").collect()
    assert [(r.doc_id, r.title, r.section, len(r.text)) for r in c] == [
        ("a", "경계 규정", "", 2), ("a", "경계 규정", "제1조", 17), ("a", "경계 규정", "둘째", 1), ("b", "b", "", 8),
        ("b", "b", "S (1)", 1008), ("b", "b", "S (2)", 1008), ("b", "b", "S (3)", 503), ("c", "T", " (1)", 1200), ("c", "T", " (2)", 1200), ("c", "T", " (3)", 602),
    ]
    assert c[0].meta.tags == ["경계", "근무"] and c[0].meta.extra == {"x": "2"}


def test_structure(spark):
    paras = ["제1장 총칙", "제1조(목적) 목적이다.", "제5조의2[특례] 특례를 둔다.", "제5조에 따라 한다.", "본문", "부칙", "제2장의 규정을 준용한다.", "제3조 및 제4조에 따라"]
    other = ["1. 개요", "2.5 km 이동", "2.1 GPS 점검", "내용", "2025. 3. 1. 개정"]
    d = spark.createDataFrame([("d", i, p) for i, p in enumerate(paras)] + [("e", i, p) for i, p in enumerate(other)], "doc_id string, paragraph_no int, text string")
    modes = D.document_modes(d)
    assert {r.doc_id: r["mode"] for r in modes.collect()} == {"d": "article", "e": "numbered"}
    got = [(r.section, r.paragraphs) for r in D.structured(d, modes).orderBy("doc_id", "section_no").collect()]
    assert got == [
        ("제1장 총칙", []), ("제1장 총칙 › 제1조(목적)", ["목적이다."]), ("제1장 총칙 › 제5조의2(특례)", ["특례를 둔다.", "제5조에 따라 한다.", "본문"]),
        ("부칙", ["제2장의 규정을 준용한다.", "제3조 및 제4조에 따라"]), ("1. 개요", ["2.5 km 이동"]), ("2.1 GPS 점검", ["내용", "2025. 3. 1. 개정"]),
    ]


def test_pages(spark):
    rows = [("f", 1, 1, "1"), ("f", 1, 2, "가나다"), ("f", 1, 3, "라마"), ("f", 1, 4, "- 3 -"), ("f", 2, 1, "2025"), ("f", 2, 2, "합니다."), ("f", 2, 3, "12"), ("f", 2, 4, "")]
    d = D.merge_lines(D.strip_page_numbers(spark.createDataFrame(rows, "doc_id string, page_no int, line_no int, text string")))
    assert [r.text for r in d.orderBy("paragraph_no").collect()] == ["가나다", "라마", "2025 합니다."]


def test_synonyms(spark):
    groups = spark.createDataFrame([(0, ["경계근무", "보초 ", "불침번"]), (1, ["불침번", "야간 근무"]), (2, ["one"])], "group_id int, words array<string>")
    g = R.synonym_groups(groups)
    assert [(r.group_id, r.word) for r in g.orderBy("group_id", "pos").collect()] == [(0, "경계근무"), (0, "보초"), (0, "불침번"), (0, "야간 근무")]
    q = spark.createDataFrame([(1, "보초 요령"), (2, "없음")], "query_id int, query string")
    assert {r.query_id: r.expanded for r in R.expand(q, g).collect()} == {1: "보초 요령 경계근무 불침번 야간 근무", 2: "없음"}


def test_equal_vectors_keep_their_cosine(spark):
    lex = spark.createDataFrame([(1, 7, 2.0, 1)], "query_id long, chunk_id long, bm25 double, bm25_rank int")
    vec = spark.createDataFrame([(1, 8, 0.5, 1), (1, 9, 0.5, 2)], "query_id long, chunk_id long, cosine double, vector_rank int")
    rows = R.fuse(lex, vec, 0.8, 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in rows] == [(7, 10.0), (8, 4.0), (9, 4.0)]


def test_keywords(spark):
    rows = [("Time of 2025", "I", False), ("plan I now", "i|zz", True), ("정지 명령", "정지|보고", True), ("x", " ", False), (None, "a", False)]
    d = spark.createDataFrame(rows, "t string, k string, e boolean").select("e", E.keyword_present(F.col("t"), F.col("k")).alias("g"))
    assert all(r.e == r.g for r in d.collect())


def test_lockout(spark):
    rows = [("k", i, f"2024-01-01 00:{i:02d}:00", False) for i in range(6)] + [("k", 6, "2024-01-01 00:10:30", True), ("k", 7, "2024-01-01 00:11:00", False)]
    d = spark.createDataFrame(rows, "client_key string, attempt_id long, ts string, success boolean").withColumn("ts", F.to_timestamp("ts"))
    assert [r.locked for r in S.lockouts(d).orderBy("attempt_id").collect()] == [False] * 5 + [True, False, False]


def test_client_address(spark):
    d = spark.createDataFrame([("10.0.0.1", " 1.2.3.4 , 10.0.0.2"), ("9.9.9.9", "1.1.1.1"), ("10.0.0.1", "10.0.0.3"), ("10.0.0.1", None)], "p string, f string")
    got = [r[0] for r in d.select(S.client_address(F.col("p"), F.col("f"), [("10.0.0.0", 8)])).collect()]
    assert got == ["1.2.3.4", "9.9.9.9", "10.0.0.3", "10.0.0.1"]


def test_dtg(spark):
    rows = [
        ("071430IOCT26", "Z", "070530ZOCT26"), ("311600ZDEC26", "KST", "010100IJAN27"), ("2026-10-07T14:30+09:00", "I", "071430IOCT26"), ("990000ZJAN26", "Z", None),
        ("071430JOCT26", "Z", None), ("bad", "Z", None), ("2026-10-07T14:30", "Z", None),
    ]
    d = spark.createDataFrame(rows, "v string, z string, e string").select("e", G.convert_dtg(F.col("v"), F.col("z")).alias("g"))
    assert all(r.e == r.g for r in d.collect())


def test_forms(spark):
    r = G.fill_forms(spark.createDataFrame([("스팟렙", {"size": "3", "zz": "1"}), ("nope", None)], "kind string, fields map<string,string>")).collect()
    assert r[0].form == "SPOTREP" and len(r[0].missing) == 6 and r[0].unknown == ["zz"] and "Size): 3" in r[0].report
    assert r[1].form is None and r[1].report is None


def test_chains_of_synonyms_end_in_one_group(spark):
    groups = spark.createDataFrame([(i, [f"w{i}", f"W{i + 1}"]) for i in range(80)] + [(200, ["a", "b"])], "group_id int, words array<string>")
    got = R.synonym_groups(groups).groupBy("group_id").count().collect()
    assert {r.group_id: r["count"] for r in got} == {0: 160, 200: 2}


def test_vectors_that_cannot_take_part(spark):
    kind = "chunk_id long, vector array<double>"
    rows = [(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [0.0, 0.0]), (5, [2.0, 2.0]), (6, []), (7, [1.0, None]), (8, [1.0, 0.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, kind)
    asked = spark.createDataFrame([(1, [3.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id long, vector array<double>")
    got = sorted((r.query_id, r.vector_rank, r.chunk_id, round(r.cosine, 6)) for r in R.vector_top(vectors, asked, 3).collect())
    assert got == [(1, 1, 1, 1.0), (1, 2, 9, 1.0), (1, 3, 5, 0.707107), (3, 1, 1, 0.0), (3, 2, 4, 0.0), (3, 3, 5, 0.0)]
    assert R.vector_top(vectors, asked.limit(0), 3).count() == 0 == R.vector_top(vectors.limit(0), asked, 3).count()


def test_expansion_looks_at_the_whole_text(spark):
    words = spark.createDataFrame([(0, "ab", 0), (0, "Long Word", 1), (1, "zz", 0), (1, "q", 1)], "group_id int, word string, pos int")
    q = spark.createDataFrame([(1, "x " * 5000 + "\nthe LONG WORDs"), (2, "y"), (3, "Q"), (4, None)], "query_id int, query string")
    got = {r.query_id: r.expanded for r in R.expand(q, words).collect()}
    assert got[1].endswith("WORDs ab") and got[2] == "y" and got[3] == "Q zz" and got[4] is None


def test_cases_without_an_answer_fail(spark):
    cases = spark.createDataFrame([(1, ["a"], [], False, "x"), (2, ["b"], [], False, "x"), (3, [], [], True, "y")], "case_id int, expected_keywords array<string>, forbidden array<string>, blocked boolean, category string")
    answers = spark.createDataFrame([(1, "A!", False, None, 1.0, 2, None, None, None)], "case_id int, answer string, blocked boolean, error string, seconds double, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long")
    r = E.answer_results(cases, answers)
    assert {x.case_id: (x.passed, x.error) for x in r.collect()} == {1: (True, None), 2: (False, "no answer"), 3: (False, "no answer")}
    m = E.answer_metrics(r).first()
    assert (m.cases, m.pass_rate, m.errors, m.keyword_rate) == (3, 0.3333, 2, 0.5)
    assert [x.case_id for x in E.sliced(cases, "x", 1).collect()] == [1] and E.sliced(cases, limit=2).count() == 2 and E.sliced(cases, "y").count() == 1


def test_users_and_sessions(spark):
    users = spark.createDataFrame([("a", 1), ("b", 2)], "username string, clearance int")
    assert S.user_count(users).first().n == 2 and S.user_named(users, "b").first().clearance == 2 and S.user_named(users, "z").count() == 0
    sessions = spark.createDataFrame([("s1", "a"), ("s2", "a"), ("s3", "b"), ("s4", "b")], "session_id string, username string")
    gone = spark.createDataFrame([("s1", "a"), ("s2", "b"), ("s3", None)], "session_id string, username string")
    assert sorted(r.session_id for r in S.without_sessions(sessions, gone).collect()) == ["s2", "s4"]
    said = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q"), (2, 1, "user", "again")], "conv_id int, turn int, role string, text string")
    assert [tuple(r) for r in S.pending_question(said).collect()] == [(2, 1, "again")]


def test_pending_questions_go_along_if_they_fit(spark):
    asked = spark.createDataFrame([(1, 50, 20), (2, 50, 60), (3, 50, None), (4, 200, 1), (5, 90, 10)], "query_id int, base_cost int, pending_cost int")
    hits = spark.createDataFrame([(i, r, 10) for i in (1, 2, 3, 4) for r in (1, 2, 3)], "query_id int, rank int, cost int")
    got = {r.query_id: (r.n_hits, r.status, r.merged) for r in S.fitted_hits(asked, hits, 100).collect()}
    assert got == {1: (3, "fitted", True), 2: (3, "fitted", False), 3: (3, "fitted", False), 4: (0, "rejected", False), 5: (0, "no_documents", True)}


def test_zone_letters(spark):
    got = {r.h: r.z for r in spark.range(-14, 15).select(F.col("id").alias("h"), G.zone_letter(F.col("id")).alias("z")).collect()}
    assert got[0] == "Z" and got[9] == "I" and got[10] == "K" and got[12] == "M" and got[-1] == "N" and got[-12] == "Y" and got[13] is None and got[-13] is None


def test_units(spark):
    rows = [(100.0, "mil", "deg", 5.625), (20.0, "kn", "km/h", 37.04), (37.0, "C", "℉", 98.6), (0.0, "섭씨", "k", 273.15), (1.0, "kg", "m", None), (1.0, "?", "m", None), (None, "m", "km", None), (5.0, " Mile ", "km", None)]
    d = G.with_converted(spark.createDataFrame(rows, "x double, a string, b string, e double"), "x", "a", "b", "g").collect()
    assert all((r.e is None) == (r.g is None) and (r.e is None or abs(r.e - r.g) < 1e-9) for r in d), d
    shown = spark.createDataFrame([(0.0,), (1234567.0,), (0.00012345,), (-2.5,), (None,)], "x double").select(G.significant(F.col("x"))).collect()
    assert [r[0] for r in shown] == ["0", "1,234,567", "0.0001234", "-2.5", None] or [r[0] for r in shown][2] == "0.0001235"


def test_running_sums(spark):
    rows = [(list(range(n)),) for n in (0, 1, 2, 3, 10, 101)]
    got = [r[0] for r in spark.createDataFrame(rows, "x array<int>").select(T.running_sums(F.col("x"))).collect()]
    assert got == [[sum(x[:i]) for i in range(len(x))] for (x,) in rows]


def test_lockouts_over_batches_and_many_keys(spark):
    """One key with very many attempts, and others, against a plain walk."""
    import random

    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(40)}", i, rng.randrange(40000), rng.random() < 0.2) for i in range(30000)]
    d = spark.createDataFrame(rows, "client_key string, attempt_id long, s long, success boolean").withColumn("ts", F.timestamp_seconds("s"))
    recent, expected = {}, {}
    for k, i, t, ok in sorted(rows, key=lambda r: (r[2], r[1])):
        mine = [x for x in recent.get(k, []) if t - x < 600]
        expected[i] = (len(mine) >= 5, len(mine))
        recent[k] = mine if len(mine) >= 5 else [] if ok else [*mine, t]
    assert {r.attempt_id: (r.locked, r.failures) for r in S.lockouts(d).collect()} == expected
