import numpy as np
from pyspark.sql import functions as F

from tessera.llm import hash_forest as HF
from tessera.llm import link_trust as LT
from tests.conftest import same_as_sql


def recall(spark, vectors, **how):
    d = vectors.toPandas()
    x, ids = np.stack(d.embedding).astype(float), d.vec_id.to_numpy()
    got = {}
    for r in HF.search(vectors, F.col("vec_id") % 20 == 0, **how).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    at = {v: i for i, v in enumerate(ids)}
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        mine = sorted(got[ids[i]])
        assert [r for r, _, _ in mine] == list(range(1, len(mine) + 1)) and len(mine) == min(20, len(ids) - 1)
        assert all(abs(s[at[v]] - score) < 1e-12 for _, v, score in mine)
        assert [m[1] for m in mine] == [m[1] for m in sorted(mine, key=lambda m: (-m[2], m[1]))]
        hit += len(set(best) & {v for _, v, _ in mine})
        total += len(best)
    return hit / total


def test_recall_of_the_forest(spark):
    for size in ("sf0.001", "sf0.1"):
        vectors = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
        assert recall(spark, vectors) >= 0.9
    # Several shards, and more packed query rows than one.
    assert recall(spark, vectors, shard_rows=600, query_rows=32) >= 0.9


def test_prefixes_meet_all_rows_in_the_end():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    codes = HF.hash_strings(x, HF.directions(16, 4, 20))
    order = np.argsort(codes, 1, kind="stable")
    held = np.take_along_axis(codes, order, 1)
    for wanted in (1, 10, 100, 299, 300, 1000):
        met = HF.candidates(codes[:, 5], held, order, wanted, 20)
        assert 5 in met and len(met) >= min(wanted, 300)


def test_forest_edges(spark):
    rows = [
        (0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [float("nan"), 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [None, 1.0]), (80, [1.0, 2.0, 3.0]),
        (None, [1.0, 1.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0]), (4, [float("inf"), 1.0]),
    ]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit(1)).withColumn("score", F.lit("x"))
    got = [tuple(r) for r in HF.search(d, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 100, 0.0), (0, 4, 100, 0.0), (100, 1, 1, 1.0), (100, 2, 2, 1.0), (100, 3, 0, 0.0)]
    assert HF.search(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_link_trust_equals_sql(spark, sf):
    same_as_sql(LT.op1(spark, sf), LT.OP1_SQL, sf)


def test_ranks_against_matrix_powers(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("b", "d"), ("e", "e2")]
    pages = spark.createDataFrame(
        [(i, f"http://{s}.test/x", f'<a href="http://{t}.test/">') for i, (s, t) in enumerate(links)], "page_id long, url string, html string"
    ).withColumn("host", LT.host_of())
    edges = LT.host_edges(pages).checkpoint()
    seeds = spark.createDataFrame([("a.test", 1.0)], "host string, seed double")
    got = {r.host: r["rank"] for r in LT.personalised_rank(edges, seeds).collect()}
    names = sorted({r.src for r in edges.collect()} | {r.dst for r in edges.collect()})
    m = np.zeros((len(names), len(names)))
    for r in edges.collect():
        m[names.index(r.dst), names.index(r.src)] = r.share
    start = np.array([float(n == "a.test") for n in names])
    rank = start.copy()
    for _ in range(LT.ROUNDS):
        rank = 0.15 * start + 0.85 * m @ rank
    assert all(abs(got.get(n, 0.0) - v) < 1e-12 for n, v in zip(names, rank))


def test_link_trust_edges(spark):
    rows = [
        (1, None, None), (2, "no scheme", "x"), (3, "http://A.Example.org/es/x?q", ""), (4, "https://example.org/en/12#t", None), (5, "http://sub.com/fr/", None),
        (6, "http://sub.com/de/", None), (7, "http://x.org", None), (8, "http://notorg/", None), (9, "http://spam.net/", '<a href="//sub.com/de/">'), (9, "http://spam.net/", '<a href="//sub.com/de/">'),
        (10, "://", None), (11, "http://friend.net/a?b=/es/", "<img src=http://SUB.com/y>"),
    ]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("z")).withColumn("host", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in LT.judge(d).collect()}
    assert got[1] == ("", "", None, "allow") == got[2] == got[10]
    assert got[3] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[4] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[5][2:] == ("com/fr/", "allow") and got[6][2:] == ("com/de/", "block")
    assert got[7] == ("x.org", "", None, "allow") and got[8] == ("notorg", "/", None, "allow")
    # Both link to a host with one page allowed and one blocked: distrust comes back along the link, trust does not.
    assert got[9][3] == "block" and got[11] == ("friend.net", "/a", None, "block")
    assert LT.judge(d.limit(0)).count() == 0


def test_small_and_distant_distrust_blocks(spark):
    """A rank below ten decimals counts, and so does one that comes over more than twelve edges."""
    pages = [(0, "http://bad.com/de/", None), (1, "http://h1.net/", '<a href="//bad.com/">')]
    pages += [(i, f"http://h{i}.net/", f'<a href="//h{i - 1}.net/">') for i in range(2, 17)]
    many = "".join(f'<a href="//x{i}.net/">' for i in range(50))
    pages += [(20, "http://far.net/", '<a href="//h16.net/">' + many), (21, "http://fine.net/", '<a href="//x1.net/">')]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.distrust) for r in LT.judge(d).collect()}
    assert all(got[i][0] == "block" and got[i][1] > 0 for i in [*range(17), 20]) and got[21] == ("allow", 0.0)
    edges = LT.host_edges(d.withColumn("host", LT.host_of())).checkpoint()
    seeds = spark.createDataFrame([("bad.com", 1e-9)], "host string, seed double")
    rank = LT.personalised_rank(LT.reversed_edges(edges), seeds, rounds=None).withColumn("rank", LT.rounded(F.col("rank")))
    ranks = {r.host: r["rank"] for r in rank.collect()}
    assert all(ranks[f"h{i}.net"] > 0 for i in range(1, 17)) and 0 < ranks["far.net"] < 5e-11


def test_a_table_of_rules_is_the_list_of_rules(spark, sf):
    """The joined form gives what the expression gives, and takes more rules than an expression could."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("host", LT.host_of()).withColumn("path", LT.path_of())
    rules = [*LT.RULES, ("block", "org", "/"), ("block", "com", ""), ("allow", "com", "")]
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    a, b = (sorted((r.page_id, r["__r"]) for r in LT.with_rules(pages, x).select("page_id", "__r").collect()) for x in (tuple(rules), table))
    assert a == b and len({r for _, r in a}) > 2
    many = tuple([*rules, *[("block", f"h{i}.example", "/") for i in range(1500)]])
    got = {r.page_id: r.verdict for r in LT.judge(spark.read.parquet(f"{sf}/pages.parquet"), many).collect()}
    assert got == {r.page_id: r.verdict for r in LT.judge(spark.read.parquet(f"{sf}/pages.parquet"), tuple(rules)).collect()}
