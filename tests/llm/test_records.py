"""Quality labels, WARC round trips, tool calls, audio, and the pipeline."""

import base64
import hashlib
import json
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chroma as C
from tessera.llm import registry
from tessera.llm import simhash_bk as SH
from tessera.llm import tool_calls as TC
from tessera.llm import warc as W
from tessera.llm import weak_quality as Q
from tessera.llm.shared import fresh_path


def test_labels_held_out(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    known, held = labels.where("doc_id % 3 <> 0"), labels.where("doc_id % 3 = 0")
    r = Q.classify(docs, known).join(held, "doc_id").toPandas()
    noise, abuse = r.p_noise >= 0.6, r.p_abuse >= 0.5
    assert noise[r.quality == 0].mean() > 0.95
    assert abuse[(r.toxic == 1) & (r.quality == 1)].mean() > 0.75
    clean = (r.quality == 1) & (r.toxic == 0)
    assert r.keep[clean].mean() > 0.99


def test_votes_see_all_words_of_long_texts():
    """A long table is seen to be one, wherever its separators stand; few words over and over are no variety."""
    at = {name: i for i, name in enumerate(Q.NOISE)}
    for n in (1000, 1500, 3000, 9000):
        for table in ([b"word%d |" % i for i in range(n)], [b"| word%d" % i for i in range(n)], [b"a%d b%d |" % (i, i) for i in range(n)]):
            assert Q.noise_votes(b" ".join(table))[at["separators"]] == Q.BAD
    distinct = [b"word%d" % i for i in range(5000)]
    assert Q.noise_votes(b" ".join(distinct))[at["variety"]] == Q.GOOD
    # Every other word is one and the same hundred: half of each part repeats, at any length.
    mixed = [w for i, x in enumerate(distinct) for w in (x, b"again%d" % (i % 100))]
    assert abs(Q.variety(mixed[:2000]) - Q.variety(mixed)) < 1e-9
    assert Q.variety([b"a", b"b"] * 1500) > 0.6 > Q.variety(distinct)


def plain_em(votes, right=None, rounds=2000):
    """EM over documents one by one: posteriors of bad. right: (labeller, share) that is believed in as Q.BELIEF says."""
    n, labellers = len(votes), len(votes[0])
    post = []
    for v in votes:
        bad, good = v.count(Q.BAD), v.count(Q.GOOD)
        post.append(min(0.98, max(0.02, 0.1 + 0.8 * ((bad + 0.5) / (bad + 0.5 * good + 0.5) if bad else 0))))
    for _ in range(rounds):
        prior = (sum(post) + 1) / (n + 2)
        table = {}
        for j in range(labellers):
            spoken = sum(v[j] != Q.ABSTAIN for v in votes)
            silent = (n - spoken + 0.5) / (n + 1)
            for c in (0, 1):
                count = [0.5] * 3
                if right and j == right[0]:
                    for k, share in ((Q.ABSTAIN, silent), (Q.GOOD, (1 - silent) * (1 - right[1] if c else right[1])), (Q.BAD, (1 - silent) * (right[1] if c else 1 - right[1]))):
                        count[k] += Q.BELIEF * spoken * share
                for v, p in zip(votes, post):
                    count[v[j]] += p if c else 1 - p
                table[j, c] = [x / sum(count) for x in count]
        new = []
        for v in votes:
            good, bad = 1 - prior, prior
            for j in range(labellers):
                good, bad = good * table[j, 0][v[j]], bad * table[j, 1][v[j]]
            new.append(bad / (good + bad))
        moved, post = max(abs(a - b) for a, b in zip(new, post)), new
        if moved < 1e-6:
            break
    return post


def test_votes_and_posteriors_by_brute_force(spark, sf):
    """The counts of vote patterns are those of the documents one by one, and EM on counts is EM on documents."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    noise, abuse = {}, {}
    for r in docs.collect():
        q, t = known.get(r.doc_id, (None, None))
        text = (r.text or "").encode()
        noise[r.doc_id] = [*Q.noise_votes(text), {None: Q.ABSTAIN, 1: Q.GOOD, 0: Q.BAD}[q]]
        abuse[r.doc_id] = [*Q.abuse_votes(text), {None: Q.ABSTAIN, 0: Q.GOOD, 1: Q.BAD}[t]]
    code = lambda v: sum(x * 3**i for i, x in enumerate(v))
    got = {r.doc_id: (r.noise, r.abuse) for r in Q.annotate(docs, labels, "doc_id", "text").collect()}
    assert got == {i: (code(noise[i]), code(abuse[i])) for i in noise}
    for votes in (noise, abuse):
        codes, last = [code(v) for v in votes.values()], len(next(iter(votes.values()))) - 1
        post, _ = Q.estimate({c: codes.count(c) for c in codes}, last + 1, trusted=(last,))
        assert max(abs(post[c] - p) for c, p in zip(codes, plain_em(list(votes.values()), (last, Q.RIGHT)))) < 1e-3


def test_training_is_the_same_in_any_order(spark, sf):
    """Repeated ids with unlike texts, ties and another dealing of rows change nothing."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.union(docs.where("doc_id % 3 = 0").withColumn("text", F.lit("you are an idiot"))).withColumn("keep", F.lit(7))
    a, b = (sorted((r.doc_id, round(r.p_noise, 9), round(r.p_abuse, 9)) for r in Q.classify(d, labels).collect()) for d in (docs, docs.repartition(5)))
    assert a == b and len(a) == docs.count()
    empty = Q.classify(docs.limit(0), labels)
    assert empty.count() == 0 and {"doc_id", "p_noise", "p_abuse", "keep"} <= set(empty.columns)


def test_estimated_chances_are_near_the_true_ones():
    rng = np.random.default_rng(3)
    truth = rng.random(20000) < 0.3
    right, speaks = (0.95, 0.8, 0.7), (0.9, 0.6, 0.8)
    code = np.zeros(20000, int)
    for j in range(3):
        vote = np.where(rng.random(20000) < right[j], truth, ~truth)
        code += np.where(rng.random(20000) < speaks[j], np.where(vote, Q.BAD, Q.GOOD), Q.ABSTAIN) * 3**j
    counts = dict(zip(*(x.tolist() for x in np.unique(code, return_counts=True))))
    post, chances = Q.estimate(counts, 3)
    for j in range(3):
        said = chances[j][:, 1:]
        assert abs(said[1, 1] / said[1].sum() - right[j]) < 0.06 and abs(said[0, 0] / said[0].sum() - right[j]) < 0.06
    assert np.mean((np.vectorize(post.get)(code) > 0.5) == truth) > 0.9


def test_quality_edges(spark):
    kind = "doc_id long, text string, keep int"
    rows = [(1, None, 0), (2, "", 0), (None, "x", 0), (3, "same", 0), (3, "same", 0), (4, "word " * 60000, 0)]
    d = spark.createDataFrame(rows, kind)
    labels = spark.createDataFrame([(3, 0, None), (3, 1, 1), (None, None, 1)], "doc_id long, quality int, toxic int")
    for have in (None, labels, labels.limit(0)):
        got = Q.classify(d, have, keep_columns=True)
        assert sorted(str(r.doc_id) for r in got.collect()) == sorted(str(r[0]) for r in rows) and "p_noise" in got.columns
    assert Q.classify(d.limit(0), labels).count() == 0


def test_warc_round_trip(spark, sf):
    odd = spark.createDataFrame(
        [(1, None, None), (2, "http://A.b/c\td\n\\x\0", "é"), (3, None, ""), (4, "x", "é"), (4, "x", "é"), (None, "http://q", "zz"), (None, None, None), (7, "https://a.b.c/?q=1#f", "zz"), (8, "http://ü.de/ß", "<html>" * 1000)],
        "page_id long, url string, html string",
    ).withColumn("key", F.lit(1))
    for pages, how in ((spark.read.parquet(f"{sf}/pages.parquet"), {"archive_bytes": 20000, "block_lines": 7}), (odd, {}), (odd.limit(0), {})):
        got = sorted((tuple(r) for r in W.round_trip(pages, **how).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
        rows, top, expected = pages.collect(), {}, []
        for r in rows:
            top[r.html or ""] = max(top.get(r.html or "", -1), -1 if r.page_id is None else r.page_id)
        for r in rows:
            b, h = (r.html or "").encode(), top[r.html or ""]
            again = h != -1 and r.page_id != h
            expected.append((r.page_id, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", h if again else None))
        assert got == sorted(expected, key=str)


def test_repeated_keys_over_blocks_and_parts(spark):
    """Rows with one url and id are a record each, though they fill blocks and parts; shared digests joined without a broadcast give the same types."""
    rows = [(5, "http://a.b/", f"page {i % 37}") for i in range(90)] + [(None, None, f"x{i}") for i in range(30)] + [(6, "http://a.b/", "page 1"), (4, "http://a.b/", "big " * 400000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = sorted((tuple(r) for r in W.round_trip(pages, archive_bytes=900, block_lines=4).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    top = {}
    for i, _, h in rows:
        top[h] = max(top.get(h, -1), -1 if i is None else i)
    expected = []
    for i, _, h in rows:
        again = top[h] != -1 and i != top[h]
        expected.append((i, len(h), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if again else "response", top[h] if again else None))
    assert got == sorted(expected, key=str)
    a, b = (sorted(map(str, W.with_types(pages, broadcast_rows=n).drop("html", "salt").collect())) for n in (0, 1000))
    assert a == b


def test_archives_hold_whole_payloads(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    archives, places = W.write_archives(W.with_types(pages, min_bytes=1 << 40), 30000)
    assert archives.count() > 1 and places.count() == pages.count()
    found = {h["WARC-Record-ID"]: p.decode() for r in archives.collect() for h, p in W.records(bytes(r.data))}
    assert found == {f"<urn:page:{r.page_id}>": r.html for r in pages.collect()}


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [(1, 1, "a", "note", '{"text":"x","tags":["q"]}', None), (1, 2, "b", "search", '{"query":"é","limit":3}', "a"), (1, 3, "c", "search", '{"limit":true}', "b"), (1, 4, "d", "zzz", "{}", "e"),
         (1, 5, "e", "note", "[1", "d"), (1, 6, None, "note", None, "a"), (1, 7, "f", "note", "{}", "d"), (None, 1, "a", "note", '{"tags":[1],"text":"t"}', "nope"), (1, 1, "a", "note", '{"text":"x","tags":["q"]}', None)],
        "conv_id long, turn long, call_id string, name string, arguments string, parent string",
    ).withColumn("depth", F.lit("z"))
    results = spark.createDataFrame([(1, 2, "a", "r1"), (1, 1, "a", "r0"), (1, 3, "zz", "o"), (None, 2, "a", "n"), (1, 9, None, "x")], "conv_id long, turn long, call_id string, content string")
    got = sorted(((r.conv_id, r.turn, r.call_id, r.depth, r.status, r.n_results, r.valid) for r in TC.link(calls, results).collect()), key=str)
    assert got == sorted(
        [(None, 1, "a", 0, "answered", 1, False), (1, 1, "a", 0, "answered", 2, True), (1, 1, "a", 0, "answered", 2, True), (1, 2, "b", 1, "unanswered", 0, True), (1, 3, "zz", None, "orphan", 1, False),
         (1, 3, "c", 2, "unanswered", 0, False), (1, 4, "d", None, "cyclic", 0, False), (1, 5, "e", None, "cyclic", 0, False), (1, 6, None, None, "unanswered", 0, False), (1, 7, "f", None, "cyclic", 0, False),
         (1, 9, None, None, "orphan", 1, False)],
        key=str,
    )
    assert TC.link(calls.limit(0), results.limit(0)).count() == 0


def test_tool_calls_of_conversations(spark, sf):
    """Against a plain walk over each conversation; every call stands after the one it builds on."""
    calls, results = TC.calls_of(spark.read.parquet(f"{sf}/conversations.parquet"))
    by = {(r.conv_id, r.call_id): r for r in calls.collect()}
    said = {}
    for r in results.collect():
        said.setdefault((r.conv_id, r.call_id), []).append((r.turn, r.content))

    def depth(r):
        up = by.get((r.conv_id, r.parent))
        return 0 if up is None else 1 + depth(up)

    got = TC.op10(spark, sf).collect()
    linked = [r for r in got if r.status != "orphan"]
    assert len(linked) == len(by) and sum(r.status == "orphan" for r in got) == sum(len(v) for k, v in said.items() if k not in by)
    for r in linked:
        call, answers = by[r.conv_id, r.call_id], sorted(said.get((r.conv_id, r.call_id), []))
        assert r.depth == depth(call) and r.n_results == len(answers) and r.valid == (not TC.violations(json.loads(call.arguments), TC.TOOLS[call.name]))
        assert json.loads(r.canonical) == {
            "arguments": json.loads(call.arguments), "depth": r.depth, "id": r.call_id, "name": r.name, "result": answers[0][1] if answers else None, "status": r.status,
        }
        assert r.canonical == json.dumps(json.loads(r.canonical), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_long_chains_of_calls(spark):
    n = 300
    d = spark.createDataFrame([(1, f"c{i}", f"c{i - 1}" if i else None) for i in range(n)], "conv_id long, call_id string, parent string")
    assert sorted(r.depth for r in TC.depths(d).collect()) == list(range(n))


def test_cycles_end_soon_and_arguments_may_be_anything(spark):
    deep = "[" * 100000 + "]" * 100000
    texts = ['{"query":"\\ud800"}', '{"query":NaN}', '{"query":"q","limit":1e999}', deep, "", "null", '{"text":"\\ud83d\\ude00","tags":[]}', '{"query":"' + "long " * 300000 + '"}', '{"\\udc00":1,"query":"q"}']
    kind = "conv_id long, turn long, call_id string, name string, arguments string, parent string"
    rows = [(1, i, f"c{i}", "note" if "tags" in t else "search", t, f"c{i ^ 1}" if i < 2 else None) for i, t in enumerate(texts)]
    calls = spark.createDataFrame(rows, kind)
    got = {r.turn: r for r in TC.link(calls, spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")).collect()}
    assert [got[i].status for i in range(3)] == ["cyclic", "cyclic", "unanswered"]
    assert got[0].valid and json.loads(got[0].canonical)["arguments"] == {"query": "\ud800"} and "\\ud800" in got[0].canonical
    assert all(got[i].violations == ["not JSON"] for i in (1, 2, 3, 4)) and got[5].violations == ["$: not object"]
    assert got[6].valid and "\U0001f600" in got[6].canonical and got[7].valid and got[8].violations == ["$.\\udc00: unknown"]
    assert all("NaN" not in r.canonical and "Infinity" not in r.canonical for r in got.values())


def test_calls_with_several_parents(spark):
    """Depth is that of the longest chain, over forks, chains between them, repeats and cycles."""
    rng = np.random.default_rng(2)
    up = {}
    for i in range(120):
        up[i] = sorted(set(rng.integers(max(0, i - 9), i, rng.integers(0, 4)).tolist())) if i % 10 else []
    up |= {200: [201, 5], 201: [200], 202: [201, 3], 203: [202], 204: [999, 4]}  # a cycle, what stands on it, and a parent that is none
    rows = [(c, f"c{i}", [f"c{j}" for j in up[i]] or None) for i in up for c in (1, 2)]
    rows += [(1, "c7", None), (None, "c1", ["c0"]), (1, None, ["c1"])]
    d = spark.createDataFrame(rows, "conv_id long, call_id string, parent array<string>")

    def depth(i, seen=()):
        if i in seen:
            return None
        below = [depth(j, (*seen, i)) for j in up[i] if j in up]
        return None if None in below else 1 + max(below, default=-1)

    got = {(r.conv_id, r.call_id): r.depth for r in TC.depths(d).collect()}
    assert got == {(c, f"c{i}"): depth(i) for i in up for c in (1, 2)} | {(None, "c1"): 0}


def song(n, seed):
    t, g = np.arange(256) / 2048, np.random.default_rng(seed)
    return np.concatenate([9000 * np.sin(2 * np.pi * 220 * 2 ** (g.integers(24) / 12) * t) for _ in range(n)])


def test_audio(spark):
    a, c = song(120, 1), song(120, 2)
    b = np.concatenate([song(20, 5), a]) + np.random.default_rng(0).normal(0, 300, 140 * 256)
    fa, fb, fc, late = (C.fingerprint(C.chroma(x.astype("<i2"))) for x in (a, b, c, a[256 * 10 + 32 :] * 0.5))
    assert C.offsets(fa, fb)[0] == -40 and C.at_offset(fa, fb, -40)[0] < 0.05 and not C.same_recording(fa, fc) and C.same_recording(fa, late)
    assert len(C.fingerprint(C.chroma(np.zeros(10000)))) > 0 and len(C.fingerprint(C.chroma(np.zeros(10)))) == 0
    raw = lambda x: bytearray(x.astype("<i2").tobytes())
    rows = [(5, raw(a)), (3, raw(b)), (9, raw(c)), (7, raw(a)), (1, None), (2, bytearray(b"x")), (None, raw(c)), (5, raw(a))]
    d = spark.createDataFrame(rows, "media_id long, audio binary").withColumn("fp", F.lit(0))
    got = sorted(((r.media_id, r.group_id) for r in C.recording_groups(d).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 9), (7, 3), (1, 1), (2, 2), (None, 9), (5, 3)], key=str)
    assert C.recording_groups(d.limit(0)).count() == 0


def brute_recordings(fps, run=C.RUN):
    """Groups of recordings by the rule itself: every pair, offsets counted one shared run after another, bits compared at the peaks."""
    words = {i: {} for i in fps}
    for i, x in fps.items():
        for at in range(len(x) - run + 1):
            words[i].setdefault((x[at : at + run] & C.SIGNS).tobytes(), []).append(at)

    def same(i, j):
        x, y = fps[i], fps[j]
        votes = Counter(p - q for w in words[i].keys() & words[j].keys() for p in words[i][w] for q in words[j][w])
        for o, n in votes.items():
            if max(votes.get(o - 1, 0), votes.get(o + 1, 0)) > n or votes.get(o - 1) == votes.get(o + 1) == n:
                continue
            u, v = x[max(0, o) :], y[max(0, -o) :]
            n = min(len(u), len(v))
            if n >= max(8, 0.5 * min(len(x), len(y))) and sum(int(a ^ b).bit_count() for a, b in zip(u[:n], v[:n])) <= 0.2 * 32 * n:
                return True
        return False

    from tests.llm.test_dedup import brute_groups

    return brute_groups({i: i for i in fps}, same)


def test_histogram_of_offsets():
    """Against counting one by one, with long held values, nothing in common, and in small steps."""
    rng = np.random.default_rng(4)
    for n, m, kinds in [(1, 1, 1), (60, 40, 1), (80, 50, 3), (50, 90, 40), (30, 30, 10**6)]:
        a, b = (np.repeat(rng.integers(kinds, size=k), rng.integers(1, 5, size=k))[:k] for k in (n, m))
        votes = Counter(i - j for i in range(len(a)) for j in range(len(b)) if a[i] == b[j])
        for C.MEETINGS in (3, 1 << 20):
            assert C.histogram(a, b).tolist() == [votes[o] for o in range(1 - len(b), len(a))]


def test_recordings_against_brute_force(spark):
    """Songs with noisy copies (10 dB), excerpts and held tones: every pair that fits is joined, and nearly all copies fit."""
    rng, rows, copies = np.random.default_rng(3), [], []
    for i in range(40):
        s = song(int(rng.integers(30, 120)), 100 + i).astype(float)
        if i % 4 == 0:
            s = np.concatenate([s, np.tile(song(1, i), 40)])
        noisy = s + rng.normal(size=len(s)) * s.std() / 10 ** (10 / 20)
        cut = 128 * int(rng.integers(0, len(s) // 400)) + int(rng.integers(-32, 33)) % 128
        excerpt = s[cut : cut + max(len(s) // 2, 256 * 20)]
        copies += [(3 * i, 3 * i + 1), (3 * i, 3 * i + 2)]
        rows += [(3 * i + k, bytearray(x.clip(-32768, 32767).astype("<i2").tobytes())) for k, x in enumerate((s, noisy, excerpt))]
    got = C.recording_groups(spark.createDataFrame(rows, "media_id long, audio binary")).collect()
    groups = {r.media_id: r.group_id for r in got}
    assert groups == brute_recordings({r.media_id: np.frombuffer(r.fp, "<u4") for r in got})
    assert sum(groups[a] == groups[b] for a, b in copies) >= 0.9 * len(copies)
    assert len({groups[3 * i] for i in range(40)}) == 40


def test_runs_of_two_recordings_are_done_once(spark, monkeypatch):
    """Only runs that more than two recordings share meet the groups again, and few chance runs make no histogram."""
    a, b = song(100, 21), song(100, 22)
    noisy = lambda x, k: x + np.random.default_rng(k).normal(0, 300, len(x))
    rows = [(i, bytearray(x.astype("<i2").tobytes())) for i, x in enumerate((a, noisy(a, 1), b, noisy(b, 2), noisy(b, 3)))]
    met, plain = [], C.with_groups

    def seen(posts, comp):
        if comp is not None:
            met.append(posts.groupBy("key").count().agg(F.min("count"), F.max("count")).first())
        return plain(posts, comp)

    monkeypatch.setattr(C, "with_groups", seen)
    got = {r.media_id: r.group_id for r in C.recording_groups(spark.createDataFrame(rows, "media_id long, audio binary")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2} and [tuple(m) for m in met] == [(3, 3)]
    x, y = (C.fingerprint(C.chroma(s.astype("<i2"))) for s in (np.concatenate([a, song(12, 5)]), np.concatenate([song(12, 5), b])))
    assert 0 < len(np.intersect1d(C.runs(x), C.runs(y))) <= C.FEW
    monkeypatch.setattr(C, "offsets", None)
    assert not C.same_recording(x, y)


def test_meetings_of_recordings_are_cut_anywhere(spark, monkeypatch):
    """Sorted runs in batches of any length give the meetings of brute force; small limits take every path and give the same groups."""
    rng = np.random.default_rng(6)
    for _ in range(60):
        posts = sorted({(int(k), int(r)) for k, r in zip(rng.geometric(0.15, 70), rng.integers(0, 40, 70))})
        rows = [(k, r, int(rng.integers(-1, 30)) << 32 | 60, r % 3) for k, r in posts]
        cuts = [0, *sorted(rng.integers(0, len(rows), 5).tolist()), len(rows)]
        by = {k: [x for x in rows if x[0] == k] for k, _ in posts}
        meet = lambda x, y: C.ANYWHERE if min(x[2], y[2]) < 0 else (x[2] >> 32) - (y[2] >> 32)
        fit = lambda o: o == C.ANYWHERE or 60 - abs(o) >= 30

        def batches(names):
            return (pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in rows[i:j]], pa.schema([(n, pa.int64()) for n in names])) for i, j in zip(cuts, cuts[1:]))

        def rows_of(found):
            return sorted((tuple(r.values()) for b in found for r in b.to_pylist()), key=str)

        want = [(*x[:3], v[0][1] if i and fit(meet(v[0], x)) else None, meet(v[0], x), len(v) > 2) for v in by.values() if len(v) > 1 for i, x in enumerate(v)]
        assert rows_of(C.shared_runs(batches(["key", "row", "place"]))) == sorted((w for w in want if w[3] is not None or w[5]), key=str)
        monkeypatch.setattr(C, "TOGETHER", 5)
        want = [(k, None, None, None) for k, v in by.items() if len(v) > 5]
        want += [(k, x[1], y[1], meet(x, y)) for k, v in by.items() if len(v) <= 5 for i, x in enumerate(v) for y in v[i + 1 :] if i and x[3] != y[3] and fit(meet(x, y))]
        got = set(rows_of(C.pairs_apart(batches(["key", "row", "place", "grp"]))))
        assert got == set(want)
    for n, v in (("TOGETHER", 2), ("PIECE", 3000), ("ROW_MEETINGS", 1), ("COMPARED", 100)):
        monkeypatch.setattr(C, n, v)
    rows = []
    for i in range(6):
        s = np.concatenate([song(40, 300 + i), np.tile(song(1, i % 2), 30), song(40, 320 + i // 2)])
        rows += [(4 * i + k, bytearray((s[256 * 10 * k :] + rng.normal(0, 300 * k, len(s) - 256 * 10 * k)).astype("<i2").tobytes())) for k in range(4)]
    got = C.recording_groups(spark.createDataFrame(rows, "media_id long, audio binary")).collect()
    assert {r.media_id: r.group_id for r in got} == brute_recordings({r.media_id: np.frombuffer(r.fp, "<u4") for r in got})


def test_audio_of_conversations(spark):
    """All turns of a larger table against brute force over their distinct fingerprints."""
    sf = "/root/testdata/sf0.01"
    turns = spark.read.parquet(f"{sf}/conversations.parquet").withColumn("media_id", F.col("conv_id") * 65536 + F.col("turn"))
    fps = {}
    for r in C.fingerprints(C.tones(turns, "media_id", "text")).orderBy("media_id").collect():
        fps.setdefault(r.fp if len(r.fp) else r.media_id, r.media_id)
    ids = {i: np.frombuffer(fp, "<u4") for fp, i in fps.items() if isinstance(fp, (bytes, bytearray))}
    comp = brute_recordings(ids)
    got = {r.media_id: r.group_id for r in C.op7(spark, sf).collect()}
    assert len(got) == turns.count() and {i: got[i] for i in ids} == comp


def test_long_audio(spark):
    """Half an hour in one recording, and an excerpt of more than half of it."""
    s = song(14000, 9)
    rows = [(1, bytearray(s.astype("<i2").tobytes())), (2, bytearray(s[256 * 3000 + 24 :].astype("<i2").tobytes())), (3, bytearray(song(14000, 10).astype("<i2").tobytes()))]
    got = {r.media_id: r.group_id for r in C.recording_groups(spark.createDataFrame(rows, "media_id long, audio binary")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "suffix_array_dedup", "source_mixing", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        before, path = docs, fresh_path(spark, name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
        if name != "best_fit_packing":
            assert docs.columns == columns
        if name == "simhash_near_dedup":
            sets = {r.doc_id: frozenset(SH.shingle_hashes(r.text, 5).tolist()) for r in before.collect()}
            kept = {r.doc_id for r in docs.collect()}
            from tests.llm.test_dedup import brute_groups

            assert kept == set(brute_groups(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b)).values())
    assert sizes[0] < 200 and sizes[1] < sizes[0] and docs.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_stages_keep_rows_with_null_or_equal_ids(spark, sf):
    """Unlike texts stay, whatever their ids; of copies one row stays, and passages are cut row by row."""
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    a, b, c, d, e, f = (text(60) for _ in range(6))
    passage = text(20)
    rows = [(None, a), (None, b), (None, c), (None, c), (7, c), (8, d), (8, e), (8, d), (9, d), (5, passage), (11, f"{f} {passage}"), (11, f"{passage} {a[:20]} {b[:20]}")]
    d0 = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    path = fresh_path(spark, "ids")
    d0.write.parquet(path)
    docs = spark.read.parquet(path)
    kept = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns
    left = [r for r in rows if r not in ((None, c), (9, d))]
    left.remove((8, d))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(left, key=str)
    path = fresh_path(spark, "ids")
    kept.write.parquet(path)
    cut = corpus_pipeline.repeated_passages(spark, spark.read.parquet(path), sf)
    got = sorted(((r.doc_id, r.text) for r in cut.collect()), key=str)
    assert len(got) == len(left) and {(None, a), (None, b), (7, c), (8, d), (8, e), (5, passage)} <= set(got)
    assert sum(passage in t for _, t in got) == 1 and sum(t.startswith(f) for _, t in got) == 1


def test_stages_on_edges(spark, sf, tmp_path):
    """Every stage: an empty table; null, empty and very long texts; null and repeated ids; repeated rows; more columns with odd names."""
    rng = np.random.default_rng(8)
    long = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 60000))
    text = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**6, n))
    a, b = text(80), text(80)
    rows = [(1, None, "s"), (2, "", None), (3, a, "s"), (3, b, None), (None, a + " more", "s"), (None, text(30), "t"), (7, b, "t"), (7, b, "t"), (9, long, "s"), (10, "one", "t")]
    names = ["row", "rest", "doc", "text2", "p_noise", "keep", "size", "taken", "key", "__id", "spans"]
    d = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for n in names:
        d = d.withColumn(n, F.concat(F.lit("x-"), F.col("doc_id").cast("string")))
    d.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), sf)
        assert empty.count() == 0
        got = stage(spark, docs, sf)
        if name == "best_fit_packing":
            assert {r.doc_id for r in got.collect()} == {r[0] for r in rows} and got.agg(F.max(F.col("offset") + F.col("length"))).first()[0] == 2048
            continue
        assert got.columns == docs.columns == empty.columns
        kept = got.collect()
        assert all(r[n] == (None if r.doc_id is None else f"x-{r.doc_id}") for r in kept for n in names)
        texts = sorted(((r.doc_id, r.text) for r in kept), key=str)
        if name == "quality_classifier":
            assert len(kept) == len(rows)
        elif name == "simhash_near_dedup":
            left = sorted([(i, t) for i, t, _ in rows if (i, t) not in ((2, ""), (7, b), (None, a + " more"))], key=str)
            assert texts == left
        elif name == "suffix_array_dedup":
            assert (1, None) in texts and (2, "") in texts and (9, long) in texts and texts.count((7, b)) == 0 and sum(r.doc_id == 7 for r in kept) == 0
            assert [r.text for r in kept if r.doc_id is None and r.text.endswith(" more")] == [" more"]
        else:
            assert {r.doc_id for r in kept} <= {r[0] for r in rows}


def test_registry():
    assert [k.split("_")[0] for k in registry.queries()] == [f"op{i}" for i in range(1, 14)]
