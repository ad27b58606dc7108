"""Main text of pages, phrase collocations, and the divergence of sources."""

import html as entities
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import divergence as D
from tessera.llm import line_blocks as L
from tessera.llm import phrases as P
from tests.conftest import same_as_sql


def rows(df):
    return [tuple(r) for r in df.collect()]


# Main text ---------------------------------------------------------------------------------


def text_of_article(page):
    """The blocks of the one article element of a page of the given tables, by plain pattern matching."""
    inside = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S).group(1)
    blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>?", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(b for b in blocks if b)


def test_pages_of_the_tables(spark, sf):
    got = {r.page_id: (r.text, r.n_chars) for r in L.op11(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages) > 0
    for r in pages:
        want = text_of_article(r.html)
        assert got[r.page_id] == (want, len(want))


LONG = "Real text of the article that goes on for a while. " * 6
PLAIN = f"""<!doctype html><html><head><title>Site</title><style>p{{}}</style></head><body class="no-sidebar">
<div id="header"><h2>Site name</h2></div><ul class="main-menu"><li><a href=a>Home</a><li><a href=b>About</a></ul>
<div class="cookie-notice">{LONG}</div>
<div class="wrap"><h1>Headline</h1><div class="meta">By someone</div>
<div class="text"><p>{LONG}<p>Short.<ul><li>one<li>two &amp; a half</ul><div class="advert">{LONG}</div><p>{LONG}</div></div>
<div class="sideBar"><p>{LONG}</div><section id="comments"><article class="comment"><p>{LONG}</article></section>
<form><p>{LONG}<input></form><p>Copyright 2020 Someone. {LONG}</body></html>"""


def test_page_without_an_article_element():
    want = ["Headline", "By someone", LONG.strip(), "Short.", "one", "two & a half", LONG.strip()]
    assert L.blocks_of_text(PLAIN) == want


@pytest.mark.parametrize("page, want", [
    ("", []), ("<p>", []), ("<nav>only a menu</nav>", []), ("just words", ["just words"]), ("<p>a &lt; b &am", ["a < b &am"]), ("a < b", ["a < b"]),
    ("<article><p>x<br>y</p><p>z<!-- c --></p></article>", ["x y", "z"]),
    ("<article>a<script>var t='</p>'</script>b <span class=ad>buy</span> c<p>d", ["ab", "c", "d"]),
    ("<form action=x><main><h2>Title</h2><p>One.<form>mail</form></main></form><p>Else.", ["Title", "One."]),
    ("<header><h1>Site</h1></header><article><header><h1>Own</h1></header><p>t<footer>f</footer></article>", ["Own", "t"]),
    ("<article><table><tr><td>1<td>2<tr><th>3</table><pre>x\n  y</pre></article>", ["1", "2", "3", "x y"]),
    ("<article><p><a href='x'>All of it a link</a></p><p>b</article>", ["All of it a link", "b"]),
    ("<article class=card><a href=x>Elsewhere and more</a></article><article><p>Here</article>", ["Here"]),
    ('<article><p title="a > b">q</p><p data-x=it\'s>r</p></article>', ["q", "r"]),
    ("<article><div>deep<div><div><div>er</div></div></div><div></div><div></div>end</div></article>", ["deep", "er", "end"]),
])
def test_odd_pages(page, want):
    assert L.blocks_of_text(page) == want


def test_surges_and_dives():
    sums = L.sums_of([0, 50, 60, 0, 0, 0, 90, 0, 0, 0, 5], 3)
    assert sums == [110, 110, 60, 0, 90, 90, 90, 0, 5, 5, 5]
    assert list(L.surges_and_dives(sums, 80)) == [(0, 3), (4, 7)]


def test_extract_keeps_rows_and_replaces_columns(spark):
    df = spark.createDataFrame([(1, None, "o", 1), (1, "", "o", 2), (None, "<article><p>é t</article>", "o", 3), (None, "<article><p>é t</article>", "o", 3)], "page_id int, html string, text string, n_chars int")
    got = L.extract(df)
    assert got.columns == ["page_id", "text", "n_chars"]
    assert sorted(rows(got), key=str) == sorted([(1, "", 0), (1, "", 0), (None, "é t", 3), (None, "é t", 3)], key=str)
    assert rows(L.extract(df.where("false"))) == []
    assert rows(L.extract(df.select("text"), html_col="text"))[0] == ("o", 1)
    assert rows(L.extract(spark.createDataFrame([("<p>" + "long words " * 300_000,)], "html string")))[0][1] == 3_299_999


# Phrases -----------------------------------------------------------------------------------


def plain_collocations(docs, min_count, longest, top):
    count, total = defaultdict(Counter), Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    count[lang or "und"][" ".join(w[i:i + k])] += 1
    out = []
    for lang, of in count.items():
        many = {p: a for p, a in of.items() if a >= min_count}
        found = []
        for p, a in many.items():
            w = p.split(" ")
            if len(w) < 2 or any(f" {p} " in f" {q} " and q != p and b >= a for q, b in many.items()):
                continue
            cuts = [(1000 * a * total[lang] // (of[" ".join(w[:c])] * of[" ".join(w[c:])]), c) for c in range(1, len(w))]
            score, c = min(cuts)
            found.append((-score, -a, p.encode(), p, a, of[" ".join(w[:c])], of[" ".join(w[c:])], total[lang], score))
        out += [(lang, i + 1, *f[3:]) for i, f in enumerate(sorted(found)[:top])]
    return sorted(out)


def made_texts(seed, n):
    r = random.Random(seed)
    words = ["a", "b", "C", "the", "new", "york", "é", "日本", "x-y", "d"]
    copy = "The new york times a b C d. " * 3
    return [
        (None if r.random() < 0.05 else "".join(r.choice(words) + r.choice(["", " ", " ", "  ", "\t", ". ", "\n", "\x0b", ",!"]) for _ in range(r.randint(0, 60))) + r.choice(["", copy]),
         r.choice(["en", "en", "en", "de", None, "und"]))
        for _ in range(n)
    ]


@pytest.mark.parametrize("shards, bits", [(1, 16), (3, 16), (4, 3)])
def test_collocations_against_plain_counts(spark, shards, bits):
    """With 2^3 places almost all phrases share marks: counts are the same."""
    docs = made_texts(5, 300)
    df = spark.createDataFrame(docs, "text string, lang string").repartition(5).selectExpr("text", "lang", "1 AS n", "'x' AS phrase", "2 AS part")
    got = rows(P.collocations(df, min_count=12, longest=5, top=30, shards=shards, bits=bits))
    assert sorted(got) == plain_collocations(docs, 12, 5, 30) and len(got) > 40


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert rows(P.collocations(empty)) == []
    assert rows(P.collocations(spark.createDataFrame([(None, "en"), ("", None), (" \t.", "de"), ("a b", "en")], "text string, lang string"))) == []


def test_long_texts_are_cut_without_a_loss(spark):
    """Blocks far smaller than the texts, words longer than a block, no end of a piece for long."""
    kind_of = P.kinds()
    for text, size in ((b"aa bb  cc\tdd ee ff gg hh " * 40 + b"\n", 50), (b"w" * 300 + b" a b c d e f " + b"v" * 200 + b".x y\n", 40), (b"a\n", 1)):
        data = np.frombuffer(text, np.uint8)
        kind, offsets = kind_of[data], np.array([0, len(text)])
        got = Counter()
        ends = None
        for begin, owned, end in P.blocks(kind, offsets, size):
            assert ends is None or begin == ends
            ends = owned
            for batch in P.counts_of_block(data[begin:end], kind[begin:end], owned - begin, offsets[1:] - begin, np.zeros(1, np.int64), ["en"], np.zeros(1, np.uint64), np.ones(1 << 8, np.uint8), 2, 3, 5, 8):
                for r in batch.to_pylist():
                    got[r["phrase"]] += r["n"]
        assert ends == len(text)
        want = Counter()
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(rb"[^\x20\x09]+", piece)
            want[""] += len(w)
            for k in range(1, 6):
                want.update(b" ".join(w[i:i + k]).decode() for i in range(len(w) - k + 1))
        assert got == +want
    long_text = "one two three, " * 400_000
    got = rows(P.collocations(spark.createDataFrame([(long_text, "en")], "text string, lang string")))
    assert got == [("en", 1, "one two three", 400_000, 400_000, 400_000, 1_200_000, 3000)]


def test_equal_hashes_are_told_apart():
    h, g = np.array([7, 7, 5, 7], np.uint64), np.array([1, 2, 3, 1], np.uint64)
    at, n = P.grouped(h, g)
    assert sorted(zip(h[at].tolist(), g[at].tolist(), n.tolist())) == [(5, 3, 1), (7, 1, 2), (7, 2, 1)]


def test_collocations_sql(spark, sf):
    same_as_sql(P.op12(spark, sf), P.OP12_SQL, sf)


# Divergence --------------------------------------------------------------------------------


def plain_audit(docs, min_documents, top):
    count, has, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        langs[lang].add(source)
        count[lang, source].update(words)
        has[lang].update(set(words))
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in has[lang].items() if n >= min_documents]
        v = len(kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * v) for t in kept}
        p = {s: share(count[lang, s]) for s in sources}
        q = share(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -n, i + 1) for i, (n, _, o) in enumerate(pairs)]
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t, -n, i + 1) for i, (n, _, t) in enumerate(terms)]
    return sorted(out)


@pytest.mark.parametrize("block, words_of_chunk", [(8, 16), (2, 16)])
def test_audit_against_plain_sums(spark, monkeypatch, block, words_of_chunk):
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "BUCKET_TERMS", 40)
    monkeypatch.setattr(D, "CHUNK_TERMS", 16)
    r = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Été", "日本", "A", "a"]
    docs = [(" 1-".join(r.choices(words, [1 / (i + 1) for i in range(len(words))], k=r.randint(0, 40))), r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", "s4", None])) for _ in range(400)]
    docs += [(None, "en", "silent"), ("12 34", "en", "digits"), ("rare", "fr", "s1"), ("", "fr", "s2"), ("x", "it", "s1")] + [docs[0]] * 3
    df = spark.createDataFrame(docs, "text string, lang string, source string").selectExpr("*", "1 AS count", "2 AS term", "3 AS block")
    got = sorted(rows(D.audit(df, min_documents=6, top=7)))
    assert got == plain_audit(docs, 6, 7)


def test_terms_of_long_texts(monkeypatch):
    """A text of many blocks counts once for each of its terms, beside short texts."""
    import pyarrow as pa

    cut = P.blocks
    monkeypatch.setattr(D, "blocks", lambda kind, offsets, reach: cut(kind, offsets, 64, reach))
    texts = ["aa bb " * 60 + "Zz 1é2 aa", "aa", "", "bb aa-aa " * 30, "q"]
    batch = pa.RecordBatch.from_arrays([pa.array([t + "\n" for t in texts]), pa.array(["en", "en", "en", "en", "de"]), pa.array(["s", "s", "s", "t", "s"])], ["text", "lang", "source"])
    got = defaultdict(lambda: np.zeros(2, int))
    for b in D.counted(iter([batch])):
        for r in b.to_pylist():
            got[r["lang"], r["source"], r["term"]] += r["count"], r["documents"]
    assert {k: v.tolist() for k, v in got.items()} == {
        ("en", "s", "aa"): [62, 2], ("en", "s", "bb"): [60, 1], ("en", "s", "zz"): [1, 1], ("en", "s", "é"): [1, 1], ("en", "t", "bb"): [30, 1], ("en", "t", "aa"): [60, 1], ("de", "s", "q"): [1, 1],
    }


def test_audit_of_nothing(spark):
    assert rows(D.audit(spark.createDataFrame([], "text string, lang string, source string"))) == []


def test_joint_cells():
    """Three terms in both sources at unlike counts, one in each alone, two in neither."""
    a, b = np.zeros((2, D.WORDS), np.uint64), np.zeros((1, D.WORDS), np.uint64)
    a[0, 0], a[1, 0], b[0, 0] = 0b0011, 0b0100, 0b1111
    assert D.joint(a, b, np.array([10, 20]), np.array([13]), 1, 2, 6) == 3 + 3 + 7 + 12 + 2 * 1


def test_audit_sql(spark, sf):
    same_as_sql(D.op13(spark, sf), D.OP13_SQL, sf)
