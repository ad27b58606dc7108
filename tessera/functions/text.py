"""Text column functions: normalising, tokens, n-gram vectors, estimates, snippets, titles."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import forms

# Particles that may follow a Korean noun, the longer before the shorter.
PARTICLES = (
    "으로는", "에서는", "에게는", "으로", "에서", "에게", "까지", "부터", "이란", "란",
    "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도", "로",
)
# English terms as they are written in Hangul.
TRANSLITERATIONS = {
    "메데박": "medevac", "메디박": "medevac", "케이스백": "casevac",
    "시트렙": "sitrep", "싯렙": "sitrep", "스팟렙": "spotrep", "스폿렙": "spotrep",
    "프라고": "frago", "옵오더": "opord", "워노드": "warnord",
    "살루트": "salute", "디티지": "dtg",
    "줄루": "zulu", "알오이": "roe", "나토": "nato",
}
LATIN_RUN = r"[a-z0-9]+(?:[.\-/][a-z0-9]+)*"
#: Where tokens are more than runs of ASCII letters and digits: where runs are joined, and at Hangul and the two letters that have
#: ASCII ones in lower case. BEYOND holds all of the latter; as one range it is found many times faster.
JOINED, BEYOND, NOT_PLAIN = r"[.\-/](?<=[A-Za-z0-9].)[A-Za-z0-9]", r"[\u0130-\ud7a3]", r"[가-힣\u0130\u212a]"
DIM = 512


def nfkc(texts: list[str | None]) -> list[str | None]:
    """Texts for matching: NFKC, one kind of dash, no format characters."""
    def normal(t: str) -> str:
        found = unicodedata.normalize("NFKC", t)
        for c in set(found):  # a text has few of these kinds, so they are replaced one by one
            if c in forms.DASHES:
                found = found.replace(c, "-")
            elif unicodedata.category(c) == "Cf":
                found = found.replace(c, "")
        return found

    return [None if t is None else normal(t) for t in texts]


def with_normalised(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`: text for matching (NFKC, no format characters, one kind of dash).

    Texts of characters that neither change nor join with others stay as they are; the others meet
    the Arrow function: patterns of all characters that change cost more for a text than to
    normalise it.
    """
    @F.pandas_udf("string")
    def normalised(texts: pd.Series) -> pd.Series:
        return pd.Series(nfkc(texts.tolist()), dtype=object)

    d = df.select("*", F.when(forms.has_odd(F.col(text)), F.col(text)).alias("__odd"))
    return d.withColumn("__nfkc", normalised("__odd")).withColumn(out, F.coalesce("__nfkc", text)).drop("__odd", "__nfkc")


def tokens(text: Column) -> Column:
    """Words of Latin letters and digits (with their parts and their joined form), stems of Hangul words,
    English terms that they stand for, and pairs of syllables of longer stems. Null gives an empty array."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def latin(run: Column) -> Column:
        parts = F.split(run, r"[.\-/]")
        joined = F.when(run.rlike("[a-z]"), F.array(F.array_join(parts, ""))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(parts) > 1, F.concat(F.array(run), parts, joined)).otherwise(F.array(run))

    def hangul(word: Column) -> Column:
        stem = F.regexp_replace(word, "^(.{2,}?)(?:" + "|".join(PARTICLES) + ")$", "$1")
        english = F.filter(F.array(*[F.when(stem.contains(k), v) for k, v in TRANSLITERATIONS.items()]), lambda x: x.isNotNull())
        pairs = F.transform(F.sequence(F.lit(1), F.length(stem) - 1), lambda i: F.substring(stem, i, F.lit(2)))
        empty = F.array().cast("array<string>")
        return F.concat(F.array(stem), english, F.when(F.length(stem) >= 3, pairs).otherwise(empty))

    runs = F.regexp_extract_all(low, F.lit(LATIN_RUN), F.lit(0))
    # Most texts join no words by . - / and hold no Hangul: no lambda is entered for them.
    latins = F.when(low.rlike(r"[a-z0-9][.\-/][a-z0-9]"), F.flatten(F.transform(runs, latin))).otherwise(runs)
    hanguls = F.flatten(F.transform(F.regexp_extract_all(low, F.lit("[가-힣]+"), F.lit(0)), hangul))
    return F.concat(latins, hanguls)


def is_plain(text: Column) -> Column:
    """Whether the tokens of text are its runs of ASCII letters and digits in lower case, no more."""
    return ~(text.rlike(JOINED) | (text.rlike(BEYOND) & text.rlike(NOT_PLAIN)))


TOKENS_SQL = r"""flatten(list_transform(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+(?:[.\-/][a-z0-9]+)*'),
  lambda r: CASE WHEN len(string_split_regex(r, '[.\-/]')) > 1
    THEN list_concat(list_concat([r], string_split_regex(r, '[.\-/]')),
         CASE WHEN regexp_matches(r, '[a-z]') THEN [regexp_replace(r, '[.\-/]', '', 'g')] ELSE [] END)
    ELSE [r] END))"""


def token_estimate(text: Column) -> Column:
    """A careful count of model tokens: one for each non-ASCII character, one for three ASCII ones."""
    t = F.coalesce(text, F.lit(""))
    other = F.length(F.regexp_replace(t, r"[\x00-\x7F]", ""))
    return (other + F.floor((F.length(t) - other + 2) / 3)).cast("long")


def message_cost(text: Column) -> Column:
    return token_estimate(text) + 4


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def short_title(text: Column, size: int = 40) -> Column:
    """White space collapsed, the first `size` characters, with an ellipsis where more follow."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.concat(F.left(flat, F.lit(size)), F.when(F.length(flat) > size, "…").otherwise(""))


def derived_titles(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv_id, title): from the first user message; empty where there is none."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy(conv).agg(first.alias("first")).select(conv, F.coalesce(short_title(F.col("first")), F.lit("")).alias("title"))


def gram_bucket(gram: str, dim: int = DIM) -> int:
    return int(hashlib.md5(gram.encode("utf-8", "replace")).hexdigest()[:8], 16) % dim


def ngram_vectors(texts: list[str | None], dim: int = DIM, known: dict | None = None) -> np.ndarray:
    """Rows of hashed character pairs (weight 1) and triples (1.5), each row of length 1 (or all 0)."""
    known = {} if known is None else known
    out = np.zeros((len(texts), dim))
    for row, t in enumerate(texts):
        s = " ".join((t or "").lower().split())
        code = np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        for n, weight in ((2, 1.0), (3, 1.5)):
            if len(code) < n:
                continue
            gram = code[: len(code) - n + 1].copy()
            for i in range(1, n):
                gram = gram << np.uint64(21) | code[i : len(code) - n + 1 + i]
            which, count = np.unique(gram, return_counts=True)
            places = []
            for g in which.tolist():
                if (n, g) not in known:
                    text = "".join(chr(g >> 21 * i & 0x1FFFFF) for i in range(n - 1, -1, -1))
                    known[n, g] = -1 if not text.strip() else gram_bucket(text, dim)
                places.append(known[n, g])
            places = np.array(places)
            kept = places >= 0
            np.add.at(out[row], places[kept], weight * count[kept])
    length = np.sqrt((out**2).sum(1, keepdims=True))
    return out / np.where(length > 0, length, 1)


def embed(df: DataFrame, key: str, text: str, embedder=None, batch: int = 1024) -> DataFrame:
    """(key, vector): one normalised vector for each row.

    embedder: any function from a list of texts to a matrix (the hook for a model); the default
    hashes character n-grams. Rows reach it in Arrow batches.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for whole in batches:
            for s in range(0, whole.num_rows, batch):
                b = whole.slice(s, batch)
                texts = b.column(1).to_pylist()
                v = ngram_vectors(texts, DIM, known) if embedder is None else np.asarray(embedder(texts), float)
                length = np.sqrt((v**2).sum(1, keepdims=True))
                v = v / np.where(length > 0, length, 1)
                flat = pa.ListArray.from_arrays(np.arange(0, v.size + 1, max(1, v.shape[1]), dtype=np.int32), v.ravel())
                yield pa.RecordBatch.from_arrays([b.column(0), flat], [key, "vector"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, vector array<double>")


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is computed once, however often fn uses it (an expression is copied to each use)."""
    return F.transform(F.array(value), fn)[0]


def running_sums(x: Column) -> Column:
    """Sums of all elements before each: in groups of about the root of their number, as a fold copies what it has at each step."""
    def scan(a: Column) -> Column:
        return F.aggregate(a, F.array(F.lit(0)), lambda acc, v: F.array_append(acc, F.element_at(acc, -1) + v))

    def cut(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda k: F.slice(v, k * width + 1, width))

    def summed(groups: Column) -> Column:
        heads = scan(F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda a, v: a + v)))
        return F.flatten(F.zip_with(groups, F.slice(heads, 1, F.size(groups)), lambda g, h: F.transform(F.slice(scan(g), 1, F.size(g)), lambda v: v + h)))

    return let(x, lambda v: F.when(F.size(v) > 0, let(cut(v), summed)).otherwise(F.array().cast("array<int>")))


def best_windows(df: DataFrame, text: str, query: str, size: int, key: list[str]) -> DataFrame:
    """df with window_start (0-based): the line start whose next `size` characters hold most query words.

    Ties go to the earlier start; without a word of two characters or more in the text it is 0.
    """
    low = F.lower(text)
    found = df.withColumn("__terms", F.filter(F.array_distinct(tokens(F.col(query))), lambda t: (F.length(t) >= 2))).withColumn(
        "__low", low
    ).withColumn("__terms", F.filter("__terms", lambda t: F.col("__low").contains(t)))
    found = found.withColumn("__lines", F.split("__low", "\n"))
    starts = running_sums(F.transform("__lines", lambda x: F.length(x) + 1))
    # A window is cut out of the lines that it can reach, so the text is not walked from its start for each.
    window = lambda i: F.left(F.array_join(F.slice("__lines", i + 1, F.lit(size)), "\n"), F.lit(size))
    scored = F.transform(
        F.filter(F.transform(starts, lambda s, i: F.struct(s.alias("s"), window(i).alias("w"))), lambda x: (x["s"] == 0) | (x["s"] < F.length(text))),
        lambda x: F.struct((-F.size(F.filter("__terms", lambda t: x["w"].contains(t)))).alias("n"), x["s"].alias("s")),
    )
    return found.withColumn("window_start", F.when(F.size("__terms") > 0, F.array_min(scored)["s"]).otherwise(0)).drop("__terms", "__low", "__lines")


def snippet(text: str, start: str, size: int) -> Column:
    cut = F.regexp_replace(F.substring(F.col(text), F.col(start) + 1, F.lit(size)), r"\s+$", "")
    whole = F.length(text) <= size
    return F.when(whole, F.col(text)).otherwise(
        F.concat(F.when(F.col(start) > 0, "… ").otherwise(""), cut, F.when(F.col(start) + size < F.length(text), " …").otherwise(""))
    )


