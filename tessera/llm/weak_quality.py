"""Quality classifier from weak labels.

Heuristic labellers vote bad, good or not at all on each document; the annotations of the labels
table, where a document has one, are one more labeller. Expectation-maximisation over the counts
of vote patterns (never more than 3 to the number of labellers) estimates how often each labeller
is right, and gives each pattern a posterior. The posteriors of a bounded sample train a hashed
linear scorer, which then scores every document. Two such models decide: noise and abuse.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .shared import let_go, table, written

#: Documents whose posterior labels train the scorer, at most.
SAMPLE = 6000
WORD_BITS, SHAPE_BITS = 20, 12
#: Lengths of the word beginnings that are features too.
HEADS = (4, 5, 6, 7)
N_FEATURES = (1 << WORD_BITS) + (1 << SHAPE_BITS) + 1
NOISE = ("symbols", "capitals", "repeats", "separators", "word_length", "variety", "annotated_quality")
ABUSE = ("insults", "second_person", "annotated_toxic")
ABSTAIN, GOOD, BAD = 0, 1, 2
#: Words that the variety of a text is judged on at once.
WINDOW = 2000
#: What is believed of annotations before the votes are seen: right in this share of their votes, and
#: how many times the votes themselves that belief counts. EM estimates their accuracy from both.
RIGHT, BELIEF = 0.998, 4.0
# Common English insults that the lexicon labeller looks for.
INSULTS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#$%&*|!<>{}~^@=_\\", np.uint8))
WORDS = re.compile(rb"[a-z\x80-\xff]+").findall
INSULTED = re.compile(rb"\b(?:" + "|".join(INSULTS).encode() + rb")\b").search
ADDRESSED = re.compile(rb"\byou(?:'re| are)? (?:an? |all |such |nothing but )*(?:" + "|".join(INSULTS).encode() + rb")\b").search


def _by(share: float, good: float, bad: float) -> int:
    return BAD if share >= bad else GOOD if share <= good else ABSTAIN


def variety(words: list[bytes]) -> float:
    """Share of words that occurred before, less what the length explains: the mean over consecutive parts of near-equal size, at most WINDOW words."""
    n = -(-len(words) // WINDOW)
    cuts = [len(words) * i // n for i in range(n + 1)]
    return sum(1 - len(set(words[a:b])) / (b - a) - 0.05 * np.log(b - a) for a, b in zip(cuts, cuts[1:])) / n


def noise_votes(text: bytes) -> list[int]:
    """A vote of each labeller in NOISE but the last, on all words; short texts get few votes."""
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, words = len(text), text.split()
    if len(words) < 5:
        return [BAD if n and count[SYMBOLS].sum() * 4 > n else ABSTAIN] + [ABSTAIN] * 5
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    same = sum(map(eq, words, words[1:])) / (len(words) - 1)
    return [
        _by(count[SYMBOLS].sum() / n, 0.008, 0.04),
        _by(upper / max(1, upper + lower), 0.12, 0.35),
        _by(same, 0.01, 0.08),
        _by(sum(len(w) == 1 and not w.isalnum() for w in words) / len(words), 0.01, 0.12),
        _by(abs(n / len(words) - 6.5), 2.5, 5.0),
        _by(variety(words), 0.35, 0.6) if len(words) >= 20 else ABSTAIN,
    ]


def abuse_votes(text: bytes) -> list[int]:
    lower = text.lower()
    return [BAD if INSULTED(lower) else ABSTAIN, BAD if ADDRESSED(lower) else ABSTAIN]


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (place, value): words and word beginnings that occur, and shares of letter shapes."""
    words = WORDS(text.lower())
    seen = set(words)
    seen |= {w[:n] + b"^" for n in HEADS for w in seen if len(w) > n}
    at = np.unique(np.fromiter(map(zlib.crc32, seen), np.uint32, len(seen)) & ((1 << WORD_BITS) - 1))
    c = SHAPE_OF[np.frombuffer(text, np.uint8)]
    code = (c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - SHAPE_BITS)
    shape = np.bincount(code, minlength=1 << SHAPE_BITS) if len(c) > 2 else np.zeros(1 << SHAPE_BITS, np.int64)
    full = np.flatnonzero(shape)
    plain = text.split()
    same = sum(map(eq, plain, plain[1:])) / max(1, len(plain) - 1)
    return (
        np.concatenate((at, full + (1 << WORD_BITS), [N_FEATURES - 1])).astype(np.int32),
        np.concatenate((np.ones(len(at)), 20 * shape[full] / (len(c) + 100), [20 * same * len(c) / (len(c) + 100)])).astype(np.float32),
    )


def _shapes() -> np.ndarray:
    """A byte as its shape: small letter, capital, digit, white space, or itself."""
    out = np.arange(256, dtype=np.uint32) + np.uint32(10)
    out[97:123] = out[128:] = 1
    out[65:91], out[48:58], out[9:14], out[32] = 2, 3, 4, 5
    return out


SHAPE_OF = _shapes()


def votes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, noise, abuse): the votes, written in base 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            noise, abuse = [], []
            for t in b.column(1).cast(pa.binary()):
                text = t.as_py() or b""
                noise.append(sum(v * 3**i for i, v in enumerate(noise_votes(text))))
                abuse.append(sum(v * 3**i for i, v in enumerate(abuse_votes(text))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(noise, pa.int32()), pa.array(abuse, pa.int32())], ["doc_id", "noise", "abuse"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, noise int, abuse int"
    )


def estimate(counts: dict[int, int], labellers: int, rounds: int = 500, trusted: tuple[int, ...] = ()) -> tuple[dict[int, float], np.ndarray]:
    """EM for the posterior of bad for each vote pattern, and each labeller's chances of a vote.

    chances[j, class, vote], class 0 good and 1 bad. Starts from the majority of the votes. For a
    trusted labeller votes are added, BELIEF times as many as it gave, of which it is right in
    RIGHT and which it gives as often on either class: where labellers overlap little, the votes
    alone leave open whether one misses what another finds, or the other invents it.
    """
    patterns = np.array(sorted(counts), np.int64)
    n = np.array([counts[p] for p in patterns.tolist()], float)
    v = np.stack([patterns // 3**j % 3 for j in range(labellers)], 1) if len(patterns) else np.empty((0, labellers), int)
    bad, good = (v == BAD).sum(1), (v == GOOD).sum(1)
    post = np.clip(0.1 + 0.8 * np.where(bad > 0, (bad + 0.5) / (bad + 0.5 * good + 0.5), 0.0), 0.02, 0.98)
    chances = np.full((labellers, 2, 3), 1 / 3)
    added = np.full((labellers, 2, 3), 0.5)
    for j in trusted:
        silent = (np.dot(n, v[:, j] == ABSTAIN) + 0.5) / (n.sum() + 1)
        chances[j] = prior_j = [[silent, (1 - silent) * RIGHT, (1 - silent) * (1 - RIGHT)], [silent, (1 - silent) * (1 - RIGHT), (1 - silent) * RIGHT]]
        added[j] += BELIEF * np.dot(n, v[:, j] != ABSTAIN) * np.array(prior_j)
    for _ in range(rounds):
        prior = (np.dot(n, post) + 1) / (n.sum() + 2)
        for j in range(labellers):
            for c, p in enumerate((1 - post, post)):
                s = np.array([np.dot(n, p * (v[:, j] == k)) for k in range(3)]) + added[j, c]
                chances[j, c] = s / s.sum()
        log = np.log([1 - prior, prior])[None] + sum(np.log(chances[j][:, v[:, j]]).T for j in range(labellers))
        log -= log.max(1, keepdims=True)
        before, post = post, np.exp(log[:, 1]) / np.exp(log).sum(1)
        if len(post) and np.abs(post - before).max() < 1e-6:
            break
    return dict(zip(patterns.tolist(), post.tolist())), chances


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on the features whose presence tells the classes apart; weights and bias."""
    weights = np.zeros(N_FEATURES, np.float32)
    mass = float(target.sum())
    if mass < 1 or len(rows) - mass < 1:
        return weights, -10.0
    size = np.array([len(a) for a, _ in rows])
    at = np.concatenate([a for a, _ in rows])
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), size)
    n1 = np.bincount(at, target[doc], N_FEATURES)
    n0 = np.bincount(at, minlength=N_FEATURES) - n1
    p1, p0, p = n1 / mass, n0 / (len(rows) - mass), (n1 + n0) / len(rows)
    z = (p1 - p0) / np.sqrt(p * (1 - p) * (1 / mass + 1 / (len(rows) - mass)) + 1e-12)
    chosen = (np.abs(z) > 6) & (n1 + n0 >= 8)
    chosen[1 << WORD_BITS :] |= n1[1 << WORD_BITS :] + n0[1 << WORD_BITS :] >= 20
    del n1, n0, p1, p0, p, z
    keep = chosen[at]
    place, k = np.cumsum(chosen, dtype=np.int32) - 1, int(chosen.sum())
    at, doc = place[at[keep]], doc[keep]
    val = np.concatenate([v for _, v in rows])[keep]
    del keep, place
    w, bias, seen, seen_b = np.zeros(k), float(np.log(mass / (len(rows) - mass))), np.full(k, 1e-3), 1e-3
    for _ in range(rounds):
        s = np.bincount(doc, w[at] * val, len(rows)) + bias
        error = 1 / (1 + np.exp(-np.clip(s, -30, 30))) - target
        g = np.bincount(at, error[doc] * val, k) / len(rows) + 1e-5 * w
        seen, seen_b = seen + g * g, seen_b + error.mean() ** 2
        w, bias = w - 0.5 * g / np.sqrt(seen), bias - 0.5 * error.mean() / np.sqrt(seen_b)
    weights[np.flatnonzero(chosen)] = w
    return weights, bias


def annotate(docs: DataFrame, labels: DataFrame | None, id_col: str, text_col: str) -> DataFrame:
    found = written(votes(docs, id_col, text_col), "votes")
    if labels is None:
        return found.withColumn("noise", F.col("noise").cast("long")).withColumn("abuse", F.col("abuse").cast("long"))
    one = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").alias("q"), F.max("toxic").alias("t")
    )

    def vote(good: F.Column, bad: F.Column) -> F.Column:
        return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)

    return found.join(one, "doc_id", "left").select(
        "doc_id",
        (F.col("noise") + vote(F.col("q") == 1, F.col("q") == 0) * 3 ** (len(NOISE) - 1)).cast("long").alias("noise"),
        (F.col("abuse") + vote(F.col("t") == 0, F.col("t") == 1) * 3 ** (len(ABUSE) - 1)).cast("long").alias("abuse"),
    )


def fit(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """The two scorers: {"noise": (weights, bias), "abuse": ...} and what EM found of the labellers."""
    voted = annotate(docs, labels, id_col, text_col)
    counts = {"noise": {}, "abuse": {}}
    voted = written(voted, "voted")
    for r in voted.groupBy("noise", "abuse").count().collect():  # one row for each pattern of votes
        for k in counts:
            counts[k][r[k]] = counts[k].get(r[k], 0) + r["count"]
    post, chances = {}, {}
    for k, names in (("noise", NOISE), ("abuse", ABUSE)):
        post[k], chances[k] = estimate(counts[k], len(names), trusted=(len(names) - 1,))  # the annotations
    # Annotated documents come first into the sample, then the others; by hash within both.
    last = 3 ** (len(ABUSE) - 1)
    each = voted.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("noise", "abuse")).alias("v")).select("doc_id", "v.*")
    chosen = each.withColumn("h", F.xxhash64("doc_id")).orderBy((F.col("abuse") < last).cast("int"), "h", "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(t.as_py() or b"") for t in b.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([a.tobytes() for a, _ in f], pa.binary()), pa.array([v.tobytes() for _, v in f], pa.binary()), b.column(3)],
                ["noise", "abuse", "at", "val", "doc_id"],
            )

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # At most `sample` ids; rows with one id and unlike texts count as the one with the least features.
    made = (
        texts.join(F.broadcast(chosen), "doc_id").select("noise", "abuse", "text", "doc_id")
        .mapInArrow(run, "noise long, abuse long, at binary, val binary, doc_id long")
    )
    taken = made.groupBy("doc_id").agg(F.min(F.struct("at", "val", "noise", "abuse")).alias("r")).select("r.*").collect()
    model = {"labellers": chances}
    for k in ("noise", "abuse"):
        heard = [r for r in taken if r[k]]  # some labeller has voted
        rows = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["val"], np.float32)) for r in heard]
        model[k] = train(rows, np.array([post[k][r[k]] for r in heard], float))
    return model


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """Each row with its chances of noise and of abuse; text_col may lie in a struct column that is kept (struct.field)."""
    (wn, bn), (wa, ba) = model["noise"], model["abuse"]
    given = [f for f in docs.schema.fields if f.name not in ("p_noise", "p_abuse")] if keep_columns else []
    outer, _, field = text_col.partition(".")
    # A text that comes along anyway is not sent twice.
    at = [f.name for f in given].index(outer) if keep_columns and outer in [f.name for f in given] else None
    names = [f.name for f in given] if keep_columns else ["doc_id"]
    names += ["p_noise", "p_abuse"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            texts = b.column(-1 if at is None else at)
            if at is not None and field:
                texts = pc.struct_field(texts, field)
            out = np.empty((b.num_rows, 2))
            for i, t in enumerate(texts.cast(pa.binary())):
                places, val = features(t.as_py() or b"")
                out[i] = wn[places] @ val + bn, wa[places] @ val + ba
            p = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            kept = list(b.columns[: len(names) - 2])
            yield pa.RecordBatch.from_arrays([*kept, pa.array(p[:, 0]), pa.array(p[:, 1])], names)

    first = [F.col(f"`{f.name}`") for f in given] if keep_columns else [F.col(id_col).cast("long").alias("doc_id")]
    schema = StructType([*(given or [StructField("doc_id", LongType())]), StructField("p_noise", DoubleType()), StructField("p_abuse", DoubleType())])
    return docs.select(*first, *([F.col(text_col).alias("tessera_text")] if at is None else [])).mapInArrow(run, schema)


def classify(
    docs: DataFrame, labels: DataFrame | None = None, noise: float = 0.6, abuse: float = 0.45, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False,
) -> DataFrame:
    """Each row with p_noise, p_abuse and keep (each below its threshold).

    Null and empty texts get votes from no labeller and what the bias says; null ids never match
    an annotation; repeated rows are judged alike; of several annotations of a document the worst
    counts; where nothing is labelled all is kept; an empty table gives no rows. Further columns
    come along if keep_columns is set (columns named p_noise, p_abuse or keep are replaced).
    """
    return judged(docs, fit(docs, labels, id_col, text_col), noise, abuse, id_col, text_col, keep_columns)


def judged(docs: DataFrame, model: dict, noise: float = 0.6, abuse: float = 0.45, id_col: str = "doc_id", text_col: str = "text", keep_columns: bool = False) -> DataFrame:
    """Each row with what a fitted model says of it: p_noise, p_abuse and keep."""
    found = score(docs, model, id_col, text_col, keep_columns)
    return found.withColumn("keep", (F.col("p_noise") < noise) & (F.col("p_abuse") < abuse))


def op5(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
