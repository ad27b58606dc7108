"""Evaluation: retrieval and answer quality over cases, and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sliced(cases: DataFrame, category: str | None = None, limit: int | None = None, order: str = "case_id") -> DataFrame:
    """The cases of a category, and of those the first `limit` in their order."""
    if category:
        cases = cases.where(F.col("category") == category)
    return cases.orderBy(order).limit(limit) if limit else cases


def retrieval_results(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """Per case: refs found, the rank of the first expected one, hit, skipped.

    cases: case_id, question, expected_refs, blocked; hits: case_id, rank, ref. Cases without
    expected refs and blocked ones are skipped. One pass over the hits of each case, no pairs.
    """
    skipped = (F.size(F.coalesce("expected_refs", F.array().cast("array<string>"))) == 0) | F.coalesce("blocked", F.lit(False))
    wanted = cases.select("case_id", "expected_refs", skipped.alias("skipped"))
    met = hits.join(wanted.where("NOT skipped"), "case_id").groupBy("case_id").agg(
        F.min(F.when(F.exists("expected_refs", lambda e: F.lower("ref").contains(F.lower(e))), F.col("rank"))).alias("rank"),
        F.array_sort(F.collect_list(F.struct("rank", "ref"))).alias("got"),
    )
    return wanted.join(met, "case_id", "left").select(
        "case_id", "expected_refs", F.coalesce(F.col("got.ref"), F.array().cast("array<string>")).alias("top_refs"), "rank",
        F.col("rank").isNotNull().alias("hit"), "skipped",
    )


def retrieval_metrics(results: DataFrame, *by: str) -> DataFrame:
    """One row, or one for each group: cases, hit_at_k, hit_at_1, mrr (4 digits; null without cases)."""
    scored = results.where("NOT skipped")
    return scored.groupBy(*by).agg(
        F.count("*").alias("cases"),
        F.round(F.avg(F.col("hit").cast("int")), 4).alias("hit_at_k"),
        F.round(F.avg(F.coalesce((F.col("rank") == 1).cast("int"), F.lit(0))), 4).alias("hit_at_1"),
        F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 4).alias("mrr"),
    )


def misses(results: DataFrame) -> DataFrame:
    return results.where("NOT skipped AND NOT hit").select("case_id", F.col("expected_refs").alias("expected"), F.col("top_refs").alias("got"))


def keyword_present(text: Column, keyword: Column) -> Column:
    """Whether any alternative of `a|b` is in text, case aside; one ASCII letter or digit must stand alone."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def one(alt: Column) -> Column:
        a = F.lower(F.trim(alt))
        alone = F.rlike(low, F.concat(F.lit("(?<![a-z0-9])"), a, F.lit("(?![a-z0-9])")))
        return F.when(a == "", False).when(a.rlike("^[a-z0-9]$"), alone).otherwise(low.contains(a))

    return F.exists(F.split(keyword, r"\|"), one)


def answer_results(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """Per case: keywords hit and missed, forbidden words found, passed.

    cases: case_id, expected_keywords, forbidden, blocked; answers: case_id, answer, blocked, error,
    seconds and token counts (which stay null where unknown). A case without an answer has failed,
    with that as its error.
    """
    none = F.array().cast("array<string>")
    joined = cases.select(
        "case_id", F.coalesce("expected_keywords", none).alias("kw"), F.coalesce("forbidden", none).alias("fb"),
        F.coalesce("blocked", F.lit(False)).alias("expected_blocked"),
    ).join(answers.withColumn("__answered", F.lit(True)), "case_id", "left")
    joined = joined.withColumn("error", F.when(F.col("__answered").isNull(), "no answer").otherwise(F.col("error"))).drop("__answered")
    text = F.coalesce(F.col("answer"), F.lit(""))
    judged = (
        joined.withColumn("keywords_hit", F.filter("kw", lambda k: keyword_present(text, k)))
        .withColumn("keywords_missed", F.filter("kw", lambda k: ~keyword_present(text, k)))
        .withColumn("forbidden_found", F.filter("fb", lambda k: keyword_present(text, k)))
        .withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    )
    passed = F.when(F.col("expected_blocked"), F.col("blocked") & F.col("error").isNull()).otherwise(
        F.col("error").isNull() & ~F.col("blocked") & (F.size("keywords_missed") == 0) & (F.size("forbidden_found") == 0)
    )
    return judged.withColumn("passed", passed).drop("kw", "fb")


def answer_metrics(results: DataFrame) -> DataFrame:
    """One row of rates, counts and token sums; unknown tokens count as 0 only here."""
    open_ = ~F.col("expected_blocked")
    hit = F.sum(F.when(open_, F.size("keywords_hit")).otherwise(0))
    missed = F.sum(F.when(open_, F.size("keywords_missed")).otherwise(0))
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"total_{c}") for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")]
    return results.agg(
        F.count("*").alias("cases"),
        F.round(F.avg(F.col("passed").cast("int")), 4).alias("pass_rate"),
        F.round(F.try_divide(hit, hit + missed), 4).alias("keyword_rate"),
        F.count_if(F.size("forbidden_found") > 0).alias("forbidden_violations"),
        F.round(F.avg(F.when(F.col("expected_blocked"), F.col("blocked").cast("int"))), 4).alias("block_accuracy"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.round(F.avg("seconds"), 2).alias("avg_seconds"),
        *sums,
    )


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(case_id, change): improved or regressed, for cases in both runs (case_id, good, skipped)."""
    b = before.where("NOT skipped").select("case_id", F.col("good").alias("b"))
    a = after.where("NOT skipped").select("case_id", F.col("good").alias("a"))
    return a.join(b, "case_id").where("a <> b").select("case_id", F.when(F.col("a"), "improved").otherwise("regressed").alias("change"))


def compare_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta) for two tables of (metric, value)."""
    b, a = before.select("metric", F.col("value").alias("before")), after.select("metric", F.col("value").alias("after"))
    return b.join(a, "metric", "full").withColumn("delta", F.round(F.col("after") - F.col("before"), 4))


def failure_reason() -> Column:
    """Why an answer failed: its error, or what is missing, forbidden, or wrongly blocked."""
    return F.coalesce(
        F.col("error"),
        F.concat_ws(
            " ",
            F.when(F.size("keywords_missed") > 0, F.concat(F.lit("missed: "), F.array_join("keywords_missed", ", "))),
            F.when(F.size("forbidden_found") > 0, F.concat(F.lit("forbidden: "), F.array_join("forbidden_found", ", "))),
            F.when(F.col("blocked") & ~F.col("expected_blocked"), F.lit("blocked")),
            F.when(~F.col("blocked") & F.col("expected_blocked"), F.lit("not blocked")),
        ),
    )


def top_failures(results: DataFrame, limit: int = 10) -> DataFrame:
    return results.where("NOT passed").orderBy("case_id").limit(limit).select("case_id", failure_reason().alias("reason"))
