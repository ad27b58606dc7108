"""URL filters: rules, and trust that spreads over the link graph where no rule fits.

Pages give a graph between hosts: links in their markup, and each host's tie to the host one
label up, which answers for it. Personalised PageRank runs along the edges from hosts with pages
that a rule allows, and against them from hosts with pages that a rule blocks (who links to bad
hosts is suspect). A host is blocked if it gathers more distrust than trust.

All of it is DataFrame operations; page counts and links are summed per host before they meet.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import erase, table, unused, written

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
HIT = "struct<rule:string,verdict:string>"
#: Rules that are tested one by one; more are joined as a table.
LISTED = 64
DAMPING, ROUNDS, MARGIN = 0.85, 12, 1.0
#: The walk has settled when four rounds change no host's rank by more than this share of it.
TOLERANCE = 1e-12
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str = "url") -> Column:
    """From after the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(rules: tuple = RULES, host: str = "host", path: str = "path") -> Column:
    """The longest rule that fits as (rule, verdict), or null: an expression that grows with the list of rules."""
    found = F.lit(None).cast(HIT)
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1:], r[0])):  # a longer one replaces
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def with_rules(pages: DataFrame, rules: tuple | DataFrame = RULES, out: str = "__r") -> DataFrame:
    """pages (host, path, ...) with the longest rule that fits as (rule, verdict), or null.

    A short list of rules is one expression. A table (verdict, host, path) of any size, or a long
    list, is joined on each host that a page's host lies under; distinct (host, path) meet it once.
    Of rules that are equally long the last by host and path is taken, and block before allow.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= LISTED:
            return pages.withColumn(out, best_rule(rules))
        rules = pages.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    labels = F.split("host", "[.]")
    over = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    places = pages.select("host", "path").distinct().withColumn("over", F.explode(over))
    listed = rules.select(F.col("host").alias("over"), F.col("path").alias("begins"), F.col("verdict").alias("v"))
    order = F.struct(F.length(F.concat("over", "begins")), F.col("over"), F.col("begins"), F.col("v"))
    best = (
        places.join(listed, "over").where(F.col("path").startswith(F.col("begins")))
        .groupBy("host", "path").agg(F.max_by(F.struct(F.concat("over", "begins").alias("rule"), F.col("v").alias("verdict")), order).alias(out))
    )
    return pages.join(best, ["host", "path"], "left")


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, share): a host's links and its tie upwards, each edge's share of what leaves src."""
    links = pages.where(f"{html} LIKE '%//%'").select(
        F.col("host").alias("src"), F.explode(F.regexp_extract_all(html, F.lit(LINK), F.lit(1))).alias("dst")
    )
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    hosts = pages.select("host").where("host <> ''").distinct()
    up = hosts.where("host RLIKE '^[^.]+[.][^.]+[.].'").select(
        F.col("host").alias("src"), F.expr("substring(host, instr(host, '.') + 1)").alias("dst"), F.lit(1).alias("n")
    )
    both = links.union(up).where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.sum("n").alias("n"))
    out = both.groupBy("src").agg(F.sum("n").alias("all"))
    return both.join(out, "src").select("src", "dst", "n", (F.col("n") / F.col("all")).alias("share"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    back = edges.groupBy(F.col("dst").alias("src")).agg(F.sum("n").alias("all"))
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n").join(back, "src").select(
        "src", "dst", (F.col("n") / F.col("all")).alias("share")
    )


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = ROUNDS) -> DataFrame:
    """(host, rank) of a walk along edges (src, dst, share) that restarts at seeds (host, seed; summing to 1).

    What reaches a host without edges ends there; sending it back to the seeds would scale all
    ranks alike. Without `rounds` the walk goes on until it has settled (TOLERANCE), so until
    every host that the seeds reach has its rank.
    """
    start = seeds.select("host", (F.col("seed") * (1 - damping)).alias("rank"))
    rank = seeds.select("host", F.col("seed").alias("rank"))
    before = rank
    for i in count() if rounds is None else range(rounds):
        moved = rank.join(edges, rank.host == edges.src).select(
            F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank")
        )
        rank = start.union(moved).groupBy("host").agg(F.sum("rank").alias("rank"))
        if i % 4 == 3:
            rank = written(rank, "rank")
            if rounds is not None:
                erase(before)
                before = rank
            if rounds is None:
                old = before.select(F.col("host").alias("known"), F.col("rank").alias("old"))
                changed = rank.join(old, rank.host == old.known, "left").where(
                    F.col("old").isNull() | (F.abs(F.col("rank") - F.col("old")) > TOLERANCE * F.col("rank"))
                )
                settled = changed.isEmpty()
                erase(before)
                if settled:
                    break
                before = rank
    return rank


def rounded(x: Column) -> Column:
    """x to twelve significant digits, since sums in another order differ in the last ones; however small, it stays above 0."""
    return F.format_string("%.11e", x).cast("double")


def judge(pages: DataFrame, rules: tuple | DataFrame = RULES, url: str = "url", html: str = "html", margin: float = MARGIN) -> DataFrame:
    """pages with host, path, rule, verdict, trust and distrust.

    Null urls and urls without :// have an empty host and path; what no rule and no edge reaches
    is allowed (0 trust, 0 distrust); null markup has no links; repeated rows are judged alike
    (and count as often); an empty table gives no rows. Columns named like the new ones are replaced.
    """
    clean = pages.drop("host", "path", "rule", "verdict", "trust", "distrust")
    hit, of_host = unused("hit", clean.columns), unused("of_host", clean.columns)
    known = with_rules(clean.withColumn("host", host_of(url)).withColumn("path", path_of(url)), rules, hit)
    edges = written(host_edges(known, html), "edges")
    counts = written(
        known.where((F.col("host") != "") & F.col(hit).isNotNull()).groupBy("host").agg(
            F.count_if(F.col(f"`{hit}`.verdict") == "allow").alias("allowed"), F.count_if(F.col(f"`{hit}`.verdict") == "block").alias("blocked")
        ),
        "seeds",
    )
    total = counts.agg(F.sum("allowed"), F.sum("blocked")).first()

    def seeds(name: str, n: int | None) -> DataFrame:
        return counts.where(F.col(name) > 0).select("host", (F.col(name) / F.lit(n or 1)).alias("seed"))

    trust = personalised_rank(edges, seeds("allowed", total[0]), rounds=None).withColumnRenamed("rank", "trust")
    distrust = personalised_rank(reversed_edges(edges), seeds("blocked", total[1]), rounds=None).withColumnRenamed("rank", "distrust")
    hosts = trust.join(distrust, "host", "full").select(
        F.col("host").alias(of_host), rounded(F.coalesce("trust", F.lit(0.0))).alias("trust"), rounded(F.coalesce("distrust", F.lit(0.0))).alias("distrust")
    )
    hosts = written(hosts, "hosts")
    joined = known.join(hosts, known.host == hosts[of_host], "left").drop(of_host)
    verdict = F.coalesce(F.col(f"`{hit}`.verdict"), F.when(F.col("distrust") > margin * F.col("trust"), "block").otherwise("allow"))
    return (
        joined.withColumn("trust", F.coalesce("trust", F.lit(0.0)))
        .withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
        .withColumn("rule", F.col(f"`{hit}`.rule"))
        .withColumn("verdict", verdict)
        .drop(hit)
    )


def op1(spark, sf_dir: str) -> DataFrame:
    """Trust and distrust are shown to ten decimals, as the SQL has them; the verdict is by the values before that."""
    return judge(table(spark, sf_dir, "pages")).select(
        "page_id", "host", "path", "rule", "verdict", F.round("trust", 10).alias("trust"), F.round("distrust", 10).alias("distrust")
    )


def _walk_sql(name: str, seed: str, edges: str) -> str:
    out = [f"{name}0 AS (SELECT host, {seed} AS rank FROM seeds WHERE {seed} > 0)"]
    for i in range(ROUNDS):
        out.append(
            f"{name}{i + 1} AS (SELECT host, sum(rank) AS rank FROM (SELECT host, {seed} * {1 - DAMPING!r}::DOUBLE AS rank FROM seeds WHERE {seed} > 0 "
            f"UNION ALL SELECT e.dst, r.rank * e.share * {DAMPING}::DOUBLE FROM {name}{i} r JOIN {edges} e ON r.host = e.src) GROUP BY host)"
        )
    return ",\n".join(out)


OP1_SQL = f"""
WITH p AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), k AS (
  SELECT *, {' '.join(f"{'CASE' if i == 0 else ''} WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'" for i, (v, h, p) in enumerate(sorted(RULES, key=lambda r: (-len(r[1]) - len(r[2]), r[1:]))))} END AS hit
  FROM p
), links AS (
  SELECT src, translate(dst, '{UPPER}', '{LOWER}') AS dst, 1 AS n
  FROM (SELECT host AS src, unnest(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1)) AS dst FROM k)
  UNION ALL
  SELECT host, substr(host, instr(host, '.') + 1), 1 FROM (SELECT DISTINCT host FROM k)
  WHERE regexp_matches(host, '^[^.]+[.][^.]+[.].')
), both_ AS (
  SELECT src, dst, sum(n) AS n FROM links WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst
), edges AS (
  SELECT src, dst, n / CAST(sum(n) OVER (PARTITION BY src) AS DOUBLE) AS share FROM both_
), back AS (
  SELECT dst AS src, src AS dst, n / CAST(sum(n) OVER (PARTITION BY dst) AS DOUBLE) AS share FROM both_
), counts AS (
  SELECT host, count(*) FILTER (WHERE hit LIKE 'allow%') AS a, count(*) FILTER (WHERE hit LIKE 'block%') AS b
  FROM k WHERE host <> '' AND hit IS NOT NULL GROUP BY host
), seeds AS (
  SELECT host, a / CAST(greatest(1, (SELECT sum(a) FROM counts)) AS DOUBLE) AS a,
         b / CAST(greatest(1, (SELECT sum(b) FROM counts)) AS DOUBLE) AS b FROM counts
), {_walk_sql("t", "a", "edges")},
{_walk_sql("d", "b", "back")},
hosts AS (
  SELECT coalesce(t.host, d.host) AS host, round(coalesce(t.rank, 0), 10) AS trust, round(coalesce(d.rank, 0), 10) AS distrust
  FROM t{ROUNDS} t FULL JOIN d{ROUNDS} d ON t.host = d.host
)
SELECT page_id, k.host, path, CASE WHEN hit IS NOT NULL THEN substr(hit, 7) END AS rule,
       CASE WHEN hit IS NOT NULL THEN substr(hit, 1, 5) WHEN coalesce(distrust, 0) > {MARGIN}::DOUBLE * coalesce(trust, 0) THEN 'block' ELSE 'allow' END AS verdict,
       coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM k LEFT JOIN hosts ON k.host = hosts.host
"""
