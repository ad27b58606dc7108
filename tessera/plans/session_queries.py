"""Queries on sessions and identity, with their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import sessions as S
from ..sources.files import read_table
from . import views as V

#: Ten days, so that users of a small table are locked out now and then.
SECONDS = 864000
AS_OF = datetime.datetime(1998, 1, 1)
COST = "4 + length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) + (length(text) - length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) + 2) // 3"
USERS = "us AS (SELECT 'u' || c_custkey AS username, CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'user' END AS role, CAST(c_custkey % 5 AS INT) AS clearance, c_custkey % 7 = 0 AS disabled, c_mktsegment AS unit FROM customer)"
TOKENS = "tk AS (SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS token_hash, 'u' || o_custkey AS username, o_orderdate + INTERVAL 365 DAY AS expires_at FROM orders)"


def tokens(spark, sf):
    """orders as tokens of customers that run out after a year."""
    return read_table(spark, sf, "orders").select(
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("token_hash"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("username"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 365 DAYS")).alias("expires_at"),
    )


def u1(spark, sf):
    d = S.transcript(read_table(spark, sf, "conversations"))
    return d.select("conv_id", F.col("seq").cast("long").alias("seq"), "role", F.md5("text").alias("text_md5"))


U1_SQL = f"""WITH m AS (SELECT *, CAST(sum(CAST(role = 'user' AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS i FROM conversations WHERE role IN ('user', 'assistant')),
a AS (SELECT conv_id, i, coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS x, count(*) FILTER (WHERE role = 'assistant') AS n FROM m GROUP BY ALL)
SELECT conv_id, i * 2 - 1 AS seq, role, md5(text) AS text_md5 FROM m WHERE role = 'user'
UNION ALL SELECT conv_id, i * 2, 'assistant', md5(CASE WHEN trim(x) = '' THEN '{S.NO_RESPONSE}' ELSE x END) FROM a WHERE i > 0 OR n > 0"""


def u2(spark, sf):
    c = read_table(spark, sf, "conversations").withColumn("role", F.when(F.col("turn") % 5 == 0, "user").otherwise(F.col("role")))
    d = S.merged_roles(c)
    return d.select("conv_id", F.col("seq").cast("long").alias("seq"), "role", F.md5("text").alias("text_md5"))


U2_SQL = """WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'user' ELSE role END AS role, text FROM conversations),
k AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) <> role, true) AS new FROM c WHERE role = 'user' OR (role = 'assistant' AND text <> '')),
s AS (SELECT *, CAST(sum(CAST(new AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS seq FROM k)
SELECT conv_id, seq, any_value(role) AS role, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_md5 FROM s GROUP BY conv_id, seq"""


def u3(spark, sf):
    d = S.fitted_context(read_table(spark, sf, "conversations").where("role IN ('user', 'assistant')"), 900, 100)
    return d.select("conv_id", "turn", "running_cost")


U3_SQL = f"""WITH k AS (SELECT conv_id, turn, role, CAST(sum({COST}) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS running_cost FROM conversations WHERE role IN ('user', 'assistant')),
f AS (SELECT *, min(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS first FROM k WHERE running_cost + 100 <= 900)
SELECT conv_id, turn, running_cost FROM f WHERE turn >= first"""


def u4(spark, sf):
    """The pages of orders: how many line items fit into a budget."""
    li = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.col("l_quantity").cast("long").alias("cost"))
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_orderkey") % 130).alias("base_cost"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 40).alias("pending_cost"))
    return S.fitted_hits(o, li, 110)


U4_SQL = """WITH r AS (SELECT l_orderkey, l_linenumber, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS s FROM lineitem),
f AS (SELECT o_orderkey AS query_id, o_orderkey % 130 AS base, count(l_linenumber) AS found, max(l_linenumber) FILTER (WHERE o_orderkey % 130 + s <= 110) AS fit FROM orders LEFT JOIN r ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT query_id, CAST(coalesce(fit, 0) AS BIGINT) AS n_hits, CASE WHEN found = 0 AND base <= 110 THEN 'no_documents' WHEN fit IS NOT NULL THEN 'fitted' ELSE 'rejected' END AS status,
  query_id % 3 = 0 AND (fit IS NOT NULL OR (found = 0 AND base <= 110)) AND base + coalesce((SELECT max(s) FROM r WHERE l_orderkey = query_id AND l_linenumber = fit), 0) + query_id % 40 <= 110 AS merged FROM f"""


def current_sessions(spark, sf):
    """The latest state of each session."""
    d = V.sessions(spark, sf)
    return d.groupBy("session_id").agg(F.max_by(F.struct("username", "title", "turns", "updated_at"), F.struct("updated_at", "o_orderkey")).alias("s"), F.min("created_at").alias("created_at")).select(
        "session_id", "s.*", "created_at"
    )


def u5(spark, sf):
    return S.session_list(current_sessions(spark, sf), 50).select("username", "session_id", F.col("place").cast("long").alias("place"), "title")


LATEST = f"ss AS ({V.SESSIONS_SQL}), ls AS (SELECT session_id, username, title, turns, updated_at, min(created_at) OVER (PARTITION BY session_id) AS created_at, row_number() OVER (PARTITION BY session_id ORDER BY updated_at DESC, o_orderkey DESC) AS o FROM ss)"


def u6(spark, sf):
    """Even orders are the sessions so far, odd ones the changes."""
    d = V.sessions(spark, sf)
    def state(x):
        return x.groupBy("session_id").agg(F.max_by(F.struct("username", "title", "turns", "updated_at"), F.struct("updated_at", "o_orderkey")).alias("s"), F.min("created_at").alias("created_at")).select("session_id", "s.*", "created_at")
    now, new = state(d.where("o_orderkey % 2 = 0")), state(d.where("o_orderkey % 2 = 1 OR o_orderkey % 3 = 0"))
    return S.upsert_sessions(now, new, create=False).select("session_id", "username", "title", "turns")


U6_SQL = f"""WITH ss AS ({V.SESSIONS_SQL}),
a AS (SELECT * FROM (SELECT *, 0 AS new, row_number() OVER (PARTITION BY session_id ORDER BY updated_at DESC, o_orderkey DESC) AS o FROM ss WHERE o_orderkey % 2 = 0) WHERE o = 1),
b AS (SELECT * FROM (SELECT *, 1 AS new, row_number() OVER (PARTITION BY session_id ORDER BY updated_at DESC, o_orderkey DESC) AS o FROM ss WHERE o_orderkey % 2 = 1 OR o_orderkey % 3 = 0) WHERE o = 1 AND session_id IN (SELECT session_id FROM a)),
u AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY updated_at DESC, new DESC) AS p FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT session_id, username, title, turns FROM u WHERE p = 1"""


def u7(spark, sf):
    return S.resolve_tokens(tokens(spark, sf), V.users(spark, sf), AS_OF)


def u8(spark, sf):
    return S.purge_tokens(tokens(spark, sf), AS_OF, V.users(spark, sf).where("disabled")).select("token_hash", "username")


def u9(spark, sf):
    change = V.users(spark, sf).where("username LIKE '%3'").select("username", F.lit(4).alias("clearance"), F.lit(None).cast("string").alias("role"))
    return S.updated_users(V.users(spark, sf), change)


def u10(spark, sf):
    return S.lockouts(V.attempts(spark, sf), seconds=SECONDS).select("attempt_id", "locked", F.col("failures").cast("long").alias("failures"))


def u10_window(spark, sf):
    return S.recent_failures(V.attempts(spark, sf), SECONDS).select("attempt_id", "recent_failures")


ATTEMPTS = "att AS (SELECT user_id AS k, event_id AS attempt_id, ts, event_type = 'signup' AS success FROM events WHERE event_type IN ('error', 'signup'))"

LOCKOUT_SQL = f"""WITH RECURSIVE {ATTEMPTS}, o AS (SELECT k, attempt_id, epoch_us(ts) AS t, success, row_number() OVER (PARTITION BY k ORDER BY ts, attempt_id) AS rn FROM att),
r AS (SELECT k, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS recent, CAST(-1 AS BIGINT) AS attempt_id, false AS locked, CAST(0 AS BIGINT) AS failures FROM (SELECT DISTINCT k FROM o)
  UNION ALL SELECT k, rn, CASE WHEN len(f) >= 5 THEN f WHEN success THEN CAST([] AS BIGINT[]) ELSE list_append(f, t) END, attempt_id, len(f) >= 5, CAST(len(f) AS BIGINT)
  FROM (SELECT o.k, o.rn, o.t, o.success, o.attempt_id, list_filter(r.recent, lambda x: o.t - x < {SECONDS}000000) AS f FROM r JOIN o ON o.k = r.k AND o.rn = r.rn + 1))
SELECT attempt_id, locked, failures FROM r WHERE rn > 0"""


def u12(spark, sf):
    """suppliers as peers, customers' keys as forwarded hops."""
    s = read_table(spark, sf, "supplier")
    peer = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "9.9.0.").otherwise("10.0.0."), (F.col("s_suppkey") % 250).cast("string"))
    hops = F.concat(F.lit("1.2.3."), (F.col("s_suppkey") % 200).cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ", 10.0.0.7").otherwise(", 7.7.7.7 "))
    d = s.select("s_suppkey", peer.alias("peer"), F.when(F.col("s_suppkey") % 5 != 0, hops).alias("fwd"))
    return d.select("s_suppkey", S.client_address(F.col("peer"), F.col("fwd"), [("10.0.0.0", 8)]).alias("client"))


U12_SQL = """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '9.9.0.' || (s_suppkey % 250) WHEN s_suppkey % 5 = 0 THEN '10.0.0.' || (s_suppkey % 250)
  WHEN s_suppkey % 2 = 0 THEN '1.2.3.' || (s_suppkey % 200) ELSE '7.7.7.7' END AS client FROM supplier"""

def u12_networks(spark, sf):
    """Customers as requests of both families behind proxies of both; with any peer trusted, too."""
    k = F.col("c_custkey")
    c = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = (k % 200).cast("string")
    peer = F.when(k % 4 == 0, F.concat(F.lit("2001:db8::"), F.lower(F.hex(k % 4096)))).when(k % 4 == 1, F.concat(F.lit("10.0.0."), n)).when(k % 4 == 2, F.concat(F.lit("::ffff:10.0.0."), n)).otherwise(F.concat(F.lit("9.9.0."), n))
    hops = F.concat(F.lit("fe80::1, 1.2.3."), n, F.when(k % 3 == 0, ", 2001:DB8:0:0::7").when(k % 3 == 1, ", 10.0.0.7, ::1").otherwise(", 2001:db9::7 "))
    trusted = ["10.0.0.0/8", "2001:db8::/32", "::1", " ", "no network"]
    d = c.select("c_custkey", peer.alias("peer"), F.when(k % 5 != 0, hops).alias("fwd"))
    return d.select("c_custkey", S.client_address(F.col("peer"), F.col("fwd"), trusted).alias("client"), S.client_address(F.col("peer"), F.col("fwd"), ["*"]).alias("by_any"))


U12_NETWORKS_SQL = """WITH p AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '2001:db8::' || lower(to_hex(c_custkey % 4096)) WHEN 1 THEN '10.0.0.' || (c_custkey % 200) WHEN 2 THEN '::ffff:10.0.0.' || (c_custkey % 200) ELSE '9.9.0.' || (c_custkey % 200) END AS peer FROM customer)
SELECT k AS c_custkey, CASE WHEN k % 4 > 1 OR k % 5 = 0 THEN peer WHEN k % 3 = 2 THEN '2001:db9::7' ELSE '1.2.3.' || (k % 200) END AS client, CASE WHEN k % 5 = 0 THEN peer ELSE 'fe80::1' END AS by_any FROM p"""


def u9_views(spark, sf):
    """Users in order, their number, one of them, and who has sessions left after deletions by owners and by anyone."""
    users = V.users(spark, sf)
    listed = S.user_list(users).select(F.lit("listed").alias("view"), "username", F.lit(None).cast("long").alias("n"))
    counted = S.user_count(users).select(F.lit("count").alias("view"), F.lit(None).cast("string").alias("username"), "n")
    named = S.user_named(users, "u7").select(F.lit("named").alias("view"), "username", F.col("clearance").cast("long").alias("n"))
    s = current_sessions(spark, sf)
    # Owners delete some of theirs, strangers try, and some go whoever owns them.
    gone = s.select("session_id", F.when(F.length("session_id") % 3 == 0, F.col("username")).when(F.length("session_id") % 3 == 1, "stranger").alias("username"))
    left = S.without_sessions(s, gone).groupBy("username").agg(F.count("*").alias("n")).select(F.lit("left").alias("view"), "username", "n")
    return listed.unionByName(counted).unionByName(named).unionByName(left)


U9_VIEWS_SQL = f"""WITH {USERS}, {LATEST} SELECT 'listed' AS view, username, CAST(NULL AS BIGINT) AS n FROM us UNION ALL SELECT 'count', NULL, count(*) FROM us
UNION ALL SELECT 'named', username, CAST(clearance AS BIGINT) FROM us WHERE username = 'u7' UNION ALL SELECT 'left', username, count(*) FROM ls WHERE o = 1 AND length(session_id) % 3 = 1 GROUP BY username"""

QUERIES = {
    "u1_transcript": (u1, U1_SQL),
    "u2_merged_roles": (u2, U2_SQL),
    "u3_context_budget": (u3, U3_SQL),
    "u4_hit_budget": (u4, U4_SQL),
    "u5_session_list": (u5, f"WITH {LATEST}, r AS (SELECT username, session_id, row_number() OVER (PARTITION BY username ORDER BY updated_at DESC, session_id) AS place, title FROM ls WHERE o = 1) SELECT * FROM r WHERE place <= 50"),
    "u6_session_upsert": (u6, U6_SQL),
    "u7_token_resolution": (u7, f"WITH {USERS}, {TOKENS} SELECT token_hash, username, role, clearance FROM tk JOIN us USING (username) WHERE expires_at > TIMESTAMP '1998-01-01' AND NOT disabled"),
    "u8_purged_tokens": (u8, f"WITH {USERS}, {TOKENS} SELECT token_hash, username FROM tk WHERE expires_at > TIMESTAMP '1998-01-01' AND username NOT IN (SELECT username FROM us WHERE disabled)"),
    "u9_updated_users": (u9, f"WITH {USERS} SELECT username, role, CASE WHEN username LIKE '%3' THEN 4 ELSE clearance END AS clearance, disabled, unit FROM us"),
    "u10_lockouts": (u10, LOCKOUT_SQL),
    "u10_recent_failures": (u10_window, f"WITH {ATTEMPTS} SELECT attempt_id, CAST(sum(CAST(NOT success AS INT)) OVER (PARTITION BY k ORDER BY epoch_us(ts) RANGE BETWEEN {SECONDS * 1000000 - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS recent_failures FROM att"),
    "u12_client_address": (u12, U12_SQL),
    "u12_trusted_networks": (u12_networks, U12_NETWORKS_SQL),
    "u9_user_views": (u9_views, U9_VIEWS_SQL),
}
