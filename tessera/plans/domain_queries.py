"""Queries on the domain column functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import domain as G
from ..sources.files import read_table

ZONES = ("Z", "I", "KST", "A", "Q", "M", "Y", "J")


def zone(col):
    return F.element_at(F.array(*[F.lit(z) for z in ZONES]), (col % len(ZONES) + 1).cast("int"))


def g2(spark, sf):
    """Each event's time written as a date-time group and read again."""
    e = read_table(spark, sf, "events").select("event_id", G.format_dtg(F.col("ts").cast("timestamp"), zone(F.col("event_id"))).alias("dtg"))
    return e.select("event_id", "dtg", F.date_format(G.parse_dtg(F.col("dtg")), "yyyy-MM-dd HH:mm").alias("utc"))


HOURS = "CASE event_id % 8 WHEN 0 THEN 0 WHEN 1 THEN 9 WHEN 2 THEN 9 WHEN 3 THEN 1 WHEN 4 THEN -4 WHEN 5 THEN 12 WHEN 6 THEN -12 END"
LETTER = "CASE event_id % 8 WHEN 0 THEN 'Z' WHEN 1 THEN 'I' WHEN 2 THEN 'I' WHEN 3 THEN 'A' WHEN 4 THEN 'Q' WHEN 5 THEN 'M' WHEN 6 THEN 'Y' END"
G2_SQL = f"""SELECT event_id, strftime(ts + to_hours({HOURS}), '%d%H%M') || {LETTER} || upper(strftime(ts + to_hours({HOURS}), '%b%y')) AS dtg,
  CASE WHEN event_id % 8 <> 7 THEN strftime(ts, '%Y-%m-%d %H:%M') END AS utc FROM events"""


def g3(spark, sf):
    """Order dates as ISO 8601, converted to a zone."""
    o = read_table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm").alias("d"))
    return o.select("o_orderkey", G.convert_dtg(F.concat("d", F.lit("+09:00")), F.lit("UTC")).alias("dtg"))


def g3_zones(spark, sf):
    """The zone letter of each order's offset, from 13 hours west to 13 hours east."""
    return read_table(spark, sf, "orders").select("o_orderkey", G.zone_letter(F.col("o_orderkey") % 27 - 13).alias("letter"))


def g4(spark, sf):
    pairs = (("kg", "lb"), ("mi", "km"), ("노트", "km/h"), ("C", "F"), ("mil", "deg"), ("kg", "m"))
    a, b = (F.element_at(F.array(*[F.lit(p[i]) for p in pairs]), (F.col("l_orderkey") % len(pairs) + 1).cast("int")) for i in (0, 1))
    d = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", a.alias("a"), b.alias("b"))
    return G.with_converted(d, "l_quantity", "a", "b", "x").select("l_orderkey", "l_linenumber", F.round("x", 6).alias("converted"))


G4_SQL = """SELECT l_orderkey, l_linenumber, round(CASE l_orderkey % 6 WHEN 0 THEN l_quantity * 1.0::DOUBLE / 0.45359237::DOUBLE WHEN 1 THEN l_quantity * 1609.344::DOUBLE / 1000 WHEN 2 THEN l_quantity * (1852.0::DOUBLE / 3600) / (1000.0::DOUBLE / 3600)
  WHEN 3 THEN l_quantity * 9 / 5 + 32 WHEN 4 THEN l_quantity * (360.0::DOUBLE / 6400) END, 6) AS converted FROM lineitem"""


def g4_shown(spark, sf):
    p = read_table(spark, sf, "part")
    return p.select("p_partkey", G.significant(F.col("p_retailprice")).alias("shown"))


def g5(spark, sf):
    return read_table(spark, sf, "part").select("p_partkey", G.spell(F.col("p_brand")).alias("spelled"))


G5_SQL = (
    "SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(trim(p_brand), '.'), lambda c: CASE upper(c) "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.SPELLING.items()) + " ELSE c END), ' ') AS spelled FROM part"
)


def glossary(spark, sf):
    """nation and region as a glossary."""
    n, r = read_table(spark, sf, "nation"), read_table(spark, sf, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("term"), F.lower("n_name").alias("full"), F.col("r_name").alias("ko"), F.concat(F.lit("in "), "r_name").alias("desc"), F.col("n_nationkey").alias("pos")
    )


def g1(spark, sf):
    """Each customer's question is the name, or a part of the name, of a nation or region."""
    c = read_table(spark, sf, "customer").join(glossary(spark, sf), F.col("c_nationkey") == F.col("pos"))
    asked = F.when(F.col("c_custkey") % 3 == 0, F.lower("term")).when(F.col("c_custkey") % 3 == 1, F.lower("ko")).otherwise(F.substring("term", 2, 3))
    q = c.select(F.col("c_custkey").alias("query_id"), asked.alias("query"))
    return G.look_up_terms(q, glossary(spark, sf)).select("query_id", F.col("place").cast("long").alias("place"), "term", "exact")


G1_SQL = """WITH gl AS (SELECT n_name AS term, lower(n_name) AS fu, r_name AS ko, 'in ' || r_name AS de, n_nationkey AS pos FROM nation JOIN region ON n_regionkey = r_regionkey),
q AS (SELECT c_custkey AS query_id, CASE c_custkey % 3 WHEN 0 THEN lower(term) WHEN 1 THEN lower(ko) ELSE substr(term, 2, 3) END AS query FROM customer JOIN gl ON c_nationkey = pos),
e AS (SELECT query_id, term FROM q JOIN gl ON upper(regexp_replace(trim(query), '[ -]', '', 'g')) = upper(regexp_replace(term, '[ -]', '', 'g'))),
n AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS place FROM q JOIN gl ON contains(lower(term) || chr(1) || fu || chr(1) || lower(ko) || chr(1) || lower(de), lower(trim(query)))
  WHERE query_id NOT IN (SELECT query_id FROM e))
SELECT query_id, CAST(1 AS BIGINT) AS place, term, true AS exact FROM e UNION ALL SELECT query_id, place, term, false FROM n WHERE place <= 5"""


def g6(spark, sf):
    """A report for each customer, with what its row can fill."""
    kinds = ("상황 보고", "salute", "9-line", "warno", "작명", "memo")
    c = read_table(spark, sf, "customer")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("c_custkey") % len(kinds) + 1).cast("int"))
    fields = F.create_map(F.lit("unit"), F.col("c_name"), F.lit("mission"), F.col("c_mktsegment"), F.lit("line1"), F.when(F.col("c_custkey") % 2 == 0, "x").otherwise(""))
    d = G.fill_forms(c.select("c_custkey", kind.alias("kind"), fields.alias("fields")))
    return d.select("c_custkey", "form", F.size("missing").cast("long").alias("n_missing"), F.array_join("unknown", ",").alias("unknown"))


G6_SQL = """SELECT c_custkey, CASE k WHEN 0 THEN 'SITREP' WHEN 1 THEN 'SPOTREP' WHEN 2 THEN 'MEDEVAC' WHEN 3 THEN 'WARNORD' WHEN 4 THEN 'OPORD' END AS form,
  CAST(CASE k WHEN 0 THEN 7 WHEN 1 THEN 6 WHEN 2 THEN CASE WHEN c_custkey % 2 = 0 THEN 8 ELSE 9 END WHEN 3 THEN 4 WHEN 4 THEN 4 END AS BIGINT) AS n_missing,
  CASE k WHEN 0 THEN 'line1,mission' WHEN 1 THEN 'line1,mission' WHEN 2 THEN 'mission,unit' WHEN 3 THEN 'line1,unit' WHEN 4 THEN 'line1,unit' END AS unknown
FROM (SELECT c_custkey, c_custkey % 6 AS k FROM customer)"""

QUERIES = {
    "g1_glossary_lookup": (g1, G1_SQL),
    "g2_date_time_groups": (g2, G2_SQL),
    "g3_dtg_conversion": (g3, "SELECT o_orderkey, strftime(o_orderdate - INTERVAL 9 HOUR, '%d%H%M') || 'Z' || upper(strftime(o_orderdate - INTERVAL 9 HOUR, '%b%y')) AS dtg FROM orders"),
    "g3_zone_letters": (g3_zones, "SELECT o_orderkey, CASE WHEN h = 0 THEN 'Z' WHEN h BETWEEN 1 AND 12 THEN substr('ABCDEFGHIKLM', h, 1) WHEN h BETWEEN -12 AND -1 THEN substr('NOPQRSTUVWXY', -h, 1) END AS letter FROM (SELECT o_orderkey, CAST(o_orderkey % 27 - 13 AS INT) AS h FROM orders)"),
    "g4_unit_conversion": (g4, G4_SQL),
    "g4_significant_digits": (g4_shown, r"SELECT p_partkey, regexp_replace(regexp_replace(CASE WHEN p_retailprice >= 1000 THEN format('{:,.0f}', p_retailprice) ELSE format('{:,.1f}', p_retailprice) END, '(\.\d*?)0+$', '\1'), '\.$', '') AS shown FROM part"),
    "g5_spelling": (g5, G5_SQL),
    "g6_report_forms": (g6, G6_SQL),
}
