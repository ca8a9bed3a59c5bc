"""Curation over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import curation
from .base import events, orders, rounded, table


_GROUPS = ((("1-URGENT", "2-HIGH"), ("F",), "pressed and done"), (("1-URGENT", "2-HIGH"), (), "pressed"), ((), ("F",), "done"))


def crossed_groups(spark: SparkSession, d: str) -> DataFrame:
    """Rates of dear orders by crossed group; null for groups of fewer than 100 rows."""
    group = rules.crossed_group(F.col("o_orderpriority"), F.col("o_orderstatus"), _GROUPS)
    return rounded(curation.suppressed_rate(table(spark, d, "orders"), group, F.col("o_totalprice") > 300000, 100), 9, "rate")


CROSSED_GROUPS = """
WITH g AS (SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CASE WHEN o_orderstatus = 'F' THEN 'pressed and done' ELSE 'pressed' END WHEN o_orderstatus = 'F' THEN 'done' ELSE 'other' END AS value, o_totalprice > 300000 AS hit FROM orders)
SELECT value, count(*) AS n, count(*) FILTER (hit) AS hits, CASE WHEN count(*) >= 100 THEN round(count(*) FILTER (hit)::DOUBLE / count(*), 9) END AS rate FROM g GROUP BY 1"""

def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    before = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.expr("nullif(o_orderstatus, 'P')").alias("status"), F.col("o_orderpriority").alias("priority"))
    after = before.withColumn("status", F.expr("CASE WHEN status IS NULL THEN 'O' WHEN o_orderkey % 50 = 0 THEN NULL ELSE status END")).withColumn("priority", F.expr("CASE WHEN o_orderkey % 20 = 1 THEN '9-NONE' ELSE priority END"))
    return before, after


_STATES = """
WITH b AS (SELECT o_orderkey, year(o_orderdate) AS y, nullif(o_orderstatus, 'P') AS s, o_orderpriority AS p FROM orders),
t AS (SELECT *, CASE WHEN s IS NULL THEN 'O' WHEN o_orderkey % 50 = 0 THEN NULL ELSE s END AS s2, CASE WHEN o_orderkey % 20 = 1 THEN '9-NONE' ELSE p END AS p2 FROM b)"""


def audit_report(spark: SparkSession, d: str) -> DataFrame:
    return curation.audit(*_states(spark, d), "o_orderkey", ["status", "priority"])


AUDIT_REPORT = (
    _STATES
    + """, u AS (SELECT 'status' AS "column", s AS "from", s2 AS "to" FROM t UNION ALL SELECT 'priority', p, p2 FROM t)
SELECT CASE WHEN "from" IS NULL THEN 'filled' WHEN "to" IS NULL THEN 'cleared' ELSE 'changed' END AS kind, "column", "from", "to", count(*) AS records FROM u WHERE "from" IS DISTINCT FROM "to" GROUP BY 1, 2, 3, 4"""
)


def correction_deltas(spark: SparkSession, d: str) -> DataFrame:
    return curation.correction_deltas(*_states(spark, d), "o_orderkey", ["status", "priority"], F.year("o_orderdate"))


_DELTA = ", ".join(
    f"count(*) FILTER ({a} IS NULL AND {b} IS NOT NULL) AS {n}_filled, count(*) FILTER ({a} IS NOT NULL AND {b} IS NULL) AS {n}_cleared, count(*) FILTER ({a} <> {b}) AS {n}_changed" for n, a, b in (("status", "s", "s2"), ("priority", "p", "p2"))
)
CORRECTION_DELTAS = _STATES + f" SELECT y AS value, count(*) AS records, {_DELTA} FROM t GROUP BY 1"


def rare_values(spark: SparkSession, d: str) -> DataFrame:
    return curation.rare_values(table(spark, d, "orders"), "o_custkey", 10).select("o_orderkey", "rare")


RARE_VALUES = "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) < 10 AS rare FROM orders"


def page_states(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "orders").withColumn("page", F.expr("o_orderkey DIV 3"))
    return curation.page_state(pages, ["page"], F.col("o_orderstatus") == "F")


PAGE_STATES = """SELECT o_orderkey // 3 AS page, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS filled, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'all' WHEN bool_or(o_orderstatus = 'F') THEN 'mixed' ELSE 'none' END AS state FROM orders GROUP BY 1"""


def distinct_per_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("kinds"))


DISTINCT_PER_GROUP = "SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1"


def bed_days(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").withColumns({"shipped": F.col("l_shipdate").cast("date")}).join(orders(spark, d).select("o_orderkey", "day"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(curation.occupancy(items, "l_returnflag", "day", "shipped", 50, 400), 9, "occupancy")


BED_DAYS = """
WITH s AS (SELECT l_returnflag, o_orderdate::DATE AS a, l_shipdate::DATE - o_orderdate::DATE AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_returnflag, count(*) AS stays, sum(n)::BIGINT AS bed_days, max(a) - min(a) + 1 AS days, round(sum(n) / ((max(a) - min(a) + 1) * 50)::DOUBLE, 9) AS occupancy FROM s WHERE n >= 0 AND n < 400 GROUP BY 1"""

def carried_headings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.expr("o_orderkey DIV 250").alias("book"), "o_orderpriority")
    head, line = F.when(F.col("o_orderkey") % 40 == 3, F.col("o_orderpriority")), F.when(F.col("o_orderkey") % 5 == 1, F.col("o_orderkey"))
    return curation.carried_heading(rows, "book", "o_orderkey", head, line).select("o_orderkey", "heading", "near")


CARRIED_HEADINGS = """
SELECT o_orderkey, last_value(CASE WHEN o_orderkey % 40 = 3 THEN o_orderpriority END IGNORE NULLS) OVER (PARTITION BY o_orderkey // 250 ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS heading,
  last_value(CASE WHEN o_orderkey % 5 = 1 THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_orderkey // 250 ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near FROM orders"""


def span_seats(spark: SparkSession, d: str) -> DataFrame:
    span = F.expr("CASE WHEN o_orderkey % 2 = 0 THEN array(1993, 1994, 1996) ELSE array(1996, 1997) END")
    return orders(spark, d).select("o_orderkey", curation.seat_in_span(F.year("day"), span).alias("seat"))


SPAN_SEATS = """
WITH o AS (SELECT o_orderkey, year(o_orderdate)::INT AS y, CASE WHEN o_orderkey % 2 = 0 THEN [1993, 1994, 1996] ELSE [1996, 1997] END AS span FROM orders)
SELECT o_orderkey, list_sort(list_transform(span, lambda s: {'gap': abs(s - y), 'year': s}))[1].year AS seat FROM o"""


def serial_witness(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", F.expr("o_orderkey DIV 250").alias("book"), F.col("o_orderkey").alias("serial"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN array(o_orderkey + 1) END").alias("aside"))
    return curation.serial_witness(rows, "book", "serial", "aside").select("o_orderkey", "moved")


SERIAL_WITNESS = """
WITH r AS (SELECT o_orderkey, o_orderkey // 250 AS book FROM orders WHERE o_orderstatus <> 'P')
SELECT r.o_orderkey, CASE WHEN r.o_orderkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM r x WHERE x.book = r.book AND x.o_orderkey = r.o_orderkey + 1) THEN r.o_orderkey + 1 ELSE r.o_orderkey END AS moved FROM r"""


def cases_around(spark: SparkSession, d: str) -> DataFrame:
    """Cancelling events with the purchases of their user within two days."""
    e = events(spark, d)
    series = e.where("event_type = 'purchase'").groupBy("user_id", "day").agg(F.count("*").alias("n"))
    asked = e.where("event_type <> 'purchase'").select("user_id", "day", "event_type")
    return curation.around(asked, series, "user_id", "day", 2).groupBy("event_type", "covered").agg(F.count("*").alias("n"), F.sum("cases").alias("cases"))


CASES_AROUND = """
WITH e AS (SELECT user_id, ts::DATE AS day, event_type FROM events), s AS (SELECT user_id, day, count(*) AS n FROM e WHERE event_type = 'purchase' GROUP BY 1, 2),
a AS (SELECT row_number() OVER () AS k, * FROM e WHERE event_type <> 'purchase'), j AS (SELECT k, a.event_type, coalesce(sum(n), 0) AS cases, count(n) > 0 AS covered FROM a LEFT JOIN s ON s.user_id = a.user_id AND s.day BETWEEN a.day - 2 AND a.day + 2 GROUP BY 1, 2)
SELECT event_type, covered, count(*) AS n, sum(cases)::BIGINT AS cases FROM j GROUP BY 1, 2"""


def uncovered_months(spark: SparkSession, d: str) -> DataFrame:
    """Finished orders in months in which their customer has no open one."""
    o = orders(spark, d)
    covered = o.where("o_orderstatus = 'O'").select("o_custkey", F.trunc("day", "month").cast("date").alias("month")).distinct()
    return curation.uncovered(o.where("o_orderstatus = 'F'").select("o_custkey", "day"), covered, "o_custkey", "day").groupBy("month").agg(F.count("*").alias("n"))


UNCOVERED_MONTHS = """
WITH o AS (SELECT o_custkey, date_trunc('month', o_orderdate)::DATE AS month, o_orderstatus AS s FROM orders)
SELECT month, count(*) AS n FROM o WHERE s = 'F' AND NOT EXISTS (SELECT 1 FROM o p WHERE p.s = 'O' AND p.o_custkey = o.o_custkey AND p.month = o.month) GROUP BY 1"""


def merged_entities(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    a = c.where("c_custkey % 3 <> 0").select("c_custkey", F.expr("CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END").alias("segment"), F.expr("array(c_mktsegment)").alias("seen"))
    b = c.where("c_custkey % 5 <> 0").select("c_custkey", F.lit("B").alias("segment"), F.expr("array('B', 'C')").alias("seen"))
    return curation.merge_entities(a, b, "c_custkey", ["segment"], ["seen"]).withColumn("seen", F.array_join("seen", ","))


MERGED_ENTITIES = """
WITH m AS (SELECT c_custkey, c_custkey % 3 <> 0 AS a, c_custkey % 5 <> 0 AS b, c_mktsegment AS s FROM customer)
SELECT c_custkey, CASE WHEN a AND c_custkey % 2 = 0 THEN s WHEN b THEN 'B' END AS segment, CASE WHEN a AND b THEN 'both' WHEN a THEN 'a' ELSE 'b' END AS "in",
  array_to_string(list_sort(list_concat(CASE WHEN a THEN [s] ELSE [] END, CASE WHEN b THEN ['B', 'C'] ELSE [] END)), ',') AS seen FROM m WHERE a OR b"""


def span_conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select(F.expr("o_orderkey DIV 3").alias("page"), "day", F.lit(1993).alias("low"), F.lit(1996).alias("high"))
    return curation.span_conflicts(rows, "page", F.year("day"), "low", "high")


SPAN_CONFLICTS = """
WITH p AS (SELECT o_orderkey // 3 AS page, count(*) AS n, count(*) FILTER (NOT year(o_orderdate) BETWEEN 1993 AND 1996) AS outside FROM orders GROUP BY 1)
SELECT *, CASE WHEN outside = n THEN 'whole page' WHEN outside > 0 THEN 'some' ELSE 'none' END AS verdict FROM p"""


def two_sources(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return rounded(curation.two_sources(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_orderpriority", 0.005), 9, "share_a", "share_b")


TWO_SOURCES = """
WITH n AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY 1), s AS (SELECT o_orderpriority, a::DOUBLE / sum(a) OVER () AS x, b::DOUBLE / sum(b) OVER () AS y FROM n)
SELECT o_orderpriority, round(x, 9) AS share_a, round(y, 9) AS share_b, abs(x - y) <= 0.005 AS agree FROM s"""

_SPELL = "CASE WHEN o_orderkey % 7 = 0 THEN upper(o_clerk) WHEN o_orderkey % 7 < 3 THEN concat(o_clerk, '.') ELSE o_clerk END"


def canonical_spellings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("spelling", F.expr(_SPELL.replace("o_clerk", "o_orderpriority")))
    return curation.canonical(rows, F.lower(F.regexp_replace("spelling", "[.]", "")), "spelling")


CANONICAL_SPELLINGS = f"""
WITH s AS (SELECT {_SPELL.replace("o_clerk", "o_orderpriority")} AS s FROM orders), n AS (SELECT lower(replace(s, '.', '')) AS key, s, count(*) AS n FROM s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, length(s) DESC, s) AS k, sum(n) OVER (PARTITION BY key) AS records FROM n)
SELECT key, s AS canonical, records::BIGINT AS records FROM r WHERE k = 1"""


def value_decisions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey")
    manual, auto = c.where("c_custkey % 7 = 0").withColumn("target", F.lit("m")), c.where("c_custkey % 2 = 0").withColumn("target", F.lit("a"))
    values = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return curation.decisions(values, "c_custkey", manual, auto)


VALUE_DECISIONS = """
SELECT o_custkey AS c_custkey, count(*) AS records, CASE WHEN o_custkey % 7 = 0 THEN 'm' WHEN o_custkey % 2 = 0 THEN 'a' END AS target, CASE WHEN o_custkey % 7 = 0 THEN 'manual' WHEN o_custkey % 2 = 0 THEN 'auto' ELSE 'missing' END AS by
FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) OR (o_custkey % 7 <> 0 AND o_custkey % 2 <> 0) GROUP BY 1""".replace(" AS by\n", ' AS "by"\n')


def work_queue(spark: SparkSession, d: str) -> DataFrame:
    return curation.work_queue(table(spark, d, "orders"), "o_custkey", "o_orderstatus", 15)


WORK_QUEUE = """
WITH p AS (SELECT o_custkey, o_orderstatus AS m, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, sum(n)::BIGINT AS records, string_agg(m || ' ' || n, '; ' ORDER BY n DESC, m) AS mix FROM p GROUP BY 1 HAVING sum(n) >= 15"""


def why_unmapped(spark: SparkSession, d: str) -> DataFrame:
    decided = table(spark, d, "customer").where("c_custkey % 3 <> 0").select("c_custkey", F.expr("CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END").alias("target"))
    return curation.unmapped(table(spark, d, "orders"), F.expr("CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END"), decided, "c_custkey")


WHY_UNMAPPED = """
SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'no value' WHEN c_custkey IS NULL THEN 'undecided' WHEN c_custkey % 5 = 0 THEN 'decided none' ELSE 'mapped' END AS why, count(*) AS records
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 <> 0 GROUP BY 1"""

QUERIES = {
    f.__name__: f
    for f in (
        crossed_groups, audit_report, correction_deltas, rare_values, page_states, distinct_per_group, bed_days, carried_headings, span_seats, serial_witness, cases_around, uncovered_months,
        merged_entities, span_conflicts, two_sources, canonical_spellings, value_decisions, work_queue, why_unmapped,
    )
}
SQL = {name: globals()[name.upper()] for name in QUERIES}
