"""Queries on mentions in texts, segments of remarks, guarded decisions, identities and single cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, dates
from ..operators import overlay, spans, text, validate
from .base import orders, rounded, table

_LEXICON = {"noun": "the [a-z]+", "owned": "[a-z]+ of the [a-z]+", "part": "[a-z]+ of", "motion": "[a-z]*tion"}


def term_spans(spark: SparkSession, d: str) -> DataFrame:
    """All mentions of four phrases in the documents, with their places in characters."""
    return spans.term_spans(table(spark, d, "documents"), "doc_id", "text", _LEXICON)


_SPANS = f"""
m AS ({" UNION ALL ".join(f"SELECT doc_id, '{n}' AS label, {k} AS place, regexp_extract_all(text, '{p}') AS terms, string_split_regex(text, '{p}') AS gaps FROM documents" for k, (n, p) in enumerate(_LEXICON.items()))}),
e AS (SELECT doc_id, label, place, unnest(terms) AS term, unnest(gaps[:len(terms)]) AS gap, generate_subscripts(terms, 1) AS k FROM m),
s AS (SELECT doc_id, label, place, term, (sum(length(gap) + length(term)) OVER (PARTITION BY doc_id, label ORDER BY k))::BIGINT AS "end" FROM e),
t AS (SELECT doc_id, label, place, "end" - length(term) AS start, "end", term FROM s)"""
TERM_SPANS = f"WITH {_SPANS} SELECT * FROM t"


def longest_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The mentions that stay where they overlap: the longest."""
    return spans.longest_mentions(term_spans(spark, d), "doc_id")


LONGEST_MENTIONS = f"""
WITH RECURSIVE {_SPANS},
b AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end", place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR start >= before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, "end", place ROWS UNBOUNDED PRECEDING) AS run FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY "end" - start DESC, start, place) AS n FROM i),
r AS (SELECT doc_id, run, n, [{{'s': start, 'e': "end"}}] AS held, true AS stays FROM o WHERE n = 1
  UNION ALL SELECT o.doc_id, o.run, o.n, CASE WHEN len(list_filter(held, lambda a: a.s < o."end" AND o.start < a.e)) > 0 THEN held ELSE list_append(held, {{'s': o.start, 'e': o."end"}}) END, len(list_filter(held, lambda a: a.s < o."end" AND o.start < a.e)) = 0
  FROM r JOIN o ON o.doc_id = r.doc_id AND o.run = r.run AND o.n = r.n + 1)
SELECT o.doc_id, label, place, start, "end", term FROM o JOIN r USING (doc_id, run, n) WHERE stays"""

_MOVES = (("from the [a-z]", "inbound"), ("(?:to|for) the [a-z]", "outbound"), ("in the [a-z]", "internal"))
_NOISE = "[0-9@]|^ *$"


def moves(spark: SparkSession, d: str) -> DataFrame:
    """What the sentences of each document say of moves, by the first rule that matches; those with numbers or addresses are noise."""
    return text.transfers(table(spark, d, "documents"), "doc_id", "text", _MOVES, _NOISE, split=r"[.\n]")


MOVES = f"""
WITH s AS (SELECT doc_id, unnest(string_split_regex(text, '[.\\n]')) AS part, (generate_subscripts(string_split_regex(text, '[.\\n]'), 1) - 1)::INT AS segment FROM documents),
l AS (SELECT doc_id, segment, CASE {" ".join(f"WHEN regexp_matches(part, '{p}') THEN '{n}'" for p, n in _MOVES)} END AS label FROM s WHERE NOT regexp_matches(part, '{_NOISE}'))
SELECT * FROM l WHERE label IS NOT NULL"""


def decided_types(spark: SparkSession, d: str) -> DataFrame:
    """Parts with what was decided on their type (its most frequent name); a type without a decision would stop the query."""
    part = table(spark, d, "part")
    counts = part.groupBy("p_type", "p_name").agg(F.count("*").alias("n"))
    decided = counts.groupBy("p_type").agg(F.min_by("p_name", F.struct(-F.col("n"), "p_name")).alias("decided"))
    return validate.all_decided(part.select("p_partkey", "p_type"), decided, "p_type", "decided")


DECIDED_TYPES = """
WITH c AS (SELECT p_type, p_name, count(*) AS n FROM part GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_name) AS r FROM c)
SELECT p_partkey, p_type, k.p_name AS decided FROM part JOIN k USING (p_type) WHERE r = 1"""


def decision_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Names that stand for several brands, or for none."""
    return validate.conflicts(table(spark, d, "part"), "p_name", "p_brand")


DECISION_CONFLICTS = "SELECT p_name, count(DISTINCT p_brand) AS targets FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) <> 1"


def row_identity(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose orders are not all of one of the four stated priorities; customers without an urgent order have an empty cell and are not judged."""
    of = lambda p: F.nullif(F.count_if(F.col("o_orderpriority") == p), F.lit(0) if p == "1-URGENT" else F.lit(-1))
    rows = orders(spark, d).groupBy("o_custkey").agg(F.count("*").alias("orders"), *(of(p).alias(n) for n, p in (("urgent", "1-URGENT"), ("high", "2-HIGH"), ("medium", "3-MEDIUM"), ("low", "5-LOW"))))
    return validate.broken_identity(rows, F.col("orders"), F.col("urgent") + F.col("high") + F.col("medium") + F.col("low"))


ROW_IDENTITY = """
SELECT o_custkey, count(*) AS orders, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderpriority = '3-MEDIUM') AS medium,
  count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1 HAVING bool_or(o_orderpriority = '1-URGENT') AND bool_or(o_orderpriority = '4-NOT SPECIFIED')"""


def cross_table_totals(spark: SparkSession, d: str) -> DataFrame:
    """Months and priorities where fewer orders have line items than the orders' own table counts, by more than 1 where nothing is specified."""
    key = orders(spark, d).select("o_orderkey", "o_orderpriority", F.trunc("day", "month").alias("month"))
    items = key.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").withColumn("one", F.lit(1).cast("long"))
    totals = key.groupBy("month", "o_orderpriority").agg(F.count("*").alias("n"))
    slack = key.where("o_orderpriority = '4-NOT SPECIFIED'").select("month", "o_orderpriority", F.lit(1).alias("tolerance")).distinct()
    return validate.against_totals(items, totals, ["month", "o_orderpriority"], "one", "n", slack)


CROSS_TABLE_TOTALS = """
WITH k AS (SELECT o_orderkey, o_orderpriority, date_trunc('month', o_orderdate)::DATE AS month FROM orders),
t AS (SELECT month, o_orderpriority, count(*) AS printed, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS n FROM k GROUP BY 1, 2)
SELECT month, o_orderpriority, nullif(n, 0) AS found, printed, nullif(n, 0) - printed AS difference FROM t
WHERE n = 0 OR printed - n > CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END"""


def block_moved_down(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders, where priority and price of pending orders in a row stand one row too high."""
    rows = orders(spark, d).select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return overlay.shift_block_down(rows, ["o_custkey"], ["o_orderkey"], ["o_orderpriority", "o_totalprice"], F.col("o_orderstatus") == "P")


BLOCK_MOVED_DOWN = """
WITH w AS (SELECT *, o_orderstatus = 'P' AND coalesce(lag(o_orderstatus) OVER c = 'P', false) AS inside, lag(o_orderpriority) OVER c AS p, lag(o_totalprice) OVER c AS t FROM orders WINDOW c AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, o_orderkey, o_orderstatus, CASE WHEN inside THEN p ELSE o_orderpriority END AS o_orderpriority, CASE WHEN inside THEN t ELSE o_totalprice END AS o_totalprice FROM w"""


def ages(spark: SparkSession, d: str) -> DataFrame:
    """Balances read as ages, in units that begin like the market segment (machinery: months)."""
    out = table(spark, d, "customer").select("c_custkey", dates.in_years(F.col("c_acctbal"), F.col("c_mktsegment")).alias("years"))
    # Numbers stay numbers: as text one below 0.001 is written with an exponent, and a zero may have a sign, which rounding would drop.
    return out.select("c_custkey", F.when(F.col("years") == 0, F.col("years")).otherwise(F.round("years", 9)).alias("years"), dates.band(F.col("years"), 10).alias("band"))


AGES = """
WITH a AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN CASE WHEN c_mktsegment LIKE 'M%' THEN c_acctbal / 12 ELSE c_acctbal END END AS years FROM customer)
SELECT c_custkey, round(years, 9) AS years, (floor(years / 10) * 10)::BIGINT AS band FROM a"""


def month_fractions(spark: SparkSession, d: str) -> DataFrame:
    """Where in its month each order falls, as a running number of months."""
    return rounded(orders(spark, d).select("o_orderkey", dates.month_number(F.col("day")).alias("month")), 9, "month")


MONTH_FRACTIONS = "SELECT o_orderkey, round(year(o_orderdate) * 12 + month(o_orderdate) + (day(o_orderdate) - 1) / day(last_day(o_orderdate)), 9) AS month FROM orders"


def closed_cells(spark: SparkSession, d: str) -> DataFrame:
    """Types of a closed list only, and names without the range of numbers before them."""
    label = F.concat("p_partkey", F.lit("-"), "p_size", F.lit(" "), "p_name")
    return table(spark, d, "part").select("p_partkey", cells.closed(F.col("p_type"), ["ECONOMY", "PROMO"]).alias("type"), cells.strip_range_prefix(label).alias("label"))


CLOSED_CELLS = "SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN p_type ELSE '' END AS type, p_name AS label FROM part"

QUERIES = {
    q.__name__: q
    for q in (term_spans, longest_mentions, moves, decided_types, decision_conflicts, row_identity, cross_table_totals, block_moved_down, ages, month_fractions, closed_cells)
}
SQL = {name: globals()[name.upper()] for name in QUERIES}
