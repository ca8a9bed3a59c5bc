"""Queries of an interactive session: filters, facets, distributions, statistics, sorting and paging."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cells import facet_value
from ..operators import filters, stats
from .base import events, ledger, orders, rounded, stays, table

STATE = filters.FilterState(
    ranges={"day": filters.Range(dt.date(1993, 1, 1), dt.date(1996, 12, 31), narrowed_dates=True)},
    facets={"o_orderpriority": ("1-URGENT", "2-HIGH"), "c_mktsegment": ("BUILDING", "MACHINERY")},
)
_WHERE = "o_orderdate::DATE BETWEEN DATE '1993-01-01' AND DATE '1996-12-31'"
_P, _S = "o_orderpriority IN ('1-URGENT','2-HIGH')", "c_mktsegment IN ('BUILDING','MACHINERY')"
_JOIN = "orders JOIN customer ON o_custkey = c_custkey"


def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    return filters.facet_counts(ledger(spark, d), STATE, ["o_orderpriority", "c_mktsegment", "o_orderstatus"])


FACET_COUNTS = f"""
SELECT 'o_orderpriority' AS facet, o_orderpriority AS value, count(*) AS n FROM {_JOIN} WHERE {_WHERE} AND {_S} GROUP BY ALL
UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*) FROM {_JOIN} WHERE {_WHERE} AND {_P} GROUP BY ALL
UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM {_JOIN} WHERE {_WHERE} AND {_P} AND {_S} GROUP BY ALL"""


def facet_options(spark: SparkSession, d: str) -> DataFrame:
    state = filters.FilterState(facets={"p_brand": ("Brand#11", "Brand#99")})
    counts = filters.facet_counts(table(spark, d, "part"), state, ["p_brand", "p_type"])
    return filters.facet_options(counts, state, top=5)


FACET_OPTIONS = """
WITH c AS (SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS n FROM part GROUP BY ALL
  UNION ALL SELECT 'p_type', p_type, count(*) FROM part WHERE p_brand IN ('Brand#11','Brand#99') GROUP BY ALL),
t AS (SELECT 'p_brand' AS facet, unnest(['Brand#11','Brand#99']) AS value, true AS ticked),
j AS (SELECT coalesce(c.facet, t.facet) AS facet, coalesce(c.value, t.value) AS value, coalesce(n, 0) AS n, coalesce(ticked, false) AS ticked
  FROM c FULL JOIN t ON c.facet = t.facet AND c.value = t.value),
r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY ticked DESC, n DESC, value) AS k FROM j)
SELECT facet, value, n, ticked FROM r WHERE k <= 5 OR ticked OR value = 'Not recorded'"""


def facet_topn_others(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return rounded(stats.top_or_others(part, part.where("p_size <= 10"), "p_brand", 8, floor=0.005), 9, "share")


FACET_TOPN_OTHERS = """
WITH r AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 8),
c AS (SELECT p_brand AS v, count(*) AS c FROM part WHERE p_size <= 10 GROUP BY 1),
s AS (SELECT v, c, c / sum(c) OVER () AS share FROM c)
SELECT CASE WHEN v IN (SELECT p_brand FROM r) AND share >= 0.005 THEN v ELSE 'Others' END AS value, sum(c)::BIGINT AS n,
  round(sum(c) / (SELECT sum(c) FROM c), 9) AS share FROM s GROUP BY 1"""


def filter_search_any(spark: SparkSession, d: str) -> DataFrame:
    state = filters.FilterState(search="1", contains={"p_type": "a", "p_brand": "#1"})
    return filters.select(table(spark, d, "part"), state).select("p_partkey", "p_name", "p_brand")


FILTER_SEARCH_ANY = """
SELECT p_partkey, p_name, p_brand FROM part
WHERE lower(concat_ws(chr(1), p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)) LIKE '%1%' AND lower(p_type) LIKE '%a%' AND lower(p_brand) LIKE '%#1%'"""


def range_filter_nulls(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("day")).alias("day"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"))
    state = filters.FilterState(ranges={"day": filters.Range(dt.date(1994, 1, 1), dt.date(1995, 12, 31), True), "price": filters.Range(1000.0, 100000.0)})
    return filters.select(rows, state)


RANGE_FILTER_NULLS = """
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS day, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price FROM orders)
SELECT * FROM r WHERE day BETWEEN DATE '1994-01-01' AND DATE '1995-12-31' AND (price IS NULL OR price BETWEEN 1000 AND 100000)"""


def range_bounds(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


RANGE_BOUNDS = "SELECT min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders"


def distribution_share_lift(spark: SparkSession, d: str) -> DataFrame:
    out = stats.share_lift(ledger(spark, d), F.col("o_orderpriority") == "1-URGENT", "c_mktsegment")
    return rounded(out, 9, "share", "base_share", "lift")


DISTRIBUTION_SHARE_LIFT = f"""
WITH c AS (SELECT c_mktsegment AS value, count(*) FILTER (o_orderpriority = '1-URGENT') AS n, count(*) AS b FROM {_JOIN} GROUP BY 1)
SELECT value, n, round(n / sum(n) OVER (), 9) AS share, round(b / sum(b) OVER (), 9) AS base_share, round((n / sum(n) OVER ()) / (b / sum(b) OVER ()), 9) AS lift FROM c"""


def representation_lift_byar(spark: SparkSession, d: str) -> DataFrame:
    out = stats.representation(ledger(spark, d), F.col("o_orderpriority") == "1-URGENT", "c_mktsegment", F.year("day"))
    return rounded(out, 6, "expected", "lift", "lo", "hi", "expected_std", "lift_std", "lo_std", "hi_std")


_BYAR_HI = "(observed + 1) * pow(1 - 1 / (9.0::DOUBLE * (observed + 1)) + 1.96::DOUBLE / (3 * sqrt(observed + 1)), 3) / {e}"
_BYAR_LO = "CASE WHEN observed = 0 THEN 0 ELSE greatest(0, observed * pow(1 - 1 / (9.0::DOUBLE * observed) - 1.96::DOUBLE / (3 * sqrt(observed)), 3) / {e}) END"
REPRESENTATION_LIFT_BYAR = f"""
WITH c AS (SELECT c_mktsegment AS value, year(o_orderdate) AS y, count(*) AS m, count(*) FILTER (o_orderpriority = '1-URGENT') AS k FROM {_JOIN} GROUP BY 1, 2),
s AS (SELECT *, m * (sum(k) OVER (PARTITION BY y))::DOUBLE / sum(m) OVER (PARTITION BY y) AS std FROM c),
r AS (SELECT value, sum(k)::BIGINT AS observed, sum(m)::BIGINT AS registry_n, sum(std) AS expected_std FROM s GROUP BY 1),
e AS (SELECT *, (sum(observed) OVER ())::DOUBLE * registry_n / sum(registry_n) OVER () AS expected FROM r)
SELECT value, observed, registry_n, round(expected, 6) AS expected, round(observed / expected, 6) AS lift, round({_BYAR_LO.format(e="expected")}, 6) AS lo, round({_BYAR_HI.format(e="expected")}, 6) AS hi,
  round(expected_std, 6) AS expected_std, round(observed / expected_std, 6) AS lift_std, round({_BYAR_LO.format(e="expected_std")}, 6) AS lo_std, round({_BYAR_HI.format(e="expected_std")}, 6) AS hi_std FROM e"""


def crosstab_expected(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.crosstab(orders(spark, d), "o_orderpriority", "o_orderstatus"), 9, "expected", "ratio", "row_share")


CROSSTAB_EXPECTED = """
WITH c AS (SELECT o_orderpriority AS row, o_orderstatus AS col, count(*) AS observed FROM orders GROUP BY 1, 2),
r AS (SELECT row, sum(observed) AS rn FROM c GROUP BY 1), k AS (SELECT col, sum(observed) AS cn FROM c GROUP BY 1),
g AS (SELECT row, col, coalesce(observed, 0) AS observed, rn, rn::DOUBLE * cn / (SELECT sum(observed) FROM c) AS e FROM r CROSS JOIN k LEFT JOIN c USING (row, col))
SELECT row, col, observed, round(e, 9) AS expected, CASE WHEN observed >= 20 THEN round(observed / e, 9) END AS ratio, round(observed / rn, 9) AS row_share FROM g"""

_STAY_COLS = ("ratio", "lo", "hi")


def _stay(spark: SparkSession, d: str, strata: list[str]) -> DataFrame:
    rows = stays(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("chapter")), "l_partkey")
    rows = rows.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    rows = rows.select("c_mktsegment", F.datediff("shipped", "day").alias("days"), "chapter", F.year("day").alias("y"))
    return rounded(stats.compare_stays(rows, "c_mktsegment", "days", strata), 6, *_STAY_COLS)


def stay_compare_crude(spark: SparkSession, d: str) -> DataFrame:
    return _stay(spark, d, [])


def stay_compare_chapter(spark: SparkSession, d: str) -> DataFrame:
    return _stay(spark, d, ["chapter"])


def stay_compare_chapter_year(spark: SparkSession, d: str) -> DataFrame:
    return _stay(spark, d, ["chapter", "y"])


def _stay_sql(by: str) -> str:
    means = f"avg(y) OVER ({'PARTITION BY ' + by if by else ''})"
    n = f"CASE WHEN count(*) OVER (PARTITION BY {by}) >= 2 THEN y - {means} END" if by else f"y - {means}"
    return f"""
WITH i AS (SELECT c_mktsegment AS name, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::DOUBLE AS d, p_type AS chapter, year(o_orderdate) AS yr
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
l AS (SELECT *, ln(1 + d) AS y FROM i WHERE d >= 0), r AS (SELECT *, {n} AS r FROM l)
SELECT name, count(*) AS n, quantile_cont(d, 0.1) AS p10, quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.75) AS q3, quantile_cont(d, 0.9) AS p90,
  count(*) FILTER (d > 365) AS over_year, round(exp(avg(r)), 6) AS ratio, round(exp(avg(r) - 1.96 * stddev_samp(r) / sqrt(count(r))), 6) AS lo,
  round(exp(avg(r) + 1.96 * stddev_samp(r) / sqrt(count(r))), 6) AS hi, count(r) AS compared FROM r GROUP BY 1"""


def compose_over_time_year(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.compose(orders(spark, d), "day", "o_orderpriority", "year"), 9, "share")


def compose_over_time_month(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.compose(ledger(spark, d), "day", "c_mktsegment", "month"), 9, "share")


def _compose_sql(source: str, key: str, grain: str) -> str:
    return f"""
WITH c AS (SELECT date_trunc('{grain}', o_orderdate)::DATE AS period, {key} AS value, count(*) AS c FROM {source} GROUP BY 1, 2),
s AS (SELECT unnest(generate_series((SELECT min(period) FROM c)::TIMESTAMP, (SELECT max(period) FROM c)::TIMESTAMP, INTERVAL 1 {grain}))::DATE AS period),
t AS (SELECT period, sum(c) AS total FROM c GROUP BY 1),
g AS (SELECT s.period, v.value, total, c.c FROM s CROSS JOIN (SELECT DISTINCT value FROM c) v LEFT JOIN t ON t.period = s.period LEFT JOIN c ON c.period = s.period AND c.value = v.value)
SELECT period, value, CASE WHEN total IS NOT NULL THEN coalesce(c, 0) END AS n, round(CASE WHEN total IS NOT NULL THEN coalesce(c, 0) END / total, 9) AS share FROM g"""


def period_counts_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.year("ts").alias("y"), F.month("ts").alias("m"), F.dayofmonth("ts").alias("dd"), "value", "event_type")
    return e.rollup("y", "m", "dd").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


PERIOD_COUNTS_ROLLUP = "SELECT year(ts)::INT AS y, month(ts)::INT AS m, day(ts)::INT AS dd, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ROLLUP (y, m, dd)"


def wilson_share(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rounded(stats.wilson_by(rows, "lang", F.col("quality") == 1), 9, "share", "lo", "hi")


WILSON_SHARE = """
WITH c AS (SELECT coalesce(nullif(trim(lang), ''), 'Not recorded') AS value, count(*) FILTER (quality = 1) AS k, count(*)::DOUBLE AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT value, k, n::BIGINT AS n, round(k / n, 9) AS share,
  round((k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 9) AS lo,
  round((k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 9) AS hi FROM c"""


def profile_matrix(spark: SparkSession, d: str) -> DataFrame:
    any_ = F.lit(True)
    measures = {
        "urgent": (F.col("o_orderpriority") == "1-URGENT", any_),
        "closed": (F.col("o_orderstatus") == "F", any_),
        "dear_if_closed": (F.col("o_totalprice") > 200000, F.col("o_orderstatus") == "F"),
    }
    return rounded(stats.profile(ledger(spark, d), "c_mktsegment", measures), 9, *measures)


PROFILE_MATRIX = f"""
SELECT c_mktsegment AS value, count(*) AS n, round(count(*) FILTER (o_orderpriority = '1-URGENT') / count(*), 9) AS urgent,
  round(count(*) FILTER (o_orderstatus = 'F') / count(*), 9) AS closed,
  CASE WHEN count(*) FILTER (o_orderstatus = 'F') >= 10 THEN round(count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 200000) / count(*) FILTER (o_orderstatus = 'F'), 9) END AS dear_if_closed
FROM {_JOIN} GROUP BY 1"""


def adjacency_vs_chance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.adjacency(events(spark, d), ["user_id", "day"], ["ts", "event_id"], "event_type"), 9, "same_share", "by_chance")


ADJACENCY_VS_CHANCE = """
WITH p AS (SELECT event_type AS v, lag(event_type) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS b FROM events),
c AS (SELECT count(*)::DOUBLE AS c FROM events GROUP BY event_type)
SELECT count(b) AS pairs, count(*) FILTER (v = b) AS same, round(count(*) FILTER (v = b) / count(b), 9) AS same_share, round((SELECT sum(c * c) / (sum(c) * sum(c)) FROM c), 9) AS by_chance FROM p"""


def pivot_heat(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).groupBy(F.trunc("day", "month").alias("month")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


PIVOT_HEAT = """SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1"""


def paging_sort_blanks_last(spark: SparkSession, d: str) -> DataFrame:
    """Page 3 of 50 rows, by a column of numbers, words and blanks: numbers by value, then words, blanks last, then the ledger's order."""
    key = F.when(F.col("p_partkey") % 11 == 0, "").when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))
    rows = table(spark, d, "part").select("p_partkey", key.alias("key"))
    order = [F.col("key") == "", F.expr("try_cast(key AS DOUBLE)").asc_nulls_last(), F.col("key"), F.col("p_partkey")]
    page = rows.orderBy(*order).offset(100).limit(50)
    return page.withColumn("place", F.row_number().over(W.orderBy(*order)) + 100)  # one page


PAGING_SORT_BLANKS_LAST = """
WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_size::VARCHAR END AS key FROM part),
o AS (SELECT *, row_number() OVER (ORDER BY key = '', try_cast(key AS DOUBLE) NULLS LAST, key, p_partkey)::INT AS place FROM r)
SELECT * FROM o WHERE place BETWEEN 101 AND 150"""


def coverage_by_column(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return rounded(stats.coverage(rows, ["lang", "quality", "toxic"], "source"), 9, "share")


COVERAGE_BY_COLUMN = """
WITH j AS (SELECT coalesce(nullif(trim(source), ''), 'Not recorded') AS value, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
a AS (SELECT value, count(*) AS n, count(*) FILTER (trim(lang) <> '') AS lang, count(quality) AS quality, count(toxic) AS toxic FROM j GROUP BY 1),
u AS (SELECT value, 'lang' AS "column", lang AS filled, n FROM a UNION ALL SELECT value, 'quality', quality, n FROM a UNION ALL SELECT value, 'toxic', toxic, n FROM a)
SELECT value, "column", filled, n, round(filled / n, 9) AS share FROM u"""


def most_frequent_lookup(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").withColumn("seq", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return stats.most_frequent(items, "l_partkey", "l_returnflag", "seq")


MOST_FREQUENT_LOOKUP = """
WITH c AS (SELECT l_partkey, l_returnflag, count(*) AS n, min(l_orderkey * 100 + l_linenumber) AS seen FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, seen, l_returnflag) AS k FROM c)
SELECT l_partkey, l_returnflag, n FROM r WHERE k = 1"""


def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.link import best_per

    items = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return best_per(items, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 5)


TOPK_PER_GROUP = """
WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INT AS rank FROM lineitem)
SELECT * FROM r WHERE rank <= 5"""


def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """A report of 100 documents, the same for the same seed."""
    return table(spark, d, "documents").select("doc_id", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|42"))).alias("draw")).orderBy("draw", "doc_id").limit(100)


SEEDED_SAMPLE = "SELECT doc_id, md5(doc_id::VARCHAR || '|42') AS draw FROM documents ORDER BY draw, doc_id LIMIT 100"


def string_agg_top(spark: SparkSession, d: str) -> DataFrame:
    """k n; k n: the three commonest types of each day as one text."""
    c = events(spark, d).groupBy("day", "event_type").agg(F.count("*").alias("n"))
    items = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "event_type", "n")))
    out = c.groupBy("day").agg(F.slice(items, 1, 3).alias("i"))
    return out.select("day", F.array_join(F.transform("i", lambda x: F.concat(x["event_type"], F.lit(" "), x["n"].cast("string"))), "; ").alias("top"))


STRING_AGG_TOP = """
WITH c AS (SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, event_type) AS k FROM c)
SELECT day, string_agg(event_type || ' ' || n::VARCHAR, '; ' ORDER BY k) AS top FROM r WHERE k <= 3 GROUP BY 1"""


def rank_over_whole(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a selection on axes ranked over the whole table."""
    part = table(spark, d, "part")
    axes = part.groupBy(facet_value(F.col("p_type")).alias("value")).agg(F.count("*").alias("base_n")).orderBy(F.desc("base_n"), "value").limit(12)
    axes = axes.withColumn("place", F.row_number().over(W.orderBy(F.desc("base_n"), "value")))
    counts = part.where("p_size > 25").groupBy(facet_value(F.col("p_type")).alias("value")).agg(F.count("*").alias("n"))
    return axes.join(counts, "value", "left").select("place", "value", F.coalesce("n", F.lit(0)).alias("n"))


RANK_OVER_WHOLE = """
WITH a AS (SELECT p_type AS value, row_number() OVER (ORDER BY count(*) DESC, p_type)::INT AS place FROM part GROUP BY 1),
c AS (SELECT p_type AS value, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 1)
SELECT place, value, coalesce(n, 0) AS n FROM a LEFT JOIN c USING (value) WHERE place <= 12"""

QUERIES = {
    f.__name__: f
    for f in (
        facet_counts, facet_options, facet_topn_others, filter_search_any, range_filter_nulls, range_bounds, distribution_share_lift, representation_lift_byar, crosstab_expected,
        stay_compare_crude, stay_compare_chapter, stay_compare_chapter_year, compose_over_time_year, compose_over_time_month, period_counts_rollup, wilson_share, profile_matrix,
        adjacency_vs_chance, pivot_heat, paging_sort_blanks_last, coverage_by_column, most_frequent_lookup, topk_per_group, seeded_sample, string_agg_top, rank_over_whole,
    )
}
SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()} | {
    "stay_compare_crude": _stay_sql(""),
    "stay_compare_chapter": _stay_sql("chapter"),
    "stay_compare_chapter_year": _stay_sql("chapter, yr"),
    "compose_over_time_year": _compose_sql("orders", "o_orderpriority", "year"),
    "compose_over_time_month": _compose_sql(_JOIN, "c_mktsegment", "month"),
}
