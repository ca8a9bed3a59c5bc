"""Queries over time: runs, gaps, census, surges, spikes, clusters, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series
from .base import events, ledger, orders, rounded, stays


def gaps_and_islands_days(spark: SparkSession, d: str) -> DataFrame:
    return series.islands(events(spark, d), ["user_id"], "day")


_ISLANDS = "WITH d AS (SELECT DISTINCT {k}, {e}::DATE AS d FROM {t}), r AS (SELECT *, d - row_number() OVER (PARTITION BY {k} ORDER BY d)::INT AS run FROM d)"
GAPS_AND_ISLANDS_DAYS = _ISLANDS.format(k="user_id", e="ts", t="events") + ' SELECT user_id, min(d) AS "first", max(d) AS "last", count(*) AS days FROM r GROUP BY user_id, run'


def absent_months(spark: SparkSession, d: str) -> DataFrame:
    thin = ledger(spark, d).where("c_mktsegment = 'BUILDING' AND o_totalprice > 480000 AND o_orderpriority = '1-URGENT'")
    return series.absent_periods(thin, "day")


ABSENT_MONTHS = """
WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 480000 AND o_orderpriority = '1-URGENT'),
s AS (SELECT unnest(generate_series((SELECT min(m) FROM m)::TIMESTAMP, (SELECT max(m) FROM m)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS m),
a AS (SELECT m, year(m) * 12 + month(m) - row_number() OVER (ORDER BY m) AS k FROM s WHERE m NOT IN (SELECT m FROM m))
SELECT min(m) AS "first", max(m) AS "last", count(*) AS periods FROM a GROUP BY k"""


def census_daily(spark: SparkSession, d: str) -> DataFrame:
    return series.census(stays(spark, d), "day", "shipped")


_STAYS = "SELECT o_orderdate::DATE AS a, l_shipdate::DATE AS z FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_SWEEP = f"""
WITH s AS ({_STAYS}), m AS (SELECT a AS day, 1 AS step FROM s WHERE z > a UNION ALL SELECT z, -1 FROM s WHERE z > a),
g AS (SELECT day, sum(step) AS step FROM m GROUP BY 1), l AS (SELECT day, sum(step) OVER (ORDER BY day) AS present, lead(day) OVER (ORDER BY day) AS nxt FROM g),
c AS (SELECT unnest(generate_series(day::TIMESTAMP, (coalesce(nxt, day + 1) - 1)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day, present::BIGINT AS present FROM l)"""
CENSUS_DAILY = _SWEEP + " SELECT day, present FROM c WHERE present > 0"


def census_valid_months(spark: SparkSession, d: str) -> DataFrame:
    """By supplier and return flag."""
    keys = ["l_suppkey", "l_returnflag"]
    return series.census_valid_months(stays(spark, d), "day", "shipped", keys)


CENSUS_VALID_MONTHS = """
WITH s AS (SELECT l_suppkey, l_returnflag, o_orderdate::DATE AS a, l_shipdate::DATE AS z FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
v AS (SELECT DISTINCT l_suppkey, l_returnflag, unnest(generate_series(a::TIMESTAMP, (z - 1)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM s WHERE z > a),
n AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY d) < 10 THEN 0 ELSE 1 END AS new FROM v),
r AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY d) AS run FROM n), k AS (SELECT *, d - min(d) OVER (PARTITION BY l_suppkey, l_returnflag, run) AS since FROM r)
SELECT l_suppkey, l_returnflag, date_trunc('month', d)::DATE AS month, count(*) AS valid_days FROM k WHERE since >= 21 GROUP BY 1, 2, 3 HAVING count(*) >= 20"""


def trailing_count_p90(spark: SparkSession, d: str) -> DataFrame:
    return series.alarm_levels(series.trailing_counts(events(spark, d), "day", "event_type"), "event_type")


_TRAIL = """
WITH o AS (SELECT DISTINCT ts::DATE AS day FROM events), k AS (SELECT DISTINCT event_type FROM events),
c AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2),
g AS (SELECT k.event_type, o.day, coalesce(n, 0) AS n FROM o CROSS JOIN k LEFT JOIN c ON c.day = o.day AND c.event_type = k.event_type),
t AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)::BIGINT AS "trailing" FROM g),
l AS (SELECT event_type, count(*) AS days, greatest(5, list_sort(list("trailing"))[floor(count(*) * 0.9)::INT + 1])::BIGINT AS threshold FROM t GROUP BY 1)"""
TRAILING_COUNT_P90 = _TRAIL + " SELECT event_type, days, threshold FROM l"


def surge_refractory(spark: SparkSession, d: str) -> DataFrame:
    return series.surges(series.trailing_counts(events(spark, d), "day", "event_type", 7), "event_type", refractory=14)


SURGE_REFRACTORY = (
    _TRAIL.replace("WITH o", "WITH RECURSIVE o").replace("29 DAY", "6 DAY")
    + """, a AS (SELECT t.event_type, day, "trailing", threshold FROM t JOIN l USING (event_type) WHERE "trailing" >= threshold),
f AS (SELECT event_type, min(day) AS day FROM a GROUP BY 1 UNION ALL
  SELECT f.event_type, (SELECT min(a.day) FROM a WHERE a.event_type = f.event_type AND a.day > f.day + 14) FROM f WHERE f.day IS NOT NULL)
SELECT a.* FROM a JOIN f ON a.event_type = f.event_type AND a.day = f.day"""
)


def spike_days(spark: SparkSession, d: str) -> DataFrame:
    daily = orders(spark, d).groupBy("day").agg(F.count("*").alias("n"))
    return rounded(series.spikes(daily, "day", "n", 3, ratio=1.5), 6, "baseline")


SPIKE_DAYS = """
WITH c AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1),
w AS (SELECT day, n, (sum(n) OVER b - n) / 28.0::DOUBLE AS baseline, count(*) OVER b AS around FROM c WINDOW b AS (ORDER BY day RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 14 DAY FOLLOWING))
SELECT day, n, round(baseline, 6) AS baseline FROM w WHERE around >= 7 AND n >= 3 AND n >= 1.5 * greatest(baseline, 0.5)"""


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return series.clusters(events(spark, d), ["user_id"], "day", window=3, base=10, least=4, p=0.05)


def window_cluster_poisson(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_clusters(spark, d), 6, "mu", "log10_p")


_CLUSTERS = """
WITH p AS (SELECT user_id, ts::DATE AS d, count(*) AS c FROM events GROUP BY 1, 2),
v AS (SELECT d, count(*) OVER (ORDER BY d RANGE BETWEEN INTERVAL 10 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS cb, count(*) OVER (ORDER BY d RANGE BETWEEN INTERVAL 3 DAY FOLLOWING AND INTERVAL 12 DAY FOLLOWING) AS ca FROM (SELECT DISTINCT d FROM p)),
w AS (SELECT user_id, d, sum(c) OVER (PARTITION BY user_id ORDER BY d RANGE BETWEEN CURRENT ROW AND INTERVAL 2 DAY FOLLOWING)::BIGINT AS n,
  sum(c) OVER (PARTITION BY user_id ORDER BY d RANGE BETWEEN INTERVAL 10 DAY PRECEDING AND INTERVAL 12 DAY FOLLOWING) AS around,
  max(d) OVER (PARTITION BY user_id ORDER BY d RANGE BETWEEN CURRENT ROW AND INTERVAL 2 DAY FOLLOWING) AS last FROM p),
m AS (SELECT w.*, greatest((around - n)::DOUBLE / greatest(cb + ca, 1) * 3, 3.0::DOUBLE / greatest(cb + ca, 1)) AS mu FROM w JOIN v USING (d) WHERE n >= 4),
t AS (SELECT *, (n * ln(mu) - mu - lgamma(n + 1) + ln(list_sum(list_transform(range(0, 400), lambda k: exp(k * ln(mu) - (lgamma(n + 1 + k) - lgamma(n + 1))))))) / ln(10) AS lp FROM m),
h AS (SELECT user_id, d AS "start", last AS "end", n, mu, lp FROM t WHERE lp < log10(0.05))"""
WINDOW_CLUSTER_POISSON = _CLUSTERS + ' SELECT user_id, "start", "end", n, round(mu, 6) AS mu, round(lp, 6) AS log10_p FROM h'


def merge_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return series.merge_overlaps(_clusters(spark, d), ["user_id"], "start", "end")


MERGE_OVERLAPS = (
    _CLUSTERS
    + """, r AS (SELECT *, CASE WHEN "start" <= max("end") OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM h),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT user_id, min("start") AS "start", max("end") AS "end", count(*) AS parts FROM g GROUP BY user_id, run"""
)


def rate_per_covered_month(spark: SparkSession, d: str) -> DataFrame:
    return rounded(series.per_covered_month(ledger(spark, d), "day", F.col("c_mktsegment")), 9, "rate")


RATE_PER_COVERED_MONTH = """SELECT c_mktsegment AS value, count(*) AS n, count(DISTINCT date_trunc('month', o_orderdate)) AS months, round(count(*)::DOUBLE / count(DISTINCT date_trunc('month', o_orderdate)), 9) AS rate
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"""


def day_step(spark: SparkSession, d: str) -> DataFrame:
    """Each day with rows and the days with rows before and after it."""
    from pyspark.sql import Window as W

    days = events(spark, d).groupBy("day").agg(F.count("*").alias("n"))
    w = W.orderBy("day")  # one row per day
    return days.select("day", "n", F.lag("day").over(w).alias("previous"), F.lead("day").over(w).alias("following"))


DAY_STEP = "WITH c AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n, lag(day) OVER (ORDER BY day) AS previous, lead(day) OVER (ORDER BY day) AS following FROM c"


def yearly_with_undated(spark: SparkSession, d: str) -> DataFrame:
    """Counts by customer segment and year over all years, and of the rows without a date (here every ninth)."""
    rows = ledger(spark, d).select("c_mktsegment", F.when(F.col("o_orderkey") % 9 != 0, F.year("day")).alias("y"))
    years = rows.agg(F.min("y").alias("a"), F.max("y").alias("z")).select(F.explode(F.sequence("a", "z")).alias("y"))
    undated = rows.groupBy("c_mktsegment").agg(F.count_if(F.col("y").isNull()).alias("undated"))
    counts = rows.groupBy("c_mktsegment", "y").agg(F.count("*").alias("n"))
    return undated.crossJoin(F.broadcast(years)).join(counts, ["c_mktsegment", "y"], "left").fillna({"n": 0})


YEARLY_WITH_UNDATED = """
WITH r AS (SELECT c_mktsegment, CASE WHEN o_orderkey % 9 <> 0 THEN year(o_orderdate)::INT END AS y FROM orders JOIN customer ON o_custkey = c_custkey),
s AS (SELECT unnest(generate_series((SELECT min(y) FROM r), (SELECT max(y) FROM r)))::INT AS y),
u AS (SELECT c_mktsegment, count(*) FILTER (y IS NULL) AS undated FROM r GROUP BY 1), c AS (SELECT c_mktsegment, y, count(*) AS n FROM r GROUP BY 1, 2)
SELECT u.c_mktsegment, s.y, undated, coalesce(n, 0) AS n FROM u CROSS JOIN s LEFT JOIN c ON c.c_mktsegment = u.c_mktsegment AND c.y = s.y"""


def stay_band_counts(spark: SparkSession, d: str) -> DataFrame:
    """Bed days, by five-day band of the stay."""
    from ..functions.dates import band

    n = F.datediff("shipped", "day")
    rows = stays(spark, d).where(n.between(0, 399)).select(band(n, 5).alias("band"), n.alias("days"))
    return rows.groupBy("band").agg(F.count("*").alias("n"), F.sum("days").alias("bed_days"))


STAY_BAND_COUNTS = """
WITH s AS (SELECT date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT (floor(d / 5) * 5)::BIGINT AS band, count(*) AS n, sum(d)::BIGINT AS bed_days FROM s WHERE d BETWEEN 0 AND 399 GROUP BY 1"""


def window_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Intervals that touch a window of days, and how many lie off it, by return flag."""
    a, z = F.lit("1995-03-01").cast("date"), F.lit("1995-03-31").cast("date")
    inside = (F.col("day") <= z) & (F.col("shipped") >= a)
    return stays(spark, d).groupBy("l_returnflag").agg(F.count_if(inside).alias("shown"), F.count_if(~inside).alias("off_window"))


WINDOW_OVERLAP = """
SELECT l_returnflag, count(*) FILTER (o_orderdate::DATE <= DATE '1995-03-31' AND l_shipdate::DATE >= DATE '1995-03-01') AS shown,
  count(*) FILTER (NOT (o_orderdate::DATE <= DATE '1995-03-31' AND l_shipdate::DATE >= DATE '1995-03-01')) AS off_window FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"""

QUERIES = {
    f.__name__: f
    for f in (
        gaps_and_islands_days, absent_months, census_daily, census_valid_months, trailing_count_p90, surge_refractory, spike_days, window_cluster_poisson, merge_overlaps,
        rate_per_covered_month, day_step, yearly_with_undated, stay_band_counts, window_overlap,
    )
}
SQL = {name: globals()[name.upper()] for name in QUERIES}
