"""Queries on what texts hold, and on what decisions do to records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decided, harvest
from .base import ledger, orders, table

_PLAIN = "trim(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g'))"


def page_registry(spark: SparkSession, d: str) -> DataFrame:
    """Each address that pages link to, in how many blocks and pages, with the longest text beside it."""
    return harvest.registry(table(spark, d, "pages"), "page_id", "html", 'href="([^"]*)"')


PAGE_REGISTRY = f"""
WITH b AS (SELECT page_id, unnest(string_split_regex(html, '(?i)</(?:p|li|div|h[1-6]|td)>|<br\\s*/?>')) AS block FROM pages),
f AS (SELECT page_id, {_PLAIN.format("block")} AS note, unnest(list_distinct(regexp_extract_all(block, 'href="([^"]*)"', 1))) AS id FROM b)
SELECT id, count(*) AS mentions, count(DISTINCT page_id) AS sources, arg_max(note, (length(note), encode(note))) AS note FROM f GROUP BY 1"""

_URL = r"^https?://([^/]+)/([a-z]{2})/([0-9]+)"


def page_ids(spark: SparkSession, d: str) -> DataFrame:
    """Host, language and number that a page's address is made of."""
    parts = harvest.id_parts(F.col("url"), _URL, {"host": "string", "lang": "string", "number": "bigint"})
    return table(spark, d, "pages").select("page_id", parts.alias("p")).select("page_id", "p.*")


PAGE_IDS = f"SELECT page_id, nullif(regexp_extract(url, '{_URL}', 1), '') AS host, nullif(regexp_extract(url, '{_URL}', 2), '') AS lang, try_cast(nullif(regexp_extract(url, '{_URL}', 3), '') AS BIGINT) AS number FROM pages"

_KINDS = {"motion": "[a-z]*tion", "state": "[a-zèéê]*ment", "deed": "[a-z]*ing|[a-z]*ung", "place": "[a-z]*ció"}


def event_types(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of words that each document tells of, in order, with the numbers nearest to them."""
    return harvest.event_types(table(spark, d, "documents"), "doc_id", "text", _KINDS)


EVENT_TYPES = f"""
WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS w, generate_subscripts(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), 1) - 1 AS pos FROM documents),
h AS (SELECT doc_id, pos, CASE {" ".join(f"WHEN regexp_full_match(w, '{p}') THEN '{n}'" for n, p in _KINDS.items())} END AS kind, CASE WHEN regexp_full_match(w, '[0-9]+') THEN try_cast(w AS BIGINT) END AS n FROM w),
k AS (SELECT * FROM h WHERE kind IS NOT NULL OR n IS NOT NULL),
s AS (SELECT *, last_value(CASE WHEN kind IS NOT NULL THEN pos END IGNORE NULLS) OVER p AS b_at, last_value(kind IGNORE NULLS) OVER p AS b, first_value(CASE WHEN kind IS NOT NULL THEN pos END IGNORE NULLS) OVER q AS a_at, first_value(kind IGNORE NULLS) OVER q AS a
  FROM k WINDOW p AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
e AS (SELECT doc_id, pos, kind IS NOT NULL AS told, coalesce(kind, CASE WHEN b IS NOT NULL AND (a IS NULL OR pos - b_at <= a_at - pos) THEN b ELSE a END) AS kind, CASE WHEN kind IS NULL THEN n END AS n FROM s),
g AS (SELECT doc_id, kind, min(pos) FILTER (told) AS first, count(*) FILTER (told) AS mentions, sum(n)::BIGINT AS numbers FROM e WHERE kind IS NOT NULL GROUP BY 1, 2),
r AS (SELECT doc_id, list(kind ORDER BY first) AS types, list(mentions ORDER BY first) AS mentions, list(numbers ORDER BY first) AS numbers FROM g GROUP BY 1)
SELECT documents.doc_id, coalesce(types, []) AS types, coalesce(mentions, []) AS mentions, coalesce(numbers, []) AS numbers FROM documents LEFT JOIN r USING (doc_id)"""


def page_links(spark: SparkSession, d: str) -> DataFrame:
    """The links of each page as records: where they lead, what they say, how they are marked."""
    return harvest.block_records(table(spark, d, "pages"), "page_id", "html", "(?is)<a [^>]*>.*?</a>", {"address": 'href="([^"]*)"', "said": "(?is)>(.*)</a>", "mark": 'class="([^"]*)"'})


PAGE_LINKS = f"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)<a [^>]*>.*?</a>') AS a FROM pages), b AS (SELECT page_id, unnest(a) AS block, generate_subscripts(a, 1) - 1 AS place FROM l)
SELECT page_id, place, {", ".join(f"CASE WHEN regexp_matches(block, '{p}') THEN " + _PLAIN.format(f"regexp_extract(block, '{p}', 1)") + f" END AS {n}" for n, p in {"address": 'href="([^"]*)"', "said": "(?is)>(.*)</a>", "mark": 'class="([^"]*)"'}.items())} FROM b"""


def tag_inventory(spark: SparkSession, d: str) -> DataFrame:
    return harvest.tag_inventory(table(spark, d, "pages"), "html")


TAG_INVENTORY = r"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:[A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*)[\s/>]', 1)) AS tag FROM pages)
SELECT tag, count(DISTINCT page_id) AS "rows", count(*) AS uses FROM t GROUP BY 1"""



def settled_dates(spark: SparkSession, d: str) -> DataFrame:
    """Two dates of a line item after a second reading of the first: the second follows, both are kept, or the reading holds."""
    rows = table(spark, d, "lineitem").join(orders(spark, d), F.col("l_orderkey") == F.col("o_orderkey"))
    sort, end = F.substring("o_orderpriority", 1, 1), F.col("l_shipdate").cast("date")
    again = F.when(sort == "1", F.add_months("day", 12)).when(sort == "2", F.date_add("day", 90)).otherwise(F.col("day"))
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("day").alias("was"), end.alias("end"), again.alias("again"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", decided.settled_dates(F.col("was"), F.col("end"), F.col("again"), F.col("end")).alias("s")).select("l_orderkey", "l_linenumber", "l_partkey", "s.*")


SETTLED_DATES = """
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate::DATE AS was, l_shipdate::DATE AS e,
  CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN (o_orderdate + INTERVAL 1 YEAR)::DATE WHEN '2' THEN o_orderdate::DATE + 90 ELSE o_orderdate::DATE END AS again FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT *, (e + to_years((year(again) - year(was))::INT))::DATE AS moved FROM r),
k AS (SELECT *, CASE WHEN again = was THEN 'same' WHEN month(again) = month(was) AND day(again) = day(was) AND year(again) <> year(was) AND e < again AND moved >= again AND moved - again < 366 THEN 'follows'
  WHEN e < again AND e >= was THEN 'kept' ELSE 'read' END AS rule FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, CASE rule WHEN 'kept' THEN was ELSE again END AS start, CASE rule WHEN 'follows' THEN moved ELSE e END AS "end", rule FROM k"""


def record_exceptions(spark: SparkSession, d: str) -> DataFrame:
    """Customers with the cells that suppliers of the same number give them by hand."""
    s = table(spark, d, "supplier")
    by_hand = s.select(F.col("s_suppkey").alias("c_custkey"), F.lit("c_mktsegment").alias("column"), F.when(F.col("s_acctbal") > 0, F.concat(F.lit("AS "), "s_name")).alias("value"))
    by_hand = by_hand.unionAll(s.where("s_nationkey < 5").select("s_suppkey", F.lit("c_nationkey"), F.col("s_nationkey").cast("string")))
    return decided.with_exceptions(table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), by_hand, "c_custkey", ["c_mktsegment", "c_nationkey"])


RECORD_EXCEPTIONS = """
SELECT c_custkey, CASE WHEN s_suppkey IS NULL THEN c_mktsegment WHEN s_acctbal > 0 THEN 'AS ' || s_name END AS c_mktsegment, CASE WHEN s_nationkey < 5 THEN s_nationkey ELSE c_nationkey END AS c_nationkey
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey"""


def change_dates(spark: SparkSession, d: str) -> DataFrame:
    """When each customer's priority first and last changed."""
    return decided.change_dates(orders(spark, d), ["o_custkey"], "day", "o_orderpriority")


CHANGE_DATES = """
WITH o AS (SELECT o_custkey, o_orderdate::DATE AS d, o_orderpriority AS p, lag(o_orderpriority) OVER w AS q, row_number() OVER w AS k FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderpriority))
SELECT o_custkey, min(d) AS first, max(d) AS last, count(*) AS changes FROM o WHERE k > 1 AND p IS DISTINCT FROM q GROUP BY 1"""


def trimmed_axis(spark: SparkSession, d: str) -> DataFrame:
    """Orders of each nation by month, from the first month with so many to the last."""
    counts = ledger(spark, d).groupBy("c_nationkey", F.trunc("day", "month").alias("month")).agg(F.count("*").alias("n"))
    return decided.trimmed(counts, ["c_nationkey"], "month", "n", 8)


TRIMMED_AXIS = """
WITH c AS (SELECT c_nationkey, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), e AS (SELECT c_nationkey, min(month) AS a, max(month) AS z FROM c WHERE n >= 8 GROUP BY 1)
SELECT c_nationkey, month, n FROM c JOIN e USING (c_nationkey) WHERE month BETWEEN a AND z"""


def verdict_tally(spark: SparkSession, d: str) -> DataFrame:
    return decided.verdict_tally(ledger(spark, d), F.col("o_orderpriority"), ["3-MEDIUM", "1-URGENT"], ["c_mktsegment"])


VERDICT_TALLY = """
WITH n AS (SELECT c_mktsegment, o_orderpriority AS verdict, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT *, CASE verdict WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 2 + dense_rank() OVER (PARTITION BY c_mktsegment, verdict IN ('3-MEDIUM', '1-URGENT') ORDER BY verdict) END AS place FROM n"""


def lanes(spark: SparkSession, d: str) -> DataFrame:
    """From each nation of customers to some nations of suppliers."""
    items = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(ledger(spark, d), F.col("l_orderkey") == F.col("o_orderkey"))
    return decided.lanes(items.withColumn("to", F.concat(F.lit("to_"), "s_nationkey")), "c_nationkey", "to", ["to_0", "to_1", "to_2"])


LANES = """
SELECT c_nationkey, count(*) FILTER (s_nationkey = 0) AS to_0, count(*) FILTER (s_nationkey = 1) AS to_1, count(*) FILTER (s_nationkey = 2) AS to_2, count(*) FILTER (s_nationkey > 2) AS others, count(*) AS total
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1"""


def question_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Open questions, each with the part names that the suppliers of an order's items ask about, and their line items."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.col("s_suppkey") * 3 + k * k)
    return decided.bundles(table(spark, d, "supplier").select("s_suppkey", parts.alias("parts")), table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("part")), "s_suppkey", "parts", "part")


QUESTION_BUNDLES = """
WITH q AS (SELECT s_suppkey, unnest(list_distinct(list_transform(range(0, 5), lambda k: s_suppkey * 3 + k * k))) AS part FROM supplier), n AS (SELECT l_partkey AS part, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT s_suppkey, count(*) AS "values", count(n) AS known, coalesce(sum(n), 0)::BIGINT AS records FROM q LEFT JOIN n USING (part) GROUP BY 1"""


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Which queue each customer is in: those with urgent orders, then those with open ones, then those with any."""
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return decided.review_queue(table(spark, d, "customer").select("c_custkey"), "c_custkey", ("urgent", o.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")), ("open", o.where("o_orderstatus = 'O'")), ("seen", o))


REVIEW_QUEUE = """
SELECT c_custkey, CASE WHEN bool_or(o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') THEN 'urgent' WHEN bool_or(o_orderstatus = 'O') THEN 'open' WHEN count(o_orderkey) > 0 THEN 'seen' ELSE 'unreviewed' END AS queue
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"""

_ADDRESS = "concat(CASE WHEN o_totalprice < 200000 THEN c_mktsegment ELSE 'Main' END, CASE o_orderstatus WHEN 'F' THEN ' Street, ' WHEN 'O' THEN ' road near ' ELSE ' square, ' END, CASE WHEN o_totalprice < 100000 THEN lower(c_mktsegment) ELSE 'HOUSEHOLD' END)"


def namesakes(spark: SparkSession, d: str) -> DataFrame:
    """Cities that an address has as a street's name only are none."""
    rows = ledger(spark, d).select("o_orderkey", F.expr(_ADDRESS).alias("address"), "c_mktsegment")
    return rows.select("o_orderkey", "address", decided.namesake(F.col("address"), F.col("c_mktsegment")).alias("city"))


NAMESAKES = f"""
WITH a AS (SELECT o_orderkey, {_ADDRESS} AS address, c_mktsegment AS city FROM orders JOIN customer ON o_custkey = c_custkey), s AS (SELECT *, lower(address) AS l, lower(city) AS c FROM a)
SELECT o_orderkey, address, CASE WHEN (contains(l, c || ' street') OR contains(l, c || ' road')) AND NOT contains(replace(replace(l, c || ' street', ''), c || ' road', ''), c) THEN NULL ELSE city END AS city FROM s"""


def report_windows(spark: SparkSession, d: str) -> DataFrame:
    """The days that each order's report means, by what it says of when."""
    lo, hi = harvest.adverb_interval(F.col("o_orderpriority"), F.col("day"), [("(?i)urgent", 0, 0), ("(?i)h", 2, 1), ("^3", 7, 3)], (30, 0))
    return orders(spark, d).select("o_orderkey", lo.alias("lo"), hi.alias("hi"))


REPORT_WINDOWS = """
WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderpriority AS p FROM orders)
SELECT o_orderkey, d - CASE WHEN p ILIKE '%urgent%' THEN 0 WHEN p ILIKE '%h%' THEN 2 WHEN p LIKE '3%' THEN 7 ELSE 30 END - 1 AS lo, d - CASE WHEN p ILIKE '%urgent%' THEN 0 WHEN p ILIKE '%h%' THEN 1 WHEN p LIKE '3%' THEN 3 ELSE 0 END + 1 AS hi FROM o"""


def month_windows(spark: SparkSession, d: str) -> DataFrame:
    """Orders of some years, months and days."""
    return orders(spark, d).where(harvest.in_months(F.col("day"), ["1995", "1996-0", "1997-03-1"])).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


MONTH_WINDOWS = "SELECT o_orderstatus, count(*) AS n, min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last FROM orders WHERE year(o_orderdate) = 1995 OR year(o_orderdate) = 1996 AND month(o_orderdate) < 10 OR o_orderdate::DATE BETWEEN DATE '1997-03-10' AND DATE '1997-03-19' GROUP BY 1"

QUERIES = {
    f.__name__: f
    for f in (
        page_registry, page_ids, event_types, page_links, tag_inventory, settled_dates, record_exceptions, change_dates, trimmed_axis, verdict_tally, lanes, question_bundles, review_queue, namesakes,
        report_windows, month_windows,
    )
}
SQL = {name: globals()[name.upper()] for name in QUERIES}
