"""Cleaning rules over the tables' texts, and over cells that are put together from a row's values, on both sides by the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import curation, ruled
from .base import orders, table

# Words that the values of an order stand for in a cell.
_ILL = "CASE o_orderstatus WHEN 'F' THEN 'Typhus' WHEN 'O' THEN 'malaria' ELSE 'Observation for fever' END"
_SORT = "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'epidemic' WHEN '2' THEN 'of fleas' WHEN '3' THEN 'vivax' WHEN '4' THEN 'falciparum, vivax' ELSE 'quartan' END"
_END = "CASE WHEN o_totalprice < 100000 THEN ' ?' WHEN o_totalprice < 200000 THEN ', not found' ELSE '' END"
WRITTEN = f"concat({_ILL}, ' ', {_SORT}, {_END})"
CURRENT = "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN '084.9|079' WHEN '2' THEN '084.0' WHEN '3' THEN NULL ELSE '002.0' END"

# The codes. The rules are these queries' own.
TYPHUS = (
    {"label": "", "kind": "held", "pattern": r"(?i)typhus.*(\?|not found)", "stems": ["typhus"]},
    {"label": "080", "kind": "code", "pattern": r"(?i)typhus.*epidemic", "stems": ["typhus"]},
    {"label": "081.0", "kind": "code", "pattern": r"(?i)typhus.*(flea|rat)", "stems": ["typhus"]},
    {"label": "081.9", "kind": "code", "pattern": r"(?i)typhus", "stems": ["typhus"]},
)
MALARIA = (
    {"label": "084.5", "kind": "code", "pattern": r"(?i)vivax.*falciparum|falciparum.*vivax", "stems": ["falciparum"]},
    {"label": "084.1", "kind": "code", "pattern": r"(?i)vivax", "stems": ["vivax"]},
    {"label": "084.0", "kind": "code", "pattern": r"(?i)falciparum", "stems": ["falciparum"]},
    {"label": "084.2", "kind": "code", "pattern": r"(?i)quartan", "stems": ["quartan"]},
    {"label": "084.6", "kind": "code", "pattern": r"(?i)malaria", "stems": ["malaria"], "scope": "084.9"},
    {"label": "", "kind": "held", "pattern": r"(?i)malaria", "stems": ["malaria"]},
)
OBSERVATION = (
    {"label": "V71.89", "kind": "code", "pattern": r"(?i)^observation for .*, not found$", "stems": ["observation"]},
    {"label": "V71.9", "kind": "code", "pattern": r"(?i)^observation", "stems": ["observation"], "unless": r"\?"},
)
#: Marks of a document's text, the first one counts: with what may not stand before, and rules of one language only.
MARKS = (
    {"label": "letter", "kind": "person", "pattern": r"[A-Za-z0-9_]@[A-Za-z0-9.]+"},
    {"label": "licence", "kind": "rights", "pattern": r"(?i)licen[cs]e|copyright", "stems": ["license", "licence", "copyright", "licensed"], "before": r"(?i)(?:without|no) (?:a )?"},
    {"label": "address", "kind": "link", "pattern": r"https?://", "stems": ["http", "https"]},
    {"label": "station", "kind": "institution", "pattern": r"(?:^| )the [a-z]*tion", "stems": ["the"], "before": r"(?:^| )(?:in|on|of|by)", "unless": r"\|"},
    {"label": "quarter of the north", "kind": "quarter", "pattern": r"(?:^| )der [a-zäöü]*ung", "stems": ["der"], "scope": "de"},
    {"label": "quarter of the south", "kind": "quarter", "pattern": r"(?:^| )(?:le|la) [a-zéèê]*ment", "stems": ["le", "la"], "scope": "fr", "before": r"(?:^| )(?:de|dans)"},
    {"label": "school", "kind": "institution", "pattern": r"(?:^| )(?:con|para) [a-zñíó]+"},
)


def _cells(spark: SparkSession, d: str, **cells: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", *(F.expr(sql).alias(name) for name, sql in cells.items()))


def _coded(spark: SparkSession, d: str, said, scope: str | None = None, **cells: str) -> DataFrame:
    rows = ruled.first_rule(_cells(spark, d, **cells), ruled.rule_table(spark, said), "written", scope)
    current = F.col("current") if "current" in cells else F.lit(None).cast("string")
    return rows.withColumn("code", ruled.coded(F.col("rule"), current)).drop("rule")


def _coded_sql(said, cells: str, scope: str | None = None, current: str = "NULL") -> str:
    found = ruled.first_rule_sql("c", said, "written", scope)
    return f"WITH c AS (SELECT o_orderkey, {cells} FROM orders), f AS ({found}) SELECT * EXCLUDE (_row, place, label, kind), CASE WHEN kind IS NULL THEN '' WHEN kind = 'held' THEN {current} ELSE label END AS code FROM f"


def typhus_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes by ordered rules; an open question keeps the current code."""
    return _coded(spark, d, TYPHUS, written=WRITTEN, current=CURRENT)


TYPHUS_CODES = _coded_sql(TYPHUS, f"{WRITTEN} AS written, {CURRENT} AS current", current="current")


def malaria_codes(spark: SparkSession, d: str) -> DataFrame:
    """Species by ordered rules; one rule is for records of one current code only, the first of the cell's list."""
    rows = _cells(spark, d, written=WRITTEN, current=CURRENT).withColumn("first", rules.first_code(F.col("current")))
    rows = ruled.first_rule(rows, ruled.rule_table(spark, MALARIA), "written", "first")
    return rows.withColumn("code", ruled.coded(F.col("rule"), F.col("first"))).drop("rule")


MALARIA_CODES = _coded_sql(MALARIA, f"{WRITTEN} AS written, {CURRENT} AS current, trim(split_part(coalesce({CURRENT}, ''), '|', 1)) AS first", "first", "first")


def observation_codes(spark: SparkSession, d: str) -> DataFrame:
    return _coded(spark, d, OBSERVATION, written=WRITTEN)


OBSERVATION_CODES = _coded_sql(OBSERVATION, f"{WRITTEN} AS written")


def institutions(spark: SparkSession, d: str) -> DataFrame:
    """Institution, quarter or other mark of each document: ordered rules with guards, some for one language."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    found = ruled.first_rule(docs, ruled.rule_table(spark, MARKS), "text", "lang")
    return found.select("doc_id", "rule.place", "rule.label", "rule.kind")


INSTITUTIONS = f"WITH c AS (SELECT doc_id, lang, text FROM documents), f AS ({ruled.first_rule_sql('c', MARKS, 'text', 'lang')}) SELECT doc_id, place, label, kind FROM f"

_SIZES = ((None, 5, "small"), (1, 20, "usual"), (40, None, "large"), (15, 45, "wide"))


def numeric_groups(spark: SparkSession, d: str) -> DataFrame:
    """Sub-groups by ordered ranges that overlap: the first one holds."""
    return table(spark, d, "part").groupBy(ruled.first_range(F.col("p_size"), _SIZES, "other").alias("group")).agg(F.count("*").alias("n"), F.min("p_size").alias("least"), F.max("p_size").alias("most"))


NUMERIC_GROUPS = "SELECT CASE WHEN p_size <= 5 THEN 'small' WHEN p_size <= 20 AND p_size >= 1 THEN 'usual' WHEN p_size >= 40 THEN 'large' WHEN p_size BETWEEN 15 AND 45 THEN 'wide' ELSE 'other' END AS \"group\", count(*) AS n, min(p_size) AS least, max(p_size) AS most FROM part GROUP BY 1"

_PLACE = "concat(CASE o_orderstatus WHEN 'F' THEN '|| el-' WHEN 'O' THEN ' es ' ELSE '' END, substring(o_orderpriority, 3), CASE WHEN o_totalprice < 100000 THEN '?' WHEN o_totalprice < 200000 THEN '  port' ELSE '' END)"
_NAMES = {"urgent": "Pressing", "low port": "Low Harbour", "high": "Heights"}


def place_names(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d, city=_PLACE).withColumn("clean", rules.place_name(F.col("city"), _NAMES, r"^[| ]*(?:(?:el|es)[ -])?|[?]+$"))


PLACE_NAMES = f"""
WITH c AS (SELECT o_orderkey, {_PLACE} AS city FROM orders), n AS (SELECT *, regexp_replace(trim(regexp_replace(trim(city), '^[| ]*(?:(?:el|es)[ -])?|[?]+$', '', 'g')), '\\s{{2,}}', ' ', 'g') AS p FROM c)
SELECT o_orderkey, city, CASE lower(p) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items())} ELSE p END AS clean FROM n"""

_READ = "concat(substring(o_orderpriority, 3), CASE o_orderstatus WHEN 'F' THEN ' c/e' WHEN 'O' THEN '  K. o' ELSE ' \"r\"' END, CASE WHEN o_totalprice < 100000 THEN ' x.' ELSE '' END)"


def trailing_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d, read=_READ).withColumn("nation", rules.without_trailing(F.col("read"), "(?i)(?:[a-z]|c/e)[.]?"))


TRAILING_TOKENS = f"""
WITH c AS (SELECT o_orderkey, {_READ} AS read FROM orders), w AS (SELECT *, list_filter(string_split_regex(replace(read, '"', ' '), '\\s+'), lambda x: x <> '') AS l FROM c),
n AS (SELECT *, list_transform(l, lambda x: regexp_full_match(x, '(?i)(?:[a-z]|c/e)[.]?')) AS t FROM w)
SELECT o_orderkey, read, array_to_string(l[1 : greatest(1, len(l) - coalesce(list_position(list_reverse(t[2:]), false), len(l)) + 1)], ' ') AS nation FROM n"""

_FLAGS = "concat_ws(' | ', CASE WHEN o_orderstatus = 'F' THEN 'birth' END, CASE WHEN o_totalprice > 300000 THEN 'staff' END, CASE WHEN o_totalprice > 200000 THEN 'births' END)"


def flag_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Admissions: rows without these flags, as whole tokens; what is dropped is counted."""
    c = _cells(spark, d, flags=_FLAGS)
    admission = ~rules.has_flag(F.col("flags"), "birth") & ~rules.has_flag(F.col("flags"), "staff")
    return c.groupBy("flags").agg(F.count_if(admission).alias("kept"), F.count_if(~admission).alias("dropped"))


FLAG_TOKENS = f"""
WITH c AS (SELECT {_FLAGS} AS flags FROM orders), t AS (SELECT flags, list_transform(string_split(coalesce(flags, ''), '|'), lambda x: trim(x)) AS l FROM c)
SELECT flags, count(*) FILTER (NOT list_contains(l, 'birth') AND NOT list_contains(l, 'staff')) AS kept, count(*) FILTER (list_contains(l, 'birth') OR list_contains(l, 'staff')) AS dropped FROM t GROUP BY 1"""

_CELL = "CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_totalprice < 200000 THEN ' ' END ELSE concat(o_orderpriority, CASE WHEN o_totalprice < 100000 THEN '?' ELSE '' END) END"


def status_column(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d, cell=_CELL).groupBy(rules.status(F.col("cell")).alias("status")).agg(F.count("*").alias("n"))


STATUS_COLUMN = f"SELECT CASE WHEN trim(coalesce(c, '')) = '' THEN 'absent' WHEN contains(c, '?') THEN 'doubtful' ELSE 'recorded' END AS status, count(*) AS n FROM (SELECT {_CELL} AS c FROM orders) GROUP BY 1"


def folded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts in plain letters."""
    return table(spark, d, "documents").select("doc_id", rules.folded(F.col("text")).alias("plain"))


FOLDED_TEXTS = "SELECT doc_id, trim(regexp_replace(translate(lower(text), 'áàâäéèêëíìîïóòôöúùûüñç٠١٢٣٤٥٦٧٨٩', 'aaaaeeeeiiiioooouuuunc0123456789'), '[^a-z0-9]+', ' ', 'g')) AS plain FROM documents"


def _written(spark: SparkSession, d: str, formats: dict[str, str], name: str) -> DataFrame:
    """Orders with their day as its status writes it."""
    said = F.coalesce(*(F.when(F.col("o_orderstatus") == k, F.expr(sql)) for k, sql in formats.items()))
    return orders(spark, d).select("o_orderkey", "o_orderstatus", "o_orderpriority", "day", said.alias(name))


def written_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Years, months and days as written in two ways, and what is no date, as first and last day."""
    rows = orders(spark, d)
    sort = F.substring("o_orderpriority", 1, 1)
    said = F.when(sort == "1", F.date_format("day", "yyyy")).when(sort == "2", F.date_format("day", "yyyy-MM")).when(sort == "3", F.date_format("day", "yyyy-MM-dd"))
    said = said.when(sort == "4", F.date_format("day", "d.M.yyyy")).otherwise(F.concat(F.date_format("day", "yyyy"), F.lit("-13")))
    first, last = rules.written_range(F.col("said"))
    return rows.select("o_orderkey", said.alias("said")).withColumns({"first": first, "last": last})


WRITTEN_RANGES = """
WITH c AS (SELECT o_orderkey, o_orderdate::DATE AS day, substring(o_orderpriority, 1, 1) AS s FROM orders)
SELECT o_orderkey, CASE s WHEN '1' THEN strftime(day, '%Y') WHEN '2' THEN strftime(day, '%Y-%m') WHEN '3' THEN strftime(day, '%Y-%m-%d') WHEN '4' THEN strftime(day, '%-d.%-m.%Y') ELSE strftime(day, '%Y') || '-13' END AS said,
  CASE s WHEN '1' THEN date_trunc('year', day) WHEN '2' THEN date_trunc('month', day) WHEN '5' THEN NULL ELSE day END::DATE AS "first",
  CASE s WHEN '1' THEN (date_trunc('year', day) + INTERVAL 1 YEAR)::DATE - 1 WHEN '2' THEN last_day(day) WHEN '5' THEN NULL ELSE day END::DATE AS "last" FROM c"""


def month_names(spark: SparkSession, d: str) -> DataFrame:
    """Days with the month's name in three hands; the 31st of every month is not one."""
    rows = _written(spark, d, {"F": "date_format(day, 'd MMMM yyyy')", "O": "upper(date_format(day, 'd. MMMM yyyy'))", "P": "concat('31 ', date_format(day, 'MMMM yyyy'))"}, "said")
    return rows.select("o_orderkey", "said", rules.month_name_date(F.col("said")).alias("day"))


MONTH_NAMES = """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%-d %B %Y') WHEN 'O' THEN upper(strftime(o_orderdate, '%-d. %B %Y')) ELSE '31 ' || strftime(o_orderdate, '%B %Y') END AS said,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderdate::DATE WHEN day(last_day(o_orderdate)) = 31 THEN last_day(o_orderdate) END AS day FROM orders"""


def twin_dates(spark: SparkSession, d: str) -> DataFrame:
    """The day again from a written twin, a locked one first, the given one where the twin can't be read."""
    rows = _written(spark, d, {"F": "date_format(date_add(day, 1), 'dd.MM.yyyy')", "O": "date_format(day, 'dd/MM/yyyy')", "P": "'illegible'"}, "twin")
    locked = F.when(F.col("o_orderpriority") == "1-URGENT", F.date_sub("day", 7))
    return rows.withColumn("rebuilt", rules.twin_date(F.try_to_date("twin", "dd.MM.yyyy"), F.col("day"), locked)).select("o_orderkey", "twin", "rebuilt")


TWIN_DATES = """
WITH c AS (SELECT *, o_orderdate::DATE AS day, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate + INTERVAL 1 DAY, '%d.%m.%Y') WHEN 'O' THEN strftime(o_orderdate, '%d/%m/%Y') ELSE 'illegible' END AS twin FROM orders)
SELECT o_orderkey, twin, coalesce(CASE WHEN o_orderpriority = '1-URGENT' THEN day - 7 END, try_strptime(twin, '%d.%m.%Y')::DATE, day) AS rebuilt FROM c"""

_WARDS = ("URGENT", "HIGH", "MEDIUM")
_OWN = "CASE WHEN o_orderstatus = 'F' THEN substring(o_orderpriority, 3) WHEN o_orderstatus = 'O' THEN 'unknown' END"
_WRONG, _TWICE = "upper(substring(o_orderpriority, 3))", "CASE WHEN o_totalprice < 200000 THEN 'HIGH' WHEN o_totalprice < 300000 THEN 'Jaffa' END"


def misfiled_values(spark: SparkSession, d: str) -> DataFrame:
    rows = _cells(spark, d, own=_OWN, wrong=_WRONG, twice=_TWICE)
    return rows.withColumn("seated", rules.reseated(F.col("own"), F.col("wrong"), F.col("twice"), _WARDS))


MISFILED_VALUES = f"""
WITH c AS (SELECT o_orderkey, {_OWN} AS own, {_WRONG} AS wrong, {_TWICE} AS twice FROM orders), v AS (SELECT {list(_WARDS)} AS l)
SELECT o_orderkey, own, wrong, twice, CASE WHEN list_contains(l, own) THEN own WHEN list_contains(l, twice) THEN twice WHEN list_contains(l, wrong) THEN wrong END AS seated FROM c, v"""

_WARD = "CASE WHEN o_totalprice < 300000 THEN concat('pav. ', upper(substring(o_orderpriority, 3, 1))) ELSE lower(substring(o_orderpriority, 3)) END"


def gated_reading(spark: SparkSession, d: str) -> DataFrame:
    rows = orders(spark, d).select("o_orderkey", "day", F.expr(_WARD).alias("ward"), "o_orderstatus")
    return rows.select("o_orderkey", rules.gated(F.col("ward"), F.col("day"), "1995-01-01", "pav. ([HMUL])", F.col("o_orderstatus") == "F").alias("ward"))


GATED_READING = f"""
WITH c AS (SELECT *, {_WARD} AS w FROM orders)
SELECT o_orderkey, CASE WHEN o_orderdate::DATE >= DATE '1995-01-01' AND o_orderstatus = 'F' THEN coalesce(nullif(regexp_extract(w, 'pav. ([HMUL])', 1), ''), w) ELSE w END AS ward FROM c"""

_SUM = "CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_totalprice < 100000 THEN '-' WHEN o_totalprice < 200000 THEN '' WHEN o_totalprice < 300000 THEN 'ill.' END ELSE replace(substring(cast(o_orderdate AS string), 1, 7), '-', ',') END"


def stocks_flows(spark: SparkSession, d: str) -> DataFrame:
    return curation.stock_flow(table(spark, d, "orders").select("o_orderpriority", F.expr(_SUM).alias("cell")), "o_orderpriority", "cell")


STOCKS_FLOWS = f"""
WITH c AS (SELECT o_orderpriority, {_SUM} AS cell FROM orders)
SELECT o_orderpriority, sum(CASE WHEN cell = '-' THEN 0 ELSE try_cast(replace(cell, ',', '') AS BIGINT) END)::BIGINT AS total, count(try_cast(replace(cell, ',', '') AS BIGINT)) AS numbers,
  count(*) FILTER (cell = '-') AS dashes, count(*) FILTER (coalesce(cell, '') = '') AS blanks FROM c GROUP BY 1"""


_PARTS = "concat(upper(substring(o_orderpriority, 3)), CASE WHEN o_totalprice < 300000 THEN ' Street' ELSE '' END, ', ', CASE o_orderstatus WHEN 'F' THEN 'HIGH' WHEN 'O' THEN 'Jaffa' ELSE 'LOW road' END, CASE WHEN o_totalprice < 200000 THEN ' district Acre district Gaza' WHEN o_totalprice < 400000 THEN ' district Safad' ELSE '' END)"


def places_in_addresses(spark: SparkSession, d: str) -> DataFrame:
    """The single place of an address, the last district marked in it, and what the two say together."""
    rows = _cells(spark, d, address=_PARTS, place_of="CASE WHEN o_totalprice < 100000 THEN 'Gaza' ELSE 'Safad' END")
    said = {"place": curation.single_place(F.col("address"), ["HIGH", "URGENT", "Jaffa"]), "district": curation.last_marked(F.col("address"), "district (\\w+)")}
    return rows.withColumns(said).withColumn("verdict", curation.district_verdict(F.col("district"), F.col("place_of"), F.array(F.lit("Gaza"))))


PLACES_IN_ADDRESSES = f"""
WITH c AS (SELECT o_orderkey, {_PARTS} AS address, CASE WHEN o_totalprice < 100000 THEN 'Gaza' ELSE 'Safad' END AS place_of FROM orders),
s AS (SELECT *, list_distinct(list_filter(string_split_regex(address, '\\s*,\\s*'), lambda x: x IN ('HIGH', 'URGENT', 'Jaffa'))) AS p, regexp_extract_all(address, 'district (\\w+)', 1)[-1] AS district FROM c)
SELECT o_orderkey, address, place_of, CASE WHEN len(p) = 1 THEN p[1] END AS place, district,
  CASE WHEN district IS NULL THEN 'absent' WHEN district = place_of THEN 'ok' WHEN district = 'Gaza' THEN 'homonym' ELSE 'mismatch' END AS verdict FROM s"""

QUERIES = {
    f.__name__: f
    for f in (
        typhus_codes, malaria_codes, observation_codes, institutions, numeric_groups, place_names, trailing_tokens, flag_tokens, status_column, folded_texts, written_ranges, month_names, twin_dates,
        misfiled_values, gated_reading, stocks_flows, places_in_addresses,
    )
}
SQL = {name: globals()[name.upper()] for name in QUERIES}
