"""Ordered rules as a table: the first rule that a text meets names what it is."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters of a word that the rules are looked up by.
STEM = 3
#: Rules up to which they travel with the rows, as one array; beyond, stems of texts are joined with those of rules.
IN_ROW = 2_000
RULE = "place int, label string, kind string, pattern string, stems array<string>, scope string, before string, unless string"
BETWEEN = r"[^\p{L}\p{N}]+"


def rule_table(spark: SparkSession, rules: Iterable[dict]) -> DataFrame:
    """A rule for each entry, in order. label and pattern are needed; the others may be absent.

    pattern: a regular expression that the text must hold; no word boundaries of other scripts are implied. stems: beginnings of words of
    which the text must hold one for the pattern to be tried at all (a rule without stems is tried on every text). scope: the rule is
    for rows of this scope only. before: what may not stand right before the match ("near the "). unless: what the text may not hold.
    """
    names = [x.split()[0] for x in RULE.split(", ")]
    rows = []
    for place, rule in enumerate(rules):
        if unknown := set(rule) - set(names):
            raise ValueError(f"a rule has no {sorted(unknown)}")
        rows.append((place, *(rule.get(n) for n in names[1:])))
    return spark.createDataFrame(rows, RULE)


def _stems(text: Column) -> Column:
    return F.array_distinct(F.transform(F.split(F.lower(text), BETWEEN), lambda w: F.substring(w, 1, STEM)))


def _short(stems: Column) -> Column:
    return F.transform(stems, lambda s: F.substring(F.lower(s), 1, STEM))


def meets(text: Column, scope: Column, rule) -> Column:
    """Whether a rule (a struct of columns) holds for a text: its first match counts, with what stands before it."""
    head = F.call_function("regexp_extract", text, F.concat(F.lit("(?s)^(.*?)(?:"), rule["pattern"], F.lit(")")), F.lit(1))
    guarded = rule["before"].isNotNull() & F.coalesce(F.rlike(head, F.concat(F.lit("(?:"), rule["before"], F.lit(")$"))), F.lit(False))
    refused = rule["unless"].isNotNull() & F.coalesce(F.rlike(text, rule["unless"]), F.lit(False))
    return F.coalesce((rule["scope"].isNull() | (rule["scope"] == scope)) & F.rlike(text, rule["pattern"]) & ~guarded & ~refused, F.lit(False))


def coded(rule: Column, current: Column) -> Column:
    """The code that a rule's label gives; the current one where the rule is of the kind held; empty where no rule holds."""
    return F.when(rule.isNull(), F.lit("")).when(rule["kind"] == "held", current).otherwise(rule["label"])


def first_range(number: Column, rules: Iterable[tuple[float | None, float | None, str]], default: str | None = None) -> Column:
    """The label of the first rule (least, most, label) whose range, ends included, holds the number; None leaves an end open."""
    out = F.when(number.isNull(), F.lit(default))
    for least, most, label in rules:
        out = out.when((number >= least if least is not None else F.lit(True)) & (number <= most if most is not None else F.lit(True)), F.lit(label))
    return out.otherwise(F.lit(default))


def first_rule(df: DataFrame, rules: DataFrame, text: str, scope: str | None = None, key: str | None = None, in_row: int = IN_ROW) -> DataFrame:
    """df with rule (place, label, kind) of the first rule that each row's text meets, null if none.

    Few rules go along with the rows: one array, in order, of which those whose stems the text has are tried until one holds. There is no
    shuffle, and no text is copied. More rules than in_row are joined by the stems, for which key must name a column that tells rows apart;
    the text then travels once, for rows that have a stem of some rule. Null texts meet no rule.
    """
    number = rules.count()
    where = F.col(scope) if scope else F.lit(None).cast("string")
    said = lambda r: F.struct(r["place"].alias("place"), r["label"].alias("label"), r["kind"].alias("kind"))
    if number <= in_row:
        held = rules.select(F.struct("place", "label", "kind", "pattern", "scope", "before", "unless", _short("stems").alias("short")).alias("r"))
        held = held.agg(F.sort_array(F.collect_list("r")).alias("_rules"))
        # The text's stems are made once, as the argument of a lambda, and not once for each rule.
        near = lambda met: F.filter("_rules", lambda r: r["short"].isNull() | F.arrays_overlap(r["short"], met))
        hits = F.transform(F.array(_stems(F.col(text))), lambda met: F.filter(near(met), lambda r: meets(F.col(text), where, r)))
        first = F.get(F.get(hits, F.lit(0)), F.lit(0))
        return df.crossJoin(F.broadcast(held)).withColumn("_hit", first).select(*df.columns, said(F.col("_hit")).alias("rule"), F.col("_hit").isNotNull().alias("_met")).withColumn("rule", F.when(F.col("_met"), F.col("rule"))).drop("_met")
    if key is None:
        raise ValueError(f"{number} rules need a key of the rows")
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), where.alias("_scope"))
    by_stem = rules.select("place", "scope", F.explode_outer(_short("stems")).alias("stem"))
    every = by_stem.where("stem IS NULL").select("place")
    asked = rows.select("_key", "_scope", F.explode(_stems(F.col("_text"))).alias("stem")).join(by_stem.where("stem IS NOT NULL"), "stem")
    asked = asked.where("scope IS NULL OR scope = _scope").select("_key", "place").distinct()
    always = rows.select("_key").join(F.broadcast(every.agg(F.collect_list("place").alias("places")))).select("_key", F.explode("places").alias("place"))
    tried = asked.unionAll(always).join(rules, "place").join(rows, "_key")
    rule = {c: F.col(c) for c in rules.columns}
    found = tried.where(meets(F.col("_text"), F.col("_scope"), rule)).groupBy("_key").agg(F.min_by(said(rule), "place").alias("rule"))
    return df.join(found, df[key] == found["_key"], "left").drop("_key")


def first_rule_sql(source: str, rules: Iterable[dict], text: str, scope: str | None = None) -> str:
    """The same for DuckDB, every rule tried on every text: SQL of (source's columns, place, label, kind). For comparisons."""
    told = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    values = ", ".join(f"({k}, {told(r['label'])}, {told(r.get('kind'))}, {told(r['pattern'])}, {told(r.get('scope'))}, {told(r.get('before'))}, {told(r.get('unless'))})" for k, r in enumerate(rules))
    where = f"s.{scope}" if scope else "NULL"
    return f"""
SELECT s.*, h.place, h.label, h.kind FROM (SELECT *, row_number() OVER () AS _row FROM {source}) s LEFT JOIN (
  SELECT _row, arg_min(place, place) AS place, arg_min(coalesce(label, ''), place) AS label, arg_min(coalesce(kind, ''), place) AS kind
  FROM (SELECT *, row_number() OVER () AS _row FROM {source}) s, (VALUES {values}) r(place, label, kind, pattern, scope, before, unless)
  WHERE regexp_matches(s.{text}, pattern) AND (r.scope IS NULL OR r.scope = {where}) AND NOT coalesce(regexp_matches(s.{text}, unless), false)
    AND NOT coalesce(regexp_matches(regexp_extract(s.{text}, '(?s)^(.*?)(?:' || pattern || ')', 1), '(?:' || before || ')$'), false)
  GROUP BY _row) h USING (_row)"""
