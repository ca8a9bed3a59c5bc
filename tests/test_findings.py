"""What a review found on odd and larger tables: small cases of it, against SQL twins and plain Python."""

import datetime as dt
import random
from collections import Counter

import duckdb
from helpers import duck, same
from pyspark.sql import Window
from pyspark.sql import functions as F

from rollbook.llm import buckets
from rollbook.operators import link, names, plane, series
from rollbook.plans import catalogue

CUSTOMER = "c_custkey BIGINT, c_name VARCHAR, c_nationkey INTEGER, c_acctbal DOUBLE, c_mktsegment VARCHAR"
SUPPLIER = "s_suppkey BIGINT, s_name VARCHAR, s_nationkey INTEGER, s_acctbal DOUBLE"


def written(folder, **tables):
    """A folder with tables (schema, rows) as single files."""
    con = duckdb.connect()
    for name, (schema, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({schema})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet'")
    return str(folder)


def test_ages_of_signed_zeros_and_exponents(spark, tmp_path):
    rows = [(1, "n", 0, -0.0, "MACHINERY"), (2, "n", 0, 0.0004, "BUILDING"), (3, "n", 0, -0.0, None), (4, "n", 0, 1.5e7, "MACHINERY"), (5, "n", 0, -1.0, "BUILDING"), (6, "n", 0, None, "BUILDING")]
    d = written(tmp_path, customer=(CUSTOMER, rows))
    df = catalogue.QUERIES["ages"](spark, d)
    same(df, d, catalogue.SQL["ages"])
    names, want = duck(d, catalogue.SQL["ages"])
    years = lambda rows: {r[0]: str(r[1]) for r in rows}
    assert years(df.select(*names).collect()) == years(want)


def test_variants_that_are_articles(spark, tmp_path):
    of = lambda balances: [(k, "n", k % 2, b) for k, b in enumerate(balances)]
    d = written(tmp_path, customer=(CUSTOMER, [(*r, "BUILDING") for r in of([2.9, 3.2, 321.5, 321.6, None, 0.0, 3215.4])]), supplier=(SUPPLIER, of([2.9, 3.2, 321.5, 3.2])))
    same(catalogue.QUERIES["variants_decided"](spark, d), d, catalogue.SQL["variants_decided"])


def test_valid_months_make_no_row_per_day(spark):
    rng = random.Random(3)
    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(n)
    rows = [(rng.choice(["a", "b", None]), day(x), day(x + rng.choice([-3, 0, 1, 9, 40, 90]))) for x in (rng.randrange(700) for _ in range(40))] + [("c", day(5), day(3000)), ("c", None, day(9)), ("d", day(0), day(60)), ("d", day(69), day(200)), ("d", day(210), day(300))]
    df = spark.createDataFrame(rows, "k string, a date, z date")
    days = {(k, a + dt.timedelta(n)) for k, a, z in rows if a for n in range((z - a).days)}
    want, opened, last = Counter(), None, None
    for k, d in sorted(days, key=lambda x: (str(x[0]), x[1])):
        opened = d if last is None or last[0] != k or (d - last[1]).days >= 10 else opened
        want[k, d.replace(day=1)] += (d - opened).days >= 21
        last = (k, d)
    want = {x: n for x, n in want.items() if n >= 20}
    direct = series.census_valid_months(df, "a", "z", ["k"])
    by_day = series.valid_months(series.census(df, "a", "z", ["k"]), "day", ["k"])
    for got in (direct, by_day):
        assert {(r.k, r.month): r.valid_days for r in got.collect()} == want
    # The days are cut into months: the plan lays out sequences of months only.
    plan = direct._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence(" in plan and plan.count("explode(sequence(") == plan.count("INTERVAL '1' MONTH")


def test_nearest_places_sort_no_pairs(spark):
    # 400 points and 4,000 places within a few hundred metres: the ranked rows are the k best of each tile, not all pairs.
    rng = random.Random(5)
    at = lambda: (31 + rng.uniform(0, 0.002), 35 + rng.uniform(0, 0.002))
    refs, points = [(i, "x", *at()) for i in range(4000)], [(i, *at()) for i in range(400)]
    got = plane.nearest_places(spark.createDataFrame(points, "p long, lat double, lon double"), spark.createDataFrame(refs, "r long, l string, lat double, lon double"), "p", "r", "l", 5, 20.0)
    near = spark.createDataFrame(points, "p long, lat double, lon double").crossJoin(spark.createDataFrame(refs, "r long, l string, la double, lo double"))
    w = Window.partitionBy("p").orderBy(plane.haversine_km(F.col("lat"), F.col("lon"), F.col("la"), F.col("lo")), "r")
    want = near.withColumn("place", F.row_number().over(w)).where("place <= 5")
    assert sorted((r.p, r.place, r.r) for r in got.collect()) == sorted((r.p, r.place, r.r) for r in want.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array(flatten(" in plan and "slice(" in plan


def test_claims_keep_no_pairs(spark):
    pairs = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (3, 12), (4, 13)], "c long, r long")
    plain, distinct = link.claim(pairs, "c", "r"), link.claim(pairs, "c", "r", distinct=True)
    assert sorted(plain.collect()) == sorted(distinct.collect())
    assert "distinct" not in distinct._jdf.queryExecution().analyzed().toString()


def test_members_join_once_not_once_a_bucket(spark):
    # Families of 40 and 80 members with 30 buckets each: rows of buckets grow as the members do, and what joins a member joins one row.
    for n in (40, 80):
        hits = spark.createDataFrame([(b, rep, n) for rep in range(n) for b in range(30)] + [(100, 3, 2), (100, 500, 2)], "bucket long, rep long, n long")
        got = buckets.pivot_pairs(hits)
        assert sorted((r.bucket, r.met, r.a, r.b) for r in got.collect()) == sorted([(b, 30 * n + 2, 3, rep) for rep in range(n) if rep != 3 for b in range(30)] + [(100, 30 * n + 2, 3, 500)])
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
        assert {r.rep: (r.met, sorted(r.buckets)) for r in buckets.by_member(hits).collect()}[3] == (30 * n + 2, [*range(30), 100])


def test_finest_groups_readings_once(spark):
    up = {"R": None, "N": "R", "M": "R", "S": "N", "T": "N", "Q": None}
    rng = random.Random(6)
    said = [(c, rng.choice([*up, *up, "unknown", None])) for c in range(150) for _ in range(rng.randint(1, 4))] + [(None, "S"), (None, "N")]
    got = names.finest(spark.createDataFrame(said, "c int, node string"), spark.createDataFrame(list(up.items()), "node string, parent string"), "c")
    path = lambda n: [] if n is None else [*path(up[n]), n]
    want = {}
    for c, nodes in {c: {n for k, n in said if k == c and n} for c, _ in said}.items():
        if nodes:
            ways = [path(n) if n in up else [] for n in nodes]
            shared = [n for n in max(ways, key=len) if all(n in w for w in ways)]
            deepest = max(ways, key=len)
            want[c] = (len(nodes), deepest[-1] if deepest and all(w and w == deepest[: len(w)] for w in ways) else None, shared[-1] if shared else None)
    assert {r.c: (r.readings, r.finest, r.common) for r in got.collect()} == want
    # One grouping, by the cell: no row for each place above a reading.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1


def test_similar_pairs_come_once_without_a_shuffle_of_pairs(spark):
    # Repeated rows too: the grams of a repeated row are not taken for further grams of its key.
    rows = [(1, 0, "abcdef"), (1, 0, "abcdef"), (1, 0, "abcdef"), (2, 0, "abcabc"), (3, 1, "abcdef"), (4, 0, "xbcdef")]
    df = spark.createDataFrame(rows, "id long, district int, key string")
    got = names.similar_pairs(df, df, 0.6)
    want = sorted({(a, b) for a, d, x in rows for b, e, y in rows if d == e and 1 - sum(p != q for p, q in zip(x, y, strict=True)) / 6 >= 0.6})
    assert sorted((r.id, r.place) for r in got.collect()) == want
    assert not got._jdf.queryExecution().optimizedPlan().toString().startswith(("Aggregate", "Filter"))


def test_district_links_count_places_once(spark):
    cases = spark.createDataFrame([(1, 0, "abcdef"), (1, 0, "abcdeg"), (2, 0, "zzzzz"), (3, 0, None)], "c long, d int, name string")
    places = spark.createDataFrame([(7, 0, "abcdef"), (7, 0, "abcdeg"), (8, 0, "abcdxf")], "p long, d int, name string")
    got = names.link_in_district(cases, places, "c", "p", "d", "name")
    assert {r.c: (r.p, r.tier, r.candidates) for r in got.collect()} == {1: (7, "exact", 2), 2: (None, None, 0), 3: (None, None, 0)}
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_similar_names_of_any_length(spark, tmp_path):
    # Balances of one digit to six: names of one letter to six.
    balances = [0.0, 0.1, 0.2, 1.2, 1.3, 12.3, 12.4, 123.4, 123.5, 1234.5, -1234.6, 12345.6, None]
    d = written(tmp_path, customer=(CUSTOMER, [(k, "n", k % 2, b, "x") for k, b in enumerate(balances * 2)]), supplier=(SUPPLIER, [(k, "n", k % 2, b) for k, b in enumerate(balances[::-1] * 2)]))
    df = catalogue.QUERIES["similar_names"](spark, d)
    same(df, d, catalogue.SQL["similar_names"])
    assert {len(r.key) for r in df.collect()} == {1, 2, 3, 4, 5, 6}


def test_similar_pairs_below_a_half(spark):
    keys = [(k, k % 2, x) for k, x in enumerate(["abcde", "xbydz", "xbydz", "abcde", "a", "b", "ab", "ba", "aaaa", "abab", "zzzzzzzz", "zyzyzyzy", "qwerty", "azerty"])]
    left = spark.createDataFrame(keys, "id long, district int, key string")
    for least in (0.0, 0.2, 0.4, 0.49):
        all_ = left.join(left.select(F.col("id").alias("place"), "district", F.col("key").alias("other")), "district")
        want = sorted((r.id, r.place) for r in all_.where(names.alike(F.col("key"), F.col("other")) >= least).collect())
        assert sorted((r.id, r.place) for r in names.similar_pairs(left, left, least).collect()) == want


def test_similar_pairs_broadcast_no_grams(spark):
    # Small files, whose size says little of their grams: the join that makes the pairs sends neither side to all.
    df = spark.createDataFrame([(k, 0, x) for k, x in enumerate(["abcdef", "abcdeg", "xyzxyz"])], "id long, district int, key string")
    plan = names.similar_pairs(df, df, 0.6)._jdf.queryExecution().executedPlan().toString()
    pairs = next(x for x in plan.splitlines() if "levenshtein" in x)
    assert "SortMergeJoin" in pairs and pairs.index("bit_count") < pairs.index("levenshtein") < pairs.index("array_intersect")


def test_strangers_of_a_family_ask_their_buckets_only(spark):
    # A family of 100 and strangers that meet one of it each: pairs are those of the buckets, no member of the family is asked besides.
    family, strangers = range(100), range(200, 230)
    hits = [(0, r, 100) for r in family] + [(1000 + s, r, 2) for s in strangers for r in (s, s - 200)]
    hits = spark.createDataFrame(hits, "bucket long, rep long, n long")
    comps = spark.createDataFrame([(r, 0) for r in family] + [(s, s) for s in strangers], "node long, component long")
    asked = []

    def verify(pairs):
        asked.extend((r.a, r.b) for r in pairs.collect())
        return pairs.where("b % 2 = 0")

    links = buckets.unsettled_links(hits, comps, hits.select("rep").distinct(), verify, list, lambda row, others, near: 1 / 0, buckets.LARGE)
    assert sorted(asked) == [(s - 200, s) for s in strangers]
    assert sorted((r.a, r.b) for r in links.collect()) == [(s - 200, s) for s in strangers if s % 2 == 0]
