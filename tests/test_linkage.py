"""Rules as a table, names, places in the plane and profiles, against plain Python."""

import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rollbook.operators import names, plane, profiles, ruled
from rollbook.operators.names import Tier

RULES = [
    {"label": "school", "kind": "a", "pattern": r"(?i)school", "stems": ["school"], "before": r"(?:near|behind) (?:the )?"},
    {"label": "mill", "kind": "b", "pattern": r"mill", "scope": "x", "unless": r"\?"},
    {"label": "empty", "pattern": r"^$"},
    {"label": "later", "kind": "a", "pattern": r"school|mill", "stems": ["Mill", "schoolhouse"]},
]
TEXTS = [("the School", "x"), ("near the school", "x"), ("mill near school", "y"), ("a mill", "x"), ("a mill?", "x"), (None, "x"), ("", "y"), ("schools 😀 school", None), ("ab", None)]


def test_first_rule_in_row_and_joined(spark):
    table = ruled.rule_table(spark, RULES)
    df = spark.createDataFrame([(i, t, s, 1) for i, (t, s) in enumerate(TEXTS)], "id long, t string, s string, place int")
    want = {0: "school", 1: "later", 2: "later", 3: "mill", 4: "later", 5: None, 6: "empty", 7: "school", 8: None}
    for limit in (100, 0):
        got = ruled.first_rule(df, table, "t", "s", key="id", in_row=limit)
        assert {r.id: r.rule and r.rule.label for r in got.collect()} == want
        assert got.columns == [*df.columns, "rule"]
    with pytest.raises(ValueError, match="key"):
        ruled.first_rule(df, table, "t", in_row=0)
    with pytest.raises(ValueError, match="no"):
        ruled.rule_table(spark, [{"label": "x", "pattern": "x", "guard": "y"}])


def test_no_rules_and_coded(spark):
    df = spark.createDataFrame([(1, "school", "7"), (2, "else", "8"), (3, None, None)], "id long, t string, c string")
    none = spark.createDataFrame([], ruled.RULE)
    assert [r.rule for r in ruled.first_rule(df, none, "t").collect()] == [None] * 3
    held = ruled.rule_table(spark, [{"label": "", "kind": "held", "pattern": "scho"}])
    assert {r.id: r.code for r in ruled.first_rule(df, held, "t").select("id", ruled.coded(F.col("rule"), F.col("c")).alias("code")).collect()} == {1: "7", 2: "", 3: ""}


def test_first_range(spark):
    df = spark.createDataFrame([(x,) for x in (None, 0, 5, 6, 50)], "n int")
    got = [r[0] for r in df.select(ruled.first_range(F.col("n"), [(None, 5, "a"), (5, 10, "b"), (None, None, "c")], "none")).collect()]
    assert got == ["none", "a", "a", "b", "c"]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("least", [0.5, 0.6, 0.8, 0.9])
def test_similarity_join_loses_no_pair(spark, least):
    rng = random.Random(int(least * 10))
    word = lambda: "".join(rng.choice("aab c") for _ in range(rng.randint(1, 12))).replace(" ", "")
    cases = [(i, rng.randrange(3), word() or "a") for i in range(120)]
    places = [(i, rng.randrange(3), word() or "b") for i in range(90)] + [(500, 0, "a" * 30), (501, 0, "a" * 29)]
    schema = "id long, district int, key string"
    got = names.similar_pairs(spark.createDataFrame(cases, schema), spark.createDataFrame(places, schema), least, 2).collect()
    want = {(i, p) for i, d, a in cases for p, e, b in places if d == e and min(len(a), len(b)) >= 2 and 1 - levenshtein(a, b) / max(len(a), len(b)) >= least}
    assert sorted((r.id, r.place) for r in got) == sorted(want)


def test_links_in_a_district(spark):
    cases = spark.createDataFrame([(1, "A", "Rama"), (2, "A", "El Rameh"), (3, "B", "Rama"), (4, "A", "Sukhmata"), (5, None, "Rama"), (6, "A", None), (7, "A", "--"), (8, "A", "Milia"), (8, "A", "Milia")], "c long, d string, n string")
    places = spark.createDataFrame([(10, "A", "Rama"), (10, "A", "Ramah"), (11, "A", "Suhmata"), (12, "A", "Milia"), (13, "A", "milia"), (14, "C", "Rama")], "p long, d string, n string")
    got = {r.c: (r.p, r.tier, r.candidates) for r in names.link_in_district(cases, places, "c", "p", "d", "n").collect()}
    assert got == {1: (10, "exact", 1), 2: (10, "skeleton", 1), 3: (None, None, 0), 4: (11, "close", 1), 5: (None, None, 0), 6: (None, None, 0), 7: (None, None, 0), 8: (None, None, 2)}
    assert names.link_in_district(cases.where("false"), places, "c", "p", "d", "n", [Tier("exact", 1.0)]).count() == 0


def brute_pass_on(decided, keys):
    of_value, of_key = defaultdict(set), defaultdict(set)
    for v, k in keys:
        if v is not None and k is not None:
            of_value[v].add(k)
            of_key[k].add(v)
    seen, said = {}, defaultdict(set)
    for v, p in decided:
        if v is not None and p is not None:
            said[v].add(p)
    closed, turn = set(), 0
    while said:
        new = {v: (min(p) if len(p) == 1 else None, turn, "decided" if len(p) == 1 else "contested") for v, p in said.items()}
        seen |= new
        heard = defaultdict(set)
        for v, (p, _, s) in new.items():
            for k in of_value[v] if s == "decided" else ():
                if k not in closed:
                    heard[k].add(p)
        closed |= set(heard)
        said = defaultdict(set)
        for k, p in heard.items():
            for v in of_key[k]:
                if len(p) == 1 and v not in seen:
                    said[v] |= p
        turn += 1
    return seen


@pytest.mark.parametrize("seed", range(2))
def test_decisions_pass_on(spark, seed):
    rng = random.Random(seed)
    decided = [(rng.randrange(60), rng.choice("pq")) for _ in range(8)] + [(3, "p"), (3, "q"), (None, "p"), (4, None)]
    keys = [(rng.randrange(60), f"k{rng.randrange(50)}") for _ in range(90)] + [(100 + i, f"c{i + j}") for i in range(6) for j in (0, 1)] + [(100, "k0"), (None, "k1"), (1, None)] + [(200 + i, "hot") for i in range(300)] + [(106, "hot")]
    d, k = spark.createDataFrame(decided, "value long, place string"), spark.createDataFrame(keys, "value long, key string")
    got = names.pass_on(d, k)
    want = brute_pass_on(decided, keys)
    assert {r.value: (r.place, r.round, r.state) for r in got.collect()} == want
    again = names.pass_on(got.where("state = 'decided'").select("value", "place"), k.join(got.where("state = 'contested'").select("value"), "value", "left_anti"))
    assert {r.value: r.place for r in again.collect() if r.state == "decided"} == {v: p for v, (p, _, s) in want.items() if s == "decided"}
    assert names.pass_on(d.where("false"), k).count() == 0


def test_finest_place(spark):
    up = [("farm", "village"), ("village", "district"), ("town", "district"), ("district", "land"), ("land", None), ("isle", None)]
    cells = {1: ["village", "district"], 2: ["farm", "land", "village"], 3: ["village", "town"], 4: ["isle", "land"], 5: ["farm"], 6: ["farm", "nowhere"], 7: ["farm", "farm"], 8: ["farm", "town", "district"]}
    rows = [(c, n) for c, ns in cells.items() for n in ns] + [(9, None)]
    got = names.finest(spark.createDataFrame(rows, "cell long, node string"), spark.createDataFrame(up, "node string, parent string"), "cell").collect()
    assert {r.cell: (r.readings, r.finest, r.common) for r in got} == {
        1: (2, "village", "district"), 2: (3, "farm", "land"), 3: (2, None, "district"), 4: (2, None, None), 5: (1, "farm", "farm"), 6: (2, None, None), 7: (1, "farm", "farm"), 8: (3, None, "district"),
    }
    with pytest.raises(ValueError, match="loop"):
        names.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "node string, parent string"))
    line = spark.createDataFrame([(i, i + 1 if i < 40 else None) for i in range(41)], "node int, parent int")
    assert names.closure(line).count() == 41 * 42 // 2


def km(a, b):
    (la, lo), (lb, ob) = ([math.radians(x) for x in p] for p in (a, b))
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1, math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - lo) / 2) ** 2)))


@pytest.mark.parametrize(("k", "most"), [(1, 5.0), (5, 20.0), (3, 400.0)])
def test_nearest_places(spark, k, most):
    rng = random.Random(k)
    at = lambda: rng.choice([(rng.uniform(29, 30), rng.uniform(34, 35)), (31 + rng.gauss(0, 0.01), 35 + rng.gauss(0, 0.01)), (rng.uniform(-1, 1), rng.choice([-1, 1]) * rng.uniform(179.5, 180)), (rng.uniform(89, 90), rng.uniform(-180, 180)), (31.0, 35.0)])
    refs = [(i, rng.choice("xyz"), *at()) for i in range(250)] + [(900, "x", None, 1.0)]
    points = [(i, *at()) for i in range(80)] + [(900, None, 35.0), (901, 10.0, 10.0)]
    got = plane.nearest_places(spark.createDataFrame(points, "p long, lat double, lon double"), spark.createDataFrame(refs, "r long, l string, lat double, lon double"), "p", "r", "l", k, most)
    want = {}
    for p, *a in points:
        if None not in a:
            near = sorted((round(km(a, b), 9), r) for r, _, *b in refs if None not in b and km(a, b) <= most)[:k]
            want |= {(p, n + 1): r for n, (_, r) in enumerate(near)}
    assert {(r.p, r.place): r.r for r in got.collect()} == want


def test_boxes_and_points(spark):
    df = spark.createDataFrame([("e", "A", 3, "open", 31.0, 35.0), ("e", "B", 3, "confirmed", 31.5, 35.0), (None, "C", 1, "open", 31.0, 35.0), (None, "D", 2, "open", 31.000001, 35.0), (None, "X", 9, "open", None, 35.0)], "entry string, name string, n long, standing string, lat double, lon double")
    got = {r.key: (r.label, r.spellings, r.n, r.standing) for r in plane.one_point(df, "entry", "name", "n", "standing").collect()}
    assert got == {"e": ("A", 2, 6, "confirmed"), "31.00000,35.00000": ("D", 2, 3, "open")}
    box = spark.createDataFrame([(0.0, 179.0), (0.0, -179.0), (0.0, 0.0), (None, 0.0)], "lat double, lon double")
    assert [r[0] for r in box.select(plane.in_box(F.col("lat"), F.col("lon"), -1, 178, 1, -178)).collect()] == [True, True, False, False]


def test_profiles(spark):
    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(n)
    df = spark.createDataFrame([("a", day(0)), ("a", day(0)), ("a", day(9)), ("b", day(4)), (None, day(9)), ("b", None)], "k string, d date")
    assert {r.facet: (r.total, r.counts, r.present) for r in profiles.packed_days(df, "d", F.col("k")).collect()} == {"a": (3, [2, 0, 1], 2), "b": (1, [0, 1, 0], 1), None: (1, [0, 0, 1], 1)}
    dims = spark.createDataFrame([(1, "x", None), (2, "x", "q"), (3, "y", "q"), (None, "y", "q")], "a int, b string, c string")
    assert {(r.a, r.b): (r.values_a, r.values_b, r.pairs, r.a_gives_b, r.b_gives_a) for r in profiles.linked_dimensions(dims, ["a", "b", "c"]).collect()} == {
        ("a", "b"): (4, 2, 4, True, False), ("a", "c"): (4, 2, 4, True, False), ("b", "c"): (2, 2, 3, False, False),
    }
    reports = spark.createDataFrame([(i, "k", day(n)) for i, n in enumerate((0, 5, 7, 20, 40))] + [(9, "other", day(0)), (10, "k", None)], "id int, key string, day date")
    marks = spark.createDataFrame([("k", day(5)), ("k", day(5)), ("k", day(9)), ("k", day(22)), ("k", None)], "key string, day date")
    got = profiles.lead_lag(reports, marks, "key", "day", "day", 10)
    assert {r.id: r.gap for r in got.collect()} == {0: -5, 1: 0, 2: 2, 3: -2, 4: None, 9: None, 10: None}
    tally = {r.key: r for r in profiles.lead_lag_tally(got, "key", F.col("id") != 3).collect()}["k"]
    assert (tally.reports, tally.strict, tally.leads, tally.lags, tally.same, tally.median_lag, tally.alone) == (6, 5, 1, 1, 1, 2, 2)
