"""Operators and column builders on small tables made by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollbook.functions import cells, dates, intervals
from rollbook.operators import filters, link, overlay, series, stats, text, validate
from rollbook.sources import ledger

D = dt.date


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("value", "want"), [(None, "Not recorded"), ("  ", "Not recorded"), ("null", "Not recorded"), (" a ", "a")])
def test_facet_value(spark, value, want):
    assert one(spark, cells.facet_value(F.lit(value).cast("string"))) == want


@pytest.mark.parametrize(("text_", "want"), [("6.7.38", D(1938, 7, 6)), ("1.2.24", D(2024, 2, 1)), ("29.2.35", None), ("31/12/1940", D(1940, 12, 31)), ("x", None)])
def test_clerk_date(spark, text_, want):
    assert one(spark, dates.clerk_date(F.lit(text_))) == want


def test_roman_date(spark):
    assert one(spark, dates.roman_date(F.lit("28-VIII-40"))) == D(1940, 8, 28)
    assert one(spark, dates.roman_date(F.lit("28-XIII-40"))) is None


def test_age_years(spark):
    assert one(spark, dates.age_years(F.lit("18"), F.lit("months"))) == 1.5
    assert one(spark, dates.age_years(F.lit("x"), F.lit(""))) is None


def test_code_category(spark):
    assert one(spark, cells.code_category(F.lit("84.1|84.0"))) == "084"
    assert one(spark, cells.code_category(F.lit("V7"))) == "V007"
    assert one(spark, cells.code_category(F.lit("fever"))) is None


def test_skeleton_joins_spellings(spark):
    a, b = (one(spark, cells.skeleton(F.lit(x))) for x in ("el-Qassem", "Kasem"))
    assert a == b == "ksm"


def test_poisson_tail(spark):
    got = one(spark, intervals.log10_poisson_tail(F.lit(5), F.lit(1.0)))
    assert abs(10**got - 0.003659846827) < 1e-9


def test_self_excluding_counts_add_up(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", None)], "f string, g string")
    state = filters.FilterState(facets={"f": ("a",), "g": ("x",)})
    got = {(r.facet, r.value): r.n for r in filters.facet_counts(df, state, ["f", "g"]).collect()}
    assert got == {("f", "a"): 1, ("f", "b"): 1, ("g", "x"): 1, ("g", "y"): 1}
    assert filters.select(df, state).count() == 1


def test_census_is_half_open(spark):
    df = spark.createDataFrame([(D(2000, 1, 1), D(2000, 1, 3)), (D(2000, 1, 2), D(2000, 1, 2)), (D(2000, 1, 2), None)], "a date, z date")
    assert {(r.day, r.present) for r in series.census(df, "a", "z").collect()} == {(D(2000, 1, 1), 1), (D(2000, 1, 2), 1)}


def test_surges_hold_off(spark):
    rows = [("m", D(2000, 1, 1) + dt.timedelta(days=k), 9 if k in (5, 6, 7, 30) else 1) for k in range(60)]
    df = spark.createDataFrame(rows, "key string, day date, trailing long").withColumn("n", F.lit(0))
    got = [r.day for r in series.surges(df, "key", floor=5, refractory=10).orderBy("day").collect()]
    assert got == [D(2000, 1, 6), D(2000, 1, 31)]


def test_overlaps_merge(spark):
    df = spark.createDataFrame([("p", D(2000, 1, 1), D(2000, 1, 9)), ("p", D(2000, 1, 2), D(2000, 1, 3)), ("p", D(2000, 1, 10), D(2000, 1, 11)), ("p", D(2000, 2, 1), D(2000, 2, 1))], "k string, s date, e date")
    got = {(r.start, r.end, r.parts) for r in series.merge_overlaps(df, ["k"], "s", "e").collect()}
    assert got == {(D(2000, 1, 1), D(2000, 1, 11), 3), (D(2000, 2, 1), D(2000, 2, 1), 1)}


def test_insert_after_and_unmatched(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "seq long, v string")
    new = spark.createDataFrame([(1, 2, "y"), (1, 1, "x"), (7, 1, "lost")], "anchor long, k int, v string")
    got = [r.v for r in overlay.insert_after(df, new, "seq", "anchor", "k").orderBy("seq").collect()]
    assert got == ["a", "x", "y", "b"]
    assert [r.v for r in overlay.unmatched(df, new, "seq", "anchor").collect()] == ["lost"]


def test_block_shift(spark):
    df = spark.createDataFrame([(1, "a", False), (2, "b", True), (3, "c", True), (4, "d", True)], "seq int, v string, run boolean")
    got = [r.v for r in overlay.shift_block_down(df, [], ["seq"], ["v"], F.col("run")).orderBy("seq").collect()]
    assert got == ["a", "b", "b", "c"]


def test_claims(spark):
    df = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, 12), (4, 13)], "c long, r long")
    assert {(x.c, x.status) for x in link.claim(df, "c", "r").collect()} == {(1, "contested"), (2, "contested"), (3, "unique"), (4, "ambiguous")}


def test_fuzzy_ratio(spark):
    a = spark.createDataFrame([("haifa",), ("acre",)], "t string")
    b = spark.createDataFrame([("haiffa",), ("jaffa",)], "n string")
    got = link.fuzzy(a, b, "t", "n", (F.substring("t", 1, 1), F.substring("n", 1, 1)), F.lit(0.8)).collect()
    assert [(r.t, r.n) for r in got] == [("haifa", "haiffa")] and abs(got[0].ratio - 10 / 11) < 1e-9


def test_concordance_merges_windows(spark):
    body = "x" * 200 + "plague in haifa and again plague" + "y" * 300
    df = spark.createDataFrame([(1, body), (2, None), (3, "plague")], "id long, t string")
    got = text.concordance(df, "id", "t", "plague", "haifa", gap=30, context=10).collect()
    assert len(got) == 1 and got[0].hits == 2 and got[0].excerpt.startswith("x" * 10 + "plague")


def test_longest_span_wins():
    assert text.longest_spans([(0, 5), (3, 12), (12, 14)]) == [(3, 12), (12, 14)]


def test_transfers(spark):
    df = spark.createDataFrame([(1, "sent to Acre; paid | returned from Jaffa")], "id long, t string")
    got = text.transfers(df, "id", "t", [("^sent", "out"), ("^returned", "in")], "^paid").orderBy("segment").collect()
    assert [(r.segment, r.label) for r in got] == [(0, "out"), (2, "in")]


def test_identities_and_conflicts(spark):
    df = spark.createDataFrame([(3, 1, 2), (4, 1, 2), (None, 1, 2)], "p int, m int, f int")
    assert validate.broken_identity(df, F.col("p"), F.col("m") + F.col("f")).count() == 1
    spellings = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "k string, t string")
    assert [r.k for r in validate.conflicts(spellings, "k", "t").collect()] == ["a"]


def test_most_frequent_takes_the_first_seen(spark):
    df = spark.createDataFrame([("k", "b", 1), ("k", "a", 2)], "k string, v string, seq int")
    assert stats.most_frequent(df, "k", "v", "seq").first()["v"] == "b"


def test_tsv_keeps_quotes_and_drops_echoes(spark, tmp_path):
    path = tmp_path / "in.tsv"
    path.write_text('a\tb\tc\td\te\n"x\t1\t2\t3\t4\na\tb\tc\td\te\ny"\t5\t6\t7\t8\n')
    df = ledger.read_tsv(spark, str(path), list("abcde"))
    assert sorted(r.a for r in df.collect()) == ['"x', 'y"']
    ledger.write_tsv(df.withColumn("e", F.lit("p\tq")), str(tmp_path / "out"), ["b"], 1)
    again = ledger.read_tsv(spark, str(tmp_path / "out"), list("abcde"))
    assert sorted((r.a, r.e) for r in again.collect()) == [('"x', "p q"), ('y"', "p q")]


def test_sources_that_are_missing_or_done(spark, tmp_path):
    assert ledger.optional(spark, str(tmp_path / "none"), "a string").count() == 0
    todo = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    done = spark.createDataFrame([("1", "ok"), ("2", "error")], "id string, state string")
    assert sorted(r.id for r in ledger.pending(todo, done, ["id"], "state = 'error'").collect()) == ["2", "3"]


def test_renames_that_collide(spark):
    df = spark.createDataFrame([("x", "y")], "a string, b string")
    with pytest.raises(ValueError, match="collide"):
        ledger.rename(df, {"a": "b"})
    assert ledger.rename(df, {"a": "c"}, order=["b"]).columns == ["b", "c"]
    assert ledger.resolve(df, {"first": ["z", " A "]}) == {"first": "a"}


def test_canvases(spark):
    df = spark.createDataFrame([("7", '{"canvases": [{"label": "nb_7_012_x", "id": "u1"}, {"label": "cover", "id": "u2"}]}')], "nb string, m string")
    assert [(r["index"], r.page) for r in ledger.canvases(df, "m", "nb").orderBy("index").collect()] == [(0, 12), (1, None)]


def test_votes_of_equal_references(spark):
    refs = spark.createDataFrame([(k, 5.0, "a" if k <= 2 else "b") for k in range(1, 11)] + [(20 + k, 9.0, "c" if k < 2 else "d") for k in range(9)], "r long, v double, l string")
    points = spark.createDataFrame([(1, 6.0), (2, 5.0), (3, 4.5), (4, 8.9), (5, 9.0), (6, 20.0)], "p long, v double")
    got = {r.p: (r.l, r.votes) for r in link.neighbour_vote(points, refs, "p", "v", "v", "r", "l", 2, width=3.0).collect()}
    assert got == {1: ("a", 2), 2: ("a", 2), 3: ("a", 2), 4: ("c", 2), 5: ("c", 2), 6: ("c", 2)}


def test_concordance_against_all_pairs(spark):
    import random
    import re

    from rollbook.operators import text

    rng = random.Random(3)
    bodies = [" ".join(rng.choice(["aa", "bbbb", "b", "x", "yyyyy"]) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    df = spark.createDataFrame([*enumerate(bodies), (99, None)], "id int, body string")
    got = {(r.id, r.start, r.end): (r.hits, r.excerpt) for r in text.concordance(df, "id", "body", r"\baa\b", r"\bb+\b", 6, 3).collect()}
    want = {}
    for i, body in enumerate(bodies):
        pairs = []
        for x in re.finditer(r"\baa\b", body):
            for y in re.finditer(r"\bb+\b", body):
                if max(x.start(), y.start()) - min(x.end(), y.end()) <= 6:
                    pairs.append((max(0, min(x.start(), y.start()) - 3), min(len(body), max(x.end(), y.end()) + 3)))
        cover = []
        for s, e in sorted(pairs):
            if cover and s <= cover[-1][1]:
                cover[-1] = (cover[-1][0], max(e, cover[-1][1]), cover[-1][2] + 1)
            else:
                cover.append((s, e, 1))
        want.update({(i, s, e): (n, body[s:e]) for s, e, n in cover})
    assert got == want


def test_base_view_tells_what_it_drops(spark):
    df = spark.createDataFrame([(1, "camp", "x"), (2, "town", "birth"), (3, "town", "x"), (4, None, None), (5, "camp", "birth")], "id int, book string, kind string")
    kept, dropped = ledger.base_view(df, {"book": ["camp"], "kind": ["birth"]})
    assert sorted(r.id for r in kept.collect()) == [3, 4] and {r.reason: r.records for r in dropped.collect()} == {"book": 2, "kind": 1}


def test_typed_cells(spark):
    df = spark.createDataFrame([(" 7 ", "a "), ("x", ""), ("", "  "), (None, None)], "n string, t string")
    assert [tuple(r) for r in ledger.typed(df, {"n": "INT"}).collect()] == [(7, "a"), (None, None)]


def test_csv_and_json_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,t\n1,"says ""so"", twice\nover"\n2,\n')
    assert [tuple(r) for r in ledger.read_csv(spark, str(tmp_path / "a.csv"), ["n", "t"]).collect()] == [("1", 'says "so", twice\nover'), ("2", None)]
    (tmp_path / "a.json").write_text('[{"k": "x", "n": 1},\n {"k": "y"}]')
    assert sorted((r.k, r.n) for r in ledger.read_json(spark, str(tmp_path / "a.json"), "k string, n int").collect()) == [("x", 1), ("y", None)]


def test_poorer_output_is_refused(spark, tmp_path):
    rich, poor = (spark.createDataFrame(rows, "id int, v string") for rows in ([(1, "a"), (2, "b")], [(1, "a"), (2, None)]))
    path = str(tmp_path / "out")
    ledger.write_richer(rich, path, "v")
    with pytest.raises(ValueError, match="2 rows"):
        ledger.write_richer(poor, path, "v")
    assert spark.read.parquet(path).where("v IS NOT NULL").count() == 2


def test_export_in_screen_order(spark, tmp_path):
    df = spark.createDataFrame([(1, "b", 0), (2, "a", 0)], "id int, name string, hidden int")
    ledger.export_csv(df.coalesce(1), str(tmp_path / "x"), ["name", "id"], ["name"], spark.createDataFrame([(2, "keep")], "id int, verdict string"), "id")
    got = spark.read.csv(str(tmp_path / "x"), header=True)
    assert got.columns == ["name", "id", "verdict"] and sorted(map(tuple, got.collect()), key=str) == [("a", "2", "keep"), ("b", "1", None)]
