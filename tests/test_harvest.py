"""Harvested texts, decided records, XML: small cases, nulls, ties, repeats and empty tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rollbook.operators import curation, decided, harvest
from rollbook.sources import ledger, markup


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_registry_keeps_the_longest_note(spark):
    pages = [(1, '<p><a href="/a">x</a> short</p><p>a <b>longer</b>  note <a href="/a">y</a><a href="/a">again</a></p>'), (2, '<li><a href="/b"></a></li><br><a href="/a">z</a>'), (3, None), (4, ""), (5, '<p>a longer nott <a href="/b"> ya</a></p>')]
    got = harvest.registry(spark.createDataFrame(pages, "k long, html string"), "k", "html", 'href="([^"]*)"')
    assert rows(got, "id", "mentions", "sources", "note") == [("/a", 3, 2, "a longer note y again"), ("/b", 2, 2, "a longer nott ya")]
    assert harvest.registry(spark.createDataFrame([], "k long, html string"), "k", "html", "x(.)").count() == 0


def test_id_parts(spark):
    df = spark.createDataFrame([("al19380704-01.2",), ("x",), (None,), ("al99999999-01.2",)], "id string")
    got = df.select(harvest.id_parts(F.col("id"), r"^([a-z]+)(\d{8})-(\d+)\.(\d+)$", {"paper": "string", "day": "int", "issue": "int", "piece": "tinyint"}).alias("p")).collect()
    assert [r.p and tuple(r.p) for r in got] == [("al", 19380704, 1, 2), None, None, ("al", 99999999, 1, 2)]


def brute_events(text, labels):
    import re

    words = re.split(r"[^\w]+", text.lower()) if text is not None else []
    kinds = [next((n for n, p in labels.items() if re.fullmatch(p, w)), None) for w in words]
    found = {}
    for i, k in enumerate(kinds):
        if k:
            found.setdefault(k, [i, 0, None])[1] += 1
    for i, w in enumerate(words):
        if kinds[i] is None and w.isdigit() and found:
            near = min((abs(i - j), j > i, j) for j, k in enumerate(kinds) if k)[2]
            entry = found[kinds[near]]
            entry[2] = (entry[2] or 0) + int(w)
    order = sorted(found, key=lambda k: found[k][0])
    return order, [found[k][1] for k in order], [found[k][2] for k in order]


def test_event_types(spark):
    labels = {"fire": "burn(?:t|ed)?|fire", "fall": "fell|fall"}
    texts = ["Two 2 fell, 3 burnt 4 5 fell", "7 and 8", "fire", None, "", "9 fire 1 fall", "fell 1 2 3 burn", "99999999999999999999 fire"]
    got = harvest.event_types(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t", labels)
    want = {i: brute_events(t, labels) for i, t in enumerate(texts)}
    want[7] = (["fire"], [1], [None])
    assert {r.k: (r.types, r.mentions, r.numbers) for r in got.collect()} == want


def test_blocks_tags_and_windows(spark):
    df = spark.createDataFrame([(1, '<a href="/x">one <b>two</b></a><a>three</a>'), (2, None), (3, "<pc:TableCell id='1'/><TableCell>x</TableCell><br/>")], "k int, h string")
    got = harvest.block_records(df, "k", "h", "(?s)<a.*?</a>", {"to": 'href="([^"]*)"', "said": "(?s)>(.*)</a>"})
    assert rows(got, "k", "place", "to", "said") == [(1, 0, "/x", "one two"), (1, 1, None, "three")]
    assert rows(harvest.tag_inventory(df, "h", ["TableCell", "b"]), "tag", "rows", "uses") == [("TableCell", 1, 2), ("b", 1, 1)]
    day = dt.date(1938, 3, 1)
    seen = spark.createDataFrame([("the day before yesterday", day), ("yesterday", day), (None, day), ("x", None)], "t string, d date")
    lo, hi = harvest.adverb_interval(F.col("t"), F.col("d"), [("before yesterday", 2, 2), ("yesterday", 2, 1)], (10, 0))
    at = lambda n: day - dt.timedelta(n)
    assert [tuple(r) for r in seen.select(lo, hi).collect()] == [(at(3), at(1)), (at(3), at(0)), (at(11), at(-1)), (None, None)]
    assert [r[0] for r in seen.select(harvest.in_months(F.col("d"), ["1937", "1938-03"])).collect()] == [True, True, True, False]


def test_settled_dates(spark):
    d = lambda s: s and dt.date.fromisoformat(s)
    cases = [
        (("1934-01-11", "1934-02-01", "1935-01-11", "1934-02-01"), ("1935-01-11", "1935-02-01", "follows")),
        (("1934-01-11", "1934-02-01", "1934-03-11", "1934-02-01"), ("1934-01-11", "1934-02-01", "kept")),
        (("1934-01-11", "1934-02-01", "1934-01-12", "1934-02-01"), ("1934-01-12", "1934-02-01", "read")),
        (("1934-01-11", "1934-02-01", "1934-01-11", "1934-02-01"), ("1934-01-11", "1934-02-01", "same")),
        (("1934-05-11", "1934-02-01", "1934-06-11", "1934-02-01"), ("1934-06-11", "1934-02-01", "read")),
        (("1934-01-11", None, "1935-01-11", None), ("1935-01-11", None, "read")),
        ((None, "1934-02-01", "1935-01-11", "1934-02-01"), ("1935-01-11", "1934-02-01", "read")),
        (("1934-01-11", "1934-02-01", "1934-01-11", "1933-02-01"), ("1934-01-11", "1934-02-01", "kept")),
    ]
    df = spark.createDataFrame([tuple(map(d, c)) for c, _ in cases], "a date, b date, c date, e date")
    got = [tuple(r.s) for r in df.select(decided.settled_dates(*map(F.col, "abce")).alias("s")).collect()]
    assert got == [(d(a), d(b), rule) for _, (a, b, rule) in cases]


def test_exceptions_changes_and_axes(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (2, "b", 6)], "k int, s string, n int")
    made = lambda *x: spark.createDataFrame(list(x), "k int, column string, value string")
    assert rows(decided.with_exceptions(df, made((1, "s", None), (2, "n", "9"), (7, "s", "z")), "k", ["s", "n"]), "k", "s", "n") == [(1, None, 5), (2, "b", 9), (2, "b", 9)]
    for wrong in ((made((1, "s", "x"), (1, "s", "y"))), made((1, "q", "x"))):
        with pytest.raises(ValueError, match="exception"):
            decided.with_exceptions(df, wrong, "k", ["s", "n"])
    at = lambda n: dt.date(1930, 1, n)
    log = spark.createDataFrame([("x", at(1), "a"), ("x", at(2), "a"), ("x", at(3), "b"), ("x", at(4), None), ("y", at(1), "a"), ("x", None, "q")], "k string, d date, v string")
    assert rows(decided.change_dates(log, ["k"], "d", "v"), "k", "first", "last", "changes") == [("x", at(3), at(4), 2)]
    counts = spark.createDataFrame([(p, n) for p, n in enumerate((1, 5, 0, 9, 4))], "p int, n int")
    assert rows(decided.trimmed(counts, [], "p", "n"), "p") == [(1,), (2,), (3,)]
    assert decided.trimmed(counts, [], "p", "n", 100).count() == 0


def test_tallies_and_queues(spark):
    df = spark.createDataFrame([("ok",), ("bad",), ("bad",), ("zz",), (None,)], "v string")
    assert rows(decided.verdict_tally(df, F.col("v"), ["bad", "ok"]), "verdict", "n", "place") == [("bad", 2, 1), ("ok", 1, 2), ("zz", 1, 3), (None, 1, 4)]
    lanes = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", None), ("b", "x")], "f string, t string")
    assert rows(decided.lanes(lanes, "f", "t", ["x"]), "f", "x", "others", "total") == [("a", 1, 2, 3), ("b", 1, 0, 1)]
    asked = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None)], "q int, vs array<string>")
    assert rows(decided.bundles(asked, spark.createDataFrame([("a",), ("a",), ("c",)], "v string"), "q", "vs", "v"), "q", "values", "known", "records") == [(1, 2, 1, 2), (2, 0, 0, 0), (3, 0, 0, 0)]
    v = spark.createDataFrame([("a",), ("b",), ("c",)], "v string")
    assert rows(decided.review_queue(v, "v", ("one", v.where("v = 'a'")), ("two", v.where("v <> 'c'").unionAll(v))), "v", "queue") == [("a", "one"), ("b", "two"), ("c", "two")]
    named = spark.createDataFrame([("Acre Street, Haifa", "Acre"), ("Acre road, Acre", "Acre"), ("near Acre", "Acre"), (None, "Acre"), ("Acre St", None), ("a.b street", "A.B")], "a string, c string")
    assert [r[0] for r in named.select(decided.namesake(F.col("a"), F.col("c"))).collect()] == [None, "Acre", "Acre", "Acre", None, None]
    assert named.select(decided.cell(named, "c").alias("x"), decided.cell(named, "gone").alias("y")).where("x = 'Acre'").first()["y"] == ""
    assert decided.with_group(v, "g", F.lit(1), ["v", "w"]).columns == ["v"] and decided.with_group(v, "g", F.lit(1), ["v"]).columns == ["v", "g"]


def test_audit_and_verdicts(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (4, "x")], "k int, c string")
    b = spark.createDataFrame([(1, "z"), (2, "q"), (3, None), (4, "z")], "k int, c string")
    assert [tuple(r) for r in curation.audit(a, b, "k", ["c"]).collect()] == [("changed", "c", "x", "z", 2), ("filled", "c", None, "q", 1), ("cleared", "c", "y", None, 1)]
    df = spark.createDataFrame([("a", "a", ["a", "b"]), ("a", "a", ["a", None]), ("b", "a", [])], "w string, o string, s array<string>")
    got = [r[0] for r in df.select(curation.district_verdict(F.col("w"), F.col("o"), F.array(F.lit("c")), F.col("s"))).collect()]
    assert got == ["source conflict", "ok", "mismatch"]


def test_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<all xmlns:p="urn:p"><p:rec id="1"><p:title>One &amp; two</p:title><p:page n="7">x</p:page><p:page n="8">y</p:page></p:rec><p:rec id="2"/><p:rec id="many"><p:title>three</p:rec></all>')
    good, bad = markup.read_xml(spark, str(tmp_path), "rec", "_id string, title string, page array<struct<_VALUE: string, _n: string>>")
    assert [(r._id, r.title, r.page and [tuple(p) for p in r.page]) for r in good.orderBy("_id").collect()] == [("1", "One & two", [("x", "7"), ("y", "8")]), ("2", None, None)]
    assert [("many" in r.record) for r in bad.collect()] == [True]
    answers = ["<r><numberOfRecords>2</numberOfRecords><records><record><id>5</id></record><record><id>6</id><place>Acre</place></record></records></r>", "<r><numberOfRecords>0</numberOfRecords></r>", "<r><numberOf", None]
    got = markup.search_records(spark.createDataFrame(list(enumerate(answers)), "k int, x string"), "k", "x", "id: bigint, place: string")
    assert rows(got, "k", "total", "place", "id") and {(r[0], r[1], r[2], r[3]) for r in got.collect()} == {(0, 2, 0, 5), (0, 2, 1, 6), (1, 0, None, None), (2, None, None, None), (3, None, None, None)}


def test_headers(spark):
    df = spark.createDataFrame([(1, 2)], ["﻿ id ", '"name"'])
    assert ledger.clean_header(df).columns == ["id", "name"]
    with pytest.raises(ValueError, match="collide"):
        ledger.clean_header(spark.createDataFrame([(1, 2)], ["a", " a"]))
