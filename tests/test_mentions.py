"""Mentions in texts against plain Python; guarded decisions."""

import random
import re

import pytest
from pyspark.errors import PySparkException

from rollbook.operators import spans, text, validate

LEXICON = {"a": "ab+", "b": "b+c", "c": "[a-c]{3}", "wide": "é."}


def _plain(t):
    found = sorted((m.start() - m.end(), m.start(), k, m.end(), n, m.group()) for k, (n, p) in enumerate(LEXICON.items()) for m in re.finditer(p, t or ""))
    kept = []
    for s in found:
        if all(s[3] <= o[1] or s[1] >= o[3] for o in kept):
            kept.append(s)
    return found, kept


def test_spans_and_longest(spark):
    rng = random.Random(3)
    texts = {k: "".join(rng.choice("aabbccé x\n") for _ in range(rng.randrange(60))) for k in range(60)} | {60: None, 61: "", 62: "abc" * 300, 63: "xyz"}
    df = spark.createDataFrame(list(texts.items()), "id long, t string")
    every = spans.term_spans(df, "id", "t", LEXICON)
    shape = lambda rows: sorted((r["id"], r["place"], r["start"], r["end"], r["label"], r["term"]) for r in rows)
    want = [[(k, s[2], s[1], s[3], s[4], s[5]) for k, t in texts.items() for s in _plain(t)[which]] for which in (0, 1)]
    assert shape(every.collect()) == sorted(want[0])
    kept = spans.longest_mentions(every, "id").collect()
    assert shape(kept) == sorted(want[1])
    one = sorted((r["start"], r["end"]) for r in kept if r["id"] == 62)
    assert one == text.longest_spans([(s[1], s[3]) for s in _plain(texts[62])[0]])
    assert spans.longest_mentions(spans.term_spans(df.where("id > 99"), "id", "t", LEXICON), "id").count() == 0


def test_all_decided(spark):
    values = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, ""), (5, "x")], "id long, v string")
    same = spark.createDataFrame([("x", "X"), ("y", "Y"), ("x", "X")], "v string, t string")
    got = {r["id"]: r["t"] for r in validate.all_decided(values, same, "v", "t").collect()}
    assert got == {1: "X", 2: "Y", 3: None, 4: None, 5: "X"}
    for bad in ([("x", "X")], [("x", "X"), ("y", "Y"), ("y", "Z")], [("x", "X"), ("y", None)]):
        with pytest.raises(PySparkException, match="no single decision for y"):
            validate.all_decided(values, spark.createDataFrame(bad, "v string, t string"), "v", "t").collect()


def test_segments_by_other_marks(spark):
    df = spark.createDataFrame([(1, "to the hut. from 3 huts. from afar"), (2, None)], "id long, t string")
    rows = text.transfers(df, "id", "t", [("from", "in"), ("to", "out")], "[0-9]", split=r"\.")
    assert sorted(map(tuple, rows.collect())) == [(1, 0, "out"), (1, 2, "in")]
