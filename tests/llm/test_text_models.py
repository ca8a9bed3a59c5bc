"""Classifiers, scores, languages, pieces, pages and archives."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from helpers import same
from pyspark.sql import functions as F

from rollbook.llm import html_crf, langid, maxent, mixing, pieces, quality, queries, warc


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twins(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), sf_dir, queries.SQL[name])


def test_mix_takes_what_it_should(spark):
    rows = [(k, "w " * (k % 7 + 1), f"s{k % 3}" if k % 5 else None, "x") for k in range(400)] + [(None, None, "s0", "x"), (7, "w", "s1", "x"), (7, "w", "s1", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _target string")
    got = mixing.mix(df.drop("_target")).collect()
    assert len(got) == len(rows) and all(0 <= r._copies <= 3 for r in got)
    by = collections.defaultdict(lambda: [0, 0.0])
    for r in got:
        by[r.source][0] += r._copies * r._size
        by[r.source][1] = r._target
    assert all(abs(taken - target) <= 14 for taken, target in by.values())
    assert abs(sum(t for _, t in by.values()) - sum(r._size for r in got)) < 1e-6
    assert mixing.mix(df.limit(0)).count() == 0


def test_targets_refill(spark):
    sizes = spark.createDataFrame([(False, "a", 10), (False, "b", 10), (False, "c", 400), (True, "", 0)], "no_source boolean, src string, size long")
    got = {r.src: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 30 and got["b"] == 30 and got["c"] == 360 and got[""] == 0


def test_quality_on_held_out_labels(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    found = quality.classify(docs, labels.where("doc_id % 3 <> 1")).join(labels.where("doc_id % 3 = 1"), "doc_id")
    assert found.where((F.col("_good").cast("int") == F.col("quality"))).count() >= 0.95 * found.count()


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, 2.0), (1, None, None, None, 2.0), (None, "", "h", "p", 1.0), (3, "a " * 50_000, "h", None, 0.0)], "doc_id long, text string, source string, lang string, _quality double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (9, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels)
    assert got.count() == 4 and got.where("_quality IS NULL OR _quality < 0 OR _quality > 1").count() == 0
    none = quality.classify(docs, labels.limit(0)).collect()
    assert all(r._good for r in none)
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_sparse_sites_shrink(spark):
    rows = [(k, "Fine text here." if k % 4 else "BAD!! BAD!!", "big", "p") for k in range(200)] + [(900, "Fine text.", "tiny", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(200)], "doc_id long, quality int")
    got = {r.source: r for r in quality.classify(docs, labels).select("source", "_host_rate", "_path_rate").distinct().collect()}
    assert abs(got["tiny"]._host_rate - got["big"]._host_rate) < 0.1


def test_scores_against_counts(spark):
    texts = ["the cat sat", "The dog sat on the mat", None, "", "cat  dog\tcat", "unseen words"] * 3 + ["w " * 30_000]
    rows = list(enumerate(texts)) + [(None, "the cat")]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    train = df.where("doc_id IS NULL OR doc_id % 6 <> 5")
    count = collections.Counter()
    for i, t in rows:
        if i is None or i % 6 != 5:
            count.update([*(t or "").lower().split(), None])
    n, v = sum(count.values()), len(count)
    for frequent in (1_000_000, 2):
        got = {r.doc_id: r for r in maxent.score(df, train, frequent).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            tokens = [*(t or "").lower().split(), None]
            want = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens)
            assert got[i].n_tokens == len(tokens) and got[i].train_tokens == n and got[i].n_known == sum(count[w] > 0 for w in tokens)
            assert abs(got[i].base_score - want) < 1e-6 * abs(want) and got[i].score < 0
    assert maxent.score(df.limit(0), train).count() == 0
    assert maxent.score(df, train.limit(0)).where("n_known > 0").count() == 0


def test_scores_beat_the_base_on_held_out_texts(spark, sf_dir):
    got = maxent.op7(spark, sf_dir.replace("sf0.001", "sf0.01")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got["s"] > got["b"]


def test_rounds_read_every_training_text(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(maxent, "train_round", lambda docs, lexicon, weights, spark: rounds.append([r.doc_id for r in docs.collect()]) or weights)
    rows = [(k, "one hot text" if k < 60 else f"text {k}") for k in range(120)] + [(None, "no id"), (200, None)]
    maxent.score(df := spark.createDataFrame(rows, "doc_id long, text string"), df).count()
    assert collections.Counter(i for r in rounds for i in r) == collections.Counter(i for i, _ in rows)
    assert max(sum(i is not None and i < 60 for i in r) for r in rounds) < 40


def test_slot_probabilities_sum_to_one():
    w = maxent.Weights(np.random.default_rng(0).integers(1, 50, maxent.K).astype(float))
    w.classes += np.random.default_rng(1).normal(size=w.classes.shape).astype(np.float32)
    w.slots += np.random.default_rng(2).normal(size=w.slots.shape).astype(np.float32)
    f = np.tile(np.array([[3, 5, 7]]), (maxent.K, 1))
    assert abs((10 ** w.log10_slot(f, np.arange(maxent.K))).sum() - 1) < 1e-4


def naive_phrases(training, text, window):
    """Greedy longest matches, by searching."""
    n = 0
    for at in range(0, len(text), window):
        part, i = text[at : at + window], 0
        while i < len(part):
            k = 1
            while i + k < len(part) and any(part[i : i + k + 1] in t for t in training):
                k += 1
            n, i = n + 1, i + k
    return n


def test_phrases_against_search():
    train = [("aa", "abracadabra cadabra"), ("bb", "hocus pocus fidibus")]
    parser = langid.Parser(langid.train(train))
    for text in ("abra pocus", "cadabra", "fidibus hocus"):
        _, counts = parser.phrases([text])
        assert counts[0].tolist() == [naive_phrases([t], text, langid.WINDOW) for _, t in train]


def test_rare_letters_are_followed(monkeypatch):
    latin = "".join(map(chr, range(0x100, 0x17F))) * 9
    train = [("aa", latin), ("ja", "日本語の文章はひらがなと漢字を使う"), ("zh", "中文的文章使用汉字来书写内容")]
    text = "漢字を使う日本語"
    assert langid.Parser(langid.train(train)).predict([text, "使用汉字"])[0] == ["ja", "zh"]
    train = [("aa", "abracadabra cadabra"), ("bb", "hocus pocus fidibus"), ("ja", train[1][1])]
    texts = ["abra pocus", "cadabra", "fidibus hocus", text, text * 3 + "abra"]
    want = [[naive_phrases([t], x, langid.WINDOW) for _, t in train] for x in texts]
    for name, value in (("ALPHABET", 62), ("ALPHABET", 3), ("DENSE_CELLS", 0)):
        monkeypatch.setattr(langid, name, value)
        assert langid.Parser(langid.train(train)).phrases(texts)[1].tolist() == want
    assert langid.Parser(langid.train([("en", "this is his"), ("tr", "ı ſ")])).predict(["THIS IS"])[0] == ["en"]


def test_every_labelled_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_CHARS", 9_000)
    rows = [(f"l{k:03}", f"word {k}") for k in range(210)] + [("long", "lange worte " * 600), ("longer", "12 " * 9_000 + "mots " * 9_000), ("long", "kurz")]
    got = langid.training_texts(spark.createDataFrame(rows, "lang string, text string"), F.lit(True))
    assert {lang for lang, _ in got} == {lang for lang, _ in rows} and len(got) == len(rows)
    assert dict(got)["longer"].startswith("mots mots") and ("long", rows[210][1]) in got


def test_language_on_held_out_texts(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    found = langid.op8(spark, big).join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "bonjour", "fr", 1), (2, None, "fr", 1), (3, "123 !!", None, 1), (None, "", "de", 1), (4, "guten tag " * 9_000, "de", 1)], "doc_id long, text string, lang string, score int")
    model = langid.train([("de", "guten tag allerseits"), ("fr", "bonjour tout le monde")])
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert got[1][0] == "fr" and got[4][0] == "de" and got[2] == got[3] == got[None] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert langid.identify(docs.limit(0), model).count() == 0
    there = langid.train([("de", "guten tag allerseits"), ("fr", "bonjour tout le monde")], spark)
    assert there["langs"] == model["langs"] and all((langid.unpacked_edges(a) == langid.unpacked_edges(b)).all() for a, b in zip(there["edges"], model["edges"], strict=True))
    empty = langid.train(langid.training_texts(docs.limit(0), F.lit(True)), spark)
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


@pytest.fixture(scope="module")
def table():
    try:
        return pieces.load_pieces()
    except OSError:
        pytest.skip("no piece table here")


def best_sum(word, score, unknown):
    best = [0.0]
    for e in range(1, len(word) + 1):
        options = [best[s] + score[word[s:e]] for s in range(max(0, e - 16), e) if word[s:e] in score]
        best.append(max(options) if word[e - 1] in score else max([best[e - 1] + unknown, *options]))
    return best[-1]


def test_lattice_finds_the_best_sum(spark, table):
    rng = np.random.default_rng(4)
    long = ["".join(rng.choice(list("etaoinsht"), n)) for n in (60, 61, 62, 63, 64, 65, 254, 255, 256, 257, 300, 511, 512, 513, 1_500)]
    texts = ["Hello  world", "the theaores of nestion", "x" * 300, "né 中 𐍈\n\tend ", "a<b/c².", "4711 a1b2", "߷ก߷" * 200, *long]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    score = {n: s for n, _, s in table.rows}
    unknown = min(score.values()) - pieces.UNKNOWN_PENALTY
    words = {pieces.key_of(w): w for t in texts for w in re.findall(table.pattern, pieces.marked(t))}
    got = pieces.lattice(pieces.word_slices(df, table), table).collect()
    assert sorted(r.key for r in got) == sorted(words)
    for r in got:
        word, total = words[r.key], 0.0
        for i in r.ids:
            if table.byte_id <= i < table.byte_id + 256:
                continue
            total += score[table.names[i]]
        unknowns = sum(c not in score for c in word)
        assert abs(total + unknown * unknowns - best_sum(word, score, unknown)) < 1e-3
        assert pieces.decode_ids(r.ids, table.names, table.byte_id) == (word[1:] if word[0] == pieces.SPACE else word).replace(pieces.SPACE, " ")
        assert r.c == sum(re.findall(table.pattern, pieces.marked(t)).count(word) for t in texts)


def test_no_piece_crosses_a_cut(table):
    find = re.compile(table.pattern).findall
    assert all(find(n) == [n] for n, _, _ in table.rows)


def test_a_very_long_word(spark, table):
    text = "".join(np.random.default_rng(5).choice(list("etaoinshrdlu"), 200_000))
    row = pieces.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), table, check="same").first()
    score = {n: s for n, _, s in table.rows}
    assert row.same and abs(sum(score[table.names[i]] for i in row.piece_ids) - best_sum(pieces.marked(text), score, -1e9)) < 1


def test_pieces_round_trip_both_ways(spark, table, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(40)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " "), (-4, "  a ▁ b"), (None, "𐍈é\n"), (-5, "x y " * 20_000), (-5, "x y " * 20_000)], "doc_id long, text string")
    df = docs.union(odd).withColumn("decoded", F.lit(1)).withColumn("_row", F.lit("r")).withColumn("key", F.col("doc_id")).withColumn("a.b", F.lit(2))
    key = lambda r: (str(r.doc_id), tuple(r.piece_ids))
    ways = []
    for frequent in (pieces.FREQUENT, 100, 0):
        got = pieces.encode(df, table, check="same", frequent=frequent)
        assert got.columns == [*df.columns, "piece_ids", "same"]
        rows = got.collect()
        assert len(rows) == 47 and all(r.same or pieces.SPACE in r.text for r in rows) and {r["a.b"] for r in rows} == {2}
        ways.append(sorted(map(key, rows)))
    assert ways[0] == ways[1] == ways[2]
    one = pieces.decode(pieces.encode(df.drop("a.b"), table)).collect()
    assert all((r.decoded == (r.text or "")) or pieces.SPACE in r.text for r in one) and len(one) == 47
    assert pieces.encode(df, table, keep=["doc_id"]).columns == ["doc_id", "piece_ids"]
    assert pieces.encode(df.limit(0), table).count() == 0


def test_pages_made_and_real(spark, sf_dir):
    field = html_crf.default_field()
    pages = [html_crf.leaf_blocks(html_crf.made_page(k)) for k in range(5_000, 5_100)]
    want = [int(b[3] or 0) for p in pages for b in p]
    assert np.mean(np.concatenate(field.decode(pages)) == np.array(want)) > 0.97
    import re

    for r in html_crf.op3(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search("<article>(.*)</article>", r.html, re.S)[1]
        assert r.text == " ".join(" ".join(b[1] for b in html_crf.leaf_blocks(body)).split()) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    ("inner", "want"),
    [("<svg viewBox='0 0 1 1'/>", "a b"), ("<math/>", "a b"), ("<svg><title>t</title><path d=''/><text>no</text></svg>", "a b"), ("<math><mi>x</mi><mo>=</mo><mn>1</mn></math>", "a x=1 b"), ("<object><p>no</p></object>", "a b"), ("<canvas>no</canvas>", "a b"), ("<noscript><div>no</div></noscript>", "a b"), ("<template><p>no</template>", "a b")]
    + [(f"<{t}>", "a b") for t in ("object", "iframe", "canvas")],
)
def test_hidden_elements_hide_their_own_text_only(inner, want):
    assert [b[1] for b in html_crf.leaf_blocks(f"<article><p>a {inner} b</p><p>end</p></article><p>after")] == [want, "end", "after"]


def test_viterbi_against_all_labellings():
    import itertools

    field = html_crf.default_field()
    blocks = html_crf.leaf_blocks(html_crf.made_page(77))[:9]
    e = field.scores(blocks)
    value = lambda y: field.first[y[0]] + e[range(len(y)), y].sum() + sum(field.move[a, b] for a, b in itertools.pairwise(y))
    assert tuple(field.decode([blocks])[0]) == max(itertools.product((0, 1), repeat=len(blocks)), key=lambda y: value(list(y)))


def test_odd_pages(spark):
    html = [None, "", "<", "no markup at all", "<article><p>a &amp; b &lt;c&gt; <b>d</b>\n e<br>f <p>g</article>", "<a title='x", "<article>" + "<p>word</p>" * 3_000 + "</article>", "<script>var x = 1"]
    df = spark.createDataFrame([(k, "u", h, "t") for k, h in enumerate(html)] + [(4, "u", html[4], "t")], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in html_crf.extract(df).orderBy("page_id").collect()]
    assert len(got) == 9 and got[0] == (0, "") and got[1] == (1, "") and got[-1] == (7, "")
    assert ("a & b <c> d e f g") in {t for k, t in got if k == 4}
    assert dict(got)[6].count("word") == 3_000
    assert html_crf.extract(df.limit(0)).count() == 0


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<title> T </title><a href='/x'>link</a><p>body &amp; more</p>"), (2, None, None), (2, None, None), (3, "http://b/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", F.lit("clash"))
    made = warc.derive(warc.responses(pages, "2020-01-01T00:00:00Z"), keep=("page_id",))
    assert made.count() == 8
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0
    for how in ("gzip", "none"):
        warc.write_records(made, str(tmp_path / how), how)
        again = warc.read_records(spark, str(tmp_path / how))
        assert again.where("complete").count() == 8
        key = lambda r: (r.record_type, r.record_id, r.refers_to or "", r.block_digest, bytes(r.block).decode())
        want = [(r.record_type, r.record_id, r.refers_to, r.block_digest, r.block) for r in made.collect()]
        assert sorted(map(key, again.collect())) == sorted(want)
    text = {r.record_type: r for r in made.where("page_id = 1").collect()}
    assert text["conversion"].block == "T link body & more" and "outlink: /x L a/@href\r\n" in text["metadata"].block
    assert text["metadata"].refers_to == text["conversion"].refers_to and text["metadata"].record_id != text["conversion"].record_id


def test_all_references_are_decoded(spark):
    text = "it&#8217;s caf&eacute; &hellip; &mdash; &#x27;q&#39; &amp;lt; &amp;amp; a&nbsp;&#160;b AT&T &copy; &nosuch; &lt;b&gt;"
    df = spark.createDataFrame([(text,), ("&amp;eacute; &quot;",), (None,)], "html string")
    got = [r.t for r in df.select(warc.plain_text(F.col("html")).alias("t")).collect()]
    assert got == ["it’s café … — 'q' &lt; &amp; a b AT&T © &nosuch; <b>", '&eacute; "', None]
    import html

    names = [n for n in html.entities.html5 if n.endswith(";") and n not in ("nbsp;", "NonBreakingSpace;")]
    assert all(warc.decoded(f"a &{n} b") == f"a {html.entities.html5[n]} b" for n in names)


def test_responses_of_archives(spark, tmp_path):
    def record(version, kind, k, head, block):
        return f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{k}>\r\nWARC-Target-URI: http://a/{k}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    http = lambda kind, body: b"HTTP/1.1 200 OK\r\nContent-Type: " + kind + b"\r\n\r\n" + body
    more = "WARC-IP-Address: 1.2.3.4\r\nContent-Type: application/http; msgtype=response\r\n"
    records = [("1.0", "warcinfo", 0, "", b"software: x\r\n"), ("1.1", "response", 1, more, http(b"text/html", "<p>é&eacute; of WARC/1.0\r\nand\r\n\r\nmore".encode())), ("1.0", "request", 2, more, b"GET / HTTP/1.1\r\n\r\n"), ("1.1", "response", 3, more, http(b"text/html; charset=ISO-8859-1", b"<b>\xe9</b>")), ("1.0", "response", 4, more, http(b"text/plain", b""))]
    (tmp_path / "x.warc").write_bytes(b"".join(record(*r) for r in records))
    read = warc.read_records(spark, str(tmp_path / "x.warc"))
    assert read.where("complete").count() == 5 and read.count() == 5
    made = warc.derive(warc.fetched(read), keep=("source_headers",))
    got = {r.refers_to: (r.source_content_type, r.block) for r in made.where("record_type = 'conversion'").collect()}
    assert got == {"<urn:1>": ("text/html", "éé of WARC/1.0 and more"), "<urn:3>": ("text/html; charset=ISO-8859-1", "é"), "<urn:4>": ("text/plain", "")}
    warc.write_records(made, str(tmp_path / "out"))
    again = warc.read_records(spark, str(tmp_path / "out")).collect()
    assert len(again) == 6 and all(r.complete and "\nWARC-Source-IP-Address: 1.2.3.4" in r.warc_headers for r in again)


def test_folds(spark):
    df = spark.createDataFrame([(k,) for k in range(50)] + [(None,)], "doc_id long")
    got = df.select("doc_id", maxent.in_training(F.col("doc_id")).alias("a"), langid.in_training().alias("b")).collect()
    for r in got:
        h = zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode())
        assert r.a == (h % 7 != 2) and r.b == (h % 4 != 2)


def test_maxent_probabilities_and_gradient():
    rng = np.random.default_rng(7)
    mass = rng.integers(1, 50, maxent.K).astype(float)
    w = maxent.Weights(mass)
    for x in (w.classes, w.slots):
        x += rng.normal(0, 0.3, x.shape).astype(np.float32)
    f = rng.integers(0, maxent.ROWS, (1, maxent.KINDS))
    every = np.arange(maxent.K)
    assert abs((10 ** w.log10_slot(np.repeat(f, maxent.K, axis=0), every)).sum() - 1) < 1e-4
    # A step follows the slope of the log-likelihood, found by differences.
    f, slot = rng.integers(0, 3, (40, maxent.KINDS)), rng.integers(0, maxent.K, 40)
    like = lambda: w.log10_slot(f, slot).sum() * np.log(10)
    k, row = 1, f[0, 1]
    slope = np.zeros(maxent.CLASSES)
    for c in range(maxent.CLASSES):
        w.classes[k, row, c] += 0.02
        up = like()
        w.classes[k, row, c] -= 0.04
        slope[c] = (up - like()) / 0.04
        w.classes[k, row, c] += 0.02
    before = w.classes[k, row].copy()
    w.descend(f, slot, [np.zeros(x.shape[0], np.float32) for part in (w.classes, w.slots) for x in part])
    step = w.classes[k, row] - before
    want = 2 * maxent.RATE * slope / np.sqrt((slope**2).sum() + 1)
    assert np.abs(step - want).max() < 5e-3


def test_quality_against_plain_python(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "good words here " * int(rng.integers(1, 9)) if rng.random() < 0.6 else "BUY!! $$$ " * int(rng.integers(1, 9)), f"s{rng.integers(0, 4)}" if i % 17 else None, f"l{rng.integers(0, 3)}") for i in range(240)]
    labels = [(i, int(r[1].startswith("good"))) for i, r in enumerate(rows) if i % 3 == 0] + [(3, 0), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.classify(docs, marks, prefix="").collect()
    model = quality.train(docs, marks)
    y = {}
    for i, q in labels:
        if i is not None:
            y.setdefault(i, []).append(q)
    paths, hosts = collections.defaultdict(lambda: [0.0, 0.0]), collections.defaultdict(lambda: [0.0, 0.0])
    for r in got:
        weight = 1.0 if r.doc_id in y else quality.SOFT_WEIGHT
        value = np.mean(y[r.doc_id]) if r.doc_id in y else 1 / (1 + math.exp(-(r.text_score + model["base"])))
        for sums, key in ((paths, (r.source, r.lang)), (hosts, r.source)):
            sums[key][0] += weight
            sums[key][1] += weight * value
    n, good = (sum(h[k] for h in hosts.values()) for k in (0, 1))
    rate = (good + 0.5) / (n + 1)

    def strength(groups, prior):
        whole = sum(g[0] * prior(k) * (1 - prior(k)) for k, g in groups.items())
        total = sum(g[0] for g in groups.values())
        spread = sum(g[0] * (g[1] / g[0] - prior(k)) ** 2 for k, g in groups.items())
        between = (spread - sum(prior(k) * (1 - prior(k)) for k in groups)) / total
        return min(quality.MOST_STRENGTH, max(1.0, whole / total / between - 1)) if between > 0 else quality.MOST_STRENGTH

    of_hosts = strength(hosts, lambda k: rate)
    host_rate = {k: (g[1] + of_hosts * rate) / (g[0] + of_hosts) for k, g in hosts.items()}
    of_paths = strength(paths, lambda k: host_rate[k[0]])
    path_rate = {k: (g[1] + of_paths * host_rate[k[0]]) / (g[0] + of_paths) for k, g in paths.items()}
    for r in got:
        p = path_rate[r.source, r.lang]
        assert abs(r.host_rate - host_rate[r.source]) < 1e-9 and abs(r.path_rate - p) < 1e-9
        assert abs(r.quality - 1 / (1 + math.exp(-(r.text_score + math.log(p / (1 - p)))))) < 1e-9 and r.good == (r.quality >= 0.5)


def test_columns_of_any_name(spark):
    rows = [(1, "a b c", "s", "x", "y"), (1, "d e f", "s", "x", "y"), (None, "g h", None, "x", "y"), (None, "i j", None, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _target string, _size string")
    got = mixing.mix(docs, prefix="m_")
    assert got.columns == [*docs.columns, "m_size", "m_source_size", "m_target", "m_copies"]
    assert {(r._target, r._size) for r in got.collect()} == {("x", "y")}
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.mix(docs.repartition(3), prefix="m_").collect()))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    named = docs.withColumnsRenamed({"_target": "_host", "_size": "_path"}).withColumn("lang", F.lit("en"))
    out = quality.classify(named, labels, prefix="q_")
    assert out.columns[: len(named.columns)] == named.columns and {(r._host, r._path) for r in out.collect()} == {("x", "y")}


def test_deep_pages(spark):
    deep = "<article>" + "<div>x" * 60_000
    blocks = html_crf.leaf_blocks(deep)
    assert len(blocks) == 60_000 and max(len(b[0]) for b in blocks) <= 4
    row = html_crf.extract(spark.createDataFrame([(1, deep)], "page_id long, html string")).first()
    assert set(row.text) <= {"x", " "}


def _class(k: int) -> str:
    return "".join(chr(97 + k // 26**i % 26) for i in range(4))


@pytest.mark.parametrize(
    "page, blocks",
    [
        ("".join(f'<div class="{_class(k)}">x' for k in range(60_000)), 60_000),
        ("<canvas>a<i>b</i>" * 60_000, 1),
        ("<canvas>a<i>b</i>" * 60_000 + "</canvas>" * 60_000, 0),
        ("<canvas>" * 60_000 + "</object>" * 60_000 + "x", 1),
        ("<div><canvas><p>a" * 60_000 + "</div>" * 60_000, 60_000),
    ],
)
def test_pages_cost_their_length(page, blocks):
    import time

    field = html_crf.default_field()
    began = time.process_time()
    found = html_crf.leaf_blocks(page)
    assert len(found) == blocks and len(field.decode([found])[0]) == blocks
    # A square of 60,000 would take minutes; the line takes 5 s on a quiet machine.
    assert time.process_time() - began < 30


def test_places_bring_what_is_new():
    page = '<div class="a b"><section class="b c"><div class="a"><p>x</p></div></section><p>y</div><canvas>z<p>t</canvas>w'
    got = {b[1]: html_crf.path_features(b[0]) for b in html_crf.leaf_blocks(page)}
    assert got["x"] == ("in div", "name a", "name b", "in section", "name c", "in p", "tag p", "tags div/p", "named")
    assert got["y"] == ("in div", "name a", "name b", "in p", "tag p", "tags div/p", "named")
    assert got["w"] == ("in none", "tag none", "tags none", "unnamed") and set(got) == {"x", "y", "w"}


def test_a_field_without_pages_takes_nothing():
    field = html_crf.train([[], []])
    assert [list(y) for y in field.decode([html_crf.leaf_blocks("<p>a</p><p>b"), []])] == [[0, 0], []]


def _warc(k: int, block: bytes, length: int | None = None, more: bytes = b"") -> bytes:
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{k}>\r\nWARC-Target-URI: http://a/{k}\r\nContent-Type: application/http\r\nContent-Length: {len(block) if length is None else length}\r\n"
    return head.encode() + more + b"\r\n" + block + b"\r\n\r\n"


def _http(body: bytes, *head: str) -> bytes:
    return "\r\n".join(("HTTP/1.1 200 OK", *head, "", "")).encode() + body


def _chunks(body: bytes, n: int) -> bytes:
    return b"".join(b"%x;q=1\r\n%s\r\n" % (len(body[k : k + n]), body[k : k + n]) for k in range(0, len(body), n)) + b"0\r\n\r\n"


def test_archives_as_they_are_fetched(spark, tmp_path):
    import gzip
    import zlib as z

    text = "<p>café ab</p>"
    raw = z.compressobj(wbits=-15)
    raw = raw.compress(text.encode()) + raw.flush()
    quoted = _warc(99, _http(b"<p>inner</p>"))
    bodies = {
        0: (_http(_chunks(text.encode(), 3), "Transfer-Encoding: chunked"), "café ab"),
        1: (_http(gzip.compress(text.encode()), "Content-Encoding: gzip"), "café ab"),
        2: (_http(_chunks(gzip.compress(text.encode()), 7), "content-encoding: x-gzip", "transfer-encoding: chunked"), "café ab"),
        3: (_http(z.compress(text.encode()), "Content-Encoding: deflate"), "café ab"),
        4: (_http(raw, "Content-Encoding: deflate"), "café ab"),
        5: (_http("<p>café “x”</p>".encode("cp1252"), "Content-Type: text/html; charset=windows-1252"), "café “x”"),
        6: (_http("<meta charset=koi8-r><p>мир".encode("koi8-r"), "Content-Type: text/html"), "мир"),
        7: (_http("﻿<p>мир".encode("utf-16-le"), "Content-Type: text/html; charset=utf-8"), "мир"),
        8: (_http(b"<p>A block</p>\r\n\r\n" + quoted), "A block WARC/1.0 WARC-Type: response WARC-Record-ID: WARC-Target-URI: http://a/99 Content-Type: application/http Content-Length: 31 HTTP/1.1 200 OK inner"),
        9: (_http(text.encode(), "Transfer-Encoding: chunked", "Content-Encoding: gzip"), "café ab"),
        10: (_http("<p>мир".encode(), "Content-Type: text/html; charset=nosuch"), "мир"),
        11: (_http(b"", "Content-Encoding: gzip"), ""),
        12: (_http(b"a\xffb"), "a�b"),
        13: (_http(gzip.compress(b"one ") + gzip.compress(b"two"), "Content-Encoding: gzip"), "one two"),
        # Not to be read: an unknown coding, a cut chunk, a cut member.
        20: (_http(b"\x0b\x02\x80ab\x03", "Content-Encoding: br"), None),
        21: (_http(_chunks(text.encode(), 3)[:-9], "Transfer-Encoding: chunked"), None),
        22: (_http(gzip.compress(text.encode())[:-12], "Content-Encoding: gzip"), None),
    }
    records = [_warc(k, block) for k, (block, _) in bodies.items()]
    files = {"plain.warc": b"".join(records), "members.warc.gz": b"".join(map(gzip.compress, records)), "whole.warc.gz": gzip.compress(b"".join(records)), "empty.warc": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        read = warc.read_records(spark, str(tmp_path / name))
        assert read.count() == (len(records) if data else 0) and read.where("complete").count() == read.count()
        every = warc.fetched(read, unreadable=True)
        made = warc.derive(warc.fetched(read)).where("record_type = 'conversion'")
        got = {r.refers_to: r.block for r in made.collect()}
        want = {f"<urn:{k}>": t for k, (_, t) in bodies.items() if t is not None} if data else {}
        assert got == want
        assert {r.record_id for r in every.where("NOT readable").collect()} == ({"<urn:20>", "<urn:21>", "<urn:22>"} if data else set())


def test_incomplete_records_are_no_sources(spark, tmp_path):
    import gzip

    block = _http(b"<p>a</p>")
    files = {
        "long.warc": _warc(1, block) + _warc(2, block, len(block) + 500),
        "short.warc": _warc(1, block, len(block) - 6) + _warc(3, block),
        "none.warc": _warc(1, block).replace(b"Content-Length", b"X-Length") + _warc(3, block),
        "head.warc": _warc(3, block) + b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 0",
        "cut.warc.gz": gzip.compress(_warc(3, block)) + gzip.compress(_warc(1, block * 50))[:-15],
    }
    want = {"long.warc": ["<urn:1>"], "short.warc": ["<urn:3>"], "none.warc": ["<urn:3>"], "head.warc": ["<urn:3>"], "cut.warc.gz": ["<urn:3>"]}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        read = warc.read_records(spark, str(tmp_path / name))
        assert read.count() == 2 and read.where("NOT complete").count() == 1, name
        assert [r.record_id for r in warc.fetched(read).collect()] == want[name]


def test_bodies_of_any_bytes():
    import random

    rng = random.Random(5)
    for _ in range(300):
        body = rng.randbytes(rng.randrange(0, 400))
        n = rng.randrange(1, 90)
        assert warc.dechunked(_chunks(body, n)) == body
        assert warc.body_text("Transfer-Encoding: chunked\r\nContent-Type: a/b; charset=cp437", _chunks(body, n)) == body.decode("cp437") or body[:2] in (b"\xff\xfe", b"\xfe\xff")
        warc.body_text(f"Content-Encoding: {rng.choice(['gzip', 'deflate', 'br', 'chunked'])}", body)
        cut = list(warc.cut_records(_warc(1, body) + body + b"\r\n" + _warc(2, body)))
        assert cut[0][1] == body and cut[-1][1] == body and cut[-1][2]


def test_packed_edges_come_back():
    rng = np.random.default_rng(4)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 9, 20_000)), "naïve straße " * 50, ""]
    edges = langid._edges(texts, langid.symbol_map(langid.alphabet_of(texts)))
    packed = langid.packed_edges(edges)
    assert (langid.unpacked_edges(packed) == edges).all() and len(packed) * 3 < edges.nbytes
    assert langid.unpacked_edges(langid.packed_edges(edges[:0])).shape == (0, 3)
