"""Exact duplicates, resampling and the prefix trie against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from helpers import same

from rollbook.llm import exact_trie, prefix_trie, resample

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text):
    return (text or "").translate(str.maketrans(UP, LOW))


@pytest.mark.parametrize("name", ["op11_trie_resample", "op12_prefix_owners", "op13_patricia_dedup"])
def test_against_sql(spark, sf_dir, name):
    from rollbook.llm import queries

    same(queries.QUERIES[name](spark, sf_dir), sf_dir, queries.SQL[name])


# Exact duplicates


def test_trie_holds_what_a_dict_holds():
    rng = random.Random(1)
    for held in (10**9, 3_000, 1):
        trie, want, got = exact_trie.Trie(lambda a, b: a > b), defaultdict(list), defaultdict(lambda: [0, None])
        for i in range(600):
            key = exact_trie.key_of("".join(rng.choice("abB") for _ in range(rng.randrange(7))) * rng.choice((1, 1, 40)))
            want[key].append(i)
            trie.insert(key, i, 1, 1)
            if trie.held > held:
                for k, x in trie.heaviest(held // 2):
                    got[k] = [got[k][0] + x.n, x.best]
                assert trie.held <= held // 2
        for k, x in trie.everything():
            got[k] = [got[k][0] + x.n, x.best]
        assert {k: [len(v), max(v)] for k, v in want.items()} == got
        assert trie.held == 0


def test_trie_gives_out_what_the_order_has_passed():
    keys = sorted(exact_trie.key_of(f"{i % 50}" * (i % 7 + 1)) for i in range(500))
    trie, got = exact_trie.Trie(lambda a, b: a < b), Counter()
    for i, key in enumerate(keys):
        trie.insert(key, i, 1, 1)
        for k, x in trie.passed(key[: exact_trie.HEAD]):
            assert k[: exact_trie.HEAD] < key[: exact_trie.HEAD]
            got[k] += x.n
    for k, x in trie.everything():
        got[k] += x.n
    assert got == Counter(keys)


def test_texts_of_one_length_and_hash_stay_apart():
    trie = exact_trie.Trie(lambda a, b: a > b)
    for i, text in enumerate((b"aa", b"ab", b"aa", b"a")):
        trie.insert(b"\0" * 16 + text, i, 1, 1)
    assert {k[16:]: (x.n, x.best) for k, x in trie.everything()} == {b"aa": (2, 2), b"ab": (1, 1), b"a": (1, 3)}


def brute_exact(rows, largest=True):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out, done = [], set()
    for i, t in rows:
        ids = [x for x in groups[lower(t)] if x is not None]
        keep = (max if largest else min)(ids) if ids else None
        first = (i, lower(t)) not in done
        done.add((i, lower(t)))
        out.append((i, keep, len(groups[lower(t)]), i == keep and first, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("held", [exact_trie.HELD, 500])
def test_exact_duplicates(spark, monkeypatch, largest, held):
    real = exact_trie.shared_texts
    monkeypatch.setattr(exact_trie, "shared_texts", lambda *a: real(*a, held=held))
    rng = random.Random(3)
    rows = [(i, rng.choice(["", None, "Aa", "aA", "É", "é", "x y", "x  y", "long " * 3000, "LONG " * 3000, f"t{i}", f"t{i % 40}"])) for i in range(400)]
    rows += [(7, "one"), (7, "one"), (7, "ONE"), (None, "one"), (None, "two"), (None, "TWO"), (401, "hot")] + [(1000 + i, "hot") for i in range(500)]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, keep_id string, head int").repartition(7)
    got = exact_trie.exact_duplicates(df, largest=largest)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_exact(rows, largest)
    stays = exact_trie.deduplicated(df, largest=largest)
    assert stays.columns == df.columns
    kept = [r for r in brute_exact(rows, largest) if r[3]]
    assert sorted((r.doc_id, hashlib.sha256(lower(r.text).encode()).hexdigest()) for r in stays.collect() if r.doc_id is not None) == sorted((r[0], r[4]) for r in kept if r[0] is not None)
    assert stays.count() == len(kept) == len({lower(t) for _, t in rows})


def test_exact_duplicates_of_nothing_and_by_text_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_trie.exact_duplicates(empty).count() == 0
    named = spark.createDataFrame([("b", "x"), ("a", "X"), ("c", "y")], "doc_id string, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_trie.exact_duplicates(named).collect()} == {("b", "b", True), ("a", "b", False), ("c", "c", True)}


# Resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, max_n):
    words = WORDS.findall(lower(text))
    return words, [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def brute_resample(docs, target, buckets, max_n, seed, min_words, percent):
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(at, features(text, max_n)[1]))
    for text in target:
        t.update(map(at, features(text, max_n)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        words, fs = features(text, max_n)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[at(f)] for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    open_ = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(open_[: percent * len(open_) // 100])}
    return sorted((*r[:4], rank.get(id(r))) for r in out if r[0] is not None)


@pytest.mark.parametrize(("max_n", "held"), [(1, resample.HELD), (3, resample.HELD), (2, 2000)])
def test_resampling(spark, monkeypatch, max_n, held):
    for name in ("bucket_counts", "weights"):
        real = getattr(resample, name)
        monkeypatch.setattr(resample, name, lambda *a, real=real: real(*a, held=held))
    rng = random.Random(max_n)
    word = lambda: rng.choice(["the", "The", "of", "été", "x1", "7", "日本", "a" * 3000]) if rng.random() < 0.6 else f"w{rng.randrange(300)}"
    sep = lambda: rng.choice([" ", "\n", ", ", "\x00", "-", "{", "\x7f"])
    text = lambda n: "".join(word() + sep() for _ in range(n))
    docs = [(i, text(rng.randrange(40))) for i in range(-5, 200)] + [(1000, None), (1001, ""), (1002, " .;"), (1003, text(5000)), (None, text(30))]
    target = [text(20), None, "", "the the of"]
    df = spark.createDataFrame([(i, t, "r", 1) for i, t in docs], "doc_id long, text string, rank string, weight int").repartition(5)
    got = resample.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), max_n=max_n, buckets=97, min_words=20, percent=30)
    want = brute_resample(docs, target, 97, max_n, 2024, 20, 30)
    assert sorted(tuple(r) for r in got.collect() if r.doc_id is not None) == want
    assert got.count() == len(docs)


def test_resampling_of_repeats_and_nothing(spark):
    one = "a b c d e f g h i j k l m n o p q r s t u"
    df = spark.createDataFrame([(1, one)] * 30, "doc_id long, text string")
    target = spark.createDataFrame([], "text string")
    got = resample.resampled(df, target).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3] and len({r["score"] for r in got}) == 1
    assert resample.resampled(df.where("false"), target).count() == 0


def test_numbers_of_rows(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS k").repartition(6)
    got = resample.numbered(df, "k", "id").orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 5001))
    assert [(r.k, r.id) for r in got] == sorted((i % 7, i) for i in range(5000))


# Prefix trie


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        convs[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    saved, leaves, children = Counter(), Counter(), Counter()
    for node, who in members.items():
        ends = any(len(convs[c]) > len(node) for c in who)
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(who) - 1) * (len(node[-1][1].encode()) if node else 0)
            leaves[node[:d]] += not ends
        if node:
            children[node[:-1]] += 1
    out = []
    for node, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(convs[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(who), len(node), parent, len(who), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_prefix_trie(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE", 16)
    rng = random.Random(seed)
    turn = lambda: (rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "ab", "b", "", None, "é"]))
    rows = []
    for c in [*range(-12, 60), 10**15, 10**15 + 1]:
        if rng.random() < 0.8:
            n = rng.randint(1, 14)
            rows += [(c, rng.choice([k, k]) if k else None, *turn()) for k in range(n)]
    rows += [(200 + i, k, "user", "same") for i in range(100) for k in range(12)] + [(77, k, *turn()) for k in range(300)]
    rows += [(None, 0, "user", "lost"), (301, 0, None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], "conv_id long, turn long, role string, text string, family string, depth int")
    got = prefix_trie.prefix_trie(df.repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0], r[1])) == sorted(brute_trie(rows), key=lambda r: (r[0], r[1]))


def test_prefix_trie_of_repeats_and_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(5, 1, "u", "x")] * 3 + [(10, 1, "u", "x"), (10, 1, "u", "x")]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, schema)).collect()
    assert sorted(tuple(r) for r in got) == brute_trie(rows)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
