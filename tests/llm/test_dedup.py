"""Near-duplicates of texts, vectors and images against brute force."""

import itertools
import random

import numpy as np
import pytest

from rollbook.llm import buckets, lattice_hash, media, minhash
from rollbook.llm.graph import connected_components


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, width):
    words = (text or "").encode().lower().split()
    n = min(width, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()


def brute(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = components(sets, links)
    return {i: (len(sets[i]), comp[i]) for i in sets}


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randint(3, 60))) for _ in range(n // 3)]
    while len(texts) < n:
        words = rng.choice(texts).split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    return list(enumerate(texts))


@pytest.mark.parametrize("width", [2, 5])
def test_texts_against_brute_force(spark, width):
    rows = [*corpus(width), (900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "é"), (906, "É"), (907, "w " * 20_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, kept int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, width, 80).collect()}
    want = brute(rows, width, 80)
    assert got == want
    assert want[904][1] == 903 and want[906][1] == 906


def test_texts_repeated_and_null_ids_and_none(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (5, "x y z"), (7, "x y z"), (None, "x y z"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df, 2, 80).collect()), key=repr)
    assert got == sorted([(5, 5, True)] * 3 + [(7, 5, False), (None, 5, False), (None, None, True)], key=repr)
    assert minhash.near_duplicates(df.limit(0), 2, 80).count() == 0


def test_large_buckets_are_settled(spark, monkeypatch):
    """A base, its near copies, and copies of copies that the base itself is too far from."""
    monkeypatch.setattr(buckets, "LARGE", 4)
    monkeypatch.setattr(buckets, "BLOCK", 3)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        words = list(base) if i < 25 else rows[rng.randint(1, i - 1)][1].split()
        for _ in range(rng.randint(1, 9)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 2, 80).collect()}
    assert got == brute(rows, 2, 80)


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(0)
    shared, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 200, 200))
    ra, rb = minhash.registers(np.concatenate([shared, a])), minhash.registers(np.concatenate([shared, b]))
    got = minhash.estimate(ra[None], rb[None], np.array([1000]), np.array([1000]))[0]
    assert abs(got - 800 / 1200) < 0.15
    assert 0 < minhash.chance_agreement(np.array([1000]), np.array([1000]))[0] < 0.01


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (5, 5), (102, 101), (102, 101)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert connected_components(df.limit(0)).count() == 0


def vectors(n, dims, seed, noise):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, dims))
    return [v.tolist() for v in np.concatenate([base[rng.integers(0, 6, n // 2)] + rng.normal(size=(n // 2, dims)) * noise, rng.normal(size=(n - n // 2, dims))])]


@pytest.mark.parametrize(("noise", "heavy"), [(0.1, 64), (0.15, 4)])
def test_vectors_against_brute_force(spark, monkeypatch, noise, heavy):
    monkeypatch.setattr(lattice_hash, "HEAVY", heavy)
    good = vectors(150, 24, 5, noise)
    rows = list(enumerate(good)) + [(500, good[0]), (501, [x * 2 for x in good[1]]), (600, None), (601, [0.0] * 24), (602, [float("nan")] * 24), (603, [1.0, None]), (604, [])]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice_hash.near_duplicates(df).collect()}
    usable = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a, b in itertools.combinations(usable, 2) if usable[a] @ usable[b] >= 0.9]
    found, want = sum(n for n, _ in got.values()), 2 * len(links)
    assert 0.97 * want <= found <= want
    n = {i: sum(i in link for link in links) for i in got}
    assert all(got[i][0] <= n[i] for i in got)
    comp = components(got, links)
    assert np.mean([got[i][1] == comp[i] for i in got]) > 0.97
    assert all(got[i] == (0, i) for i in (600, 601, 602, 603, 604))
    assert lattice_hash.near_duplicates(df.limit(0)).count() == 0


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(200, 8)) * 2
    p = lattice_hash.decode(y)
    assert (np.abs(p * 2 - np.rint(p * 2)) < 1e-9).all() and (np.abs(p.sum(axis=1) % 2) < 1e-9).all()
    near = p[:, None] + lattice_hash.shortest()[None]
    assert (((y - p) ** 2).sum(axis=1) <= ((y[:, None] - near) ** 2).sum(axis=2).min(axis=1) + 1e-9).all()


def test_images_cropped_and_edited(spark):
    rng = np.random.default_rng(2)
    pictures = [media.resized((128 + 40 * rng.normal(size=(10, 10))).astype(np.float32), 96, 96) for _ in range(8)]
    rows = [(k, media.encode_pgm(p)) for k, p in enumerate(pictures)]
    rows += [(20, media.encode_pgm(pictures[0][6:92, 9:90])), (21, media.encode_pgm(pictures[1] * 0.8 + 20)), (22, media.encode_pgm(np.rot90(pictures[2]).copy())), (23, rows[3][1])]
    rows += [(30, None), (31, b""), (32, b"no image"), (33, media.encode_pgm(np.full((50, 50), 7.0))), (None, rows[4][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "media_id long, image binary")
    got = {r.media_id: r.component_id for r in media.copies(df).collect()}
    assert [got[k] for k in range(8)] == list(range(8))
    assert (got[20], got[21], got[22], got[23]) == (0, 1, 2, 3)
    assert all(got[k] == k for k in (30, 31, 32, 33)) and got[None] is None
    assert media.copies(df.limit(0)).count() == 0


def textured(seed, side=96):
    rng = np.random.default_rng(seed)
    a = sum(w * media.resized(rng.normal(size=(s, s)).astype(np.float32), side, side) for s, w in ((6, 1.0), (12, 0.7), (24, 0.5), (48, 0.3)))
    return np.rint((a - a.min()) / (a.max() - a.min()) * 255).astype(np.float32)


def cut(a, share):
    k = int(len(a) * share)
    at = (len(a) - k) // 3
    return a[at : at + k, at : at + k]


EDITS = {
    "scaled to 0.8": lambda a: media.resized(a, int(len(a) * 0.8), int(len(a) * 0.8)),
    "scaled to 2": lambda a: media.resized(a, 2 * len(a), 2 * len(a)),
    "noise of 8": lambda a: np.clip(a + np.random.default_rng(9).normal(0, 8, a.shape), 0, 255),
    "blurred": lambda a: media._blurred(a, 1),
    "darker": lambda a: np.clip(a * 0.8 + 20, 0, 255),
    "turned by 90 degrees": lambda a: np.rot90(a).copy(),
}


@pytest.mark.parametrize("edit", EDITS)
def test_recall_of_edited_images(edit):
    found = 0
    for seed in range(30):
        a = textured(seed)
        p, q = media.corners(a), media.corners(np.rint(EDITS[edit](a)).astype(np.float32))
        found += media.consensus(p, q) >= media.CONSENSUS and len(np.intersect1d(media.table_keys(p), media.table_keys(q))) > 0
    assert found >= 27


def test_all_corners_are_described():
    """Each peak of the response, however large the picture; a half of the picture has the corners that lie in it."""
    for side in (96, 400):
        a = textured(1, side)
        got = media.corners(a)
        first = got[got["scale"] == 1]
        b = media._blurred(a, 1)
        gy, gx = np.gradient(b)
        xx, yy, xy = media._blurred(gx * gx, 2), media._blurred(gy * gy, 2), media._blurred(gx * gy, 2)
        r, k = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2, media.RADIUS
        peaks = {(x, y) for y in range(k, side - k) for x in range(k, side - k) if r[y, x] > 1e-3 and r[y, x] >= r[y - 2 : y + 3, x - 2 : x + 3].max()}
        assert {(int(x), int(y)) for x, y in zip(first["x"], first["y"], strict=True)} == peaks and len(first) == len(peaks) > 13
    half = media.corners(a[:, : side // 2])
    deep = lambda p: {(int(x), int(y)) for x, y in zip(p["x"], p["y"], strict=True) if x < side // 2 - 2 * media.RADIUS}
    assert deep(half[half["scale"] == 1]) == deep(first)


def test_cut_pictures_are_found(monkeypatch):
    pictures = [textured(seed) for seed in range(30)]
    for share in (0.7, 0.5):
        pairs = [(media.corners(a), media.corners(cut(a, share))) for a in pictures]
        assert sum(media.consensus(p, q) >= media.CONSENSUS and len(np.intersect1d(media.table_keys(p), media.table_keys(q))) > 0 for p, q in pairs) >= 27
    # Pairs in batches and one by one, in one go and in parts, say the same; unrelated pictures are not linked.
    pairs += [(media.corners(a), media.corners(b)) for a, b in zip(pictures, pictures[1:], strict=False)] + [(pairs[0][0], np.empty(0, media.POINT))]
    alone = [media.consensus(p, q) >= media.CONSENSUS for p, q in pairs]
    assert media.agreed([p.tobytes() for p, _ in pairs], [q.tobytes() for _, q in pairs]).tolist() == alone and not any(alone[30:])
    keys = [media.table_keys(p) for p, _ in pairs]
    monkeypatch.setattr(media, "DISTANCES", 300)
    assert [media.consensus(p, q) >= media.CONSENSUS for p, q in pairs] == alone
    assert all((media.table_keys(p) == k).all() for (p, _), k in zip(pairs, keys, strict=True))


def test_images_against_brute_force(spark):
    pictures = [textured(k, 72) for k in range(10)]
    pictures += [EDITS["blurred"](pictures[0]), EDITS["darker"](pictures[0]), cut(pictures[1], 0.8), EDITS["scaled to 0.8"](pictures[2]), *(EDITS["noise of 8"](pictures[3]) for _ in range(3))]
    pictures = [np.rint(p).astype(np.float32) for p in pictures]
    df = spark.createDataFrame([(k, media.encode_pgm(p)) for k, p in enumerate(pictures)], "media_id long, image binary")
    got = {r.media_id: r.component_id for r in media.copies(df).collect()}
    points = [media.corners(p) for p in pictures]
    links = [(a, b) for a, b in itertools.combinations(range(len(points)), 2) if max(media.consensus(points[a], points[b]), media.consensus(points[b], points[a])) >= media.CONSENSUS]
    assert got == components(range(len(points)), links) and len(links) >= 8


def test_vectors_that_meet_by_chance_are_not_kept(spark, monkeypatch):
    """Unrelated vectors and a few copies: what is written down has a row for each vector, or for each pair that is nearly linked."""
    kept = []

    def counted(df, of=lattice_hash.checkpointed):
        out = of(df)
        kept.append(out.count())
        return out

    monkeypatch.setattr(lattice_hash, "checkpointed", counted)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 32))
    x[500:] = x[:100] + rng.normal(size=(100, 32)) * 0.05
    got = lattice_hash.near_duplicates(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == {k: (int(k < 100 or k >= 500), k - 500 if k >= 500 else k) for k in range(600)}
    assert max(kept) <= 600


def test_planes_part_no_linked_vectors():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 20_000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    apart = lambda c: np.bitwise_count((lattice_hash.sides(a) ^ lattice_hash.sides(c * a + np.sqrt(1 - c * c) * b)).view(np.uint64)).sum(axis=1)
    limit = lattice_hash.most_apart(float(np.arccos(0.9)))
    assert apart(0.9).max() <= limit and (apart(0.0) > limit).mean() > 0.98
