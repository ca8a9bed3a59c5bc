"""Near-duplicate documents by HyperMinHash registers, banding and verification on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import settle, shared_buckets
from .common import checkpointed, table

#: Registers of a signature, 16 bits each: 6 for the leading zeros of the least hash, 10 for the bits after them.
REGISTERS = 128
MANTISSA = 10
#: Registers of a band. At a similarity of 0.8 a band agrees with probability 0.41, and one of 32 bands with 1 - 5e-8.
ROWS = 4
BANDS = REGISTERS // ROWS
#: Estimates below this are not verified: 0.8 less 5.7 standard deviations of an estimate from 128 registers.
LEAST_ESTIMATE = 0.6
#: Ids up to which the ids whose texts are read again are broadcast (32 bytes each); beyond, they are joined by a shuffle.
BROADCAST_IDS = 2_000_000

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: bytes | None, width: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of all the words as one, if they are fewer than width."""
    words = text.lower().split() if text else []  # bytes.lower() changes A-Z only
    if not words:
        return np.empty(0, np.uint64)
    if len(known) > 500_000:
        known.clear()
    ids = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        ids.append(h)
    h = np.array(ids, np.uint64)
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash: per register the leading zeros of the least permuted hash and the MANTISSA bits that follow."""
    least = np.full(REGISTERS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[i : i + 1024, None] * _A + _B).min(axis=0), out=least)
    fraction, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63).astype(np.uint16)
    mantissa = np.minimum((fraction - 0.5) * 2 ** (MANTISSA + 1), 2**MANTISSA - 1).astype(np.uint16)
    return (zeros << np.uint16(MANTISSA)) | mantissa


def chance_agreement(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of disjoint sets of n and m elements agree, summed over the cells of each zero count."""
    n, m = np.asarray(n, float)[:, None], np.asarray(m, float)[:, None]
    w = 2.0 ** -np.arange(1, 64)
    both = n + m
    return np.minimum((n * m / both * (w / 2**MANTISSA) * (np.exp(-both * w) - np.exp(-2 * both * w))).sum(axis=1), 0.5)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates from the share of equal registers (rows of a and b), corrected for chance agreement."""
    by_chance = chance_agreement(n, m)
    return ((a == b).mean(axis=1) - by_chance) / (1 - by_chance)


def similar(inter: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (n + m - inter)


def _sign(width: int, with_set: bool = False):
    """Batches (id, text) to (id, n_shingles, set hash, registers), and the whole set as bytes if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, hi, lo, regs, sets = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    h = shingle_hashes(text, width, known)
                    d = xxhash.xxh3_128_digest(h.tobytes())
                    n.append(len(h))
                    hi.append(int.from_bytes(d[:8], "big", signed=True))
                    lo.append(int.from_bytes(d[8:], "big", signed=True))
                    regs.append(registers(h).tobytes() if len(h) else b"")
                    if with_set:
                        sets.append(h.tobytes())
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(regs, pa.binary())]
                names = ["id", "n_shingles", "hi", "lo", "regs"]
                if with_set:
                    columns.append(pa.array(sets, pa.binary()))
                    names.append("shingles")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


_SIGNED = "id long, n_shingles long, hi long, lo long, regs binary"


def _estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose registers allow the similarity; reps has (rep, n_shingles, regs)."""

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        rx = np.frombuffer(b"".join(x), np.uint16).reshape(-1, REGISTERS)
        ry = np.frombuffer(b"".join(y), np.uint16).reshape(-1, REGISTERS)
        return pd.Series(estimate(rx, ry, n.to_numpy(), m.to_numpy()) >= LEAST_ESTIMATE)

    side = lambda name: reps.select(F.col("rep").alias(name), F.col("regs").alias(f"regs_{name}"), F.col("n_shingles").alias(f"n_{name}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.where(near("regs_a", "regs_b", "n_a", "n_b")).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among pairs (a, b), from the full sets."""

    @F.pandas_udf("boolean")
    def linked(sa: pd.Series, sb: pd.Series) -> pd.Series:
        out = np.zeros(len(sa), bool)
        for i, (x, y) in enumerate(zip(sa, sb, strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            out[i] = similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)
        return pd.Series(out)

    side = lambda name: sets.select(F.col("rep").alias(name), F.col("shingles").alias(f"set_{name}"))
    # The sets of the members b come first; the pivots a are few and shared by many pairs.
    pivots = side("a").join(pairs.select("a").distinct(), "a", "left_semi")
    both = pairs.join(side("b"), "b").join(pivots, "a")
    return both.where(linked("set_a", "set_b")).select("a", "b")


def _prepare(block: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Registers, sets and set sizes of a block of classes."""
    sets = [np.frombuffer(s, np.uint64) for s in block["shingles"]]
    return np.frombuffer(b"".join(block["regs"]), np.uint16).reshape(-1, REGISTERS), sets, np.array([len(s) for s in sets])


def _compare(percent: int):
    """Positions of a block's classes that one class is linked with: by size, by estimate, then by the full sets."""

    def run(row, others: tuple, near: np.ndarray) -> np.ndarray:
        regs, sets, m = others
        mine = np.frombuffer(row.shingles, np.uint64)
        near = near[similar(np.minimum(m[near], len(mine)), m[near], len(mine), percent)]
        own = np.broadcast_to(np.frombuffer(row.regs, np.uint16), (len(near), REGISTERS))
        near = near[estimate(own, regs[near], np.full(len(near), len(mine)), m[near]) >= LEAST_ESTIMATE]
        inter = [int((mine[np.minimum(np.searchsorted(mine, sets[j]), len(mine) - 1)] == sets[j]).sum()) for j in near]
        return near[similar(np.array(inter, np.int64), len(mine), m[near], percent)]

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, hi, lo, component_id, kept) for each row of docs (doc_id, text).

    A document's set: its distinct word shingles; with fewer words than width, all of them as one. Documents are linked if
    percent * union <= 100 * intersection, checked on the full sets (as 64-bit hashes). component_id is the least doc_id
    that links reach, kept whether that is the row's own.

    How: rows of equal sets form a class. Classes that agree in a band meet in a bucket. In each bucket the class that meets
    most others is the pivot; members are compared with it, not with each other. Buckets that then still hold several
    components are settled exactly (buckets.unsettled_links). So a group of near copies costs its size, and no link between classes that a
    band brings together is left out.

    Null, empty and word-free texts: n_shingles 0, linked with nothing. Null doc_id: a row
    that no id tells apart is no document of its own; it gets the component of the documents of an equal set, or null. Repeated rows each get the same result. Empty table: no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    signed = checkpointed(rows.mapInArrow(_sign(width), _SIGNED))
    reps = signed.where("n_shingles > 0 AND id IS NOT NULL").groupBy("hi", "lo")
    reps = reps.agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("regs").alias("regs"))
    # A class goes by the first half of its set's hash.
    reps = checkpointed(reps.withColumnRenamed("rep", "id").withColumn("rep", F.col("hi")))
    step = 2 * ROWS
    bands = reps.select("rep", F.posexplode(F.array(*(F.substring("regs", 1 + step * i, step) for i in range(BANDS)))).alias("band", "part"))
    bands = bands.select("rep", F.xxhash64("band", "part").alias("bucket"))
    hits = shared_buckets(bands)
    # Full sets of the classes that share a bucket, made again from the texts.
    wanted = checkpointed(hits.select("rep").distinct().join(reps.select("rep", "id", "hi", "lo"), "rep"))
    few = wanted.count() <= BROADCAST_IDS
    asked_for = F.broadcast(wanted) if few else wanted
    texts = rows.join(asked_for.select("id").distinct(), "id", "left_semi")
    sets = texts.mapInArrow(_sign(width, with_set=True), _SIGNED + ", shingles binary").join(asked_for.select("id", "hi", "lo"), ["id", "hi", "lo"], "left_semi")
    if texts.count() > wanted.select("id").distinct().count():  # repeated ids
        sets = sets.dropDuplicates(["hi"])
    sets = checkpointed(sets.select(F.col("hi").alias("rep"), "regs", "shingles"))
    # Several texts under one id are one document.
    several = signed.where("n_shingles > 0 AND id IS NOT NULL").groupBy("id").agg(F.min("hi").alias("a"), F.max("hi").alias("z")).where("a <> z")
    several = signed.where("n_shingles > 0").join(several, "id").where("hi <> a").select("a", F.col("hi").alias("b")).distinct()
    verify = lambda pairs: _verified(checkpointed(_estimated(pairs, reps)), sets, percent)
    comps = settle(hits, sets, verify, _prepare, _compare(percent), several)
    placed = reps.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("hi", "lo", "id", F.coalesce("component", "rep").alias("component"))
    roots = placed.groupBy("component").agg(F.min("id").alias("root"))
    classes = placed.join(roots, "component").select("hi", "lo", "root")
    out = signed.drop("regs").join(classes, ["hi", "lo"], "left")
    root = F.when(F.col("n_shingles") > 0, F.coalesce("root", "id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias("doc_id"), "n_shingles", "hi", "lo", root.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNull()))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")
