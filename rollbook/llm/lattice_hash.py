"""Near-duplicate embeddings by E8 lattice hashing, multi-probe search and exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table
from .graph import connected_components

THRESHOLD = 0.9
#: Tables (random projections to 8 dimensions), and cells that a vector asks besides its own in each.
TABLES = 22
PROBES = 8
#: Standard deviation of a projected unit vector's coordinates, in lattice units. With these three a pair at cosine 0.9 meets
#: with a chance of over 0.9, one at 0.95 of over 0.999, and unrelated vectors of 64 dimensions once in some thousand pairs.
SCALE = 1.2
#: A cell of one of the first PIVOT_TABLES tables with so many vectors gives a pivot.
HEAVY = 64
PIVOT_TABLES = 4
#: Tables that are joined at a time.
ROUND = 4
#: Sides of so many random planes, by which most vectors that meet are told apart before anything is kept of them; a pair at the
#: threshold is on other sides of more planes than a limit with a chance of CHANCE at most.
PLANES = 128
CHANCE = 1e-9
SEED = 8


@lru_cache(maxsize=16)
def projections(dims: int) -> np.ndarray:
    """(dims, TABLES * 8), the same on every machine."""
    return np.random.default_rng([SEED, dims]).normal(size=(dims, TABLES * 8)) * SCALE


@lru_cache(maxsize=1)
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in product(range(8), range(8)):
        if j < i:
            for a, b in product((1.0, -1.0), repeat=2):
                v = np.zeros(8)
                v[i], v[j] = a, b
                out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum: round, and where the sum is odd round the worst one the other way."""
    r = np.rint(y)
    e = y - r
    worst = np.abs(e).argmax(axis=1)
    at = np.arange(len(y))
    r[at, worst] += np.where(r.sum(axis=1) % 2 != 0, np.where(e[at, worst] >= 0, 1.0, -1.0), 0.0)
    return r


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest E8 points of the rows of y: the nearer of D8's and of shifted D8's."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    nearer = ((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


_MULT = np.random.default_rng([SEED, 1]).integers(1, 2**63, 9, dtype=np.uint64) | np.uint64(1)


def _cell_key(points: np.ndarray, table_no: int, dims: int) -> np.ndarray:
    """64-bit keys of lattice points of a table."""
    x = np.rint(points * 2).astype(np.int64).view(np.uint64)
    h = np.full(len(x), table_no * 65_537 + dims + 1, np.uint64) * _MULT[8]
    for k in range(8):
        h = (h ^ (x[:, k] * _MULT[k])) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.asarray(h).view(np.int64)


@lru_cache(maxsize=16)
def planes(dims: int) -> np.ndarray:
    return np.random.default_rng([SEED, dims, 2]).normal(size=(dims, PLANES))


def sides(x: np.ndarray) -> np.ndarray:
    """(n, PLANES / 64): on which sides of the planes the rows of x lie, as bits."""
    return np.packbits(x @ planes(x.shape[1]) > 0, axis=1).view(np.int64)


def most_apart(angle: float) -> int:
    """The least number of planes that part two vectors at an angle with a chance of 1 - CHANCE or more at most."""
    p = angle / math.pi
    tail, k = 0.0, PLANES
    while k and (tail := tail + math.comb(PLANES, k) * p**k * (1 - p) ** (PLANES - k)) <= CHANCE:
        k -= 1
    return k


def cells(x: np.ndarray, tables: range = range(TABLES)) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the cells of unit vectors x: own (n, tables), and asked (n, tables, PROBES), the nearest neighbouring points."""
    n, dims = x.shape
    y = x @ projections(dims)
    own, asked = np.empty((n, len(tables)), np.int64), np.empty((n, len(tables), PROBES), np.int64)
    for i, t in enumerate(tables):
        part = y[:, t * 8 : t * 8 + 8]
        p = decode(part)
        own[:, i] = _cell_key(p, t, dims)
        gain = (part - p) @ shortest().T
        best = np.argpartition(-gain, PROBES, axis=1)[:, :PROBES]
        for k in range(PROBES):
            asked[:, i, k] = _cell_key(p + shortest()[best[:, k]], t, dims)
    return own, asked


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, hash of the vector, dims, unit vector as bytes); no vector: dims 0."""
    for b in batches:
        hi, lo, dims, unit = [], [], [], []
        for v in b.column(1).to_pylist():
            x = np.array(v, float) if v and None not in v else np.empty(0)
            x = x if np.isfinite(x).all() else np.empty(0)
            top = np.abs(x).max(initial=0.0)
            x = x / top if top > 0 else np.empty(0)
            x = x / np.sqrt((x * x).sum()) if len(x) else x
            d = xxhash.xxh3_128_digest(np.array(v, float).tobytes() if len(x) else b"")
            hi.append(int.from_bytes(d[:8], "big", signed=True))
            lo.append(int.from_bytes(d[8:], "big", signed=True))
            dims.append(len(x))
            unit.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(dims, pa.int32()), pa.array(unit, pa.binary())], ["id", "hi", "lo", "dims", "unit"])


def _keyed(reps: DataFrame, tables: range) -> DataFrame:
    """(rep, own, asked, s, z) of reps (rep, dims, unit): the cells in some tables, and the sides of the planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                dims = b.column(1).to_numpy()
                units = b.column(2).to_pylist()
                for d in np.unique(dims):
                    rows = np.flatnonzero(dims == d)
                    x = np.frombuffer(b"".join(units[i] for i in rows), float).reshape(len(rows), d)
                    own, asked = cells(x, tables)
                    side = sides(x)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(rows)), pa.array(list(own), pa.list_(pa.int64())), pa.array(list(asked.reshape(len(rows), -1)), pa.list_(pa.int64())), pa.array(side[:, 0]), pa.array(side[:, 1])],
                        ["rep", "own", "asked", "s", "z"],
                    )

    return reps.select("rep", "dims", "unit").mapInArrow(run, "rep long, own array<long>, asked array<long>, s long, z long")


def _near(angle: float, s: str, z: str, to_s: str, to_z: str) -> Column:
    """Whether so few planes part two vectors that they may be within an angle."""
    return F.bit_count(F.col(s).bitwiseXOR(F.col(to_s))) + F.bit_count(F.col(z).bitwiseXOR(F.col(to_z))) <= most_apart(angle)


def _cosine(a: str, b: str) -> Column:
    @F.pandas_udf("double")
    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([float(np.dot(np.frombuffer(u, float), np.frombuffer(v, float))) if len(u) == len(v) else -2.0 for u, v in zip(x, y, strict=True)], dtype=float)

    return cosine(a, b)


def _pivots(index: DataFrame, units: DataFrame) -> DataFrame:
    """(key, n, centre, to_s, to_z): the mean direction of each heavy cell; summed in the tasks first, so a heavy cell is no heavy task."""
    heavy = index.groupBy("key").agg(F.count("*").alias("n")).where(f"n >= {HEAVY}")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["key", "part"])
            sums.clear()
            return got

        for b in batches:
            for key, unit in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.frombuffer(unit, float)
                sums[key] = sums[key] + v if key in sums else v
                if len(sums) >= 20_000:
                    yield out()
        yield out()

    def total(rows: pa.Table) -> pa.Table:
        parts = sorted(x for x in rows["part"].to_pylist())
        v = np.sum([np.frombuffer(p, float) for p in parts], axis=0)
        norm = np.sqrt((v * v).sum())
        v = v / norm if norm > 0 else v
        side = sides(v[None])
        return pa.table({"key": rows["key"].combine_chunks()[:1], "centre": pa.array([v.tobytes()], pa.binary()), "to_s": pa.array(side[:, 0]), "to_z": pa.array(side[:, 1])})

    members = index.join(heavy, "key").join(units, "rep").select("key", "unit")
    return members.mapInArrow(partial, "key long, part binary").groupBy("key").applyInArrow(total, "key long, centre binary, to_s long, to_z long").join(heavy, "key")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors: links have a cosine of at least threshold, in doubles.

    Equal vectors form a class first. A class lies in one cell of each table and asks the nearest cells around it; classes
    that meet are compared by their true cosine. Groups: a heavy cell's mean direction is a pivot, and classes within half
    the threshold's angle of it are its core, which are linked with each other by the triangle inequality. So core pairs are
    counted, not made, and a group of near copies costs its size. Pairs with a class outside the core are searched as others. Of classes
    that meet by chance, whose number grows with the square of the rows, nothing is kept: planes part them in the join. The tables are
    joined a few at a time.

    Null, empty and zero vectors and those with null or non-finite components: no links, a component of their own. Vectors of
    other lengths are not compared. Null vec_id: linked with nothing. Repeated rows (id and vector) count once and get equal
    results; an id with several vectors has the component of the least id that any of them reaches. Empty table: no rows.
    """
    every = vectors.select(F.col(id_col).cast("long").alias("id"), vector_col).mapInArrow(_unit, "id long, hi long, lo long, dims int, unit binary")
    rows = checkpointed(every.drop("unit"))
    usable = rows.where("dims > 0 AND id IS NOT NULL")
    reps = every.where("dims > 0 AND id IS NOT NULL").groupBy("hi", "lo").agg(F.min("id").alias("least"), F.countDistinct("id").alias("weight"), F.first("dims").alias("dims"), F.first("unit").alias("unit"))
    reps = checkpointed(reps.withColumn("rep", F.col("hi")))
    units = reps.select("rep", "unit")
    # Cores. The margin keeps rounding from calling a pair linked that is not.
    angle = float(np.arccos(threshold))
    half = float(np.cos(angle / 2 - 1e-7))
    heads = checkpointed(_keyed(reps, range(PIVOT_TABLES)))
    index = heads.select("rep", F.explode("own").alias("key"))
    pivots = checkpointed(_pivots(index, units))
    close = heads.select("rep", "s", "z", F.explode(F.concat("own", "asked")).alias("key")).join(pivots.drop("centre"), "key").where(_near(angle / 2, "s", "z", "to_s", "to_z"))
    close = close.select("rep", "key", "n").join(pivots.select("key", "centre"), "key").join(units, "rep")
    core = close.where(_cosine("unit", "centre") >= half).groupBy("rep").agg(F.max(F.struct("n", "key")).alias("top")).select("rep", F.col("top.key").alias("pivot"))
    core = checkpointed(core)
    met = []
    for at in range(0, TABLES, ROUND):
        keyed = checkpointed(_keyed(reps, range(at, min(at + ROUND, TABLES))).join(core, "rep", "left"))
        index = keyed.select(F.explode("own").alias("key"), F.col("rep").alias("y"), F.col("pivot").alias("py"), F.col("s").alias("to_s"), F.col("z").alias("to_z"))
        asked = keyed.select(F.explode(F.concat("own", "asked")).alias("key"), F.col("rep").alias("x"), F.col("pivot").alias("px"), "s", "z")
        several = asked.where("px IS NOT NULL").select("key", F.col("px").alias("p")).unionAll(index.where("py IS NOT NULL").select("key", F.col("py").alias("p")))
        several = several.groupBy("key").agg(F.min("p").alias("a"), F.max("p").alias("z")).where("a <> z").select("key")
        found = [
            asked.where("px IS NULL").drop("px").join(index.drop("py"), "key"),
            asked.where("px IS NOT NULL").drop("px").join(index.where("py IS NULL").drop("py"), "key"),
            asked.where("px IS NOT NULL").join(several, "key").join(index.where("py IS NOT NULL"), "key").where("px <> py"),
        ]
        near = [f.where((F.col("x") != F.col("y")) & _near(angle, "s", "z", "to_s", "to_z")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")) for f in found]
        met.append(checkpointed(near[0].unionAll(near[1]).unionAll(near[2]).distinct()))
    pairs = reduce(DataFrame.unionAll, met).distinct()
    side = lambda name: units.select(F.col("rep").alias(name), F.col("unit").alias(f"unit_{name}"))
    links = pairs.join(side("a"), "a").join(side("b"), "b").where(_cosine("unit_a", "unit_b") >= threshold).select("a", "b")
    links = checkpointed(links)
    # Neighbours outside the class and outside the core, then those of the core, then the class itself.
    weights = reps.select("rep", "weight", "least")
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    outside = both.join(weights.select(F.col("rep").alias("b"), "weight"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("weight").alias("outside"))
    placed = core.join(weights, "rep")
    groups = placed.groupBy("pivot").agg(F.sum("weight").alias("core_weight"), F.min("rep").alias("first"))
    inside = core.join(groups, "pivot")
    edges = links.unionAll(inside.select(F.col("rep").alias("a"), F.col("first").alias("b")))
    again = usable.groupBy("id").agg(F.min("hi").alias("a"), F.max("hi").alias("z")).where("a <> z")
    edges = edges.unionAll(usable.join(again, "id").where("hi <> a").select("a", F.col("hi").alias("b")))
    comps = connected_components(checkpointed(edges))
    roots = weights.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = roots.groupBy("component").agg(F.min("least").alias("root"))
    facts = roots.join(least, "component").join(outside, "rep", "left").join(inside.select("rep", "core_weight"), "rep", "left")
    n = F.coalesce("core_weight", "weight") - 1 + F.coalesce("outside", F.lit(0))
    facts = facts.join(reps.select("rep", "hi", "lo"), "rep").select("hi", "lo", n.alias("n_links"), "root")
    out = rows.join(facts, ["hi", "lo"], "left")
    linked = F.col("id").isNotNull() & (F.col("dims") > 0)
    root = F.when(linked, F.coalesce("root", "id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias("vec_id"), F.when(linked, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
