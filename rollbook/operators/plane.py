"""Points on the globe: nearest neighbours by grids in space, spellings that are one point, boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RADIUS_KM = 6371.0088
#: Halvings of the widest cell, whose side is the greatest distance that counts.
LEVELS = 7
#: Spots of a cell that are held against a point at once.
TILE = 256


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    half = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(half, F.lit(1.0))))


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Whether a point lies in a box, edges included; a box with west beyond east crosses the date line. Null points lie in none."""
    wide = (lon >= west) & (lon <= east) if west <= east else (lon >= west) | (lon <= east)
    return F.coalesce((lat >= south) & (lat <= north) & wide, F.lit(False))


def _cells(side: float) -> list[Column]:
    """The cell of a point in space, from columns lat and lon: poles and the date line are no edges there."""
    lat, lon = F.radians("lat"), F.radians("lon")
    return [F.floor(RADIUS_KM * x / side) for x in (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))]


def _around() -> Column:
    """The 27 cells round a cell (x, y, z), itself among them."""
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    return F.inline(F.array(*(F.struct((F.col("x") + a).alias("cx"), (F.col("y") + b).alias("cy"), (F.col("z") + c).alias("cz")) for a, b, c in steps)))


def _sides(most_km: float) -> list[float]:
    return [most_km * (1 + 1e-9) / 2**k for k in range(LEVELS)]  # a hair wider, for what lies on an edge


def nearest_places(points: DataFrame, refs: DataFrame, point: str, ref: str, label: str, k: int = 5, most_km: float = 20.0) -> DataFrame:
    """(point, ref, label, km, place): the k nearest references of each point within most_km, of equal distances those of the least ids.

    points (point, lat, lon), refs (ref, label, lat, lon). Straight lines through the globe order points as the ways over it do, so cells are
    cubes in space. There are grids of LEVELS sides, each half the one before. All within a side of a point lies in the 27 cells round it; if these hold k
    references, the k nearest are no further than a side four times as long, so the grid two levels wider has all of them. Each point asks the
    finest grid for which that is known: where references are dense, small cells are asked, where they are sparse the ring grows, up to most_km.

    Which grid that is depends on the cell, so it is found once for each cell that has points, with a distance within which k references are
    known to lie. What the ring of an asking cell holds is gathered in tiles of some TILE spots of each cell; a point takes the k best of a tile on the
    spot, so only these are written and sorted, not its pairs with all references around. References on one spot go as one with
    their k least ids: of more no point can need any. Points or references without a place are left out; a point that none is near has no row.
    """
    spot = refs.select(F.col(ref).alias("ref"), F.col(label).alias("label"), "lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL")
    first = F.row_number().over(W.partitionBy("lat", "lon").orderBy("ref"))
    spots = spot.withColumn("first", first).where(F.col("first") <= k).groupBy("lat", "lon").agg(F.collect_list(F.struct("ref", "label")).alias("held"))
    sides, cell, ring = _sides(most_km), ["level", "x", "y", "z"], ["level", "cx", "cy", "cz"]
    levels = lambda: F.inline(F.array(*(F.struct(F.lit(n).alias("level"), *(c.alias(a) for c, a in zip(_cells(s), "xyz", strict=True))) for n, s in enumerate(sides))))
    gridded = spots.select("*", levels())
    counts = gridded.groupBy(*cell).agg(F.sum(F.size("held")).alias("n"), F.count("*").alias("spots"))
    tile = F.pmod(F.xxhash64("lat", "lon"), F.ceil(F.col("spots") / TILE)).alias("tile")
    tiles = gridded.join(counts, cell).groupBy(*(F.col(a).alias(b) for a, b in zip(cell, ring, strict=True)), tile).agg(F.collect_list(F.struct("lat", "lon", "held")).alias("spots"))
    counts = counts.select(*(F.col(a).alias(b) for a, b in zip(cell, ring, strict=True)), "n")
    asking = points.select(F.col(point).alias("point"), "lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL")
    asking = asking.select("*", *(c.alias(a) for c, a in zip(_cells(sides[-1]), ("fx", "fy", "fz"), strict=True)))
    # Sides are halves, so a cell of any grid comes from the finest by a shift.
    up = lambda n: [F.shiftright(f, LEVELS - 1 - n).alias(a) for f, a in zip(("fx", "fy", "fz"), "xyz", strict=True)]
    homes = asking.select("fx", "fy", "fz").distinct().select("*", F.inline(F.array(*(F.struct(F.lit(n).alias("level"), *up(n)) for n in range(LEVELS)))))
    full = homes.select(*cell).distinct().select(*cell, _around()).join(counts, ring).groupBy(*cell).agg(F.sum("n").alias("n")).where(F.col("n") >= k)
    grid = homes.join(full.select(*cell), cell).groupBy("fx", "fy", "fz").agg(F.max("level").alias("full"))
    # Two cells that touch lie within two diagonals of each other, as the straight line goes.
    sure = F.array(*(F.lit(min(most_km, 2 * RADIUS_KM * math.asin(min(1.0, math.sqrt(3) * s / RADIUS_KM)) * (1 + 1e-9))) for s in sides))
    known = F.col("full").isNotNull()
    placed = asking.join(grid, ["fx", "fy", "fz"], "left").withColumns({"level": F.when(known, F.greatest(F.col("full") - 2, F.lit(0))).otherwise(0), "sure": F.when(known, F.element_at(sure, F.col("full") + 1)).otherwise(most_km)})
    own = F.element_at(F.array(*(F.struct(*up(n)) for n in range(LEVELS))), F.col("level") + 1)
    placed = placed.withColumn("own", own).select("point", F.col("lat").alias("plat"), F.col("lon").alias("plon"), "sure", "level", "own.*")
    around = placed.select(*cell).distinct().select(*cell, _around()).join(tiles, ring).groupBy(*cell, "tile").agg(F.flatten(F.collect_list("spots")).alias("spots"))
    far = F.transform("spots", lambda s: F.struct(haversine_km(F.col("plat"), F.col("plon"), s["lat"], s["lon"]).alias("km"), s["held"].alias("held")))
    near = F.filter(far, lambda s: s["km"] <= F.col("sure"))
    each = F.flatten(F.transform(near, lambda s: F.transform(s["held"], lambda h: F.struct(s["km"].alias("km"), h["ref"].alias("ref"), h["label"].alias("label")))))
    best = placed.join(around, cell).select("point", F.inline(F.slice(F.sort_array(each), 1, k)))
    ranked = best.withColumn("place", F.row_number().over(W.partitionBy("point").orderBy("km", "ref"))).where(F.col("place") <= k)
    return ranked.select(F.col("point").alias(point), F.col("ref").alias(ref), F.col("label").alias(label), "km", "place")


def nearest_vote(points: DataFrame, refs: DataFrame, point: str, ref: str, label: str, k: int = 5, most_km: float = 20.0) -> DataFrame:
    """(point, label, votes): the commonest label of the k nearest references within most_km; of equal counts the least label."""
    near = nearest_places(points, refs, point, ref, label, k, most_km).groupBy(point, label).agg(F.count("*").alias("votes"))
    best = near.groupBy(point).agg(F.min(F.struct((-F.col("votes")).alias("less"), F.col(label).alias("label"), "votes")).alias("b"))
    return best.select(point, F.col("b.label").alias(label), F.col("b.votes").alias("votes"))


def one_point(spellings: DataFrame, entry: str, name: str, n: str, standing: str, digits: int = 5) -> DataFrame:
    """(key, label, spellings, n, lat, lon, standing): the spellings that the review sent to one entry, or to one rounded point, as one place.

    spellings (entry, name, n, standing, lat, lon), a row for each spelling. The key is the entry, else the point; the label the spelling with most
    records, of these the least; one confirmed spelling confirms the place. Spellings without a point are left out.
    """
    rows = spellings.where("lat IS NOT NULL AND lon IS NOT NULL")
    point = F.format_string(f"%.{digits}f,%.{digits}f", F.col("lat"), F.col("lon"))
    rows = rows.select(F.coalesce(F.col(entry).cast("string"), point).alias("key"), F.col(name).alias("s"), F.col(n).alias("c"), F.col(standing).alias("standing"), "lat", "lon")
    per = rows.groupBy("key", "s").agg(F.sum("c").alias("c"), F.max(F.col("standing") == "confirmed").alias("ok"), F.min(F.struct("lat", "lon")).alias("at"))
    out = per.groupBy("key").agg(F.min(F.struct((-F.col("c")).alias("less"), "s")).alias("top"), F.count("*").alias("spellings"), F.sum("c").alias("n"), F.min("at").alias("at"), F.max("ok").alias("ok"))
    return out.select("key", F.col("top.s").alias("label"), "spellings", "n", "at.lat", "at.lon", F.when(F.col("ok"), "confirmed").otherwise("open").alias("standing"))
