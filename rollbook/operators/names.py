"""Names that are spelt in several ways: links inside a district, decisions that pass on to variants, places inside places."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions.cells import loose_key, skeleton

#: Letters of a gram.
GRAM = 2


class Tier(NamedTuple):
    """What makes two names of one district one place: how alike they are, how long both keys are at least, whether the skeletons must be equal."""

    name: str
    alike: float
    length: int = 1
    skeleton: bool = False


#: Strict to loose.
TIERS = (Tier("exact", 1.0), Tier("skeleton", 0.6, 3, True), Tier("close", 0.8, 5))


def alike(a: Column, b: Column) -> Column:
    """1 less the edits between two keys by the longer one's length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def _keyed(df: DataFrame, id_: str, district: str, name: str) -> DataFrame:
    rows = df.select(F.col(id_).alias("id"), F.col(district).alias("district"), F.col(name).alias("name"))
    rows = rows.withColumns({"key": loose_key(F.col("name")), "bones": skeleton(F.col("name"))})
    return checkpointed(rows.where((F.col("key") != "") & F.col("district").isNotNull()).drop("name"))  # each tier reads it


def _grams(rows: DataFrame, least: float) -> DataFrame:
    """(id, district, key, gram): the grams of a key with an edge mark on either side, those that repeat with their number.

    Keys that are alike by less than a half may share no gram; where least is so low, all keys have the empty gram too.
    """
    marked = F.concat(F.lit("^"), F.col("key"), F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.length(marked) - GRAM + 1), lambda k: F.substring(marked, k, F.lit(GRAM)))
    numbered = F.transform("grams", lambda g, k: F.concat(g, F.size(F.filter(F.slice("grams", 1, k + 1), lambda x: x == g)).cast("string")))
    every = F.concat(numbered, F.array(F.lit(""))) if least < 1 - 1 / GRAM else numbered
    return rows.select("id", "district", "key", grams.alias("grams")).select("id", "district", "key", F.explode(every).alias("gram"))


def _prefix(grams: DataFrame, seen: DataFrame, least: float) -> DataFrame:
    """(id, district, key, first, mask): the rarest grams of each key, the rarest first, so many that keys as alike as least share one of them.

    mask has a bit for each gram of the key, of 64 by its hash.

    k edits change GRAM * k grams at most. A key of n letters has partners of n / least letters at most, so the edits between
    them are at most n (1 - least) / least, rounded down; all but GRAM times so many grams are shared, and one among the first ones, in any order
    that both sides follow. With the empty gram each pair shares one, and the same number of first ones holds it: all of them where
    the edits may change all others.
    """
    edits = F.least(F.floor(F.length("key") * ((1 - least) / max(least, 1e-6)) + 1e-9), F.length("key") + 1)
    ranked = grams.join(seen, ["district", "gram"], "left").select("id", "district", "key", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram").alias("gram"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("gram.gram"), F.lit(64)).cast("int"))
    first = ranked.groupBy("id", "district", "key").agg(F.array_sort(F.collect_set("gram"))["gram"].alias("first"), F.bit_or(bit).alias("mask"))
    return first.withColumn("first", F.slice("first", 1, (GRAM * edits + 1).cast("int")))


def similar_pairs(cases: DataFrame, places: DataFrame, least: float, length: int = 1) -> DataFrame:
    """(id, place, district, key, other): pairs of one district whose keys are alike by least or more and have so many letters.

    cases and places: (id, district, key). A similarity join by prefixes: pairs are made only between keys that share one of their
    rarest grams and whose lengths allow it; every pair as alike as least is among them. Both sides follow one order of grams, and a pair
    is taken at the first gram that it shares: it comes once, and nothing keeps the pairs. Of the pairs that share a gram most have too many
    others apart, which their masks tell. Neither side is broadcast: how many grams a small file holds can't be told beforehand.
    """
    grams_c, grams_p = _grams(cases.where(F.length("key") >= length), least), _grams(places.where(F.length("key") >= length), least)
    seen = grams_p.groupBy("district", "gram").agg(F.count("*").alias("n"))
    a = _prefix(grams_c, seen, least).withColumn("gram", F.explode("first"))
    b = _prefix(grams_p, seen, least).withColumnsRenamed({"id": "place", "key": "other", "mask": "marks", "first": "theirs"}).withColumn("gram", F.explode("theirs"))
    # The cheap conditions come first: an edit takes GRAM grams of a key at most, so its edits bound the grams that the other lacks.
    changed = GRAM * F.floor(F.greatest(F.length("key"), F.length("other")) * (1 - least) + 1e-9)
    lacks = lambda x, y: F.bit_count(F.col(x).bitwiseAND(F.bitwise_not(y))) <= changed
    fit = (F.length("key") + 1e-9 >= least * F.length("other")) & (F.length("other") + 1e-9 >= least * F.length("key"))
    near = a.join(b.hint("merge"), ["district", "gram"]).where(
        fit & lacks("mask", "marks") & lacks("marks", "mask") & (alike(F.col("key"), F.col("other")) >= least) & (F.get(F.array_intersect("first", "theirs"), F.lit(0)) == F.col("gram"))
    )
    return near.select("id", "place", "district", "key", "other")


def link_in_district(cases: DataFrame, places: DataFrame, id_: str, place: str, district: str, name: str, tiers: Sequence[Tier] = TIERS) -> DataFrame:
    """(id_, place, tier, candidates) for each row of cases: the place of its district that its name means.

    cases (id_, district, name), places (place, district, name), a place under any number of names. A case takes the first tier under which just one place
    is found; candidates counts the places of the loosest tier that finds any. A case without a district or a key, and one whose tiers
    find none or several, has no place. Equal keys and skeletons meet by equal values, other names by a similarity join: no pair is made outside
    these, and a district is never compared as a whole. Rows of cases that share an id are one case.
    """
    c, p = _keyed(cases, id_, district, name), _keyed(places, place, district, name)
    p = p.withColumnsRenamed({"id": "place", "key": "other", "bones": "theirs"})
    found = []
    for t in tiers:
        if t.alike >= 1:
            found.append(c.join(p.withColumn("key", F.col("other")), ["district", "key"]).where(F.length("key") >= t.length).select("id", "place", F.lit(t.name).alias("tier")))
        elif t.skeleton:
            near = c.join(p.withColumn("bones", F.col("theirs")), ["district", "bones"]).where(F.least(F.length("key"), F.length("other")) >= t.length)
            found.append(near.where(alike(F.col("key"), F.col("other")) >= t.alike).select("id", "place", F.lit(t.name).alias("tier")))
        else:
            theirs = p.select(F.col("place").alias("id"), "district", F.col("other").alias("key"))
            found.append(similar_pairs(c.select("id", "district", "key"), theirs, t.alike, t.length).select("id", "place", F.lit(t.name).alias("tier")))
    hits = found[0]
    for x in found[1:]:
        hits = hits.unionAll(x)
    # A place that a case meets more than once counts once in a tier: one row for both, then plain sums.
    met = hits.groupBy("id", "place").agg(*(F.max((F.col("tier") == t.name).cast("int")).alias(t.name) for t in tiers))
    per = met.groupBy("id").agg(*(F.sum(t.name).alias(f"n_{t.name}") for t in tiers), *(F.min(F.when(F.col(t.name) == 1, F.col("place"))).alias(f"p_{t.name}") for t in tiers))
    first = lambda value: F.coalesce(*(F.when(F.col(f"n_{t.name}") == 1, value(t)) for t in tiers))
    seen = F.coalesce(*(F.when(F.col(f"n_{t.name}") > 0, F.col(f"n_{t.name}")) for t in reversed(tiers)), F.lit(0))
    per = per.select(F.col("id").alias(id_), first(lambda t: F.col(f"p_{t.name}")).alias(place), first(lambda t: F.lit(t.name)).alias("tier"), seen.alias("candidates"))
    return cases.select(id_).distinct().join(per, id_, "left").na.fill(0, ["candidates"])


def pass_on(decided: DataFrame, keys: DataFrame, value: str = "value", place: str = "place", key: str = "key") -> DataFrame:
    """(value, place, round, state): decisions passed on to all variants that keys lead to, until none is new.

    decided (value, place), keys (value, key): values that share a key are variants. In each round the values that were decided in the round before
    pass their place to their keys; a key that hears of two places is closed for good. An undecided value that hears of one place takes it, one
    that hears of several is contested and passes nothing on. Values given several places are contested from the start.

    Semi-naive: a round joins the decisions of the last one only, with keys and values that none has reached; each is written down. Nothing is paired
    within a key, so a key of any number of values costs its rows. A second run over its own result changes nothing: the decided values are all
    there. Nulls are no values, keys or places.
    """
    edges = checkpointed(keys.select(F.col(value).alias("value"), F.col(key).alias("key")).where("value IS NOT NULL AND key IS NOT NULL").distinct())
    state = lambda: F.when(F.min("place") == F.max("place"), "decided").otherwise("contested")
    seeds = decided.select(F.col(value).alias("value"), F.col(place).alias("place")).where("value IS NOT NULL AND place IS NOT NULL")
    new = checkpointed(seeds.groupBy("value").agg(F.min("place").alias("place"), F.lit(0).alias("round"), state().alias("state")))
    parts, turn = [new], 0
    open_ = checkpointed(edges.join(new, "value", "left_anti"))
    while True:
        turn += 1
        heard = checkpointed(new.where("state = 'decided'").join(edges, "value").groupBy("key").agg(F.min("place").alias("place"), F.max("place").alias("other")))
        told = open_.join(heard.where("place = other").select("key", "place"), "key")
        new = checkpointed(told.groupBy("value").agg(F.min("place").alias("place"), F.lit(turn).alias("round"), state().alias("state")))
        if new.isEmpty():
            break
        parts.append(new)
        # A key is heard once: where it told, all its values are reached, and where it heard of several places it is closed.
        open_ = checkpointed(open_.join(new, "value", "left_anti").join(heard.where("place <> other"), "key", "left_anti"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)
    return out.select(F.col("value").alias(value), F.when(F.col("state") == "decided", F.col("place")).alias(place), "round", "state")


def closure(parents: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, ancestor, steps): every node with itself and all that it lies in, by doubling: as many rounds as the logarithm of the depth.

    A node has one parent or none (null). A loop raises.
    """
    up = checkpointed(parents.where(F.col(parent).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("steps")))
    every = parents.select(F.col(node).alias("node")).unionAll(parents.where(F.col(parent).isNotNull()).select(F.col(parent))).distinct()
    reach, span = up, 1
    while True:
        far = reach.where(F.col("steps") == span)
        more = far.join(reach.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("top"), F.col("steps").alias("further")), "ancestor")
        more = checkpointed(more.select("node", F.col("top").alias("ancestor"), (F.col("steps") + F.col("further")).alias("steps")))
        if more.isEmpty():
            break
        if not more.where("node = ancestor").isEmpty():
            raise ValueError("the hierarchy has a loop")
        reach, span = checkpointed(reach.unionAll(more)), span * 2
    return reach.unionAll(every.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("steps")))


def finest(readings: DataFrame, parents: DataFrame, id_: str, node: str = "node", parent: str = "parent") -> DataFrame:
    """(id_, readings, finest, common) for each id of readings (id_, node): what several readings of one cell say together.

    finest: the reading that lies in all others, if they lie in each other like a village in its district; else null, as the cell may mean either.
    common: the finest place that holds all readings, null if none does. A reading that the hierarchy doesn't know makes both null.

    Each reading takes its path from the top, and the readings are grouped once, by their cell: a row for a reading, none for each place above it.
    """
    up = closure(parents, node, parent)
    paths = up.groupBy("node").agg(F.collect_set(F.struct((-F.col("steps")).alias("up"), "ancestor")).alias("path"))
    paths = checkpointed(paths.select("node", F.array_sort("path")["ancestor"].alias("path")))
    asked = readings.select(F.col(id_).alias("id"), F.col(node).alias("node")).where("node IS NOT NULL").join(paths, "node", "left")
    per = asked.groupBy("id").agg(F.collect_set(F.coalesce("path", F.array("node"))).alias("paths"), F.max(F.col("path").isNull()).alias("unknown"))
    # In the order of paths what begins alike stands together: what the first and the last share, all share, and the last is the deepest of a chain.
    last = F.array_max("paths")
    shared = F.array_intersect(F.array_min("paths"), last)
    chain = F.forall("paths", lambda p: F.get(last, F.size(p) - 1) == F.get(p, F.size(p) - 1))
    known = lambda c: F.when(~F.col("unknown"), c)
    finest_, common = F.when(chain, F.get(last, F.size(last) - 1)), F.get(shared, F.size(shared) - 1)
    return per.select(F.col("id").alias(id_), F.size("paths").cast("long").alias("readings"), known(finest_).alias("finest"), known(common).alias("common"))
