"""From buckets of candidates to components: pivots first, then an exact settlement of what they leave open."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .graph import connected_components

#: Shared buckets up to which they are broadcast (16 bytes each) to find their members; beyond, all members are shuffled once more.
BROADCAST_BUCKETS = 1_000_000
#: Components and buckets from this size on are settled in blocks of BLOCK members, not in pairs.
LARGE = 64
BLOCK = 512
#: Members of a block that one member is compared with at a time.
STEP = 64

#: (pairs (a, b)) -> links (a, b)
Verify = Callable[[DataFrame], DataFrame]
#: (a member's row, the frame of the others, which of them may count) -> positions of the others that it is linked with
Compare = Callable[[pd.Series, pd.DataFrame, np.ndarray], np.ndarray]


def shared_buckets(members: DataFrame) -> DataFrame:
    """(bucket, rep, n): the rows of members (bucket, rep) whose bucket has n > 1 of them."""
    n = checkpointed(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    return checkpointed(members.join(F.broadcast(n) if n.count() <= BROADCAST_BUCKETS else n, "bucket"))


def by_member(hits: DataFrame) -> DataFrame:
    """(rep, met, buckets): each member of hits once, with its buckets, as many as it has keys at most, and how many it meets in them.

    What is known of a member joins this row, not one for each of its buckets.
    """
    return hits.groupBy("rep").agg(F.sum("n").alias("met"), F.collect_list("bucket").alias("buckets"))


def pivot_pairs(hits: DataFrame) -> DataFrame:
    """(bucket, met, a, b): each bucket's members b with its pivot a, the one that meets most others over all its buckets."""
    pivots = by_member(hits).select("rep", "met", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.max(F.struct("met", "rep")).alias("top"))
    paired = hits.join(pivots.select("bucket", F.col("top.met").alias("met"), F.col("top.rep").alias("a")), "bucket")
    return paired.where("rep <> a").select("bucket", "met", "a", F.col("rep").alias("b"))


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (node, component) after links (a, b) between its nodes: components of the graph of components."""
    ends = links.join(comps.select(F.col("node").alias("a"), F.col("component").alias("x")), "a").join(comps.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
    joined = connected_components(ends.where("x <> y").select("x", "y").distinct(), "x", "y").select(F.col("node").alias("component"), F.col("component").alias("to"))
    return checkpointed(comps.join(joined, "component", "left").select("node", F.coalesce("to", "component").alias("component")))


def _in_blocks(left: DataFrame, right: DataFrame, data: DataFrame, prepare: Callable, compare: Compare) -> DataFrame:
    """Links (a, b) between the members of left and of right (grp, rep, component) with equal grp and other components.

    Both sides of a group are dealt into blocks of BLOCK; a task holds one block of each at a time. It compares members of
    different components only, takes their components as one after a link, and gives back these links: a spanning forest of
    what the blocks join, so neither the rows nor, in a family, the comparisons grow with the square of its size.
    """
    blocks = lambda df, name: df.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    shape = blocks(left, "lefts").join(blocks(right, "rights"), "grp")
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ["component", *data.columns]]
    a = left.join(shape, "grp").join(data, "rep").withColumn("own", block("lefts"))
    a = a.select(F.col("grp").alias("grp_a"), F.col("own").alias("row_a"), spread("rights").alias("col_a"), *held("a"))
    b = right.join(shape, "grp").join(data, "rep").withColumn("own", block("rights"))
    b = b.select(F.col("grp").alias("grp_b"), spread("lefts").alias("row_b"), F.col("own").alias("col_b"), *held("b"))

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        links = []
        if len(x) and len(y):
            x, y = (z.rename(columns=lambda c: c[:-2]) for z in (x, y))
            ids, others = y["rep"].to_numpy(), prepare(y)
            label = np.unique(np.concatenate([x["component"].to_numpy(), y["component"].to_numpy()]), return_inverse=True)[1]
            mine, theirs = label[: len(x)], label[len(x) :]
            for k, row in enumerate(x.itertuples(index=False)):
                for at in range(0, len(y), STEP):
                    part = theirs[at : at + STEP]
                    for j in compare(row, others, at + np.flatnonzero(part != mine[k])):
                        if theirs[j] != mine[k]:
                            links.append((row.rep, ids[j]))
                            gone = theirs[j]
                            mine[mine == gone] = theirs[theirs == gone] = mine[k]
        return pd.DataFrame(np.array(links, np.int64).reshape(-1, 2), columns=["a", "b"])

    keyed = lambda df, x: df.groupBy(f"grp_{x}", f"row_{x}", f"col_{x}")
    return keyed(a, "a").cogroup(keyed(b, "b")).applyInPandas(run, "a long, b long")


def unsettled_links(hits: DataFrame, comps: DataFrame, data: DataFrame, verify: Verify, prepare: Callable, compare: Compare, whole: int = 0) -> DataFrame:
    """Links between members that share a bucket but not yet a component of comps (node, component).

    A bucket of more than whole members that touches a large component: its members outside that are held against the whole component
    and against each other. A large bucket without one: its members are held against each other. Both in blocks. What is left are buckets
    of at most LARGE members, whose pairs are made and verified.
    """
    everyone = comps.withColumnRenamed("node", "rep")
    everyone = checkpointed(everyone.join(everyone.groupBy("component").agg((F.count("*") >= LARGE).alias("large")), "component"))
    placed = by_member(hits).join(everyone, "rep").select("rep", F.explode("buckets").alias("bucket"), "component", "large")
    open_ = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("large").alias("any_large"))
    placed = checkpointed(placed.join(open_.where("lo <> hi").select("bucket", "n", "any_large"), "bucket"))
    big = placed.where("large").select("bucket", F.col("component").alias("of")).distinct()
    asking = placed.where(f"any_large AND n > {whole}").join(big, "bucket").where("component <> of")
    asking = checkpointed(asking.select(F.xxhash64(F.lit("component"), "of").alias("grp"), "of", "rep", "component").distinct())
    members = everyone.join(asking.select(F.col("of").alias("component"), "grp").distinct(), "component")
    wide = placed.where(f"NOT any_large AND n > {LARGE}").select(F.xxhash64(F.lit("bucket"), "bucket").alias("grp"), "rep", "component")
    cols = ["grp", "rep", "component"]
    left = asking.select(*cols).unionAll(wide.select(*cols))
    found = _in_blocks(left, left.unionAll(members.select(*cols)), data, prepare, compare)
    rest = placed.where(f"n <= {LARGE} AND NOT (any_large AND n > {whole})").select("bucket", "rep", "component")
    other = rest.select("bucket", F.col("rep").alias("b"), F.col("component").alias("theirs"))
    pairs = rest.join(other, "bucket").where("rep < b AND component <> theirs").select(F.col("rep").alias("a"), "b").distinct()
    return found.unionAll(verify(pairs))


def settle(hits: DataFrame, data: DataFrame, verify: Verify, prepare: Callable, compare: Compare, more: DataFrame | None = None, whole: int = 0) -> DataFrame:
    """(node, component) over all links between members that share a bucket of hits (bucket, rep, n), and the edges of more (a, b).

    data (rep, ...) is what compare sees of a member; prepare turns a block of it into what compare takes as the others.
    First each member is held against one pivot, that of its buckets which meets most; then against the pivots of those
    buckets only that still hold other components than the pivot's; then what is left is settled exactly. whole: buckets up to this size
    never ask a whole component (LARGE at most); where strangers meet a family by chance, that would cost its size for each.
    """
    pairs = checkpointed(pivot_pairs(hits))
    links = verify(pairs.groupBy("b").agg(F.max(F.struct("met", "a")).alias("top")).select(F.col("top.a").alias("a"), "b"))
    links = checkpointed(links if more is None else links.unionAll(more))
    nodes = hits.select(F.col("rep").alias("node"))
    if more is not None:
        nodes = nodes.unionAll(more.select("a")).unionAll(more.select("b"))
    comps = checkpointed(nodes.distinct().join(connected_components(links), "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    of = lambda name, to: comps.select(F.col("node").alias(name), F.col("component").alias(to))
    again = pairs.select("a", "b").distinct().join(of("a", "x"), "a").join(of("b", "y"), "b").where("x <> y").select("a", "b")
    comps = merged(comps, checkpointed(verify(again)))
    return merged(comps, checkpointed(unsettled_links(hits, comps, data, verify, prepare, compare, whole)))
