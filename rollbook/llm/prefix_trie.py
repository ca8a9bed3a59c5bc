"""The prefix trie of conversations as grouped rows: the smallest member of a node owns it, so each conversation owns a path's end."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Conversations of a family share the head of the conversation whose id is the family's; heads have under HEADS turns.
FAMILY, HEADS = 5, 9
#: Ids of a digest that are joined into one text before the texts meet: neighbours in number, so a text has SLICE ids at most.
SLICE = 4096


def _halves(digest: Column) -> tuple[Column, Column]:
    """The first 128 bits of a hex digest as two longs."""
    return tuple(F.conv(F.substring(digest, 1 + 16 * i, 16), 16, -10).cast("long") for i in range(2))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, size) for each row: 128 bits of the turn's SHA-256 (role, text), and its text's UTF-8 bytes. Texts end here."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit("|"), role, text).cast("binary"), 256)
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    a, b = _halves(F.col("digest"))
    return rows.where("conv_id IS NOT NULL").select("conv_id", "turn", a.alias("a"), b.alias("b"), "size")


def head_of(conv_id: Column) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(HEADS)).cast("long")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(family, conv_id, depth, a, b, size): every conversation as its family's head, then its own turns, with a row of depth 0.

    h = crc32(conv_id) mod HEADS turns come from conversation conv_id - conv_id % FAMILY (fewer if it has fewer, none if it is absent), then
    the own turns after the first h. Turns are ordered by turn (null first); rows of one turn by their digests. All of it is one shuffle by
    family; only a family's ids, nine at most, are gathered.
    """
    conv, pos = F.col("conv_id"), F.col("pos")
    family = W.partitionBy("family")
    rows = turns.withColumn("family", conv - conv % FAMILY)
    rows = rows.withColumn("pos", F.row_number().over(W.partitionBy("family", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "a", "b")).cast("long"))
    rows = rows.withColumns({"ids": F.collect_set("conv_id").over(family), "first": F.coalesce(F.max(F.when(conv == F.col("family"), pos)).over(family), F.lit(0))})
    place = lambda c, depth: F.struct(c.alias("conv_id"), depth.cast("long").alias("depth"))
    h = head_of(conv)
    own = F.when(pos > h, F.array(place(conv, F.least(h, F.col("first")) + pos - h)))
    head = F.when(conv == F.col("family"), F.transform(F.filter("ids", lambda c: head_of(c) >= pos), lambda c: place(c, pos)))
    root = F.when(pos == 1, F.array(place(conv, F.lit(0))))
    none = F.array().cast("array<struct<conv_id:bigint,depth:bigint>>")
    places = F.concat(*(F.coalesce(x, none) for x in (own, head, root)))
    out = rows.select("family", "a", "b", "size", F.explode(places).alias("at"))
    turn = F.col("at.depth") > 0
    return out.select("family", "at.conv_id", "at.depth", *(F.when(turn, F.col(c)).otherwise(0).alias(c) for c in ("a", "b", "size")))


def occurrences(sequences: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, up_a, up_b, length, rest): each conversation's nodes from the root on, of sequences (family, conv_id, depth, a, b, size).

    (depth, a, b) names a node: 128 bits, the exclusive or of its turns' digests salted with their depths. up_ is the parent's. length is the
    conversation's number of turns, rest its bytes from this turn on. Windows along a conversation only, on the partitions by family that are there.
    """
    conv = W.partitionBy("family", "conv_id")
    along, onward = (conv.orderBy(x) for x in ("depth", F.col("depth").desc()))
    salted = F.sha2(F.concat_ws("|", "depth", "a", "b").cast("binary"), 256)
    x, y = _halves(salted)
    rows = sequences.withColumns({"x": F.when(F.col("depth") > 0, x).otherwise(0), "y": F.when(F.col("depth") > 0, y).otherwise(0)})
    rows = rows.withColumns({"a": F.bit_xor("x").over(along), "b": F.bit_xor("y").over(along), "length": F.max("depth").over(conv), "rest": F.sum("size").over(onward)})
    return rows.select("conv_id", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("up_a"), F.col("b").bitwiseXOR(F.col("y")).alias("up_b"), "length", "rest")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over each node's texts in order, rows of one node following each other."""
    key, sha = None, None
    for batch in batches:
        out = []
        for *now, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now != key:
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = now, hashlib.sha256(text.encode())
            else:
                sha.update(b"," + text.encode())
        yield _frame(out)
    if key is not None:
        yield _frame([(*key, sha.hexdigest())])


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.string()]
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["depth", "a", "b", "ends_sha256"])


def ends(occ: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256): SHA-256 of the ids of the conversations that end at a node, ascending, comma between.

    Ids near in number are joined to one text each in a shuffle by node and slice, in as many tasks as there are; then a node's texts
    go in order through one running digest, so that a node where a third of all conversations end holds no more than one text at a time.
    """
    key = ["depth", "a", "b"]
    last = occ.where("depth = length").select(*key, "conv_id", F.floor(F.col("conv_id") / SLICE).alias("slice"))
    texts = last.groupBy(*key, "slice").agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    in_order = texts.repartition(*key).sortWithinPartitions(*key, "slice").select(*key, "ids")
    return in_order.mapInArrow(_digest, "depth long, a long, b long, ends_sha256 string")


def prefix_nodes(occ: DataFrame) -> DataFrame:
    """A row for each node of the trie of occurrences (see there): the columns of op12.

    A node's smallest member owns it. If a conversation owns a node it owns all further ones on its path, as their members are members of
    this one: it owns a path's end, from depth f on. So sums over subtrees need no descent: what is counted once for each member and turn,
    less what the owners have on their own ends, is what a shared prefix saves, and leaves and children are counted by their owners. One
    grouping by node gives all of it.

    Groupings by node are combined before the shuffle (the root and a hot first turn have all conversations); joins on nodes are plain
    joins, whose hot keys Spark splits. Nothing is gathered by node.
    """
    key = ["depth", "a", "b"]
    nodes = occ.groupBy(*key).agg(
        F.min(F.struct("conv_id", "rest")).alias("owner"), F.max("length").alias("reaches"), F.first("up_a").alias("up_a"), F.first("up_b").alias("up_b")
    )
    nodes = checkpointed(nodes.select(*key, F.col("owner.conv_id").alias("owner"), F.col("owner.rest").alias("rest"), (F.col("reaches") == F.col("depth")).alias("leaf"), "up_a", "up_b"))
    # What each conversation owns: from which depth on, the bytes from there on, whether its last node is a leaf.
    owned = nodes.groupBy("owner").agg(F.min(F.struct("depth", "rest", "up_a", "up_b")).alias("top"), F.max("leaf").alias("leaf"))
    owned = checkpointed(owned.select(F.col("owner").alias("conv_id"), F.col("top.depth").alias("f"), F.col("top.rest").alias("kept"), F.col("leaf"), F.col("top.up_a").alias("a"), F.col("top.up_b").alias("b")))
    first = F.coalesce("f", F.lit(2**62))
    shared = F.when(F.col("depth") < first, F.col("rest") - F.coalesce("kept", F.lit(0))).otherwise(0)
    child = (first <= F.col("depth") + 1) & (F.col("depth") < F.col("length"))
    per = occ.join(owned.select("conv_id", "f", "kept", "leaf"), "conv_id", "left").groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.sum(child.cast("long")).alias("n_children"),
        F.sum(F.coalesce(F.col("leaf"), F.lit(False)).cast("long")).alias("n_leaves"),
        F.sum(shared).alias("saved_tokens"),
    )
    # The parent of a node that its owner owns from depth f on is the owner's too, but for the first one.
    above = nodes.select((F.col("depth") + 1).alias("f"), "a", "b", F.col("owner").alias("above"))
    tops = owned.select("conv_id", "f", "a", "b").where("f > 0").join(above, ["f", "a", "b"]).select("conv_id", F.col("f").alias("depth"), "above")
    parent = F.when(F.col("depth") > 0, F.coalesce("above", "conv_id"))
    out = per.join(ends(occ), key, "left").join(tops, ["conv_id", "depth"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    figures = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), *figures, F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations (conv_id, turn, role, text): a row for each distinct sequence of first turns.

    Null roles and texts are empty. Rows without a conv_id belong to no conversation. Rows of one turn are ordered by their digests,
    repeated rows are turns one after another. A conversation without any turn is a member of the root. Empty table: no rows, not even a root.
    Other columns are not read.
    """
    return prefix_nodes(checkpointed(occurrences(rebuilt(turns_of(conversations)))))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = r"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
        FROM range(256) r(i))),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, count(*) AS n,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda x, y: xor(x >> 8, any_value(t)[(xor(x, y) & 255) + 1])), 4294967295) % 9 AS h
  FROM conversations, tab WHERE conv_id IS NOT NULL GROUP BY conv_id),
o AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations),
q AS (
  SELECT c.conv_id, o.pos AS depth, role, text FROM c JOIN o ON o.conv_id = c.base AND o.pos <= c.h
  UNION ALL
  SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + o.pos - c.h, role, text
  FROM c JOIN o ON o.conv_id = c.conv_id AND o.pos > c.h LEFT JOIN c b ON b.conv_id = c.base),
p AS (
  SELECT conv_id, depth, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY depth)::VARCHAR AS path, octet_length(encode(text)) AS size FROM q
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
k AS (SELECT *, depth || md5(path) AS node, max(depth) OVER (PARTITION BY conv_id) AS len FROM p),
m AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size, max(len) = depth AS leaf,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = depth), '')) AS ends_sha256
  FROM k GROUP BY node, depth),
u AS (SELECT DISTINCT v.node AS top, w.node FROM k v JOIN k w ON v.conv_id = w.conv_id AND w.depth >= v.depth),
s AS (
  SELECT u.top AS node, sum((m.n_convs - 1) * m.size)::BIGINT AS saved_tokens, count(*) FILTER (m.leaf) AS n_leaves
  FROM u JOIN m USING (node) GROUP BY u.top),
e AS (SELECT DISTINCT v.node AS top, w.node FROM k v JOIN k w ON v.conv_id = w.conv_id AND w.depth = v.depth + 1),
n AS (SELECT top AS node, count(*) AS n_children FROM e GROUP BY top)
SELECT m.conv_id, m.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, m.n_convs, coalesce(n.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, m.ends_sha256
FROM m JOIN s USING (node) LEFT JOIN n USING (node) LEFT JOIN e ON e.node = m.node LEFT JOIN m up ON up.node = e.top
"""
