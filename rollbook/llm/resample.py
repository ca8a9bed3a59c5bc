"""Importance resampling towards a target text collection: hashed n-gram counts from word tries, Gumbel scores, a global order."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bound_batches, checkpointed, free_prefix, table

BUCKETS = 10_000
MAX_N = 1
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
#: Bytes of nodes that a task's trie holds before its counts are added to the buckets and it starts anew; a node weighs NODE beside its word.
HELD = 64 << 20
NODE = 250
#: ASCII characters but letters and digits part words; capitals become small; bytes above are parts of words.
_SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum()).encode()
_WORDS = bytes.maketrans(_SEPARATORS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_SEPARATORS) + b"abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


class Node(dict):
    """A run of words. A word leads to the longer run; crc is the CRC-32 of this one's bytes, from which the next ones' go on."""

    __slots__ = ("crc", "figure", "trie")

    def __init__(self, crc: int | None, trie: Trie) -> None:
        self.crc, self.trie = crc, trie
        self.figure = 0 if crc is None or trie.gains is None else trie.gains[crc % trie.buckets]

    def __missing__(self, word: bytes) -> Node:
        self.trie.held += NODE + len(word)
        crc = crc32(word) if self.crc is None else crc32(word, crc32(b" ", self.crc))
        node = self[word] = Node(crc, self.trie)
        return node


class Trie:
    """The runs of 1 to max_n words that a task has met. A node's figure is its count, or its bucket's gain where gains are given."""

    def __init__(self, buckets: int, max_n: int, gains: list[int] | None = None) -> None:
        self.buckets, self.max_n, self.gains = buckets, max_n, gains
        self.clear()

    def clear(self) -> None:
        self.held, self.root = 0, Node(None, self)

    def walk(self, words: list[bytes]) -> Iterator[list[Node]]:
        """The nodes of all runs of one word, then of two words, and so on."""
        at = [self.root] * len(words)
        for n in range(min(self.max_n, len(words))):
            at = [node[word] for node, word in zip(at, words[n:], strict=False)]
            yield at

    def totals(self) -> np.ndarray:
        """Counts by bucket."""
        out, stack = np.zeros(self.buckets, np.int64), list(self.root.values())
        while stack:
            node = stack.pop()
            out[node.crc % self.buckets] += node.figure
            stack.extend(node.values())
        return out


def _count(buckets: int, max_n: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, totals = Trie(buckets, max_n), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for nodes in trie.walk(words_of(text)):
                    for node in nodes:
                        node.figure += 1
                if trie.held > held:
                    totals += trie.totals()
                    trie.clear()
        totals += trie.totals()
        met = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(totals[met], pa.int64())], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, max_n: int = MAX_N, held: int = HELD) -> DataFrame:
    """(bucket, n): how many runs of 1 to max_n words of the texts (one column) fall in each bucket that any falls in.

    A task counts in a trie of its own and hands on at most one row a bucket, whatever the number of its texts.
    """
    return texts.mapInArrow(_count(buckets, max_n, held), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for all buckets, from counts (bucket, n): floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))), in doubles."""
    spark = corpus.sparkSession
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    both = both.select("bucket", *(F.coalesce(x, F.lit(0)).cast("double").alias(x) for x in "st"))
    everything = W.partitionBy(F.lit(0))  # one row a bucket
    ratio = (F.col("t") + 1) * (F.sum("s").over(everything) + buckets) / ((F.col("s") + 1) * (F.sum("t").over(everything) + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def _weigh(gain: list[int], buckets: int, max_n: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(buckets, max_n, gain)
        for batch in batches:
            out = []
            for text in batch.column(-1 + batch.num_columns).to_pylist():
                words = words_of(text)
                features = weight = 0
                for nodes in trie.walk(words):
                    features += len(nodes)
                    weight += sum([node.figure for node in nodes])
                out.append((len(words), features, weight))
                if trie.held > held:
                    trie.clear()
            added = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], "n_words", "n_features", "weight"])

    return run


def weights(docs: DataFrame, gain: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, max_n: int = MAX_N, held: int = HELD) -> DataFrame:
    """(id, n_words, n_features, weight) for each row of docs: the sum of the gains of its runs.

    gain has one row for each of the buckets, a fixed number, and goes to the tasks as a list. Each task hangs the gains at the nodes of a
    trie of its own as it makes them, and walks its texts along the paths.
    """
    attached = [0] * buckets
    for row in gain.collect():
        attached[row.bucket] = row.gain
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_weigh(attached, buckets, max_n, held), f"id {kind}, n_words long, n_features long, weight long")


def numbered(df: DataFrame, *order) -> DataFrame:
    """df with position, 1 for the first row in the order, and so on: rows are dealt by ranges, and each range numbers its own.

    One shuffle. The rows before a range are summed over a table of one row for each range; the ranges are written down first, since a range
    dealt again may be cut elsewhere.
    """
    p = free_prefix(df, "at")
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpointed(dealt.withColumn(p + "id", F.monotonically_increasing_id()))
    rank = F.col(p + "id").bitwiseAND((1 << 33) - 1)
    placed = placed.withColumns({p + "range": F.shiftright(p + "id", 33), p + "row": rank})
    before = W.partitionBy(F.lit(0)).orderBy(p + "range").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy(p + "range").agg(F.count("*").alias(p + "n"))
    starts = starts.select(p + "range", F.coalesce(F.sum(p + "n").over(before), F.lit(0)).alias(p + "start"))
    found = placed.join(F.broadcast(starts), p + "range")  # a row a partition
    return found.withColumn("position", F.col(p + "start") + F.col(p + "row") + 1).drop(*(p + c for c in ("id", "range", "row", "start")))


def noise(doc_id, seed: int) -> F.Column:
    """floor(-1000 ln(-ln u)): u from the first 8 hex digits of the SHA-256 of seed and id. A null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, max_n: int = MAX_N, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_features, weight, score, rank) for each row of docs; target (one column of texts) is what the draw should look like.

    weight sums the gains of the document's runs of 1 to max_n words, score adds Gumbel noise, so the highest scores are a draw without
    replacement by weight. rank counts the floor(percent / 100 of the documents with min_words words) highest of these, ties to smaller ids; the
    others have none.

    Null and empty texts: no features, weight 0, never drawn. Null ids: noise of an empty id, after all ids in ties. Repeated rows are documents
    of their own, with equal scores and ranks one after another. Empty target: weights by rarity in docs. Empty docs: no rows.
    """
    text = F.col(f"`{text_col}`")
    gain = gains(bucket_counts(docs.select(text), buckets, max_n), bucket_counts(target, buckets, max_n), buckets)
    found = weights(docs, gain, id_col, text_col, buckets, max_n)
    # Written down: dealing rows by ranges reads them twice, and the texts should be walked once.
    found = checkpointed(found.withColumns({"score": F.col("weight") + noise(F.col("id"), seed), "open": F.col("n_words") >= min_words}))
    order = (F.col("open").desc(), F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = numbered(found, *order)
    most = ranked.agg(F.floor(F.count_if("open") * percent / 100).alias("most"))
    rank = F.when(F.col("open") & (F.col("position") <= F.col("most")), F.col("position"))
    return ranked.join(F.broadcast(most)).select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.cast("long").alias("rank"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("text"))


OP11_SQL = r"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
        FROM range(256) r(i))),
both_ AS (
  SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (
  SELECT side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM both_),
b AS (
  SELECT word, xor(list_reduce(list_concat([4294967295::BIGINT],
           list_transform(range(1, 2 * octet_length(encode(word)), 2), lambda i: ('0x' || substr(hex(encode(word)), i, 2))::BIGINT)),
           lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM w), tab),
f AS (SELECT side, doc_id, bucket FROM w JOIN b USING (word)),
n AS (
  SELECT r.bucket, count(*) FILTER (f.side = 0) AS s, count(*) FILTER (f.side = 1) AS t
  FROM range(10000) r(bucket) LEFT JOIN f ON f.bucket = r.bucket GROUP BY ALL),
g AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(t0.s) OVER () + 10000)::DOUBLE
                                 / ((t0.s + 1)::DOUBLE * (sum(t0.t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM n t0),
d AS (
  SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN g USING (bucket) WHERE side = 0 GROUP BY doc_id),
s AS (
  SELECT documents.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || documents.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                    / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN d USING (doc_id)),
r AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         sum((n_features >= 20)::INT) OVER () AS n FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM r
"""
