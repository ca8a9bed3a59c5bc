"""Exact duplicates: compressed radix tries over whole texts, whose terminals know the document that owns them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, bound_batches, free_prefix, table

#: Bytes of labels that a task's trie holds before subtrees of it are given out.
HELD = 64 << 20
#: What a node weighs beside its label.
NODE = 300
#: Rows of an output batch, and the bytes of texts in it.
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20
#: A key is the text's length and a hash of its content, HEAD bytes together, then the text itself.
HEAD = 16
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def key_of(text: str | None) -> bytes:
    """The text in lower case (A-Z only), behind its length and content hash: tries are parted by these first."""
    content = (text or "").encode().translate(_LOWER)
    return len(content).to_bytes(8, "big") + hashlib.blake2b(content, digest_size=8).digest() + content


class Node:
    __slots__ = ("best", "below", "label", "n", "ties", "weight")

    def __init__(self, label: bytes) -> None:
        self.label = label
        self.below: dict[int, Node] = {}
        self.weight = 0
        self.n, self.ties, self.best = 0, 0, None


class Trie:
    """A compressed radix trie of byte strings.

    A node's label is the run of bytes that leads to it; weight is what its subtree holds. The terminal of a string stores the best
    identifier (the least by better), how often it was met and how many strings ended there.
    """

    def __init__(self, better: Callable) -> None:
        self.root, self.better = Node(b""), better

    @property
    def held(self) -> int:
        return self.root.weight

    def insert(self, key: bytes, best, ties: int, n: int) -> None:
        node, at, path = self.root, 0, [self.root]
        added = 0
        while at < len(key):
            child = node.below.get(key[at])
            if child is None:
                child = node.below[key[at]] = Node(key[at:])
                added += NODE + len(key) - at
            elif not key.startswith(child.label, at):
                child = node.below[key[at]] = self._split(child, key, at)
                added += NODE
            at += len(child.label)
            node = child
            path.append(node)
        if added:
            for x in path:
                x.weight += added
        if not node.n or best is not None and (node.best is None or self.better(best, node.best)):
            node.best, node.ties = best, ties
        elif best == node.best:
            node.ties += ties
        node.n += n

    @staticmethod
    def _split(node: Node, key: bytes, at: int) -> Node:
        """A node over the part of node's label that key shares from at on, with node below it."""
        low, high = 1, min(len(node.label), len(key) - at)
        while low < high:
            mid = (low + high + 1) // 2
            if key.startswith(node.label[:mid], at):
                low = mid
            else:
                high = mid - 1
        over = Node(node.label[:low])
        over.weight = node.weight
        node.label = node.label[low:]
        node.weight -= low
        over.below[node.label[0]] = node
        return over

    def _terminals(self, prefix: list[bytes], top: Node) -> Iterator[tuple[bytes, Node]]:
        stack = [(b"".join(prefix), top)]
        while stack:
            before, node = stack.pop()
            key = before + node.label
            if node.n:
                yield key, node
            stack.extend((key, x) for x in node.below.values())

    def everything(self) -> Iterator[tuple[bytes, Node]]:
        yield from self._terminals([], self.root)
        self.root = Node(b"")

    def heaviest(self, down_to: int) -> Iterator[tuple[bytes, Node]]:
        """Takes out the heaviest subtrees, until down_to bytes are held."""
        path = [self.root]
        while len(path[-1].below) == 1 and not path[-1].n:
            path.append(next(iter(path[-1].below.values())))
        fork, prefix = path[-1], [x.label for x in path]
        if not fork.below:
            yield from self.everything()
            return
        for first, node in sorted(fork.below.items(), key=lambda x: -x[1].weight):
            if self.held <= down_to:
                break
            del fork.below[first]
            for x in path:
                x.weight -= node.weight
            yield from self._terminals(prefix, node)

    def passed(self, head: bytes) -> Iterator[tuple[bytes, Node]]:
        """Takes out all subtrees but the one that head leads to; heads come in order, so none of these grows any more."""
        node, at, path = self.root, 0, [self.root]
        while at < len(head):
            for first in [x for x in node.below if x != head[at]]:
                gone = node.below.pop(first)
                for x in path:
                    x.weight -= gone.weight
                yield from self._terminals([x.label for x in path], gone)
            node = node.below.get(head[at])
            if node is None:
                return
            at += len(node.label)
            path.append(node)


def _better(largest: bool) -> Callable:
    return (lambda a, b: a > b) if largest else (lambda a, b: a < b)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += size(row)
        if len(part) >= BATCH_ROWS or held >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)
            part, held = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def _local(kind: pa.DataType, largest: bool, held: int):
    """(id, text) of a task to (head, text, best, ties, n): a row for each distinct text, or a few where the trie gave it out early."""
    schema = pa.schema([("head", pa.binary()), ("text", pa.binary()), ("best", kind), ("ties", pa.int64()), ("n", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        trie = Trie(_better(largest))
        out = lambda found: ((key[:HEAD], key[HEAD:], x.best, x.ties, x.n) for key, x in found)
        for batch in batches:
            for best, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                trie.insert(key_of(text), best, 1, 1)
                if trie.held > held:
                    yield from out(trie.heaviest(held // 2))
        yield from out(trie.everything())

    return lambda batches: _batches(rows(batches), schema, lambda row: len(row[1]))


def _merged(kind: pa.DataType, largest: bool, held: int):
    """Rows of _local in the order of head to (text_sha256, keep, ties, group_size), for texts of several rows."""
    schema = pa.schema([("text_sha256", pa.string()), ("keep", kind), ("ties", pa.int64()), ("group_size", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        trie = Trie(_better(largest))
        out = lambda found: ((hashlib.sha256(key[HEAD:]).hexdigest(), x.best, x.ties, x.n) for key, x in found if x.n > 1)
        for batch in batches:
            for head, text, best, ties, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                trie.insert(head + text, best, ties, n)
                if trie.held > held:
                    yield from out(trie.passed(head))
        yield from out(trie.everything())

    return lambda batches: _batches(rows(batches), schema, lambda _: 100)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def shared_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True, held: int = HELD) -> DataFrame:
    """(text_sha256, keep, ties, group_size): a row for each text that several rows of docs hold, A-Z in lower case.

    keep is the largest id of these rows (the smallest, unless largest), null if none has one; ties counts the rows that hold it.

    How: each task puts its texts, as full byte strings, into a compressed radix trie and hands on one row for each distinct text.
    These are dealt by length and content hash and meet, in that order, in a second trie, so that texts count as equal only if
    all their bytes are. Beyond held bytes the first gives out its heaviest subtrees early (the second adds them up), the second all that
    the order has passed. So a task holds some held bytes and one text, and of a group of any size the second step gets one row for each
    task of the first. Sorting and its spilling are Spark's.
    """
    kind = docs.schema[id_col].dataType
    arrow, name = _arrow(kind), kind.simpleString()
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    local = rows.mapInArrow(_local(arrow, largest, held), f"head binary, text binary, best {name}, ties long, n long")
    dealt = local.repartition("head").sortWithinPartitions("head")
    return dealt.mapInArrow(_merged(arrow, largest, held), f"text_sha256 string, keep {name}, ties long, group_size long")


def text_digest(text) -> F.Column:
    """Hex SHA-256 of the normalised text; null is the empty text."""
    return F.sha2(F.coalesce(ascii_lower(text), F.lit("")).cast("binary"), 256)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True) -> DataFrame:
    """A row for each row of docs: (id, keep_id, group_size, kept, text_sha256).

    Of equal texts the row with the largest id stays (the smallest, unless largest). Null texts are empty texts. Rows without an id come
    after all ids; where no row has one, one of them stays and keep_id is null. Of rows with equal id and text one
    stays. A text of its own keeps itself. Empty table: no rows. Other columns are not read.
    """
    groups = shared_texts(docs, id_col, text_col, largest)
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), text_digest(F.col(f"`{text_col}`")).alias("text_sha256"))
    # Rows alike in id and text go as one with their number, and one of them may stay.
    slim = slim.groupBy("text_sha256", "id").agg(F.count("*").alias("rows"))
    found = slim.join(groups, "text_sha256", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep"))
    return found.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(keep) & (F.col("copy") == 1)).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows alike in id and text the least by a hash of all columns."""
    p = free_prefix(docs, "trie")
    groups = shared_texts(docs, id_col, text_col, largest).select(*(F.col(c).alias(p + c) for c in ("text_sha256", "keep", "ties")))
    marked = docs.withColumn(p + "text_sha256", text_digest(F.col(f"`{text_col}`"))).join(groups, p + "text_sha256", "left")
    stays = marked.where(F.col(p + "ties").isNull() | F.col(f"`{id_col}`").eqNullSafe(F.col(p + "keep")))
    single = stays.where(F.coalesce(F.col(p + "ties"), F.lit(1)) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))
    tied = stays.where(F.col(p + "ties") > 1)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = tied.groupBy(p + "text_sha256").agg(F.min_by(row, F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))).alias("row"))
    return single.unionAll(one.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
