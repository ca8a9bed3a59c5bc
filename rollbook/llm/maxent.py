"""Language-model scores from a hashed maximum-entropy model with class-factored softmax."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, crc_remainder, table

#: The end of a text, as a token; no word equals it, since words hold no space.
END = b" "
#: Classes, and slots in each: the factors of the softmax. A slot is one frequent word or a group of rarer ones.
CLASSES, SLOTS = 16, 16
K = CLASSES * SLOTS
#: Frequent words with a slot of their own (the end among them); the other slots go to words by their last letters and length.
OWN = K // 2
#: Feature rows of each kind (previous word, the word before it, both): hashed.
ROWS = 2_048
KINDS = 3
#: Holds every row number; short integers are sorted by their digits.
ROW_TYPE = np.min_scalar_type(ROWS * CLASSES - 1)
#: Counts of the most frequent words are broadcast (16 bytes each); the others are joined.
FREQUENT = 1_000_000
#: Slices of the training documents. Each is one training round, which averages the tasks' weights at its end.
SLICES = 4
MINIBATCH = 16_384
#: Tasks whose changes are added first, before those of all tasks: no group holds the changes of more than a few thousand.
FAN_IN = 64
RATE = 0.25
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def in_training(doc_id: Column) -> Column:
    return crc_remainder(doc_id, 7) != 2


def _hash(token: bytes) -> int:
    return xxhash.xxh3_64_intdigest(token)


def group_slot(token: bytes) -> int:
    """The slot of a word without one of its own: class by the last byte, slot by the byte before it and the length."""
    return OWN + (token[-1] % (CLASSES // 2)) * SLOTS + ((token[-2] if len(token) > 1 else 0) + 5 * min(len(token), 12)) % SLOTS


def token_counts(docs: DataFrame) -> DataFrame:
    """(token binary, c) over all texts of docs (text), the end of each text included; summed in the task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "c"])
            seen.clear()
            return got

        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    seen.update(text.lower().split())
                seen[END] += 1
                if len(seen) > 300_000:
                    yield out()
        yield out()

    part = docs.select(F.col("text").cast("binary")).mapInArrow(run, "token binary, c long")
    return part.groupBy("token").agg(F.sum("c").alias("c"))


class Lexicon:
    """Frequent tokens of the model: sorted hashes, counts and slots; and the sums that the last factor needs."""

    def __init__(self, rows: list[tuple[bytes, int]], own: list[bytes], mass: np.ndarray, n: int, v: int):
        h = np.array([_hash(t) for t, _ in rows], np.uint64)
        order = np.argsort(h)
        mine = {t: k for k, t in enumerate(own)}
        self.keys = h[order]
        self.counts = np.array([c for _, c in rows], np.int64)[order]
        self.slots = np.array([mine.get(t, -1) for t, _ in rows], np.int16)[order]
        self.own, self.n, self.v = mine, n, v
        #: log10 of the mass of each slot: its tokens' counts plus one each, plus one for what was never seen.
        self.mass = np.log10(mass)

    def look(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, count (0 if not frequent) and slot of distinct tokens."""
        h = np.fromiter((_hash(t) for t in tokens), np.uint64, len(tokens))
        slot = np.fromiter((self.own.get(t, -1) for t in tokens), np.int64, len(tokens))
        for i in np.flatnonzero(slot < 0):
            slot[i] = group_slot(tokens[i])
        if not len(self.keys):
            return h, np.zeros(len(tokens), np.int64), slot
        k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return h, np.where(self.keys[k] == h, self.counts[k], 0), slot


def features_of(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Feature rows (tokens, KINDS) of a run of token hashes; first marks the texts' first tokens. Before them is nothing: 0."""
    one = np.concatenate([[0], h[:-1]]).astype(np.uint64) if len(h) else h
    one = np.where(first, np.uint64(0), one)
    second = np.concatenate([[False], first[:-1]]) | first if len(h) else first
    two = np.concatenate([[0, 0], h[:-2]])[: len(h)].astype(np.uint64) if len(h) else h
    two = np.where(second, np.uint64(0), two)
    top = np.uint64(64 - int(np.log2(ROWS)))
    return np.stack([(one * _P1) >> top, (two * _P2) >> top, ((one * _P2 ^ (two * _P1 + _P2)) * _P1) >> top], axis=1).astype(np.int64)


class Weights:
    """Class weights (KINDS, ROWS, CLASSES) and slot weights (KINDS, ROWS * CLASSES, SLOTS) with biases from counts."""

    def __init__(self, mass: np.ndarray):
        p = mass / mass.sum()
        by_class = p.reshape(CLASSES, SLOTS)
        self.class_bias = np.log(by_class.sum(axis=1)).astype(np.float32)
        self.slot_bias = np.log(by_class / by_class.sum(axis=1, keepdims=True)).astype(np.float32)
        self.classes = np.zeros((KINDS, ROWS, CLASSES), np.float32)
        self.slots = np.zeros((KINDS, ROWS * CLASSES, SLOTS), np.float32)

    def logits(self, f: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # take() copies whole rows; an index in brackets goes by single numbers.
        a, b = self.classes[0].take(f[:, 0], 0), self.slots[0].take(f[:, 0] * CLASSES + c, 0)
        a += self.class_bias
        b += self.slot_bias.take(c, 0)
        for k in range(1, KINDS):
            a += self.classes[k].take(f[:, k], 0)
            b += self.slots[k].take(f[:, k] * CLASSES + c, 0)
        return a, b

    def log10_slot(self, f: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """log10 of the probability of each slot: its class by the features, then the slot in its class."""
        c, s = slot // SLOTS, slot % SLOTS
        a, b = self.logits(f, c)
        at = np.arange(len(slot))
        total = a[at, c] - _log_sum(a) + b[at, s] - _log_sum(b)
        return total.astype(np.float64) / np.log(10)

    def descend(self, f: np.ndarray, slot: np.ndarray, norms: list[np.ndarray]) -> None:
        """One AdaGrad step on the mean gradient rows of a minibatch."""
        c, s = slot // SLOTS, slot % SLOTS
        a, b = self.logits(f, c)
        at = np.arange(len(slot))
        grads = []
        for x, y in ((a, c), (b, s)):
            p, total, _ = _exp(x)
            p *= (-1 / total)[:, None]
            p[at, y] += 1
            grads.append(p)
        a, b = grads
        for k in range(KINDS):
            # In the order of feature and class both kinds of rows stand together: one sort for the two.
            row = f[:, k] * CLASSES + c
            order = np.argsort(row.astype(ROW_TYPE), kind="stable")
            row = row.take(order)
            for w, norm, grad, ordered in ((self.classes[k], norms[k], a, row // CLASSES), (self.slots[k], norms[KINDS + k], b, row)):
                begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                rows = ordered.take(begin)
                g = np.add.reduceat(grad.take(order, 0), begin, axis=0)
                norm[rows] += (g * g) @ np.ones(g.shape[1], np.float32)
                w[rows] += g * (np.float32(2 * RATE) / np.sqrt(norm[rows] + 1.0))[:, None]


def _exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp(x - top), its sums by row, and top: 0, or each row's greatest where the plain numbers are too large or small for singles."""
    one, top = np.ones(x.shape[1], np.float32), 0.0
    with np.errstate(over="ignore"):
        p = np.exp(x)
        total = p @ one
    if len(total) and not (total.min() > 1e-30 and total.max() < 1e30):
        top = x.max(axis=1)
        p = np.exp(x - top[:, None])
        total = p @ one
    return p, total, top


def _log_sum(x: np.ndarray) -> np.ndarray:
    _, total, top = _exp(x)
    return np.log(total) + top


def _run(texts: list[bytes | None], lexicon: Lexicon):
    """Token ids of texts among their distinct tokens, with the texts' token numbers, and the distinct tokens' figures."""
    local: dict[bytes, int] = {END: 0}
    ids, lengths = [], []
    for text in texts:
        words = text.lower().split() if text else []
        ids.extend([local.setdefault(w, len(local)) for w in words])
        ids.append(0)
        lengths.append(len(words) + 1)
    tokens = list(local)
    return np.array(ids, np.int64), np.array(lengths, np.int64), tokens, lexicon.look(tokens)


def _firsts(lengths: np.ndarray, n: int) -> np.ndarray:
    first = np.zeros(n, bool)
    first[np.concatenate([[0], np.cumsum(lengths)[:-1]])[: len(lengths)]] = True
    return first


def train_round(docs: DataFrame, lexicon, weights: Weights, spark: SparkSession) -> Weights:
    """One round of distributed gradient updates: every task descends on its documents' minibatches from the round's weights;
    the tasks' changes, cut into shards of rows, are averaged by the tokens behind them in a tree of grouped aggregations."""
    shared, lex = spark.sparkContext.broadcast(weights), lexicon
    shards = KINDS * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Weights.__new__(Weights)
        w.__dict__.update({k: v.copy() for k, v in shared.value.__dict__.items()})
        norms = [np.zeros(x.shape[0], np.float32) for part in (w.classes, w.slots) for x in part]
        done, task = 0, TaskContext.get().partitionId()
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                ids, lengths, _, (h, _, slot) = _run(whole.column(0).slice(at, 128).to_pylist(), lex.value)
                f = features_of(h[ids], _firsts(lengths, len(ids)))
                for k in range(0, len(ids), MINIBATCH):
                    w.descend(f[k : k + MINIBATCH], slot[ids[k : k + MINIBATCH]], norms)
                done += len(ids)
        if done:
            for k in range(KINDS):
                rows = ROWS // 8
                for j in range(8):
                    a = (w.classes[k][j * rows : (j + 1) * rows] - shared.value.classes[k][j * rows : (j + 1) * rows]).ravel()
                    b = (w.slots[k][j * rows * CLASSES : (j + 1) * rows * CLASSES] - shared.value.slots[k][j * rows * CLASSES : (j + 1) * rows * CLASSES]).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k * 8 + j], pa.int32()), pa.array([task // FAN_IN], pa.int32()), pa.array([done], pa.int64()), pa.array([np.concatenate([a, b]).astype(np.float16).tobytes()], pa.binary())],
                        ["shard", "branch", "tokens", "change"],
                    )

    def add(rows: pa.Table) -> pa.Table:
        total = 0.0
        for n, change in zip(rows["tokens"].to_pylist(), rows["change"], strict=True):
            total = total + np.frombuffer(change.as_buffer(), np.float16).astype(np.float64) * n
        return out(rows, "branch", total)

    def mean(rows: pa.Table) -> pa.Table:
        total = 0.0
        for change in rows["change"]:
            total = total + np.frombuffer(change.as_buffer(), np.float64)
        return out(rows, None, (total / sum(rows["tokens"].to_pylist())).astype(np.float32))

    def out(rows: pa.Table, branch: str | None, change: np.ndarray) -> pa.Table:
        first = {c: rows[c].slice(0, 1) for c in ("shard", branch) if c}
        return pa.table({**first, "tokens": pa.array([sum(rows["tokens"].to_pylist())], pa.int64()), "change": pa.array([change.tobytes()], pa.binary())})

    parts = docs.select(F.col("text").cast("binary")).mapInArrow(run, "shard int, branch int, tokens long, change binary")
    # The order of a sum changes its last digits: the changes are halves, their sums doubles, so that reruns agree in single.
    sums = parts.groupBy("shard", "branch").applyInArrow(add, "shard int, branch int, tokens long, change binary")
    got = sums.groupBy("shard").applyInArrow(mean, "shard int, tokens long, change binary").collect()  # always shards rows
    assert len(got) <= shards
    new = Weights.__new__(Weights)
    new.__dict__.update({k: v.copy() for k, v in weights.__dict__.items()})
    rows = ROWS // 8
    for r in got:
        k, j = divmod(r["shard"], 8)
        x = np.frombuffer(r["change"], np.float32)
        new.classes[k][j * rows : (j + 1) * rows] += x[: rows * CLASSES].reshape(rows, CLASSES)
        new.slots[k][j * rows * CLASSES : (j + 1) * rows * CLASSES] += x[rows * CLASSES :].reshape(rows * CLASSES, SLOTS)
    shared.unpersist()
    return new


def score(docs: DataFrame, training: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text), learning from training.

    Tokens are the words of the lower-cased text (A-Z) and one end. base_score is the add-one unigram sum. score is the log10
    probability under the model: the class of a token given hashed features of the two tokens before it (each and both),
    its slot in the class given the same features, and the token in its slot by add-one counts, what was never seen being
    one more token of the slot.

    Counts are taken over all training texts, and the rounds together read each of them once. Those of the frequent tokens are broadcast (a fixed number); the other tokens
    of a document are joined with their counts, as (document, token, times). Null text: the end alone. Repeated rows: equal
    results, each counted in training. No training rows: every count is 0. Extra columns are dropped.
    """
    spark = docs.sparkSession
    counts = checkpointed(token_counts(training))
    figures = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = int(figures["n"] or 0), int(figures["v"] or 0)
    top = counts.where(F.col("token") != F.lit(END)).orderBy(F.desc("c"), "token").limit(OWN - 1).collect()
    own = [END, *(bytes(r["token"]) for r in top)]

    mine = spark.sparkContext.broadcast({t: k for k, t in enumerate(own)})

    def slot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(K, np.int64)
        for b in batches:
            tokens = b.column(0).to_pylist()
            slot = np.fromiter((mine.value.get(t, -1) for t in tokens), np.int64, len(tokens))
            for i in np.flatnonzero(slot < 0):
                slot[i] = group_slot(tokens[i])
            np.add.at(total, slot, b.column(1).to_numpy() + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(K), pa.int32()), pa.array(total, pa.int64())], ["slot", "mass"])

    mass = np.ones(K)
    for r in counts.mapInArrow(slot_sums, "slot int, mass long").groupBy("slot").agg(F.sum("mass").alias("mass")).collect():  # K rows
        mass[r["slot"]] += r["mass"]
    threshold = _threshold(counts, v, frequent)
    common = counts.where(F.col("c") >= threshold).select("token", "c").toArrow()
    lexicon = Lexicon(list(zip(common["token"].to_pylist(), common["c"].to_pylist(), strict=True)), own, mass, n, v)
    lex = spark.sparkContext.broadcast(lexicon)
    weights = Weights(mass)
    # The id comes first: equal texts of different documents are dealt over the slices.
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SLICES))
    for r in range(SLICES):
        weights = train_round(training.where(part == r), lex, weights, spark)
    final = spark.sparkContext.broadcast(weights)
    base = float(np.log10(n + v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                ids, lengths, tokens, (h, c, slot) = _run(b.column(1).to_pylist(), lex.value)
                f = features_of(h[ids], _firsts(lengths, len(ids)))
                slots = slot[ids]
                model = np.concatenate([final.value.log10_slot(f[k : k + MINIBATCH], slots[k : k + MINIBATCH]) for k in range(0, len(ids), MINIBATCH)]) if len(ids) else np.empty(0)
                model -= lex.value.mass[slots]
                known = c[ids] > 0
                begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
                sums = lambda x: np.add.reduceat(x, begins) if len(begins) else np.empty(0)  # noqa: E731, B023
                rare_of = [[] for _ in lengths]
                where = np.flatnonzero(~known)
                for doc, t in zip(np.searchsorted(begins, where, side="right") - 1, ids[where], strict=True):
                    rare_of[doc].append(tokens[t])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array(lengths, pa.int64()),
                        pa.array(sums(known.astype(np.int64)), pa.int64()),
                        pa.array(sums(np.log10(c + 1.0)[ids]), pa.float64()),
                        pa.array(sums(model), pa.float64()),
                        pa.array([[(t, k) for t, k in Counter(x).items()] for x in rare_of], pa.list_(pa.struct([("token", pa.binary()), ("times", pa.int64())]))),
                    ],
                    ["doc_id", "n_tokens", "known", "logs", "model", "rare"],
                )

    shape = "doc_id long, n_tokens long, known long, logs double, model double, rare array<struct<token: binary, times: bigint>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = checkpointed(rows.mapInArrow(run, shape))
    # Rows of equal figures and rare tokens get equal sums, so they share a key.
    key = F.xxhash64("doc_id", "n_tokens", "logs", "model", "rare").alias("key")
    rare = rows.select(key, "rare").where("size(rare) > 0").dropDuplicates(["key"]).select("key", F.explode("rare").alias("r")).select("key", "r.token", "r.times")
    found = rare.join(counts.where(F.col("c") < threshold), "token").groupBy("key").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("rare_logs"))
    out = rows.select("*", key).drop("rare").join(found, "key", "left")
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * base).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )


def _threshold(counts: DataFrame, v: int, frequent: int) -> int:
    """The least count from which on there are at most so many tokens; the table of counts is grouped by its values."""
    if v <= frequent:
        return 1
    values = counts.groupBy(F.least("c", F.lit(100_000)).alias("c")).count().orderBy(F.desc("c")).collect()  # at most 100,000 rows
    taken, least = 0, 100_001
    for r in values:
        taken += r["count"]
        if taken > frequent:
            break
        least = r["c"]
    return int(least)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, docs.where(in_training(F.col("doc_id"))))
    return found.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
