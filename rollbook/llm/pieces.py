"""SentencePiece encoding and decoding over a relational lattice."""

from __future__ import annotations

import hashlib
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
import sentencepiece
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, checkpointed, setting, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: The encodings of so many most frequent words are broadcast (about 20 bytes each, 20 MB); those of the others are joined.
FREQUENT = 1_000_000
#: An unknown character scores this much less than the worst piece, as in the library.
UNKNOWN_PENALTY = 10.0
#: Characters of a substring that tell how long a piece that begins with them can be.
HEAD = 4
#: Words longer than this go by a hash and are cut into overlapping slices of SLICE characters for the lattice.
LONG = 64
SLICE = 256
#: Characters of the texts that a task takes into Python objects at a time.
CHARS = 1_000_000
#: Distinct chunks of text that a task counts, and whose encodings it holds, at a time (some 150 bytes each).
COUNTED, HELD = 600_000, 300_000
#: Keys up to which a hash aggregation keeps its groups in memory: words are short, a partition holds some 100,000.
KEYS_IN_MEMORY = "1000000"

@dataclass(frozen=True)
class Pieces:
    """A piece table: (piece, id, score) of ordinary pieces, the first byte piece's id, and the pattern that cuts words."""

    rows: tuple[tuple[str, int, float], ...]
    byte_id: int
    longest: int
    pattern: str
    names: tuple[str, ...]


def load_pieces(path: str = MODEL) -> Pieces:
    """Reads the piece table of a SentencePiece model with byte fallback.

    Words are cut where no piece of the table can cross: before a space mark, between signs and other characters, and
    around characters that are in no piece but their own (digits, mostly).
    """
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    names = tuple(p.id_to_piece(i) for i in range(p.get_piece_size()))
    special = [p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i) for i in range(len(names))]
    rows = tuple((n, i, p.get_score(i)) for i, n in enumerate(names) if not special[i])
    byte_id = p.piece_to_id("<0x00>")
    if any(names[byte_id + k] != f"<0x{k:02X}>" for k in range(256)):
        raise ValueError("the byte pieces are not in order")
    if any(re.search(f"[^{SPACE}]{SPACE}", n) for n, _, _ in rows):
        raise ValueError("a piece crosses a word's start")
    # Signs: ASCII punctuation and control spaces. Where a piece joins a sign with another character, a letter or digit turns
    # the sign into a letter, and any other character becomes a sign itself, until no piece crosses.
    signs = set(string.punctuation + "\t\n\r")
    near = {(a, b) for n, _, _ in rows for x, y in zip(n, n[1:], strict=False) for a, b in ((x, y), (y, x)) if SPACE not in (a, b)}
    while crossing := {(a, b) for a, b in near if a in signs and b not in signs}:
        signs -= {a for a, b in crossing if b.isalnum() and b.isascii()}
        signs |= {b for a, b in crossing if a in signs and not (b.isalnum() and b.isascii())}
    joined = {c for n, _, _ in rows if len(n) > 1 for c in n}
    alone = {n for n, _, _ in rows if len(n) == 1} - joined - signs - {SPACE}
    of, one = ("".join(re.escape(c) for c in sorted(x)) for x in (signs, alone))
    pattern = f"{SPACE}*[^{of}{one}{SPACE}]+|{SPACE}*[{of}]+|{SPACE}+" + (f"|[{one}]" if one else "")
    if not re.fullmatch(f"{SPACE}*[^{of}{one}{SPACE}]+", SPACE + string.ascii_letters):
        raise ValueError("a letter is cut from its neighbours")
    return Pieces(rows, byte_id, max(len(n) for n, _, _ in rows), pattern, names)


def marked(text: str) -> str:
    """The text as the lattice sees it: spaces as marks, one mark before the first word; empty stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def key_of(word: str) -> str:
    """What a word goes by: itself, or its hash if it is long."""
    return word if len(word) <= LONG else "\0" + hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of rows with CHARS bytes of text or so, one row at least."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for k, n in enumerate(sizes.tolist()):
        if k > begin and total + n > CHARS:
            yield begin, k
            begin, total = k, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def chunks_of(text: str | None, find) -> list[str]:
    """The chunks of a text: between spaces; each stands for the words of itself with a mark before it.

    Where that would not give the text's words (several spaces in a row or at an end, marks in the text), each word is a
    chunk of its own, told by one more mark.
    """
    if not text:
        return []
    if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
        return [SPACE + w for w in find(marked(text))]
    return text.split(" ")


def words_of(chunk: str, find) -> list[str]:
    if chunk.isalpha() and chunk.isascii():  # never cut, see load_pieces
        return [SPACE + chunk]
    return [chunk[1:]] if chunk[:1] == SPACE else find(SPACE + chunk)


def word_slices(docs: DataFrame, pieces: Pieces, text: str = "text") -> DataFrame:
    """(key, base, part, own, c): the distinct words of all texts and how often they occur, long ones in slices.

    A word of LONG characters at most is one row, base 0, part null. Of a longer one each row holds the own characters from
    base on, and those after them that a piece may reach. Counted in the task first; then partitioned by key.
    """
    pattern, reach = pieces.pattern, pieces.longest - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).findall
        seen: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words: dict[str, int] = {}
            for chunk, c in seen.items():
                for w in words_of(chunk, find):
                    words[w] = words.get(w, 0) + c
            seen.clear()
            long = [w for w in words if len(w) > LONG]
            rows = [(key_of(w), k, w[k : k + SLICE + reach], min(SLICE, len(w) - k), words[w]) for w in long for k in range(0, len(w), SLICE)]
            for w in long:
                del words[w]
            n, names, kinds = len(words), ["key", "base", "part", "own", "c"], (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.array(list(words.values()), pa.int64())], names)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

        for b in batches:
            for begin, end in _slices(b.column(0)):
                for one in b.column(0).slice(begin, end - begin).to_pylist():
                    seen.update(chunks_of(one, find))
                if len(seen) > COUNTED:
                    yield from out()
        yield from out()

    parts = docs.select(text).mapInArrow(run, "key string, base int, part string, own int, c long").repartition("key")
    parts = parts.groupBy("key", "base", "part", "own").agg(F.sum("c").alias("c"))
    return parts.select("key", F.coalesce("base", F.lit(0)).alias("base"), "part", F.coalesce("own", F.length("key")).alias("own"), "c")


def lattice(slices: DataFrame, pieces: Pieces) -> DataFrame:
    """(key, c, ids) for the words of slices (see word_slices): the segmentation with the best sum of piece scores.

    Every substring that can be a piece is an edge if the piece table has it; a character that is no piece is an edge that
    stands for its bytes. How long a substring can be is read from its first HEAD characters: no longer than the longest piece
    that begins with them. The edges of a word come together and are folded from left to right; of equal sums the longest
    last piece stays. The piece table is broadcast: its size is that of the model's vocabulary.

    An edge is gathered as one number: where it ends, its length (long ones first) and its piece, or its character above
    2^23, so that edges sort as they are folded. The state of the fold holds the open position with its best sum and edge, the
    sums of the last positions only, and the best edges of the positions of the block.
    """
    spark = slices.sparkSession
    table_ = F.broadcast(spark.createDataFrame([(n, i) for n, i, _ in pieces.rows], "piece string, id int"))
    reach: dict[str, int] = {}
    for n, _, _ in pieces.rows:
        if len(n) >= HEAD:
            reach[n[:HEAD]] = max(reach.get(n[:HEAD], 0), len(n))
    heads = F.broadcast(spark.createDataFrame(list(reach.items()), "head string, reach int"))
    begun = slices.select("key", "c", "base", F.coalesce("part", "key").alias("part"), F.explode(F.sequence(F.lit(1), F.col("own"))).alias("s"))
    begun = begun.withColumn("head", F.expr(f"substring(part, s, {HEAD})")).join(heads, "head", "left")
    longest = F.least(F.coalesce("reach", F.lit(HEAD - 1)), F.length("part") - F.col("s") + 1)
    cut = begun.select("key", "c", (F.col("base") + F.col("s") - 1).alias("at"), F.expr(f"substring(part, s, {pieces.longest})").alias("rest"), F.explode(F.sequence(F.lit(1), longest)).alias("k"))
    edges = cut.withColumn("piece", F.expr("substring(rest, 1, k)")).join(table_, "piece", "left").where("id IS NOT NULL OR k = 1")
    code = F.shiftleft((F.col("at") + F.col("k")).cast("long"), 32) + F.shiftleft((255 - F.col("k")).cast("long"), 24) + F.coalesce(F.col("id"), F.lit(1 << 23) + F.ascii("piece"))
    grouped = edges.groupBy("key", "c").agg(F.sort_array(F.collect_list(code)).alias("codes"))
    lowest = min(x for _, _, x in pieces.rows) - UNKNOWN_PENALTY
    score = [lowest] * len(pieces.names)
    for _, i, x in pieces.rows:
        score[i] = x
    # Edges in blocks, as a fold copies its state at each step: what grows with the word is copied once a block only.
    block = 512
    blocks = F.expr(
        f"""IF(size(codes) <= {block}, array(codes), transform(sequence(0, (size(codes) - 1) DIV {block}),
              j -> transform(sequence(j * {block}, least(j * {block} + {block - 1}, size(codes) - 1)), i -> codes[i])))"""
    )
    read = F.expr(
        f"""transform(codes, of -> transform(of, c -> named_struct(
              'to', cast(shiftright(c, 32) AS int), 'at', cast(shiftright(c, 32) - 255 + (shiftright(c, 24) & 255) AS int), 'code', c,
              'score', IF((c & {1 << 23}) = 0, cast(split('{",".join(map(repr, score))}', ',') AS array<double>)[cast(c & {(1 << 23) - 1} AS int)], {lowest}D))))"""
    )
    keep = pieces.longest
    window = 4 * keep
    best = F.expr(
        f"""aggregate(edges, named_struct('to', 0, 'sum', 0D, 'via', 0L, 'base', 0, 'sums', cast(array() AS array<double>), 'done', cast(array() AS array<array<bigint>>)),
              (all, of) -> aggregate(of, named_struct('to', all.to, 'sum', all.sum, 'via', all.via, 'base', all.base, 'sums', all.sums, 'open', cast(array() AS array<bigint>)),
                (acc, e) -> CASE
                  WHEN e.to > acc.to THEN named_struct('to', e.to, 'sum', IF(e.at = acc.to, acc.sum, acc.sums[e.at - acc.base]) + e.score, 'via', e.code,
                    'base', IF(size(acc.sums) < {window}, acc.base, acc.to - {keep - 1}),
                    'sums', array_append(IF(size(acc.sums) < {window}, acc.sums, slice(acc.sums, {1 - keep}, {keep - 1})), acc.sum),
                    'open', array_append(acc.open, acc.via))
                  WHEN acc.sums[e.at - acc.base] + e.score > acc.sum THEN
                    named_struct('to', acc.to, 'sum', acc.sums[e.at - acc.base] + e.score, 'via', e.code, 'base', acc.base, 'sums', acc.sums, 'open', acc.open)
                  ELSE acc END,
                acc -> named_struct('to', acc.to, 'sum', acc.sum, 'via', acc.via, 'base', acc.base, 'sums', acc.sums, 'done', array_append(all.done, acc.open))),
              all -> flatten(array_append(all.done, array(all.via))))"""
    )
    # Back from the end, in blocks of positions: position p is entry p of best.
    back = F.expr(
        f"""aggregate(sequence(size(best) - 1, 1, -{block}), named_struct('p', size(best) - 1, 'done', cast(array() AS array<array<int>>)),
              (all, top) -> aggregate(sequence(top, greatest(top - {block - 1}, 1), -1), named_struct('p', all.p, 'ids', cast(array() AS array<int>)),
                (acc, p) -> IF(p = acc.p, named_struct('p', p - 255 + cast(shiftright(best[p], 24) & 255 AS int), 'ids', array_append(acc.ids, cast(best[p] & 16777215 AS int))), acc),
                acc -> named_struct('p', acc.p, 'done', array_append(all.done, acc.ids))),
              all -> reverse(flatten(all.done)))"""
    )
    # A character above 2^23 becomes its bytes in UTF-8.
    of = lambda shift, head: f"{pieces.byte_id + head} + (shiftright(i - {1 << 23}, {shift}) & {63 if head == 128 else 31 if head == 192 else 15 if head == 224 else 7})"
    as_bytes = f"""flatten(transform(ids, i -> CASE WHEN i < {1 << 23} THEN array(i)
        WHEN i < {(1 << 23) + 0x80} THEN array({pieces.byte_id} + i - {1 << 23})
        WHEN i < {(1 << 23) + 0x800} THEN array({of(6, 192)}, {of(0, 128)})
        WHEN i < {(1 << 23) + 0x10000} THEN array({of(12, 224)}, {of(6, 128)}, {of(0, 128)})
        ELSE array({of(18, 240)}, {of(12, 128)}, {of(6, 128)}, {of(0, 128)}) END))"""
    out = grouped.select("key", "c", blocks.alias("codes")).select("key", "c", read.alias("edges")).select("key", "c", best.alias("best")).select("key", "c", back.alias("ids"))
    return out.select("key", "c", F.when(F.exists("ids", lambda i: i >= 1 << 23), F.expr(as_bytes)).otherwise(F.col("ids")).alias("ids"))


def _hashes(keys: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _digest(text: str | None) -> bytes:
    return xxhash.xxh3_128_digest(text or "")


def _frequent(known: DataFrame, most: int) -> tuple[int, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A count, and the words that occur so often or oftener, most of them at most: sorted hashes with the words' ranks, and the
    ids by rank with where each begins."""
    least = 1
    if known.count() > most:
        # Words by how often they occur: no more rows than there are such figures, at most 100,000.
        seen = known.groupBy(F.least("c", F.lit(100_000)).alias("c")).count().orderBy(F.desc("c")).collect()
        room = np.cumsum([r["count"] for r in seen]) <= most
        least = int(seen[int(room.sum()) - 1]["c"]) if room.any() else 100_001
    packed = known.where(F.col("c") >= least).mapInArrow(_pack, "h binary, c binary, n binary, ids binary").collect()
    h, c, n, flat = (np.frombuffer(b"".join(bytes(r[k]) for r in packed), t) for k, t in (("h", np.uint64), ("c", np.int64), ("n", np.int32), ("ids", np.int32)))
    begins = np.cumsum(n, dtype=np.int64) - n
    by_rank = np.lexsort((h, -c))
    n, begins, h = n[by_rank], begins[by_rank], h[by_rank]
    starts = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    ids = flat[np.repeat(begins - starts[:-1], n) + np.arange(starts[-1])] if len(flat) else flat
    order = np.argsort(h)
    return least, (h[order], order.astype(np.int32)), (starts, ids)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes, counts, lengths and ids of a batch's words, as bytes."""
    for b in batches:
        n = pa.compute.list_value_length(b.column("ids")).to_numpy(zero_copy_only=False).astype(np.int32)
        ids = b.column("ids").flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        parts = (_hashes(b.column("key").to_pylist()), b.column("c").to_numpy(), n, ids)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["h", "c", "n", "ids"])


class _Numbers(dict):
    """Numbers what it is asked for, in order."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class _Grown:
    """Whole numbers that are appended to; room is doubled, so that no number is copied more than twice or so."""

    def __init__(self) -> None:
        self.room, self.used = np.empty(1024, np.int64), 0

    def append(self, more: np.ndarray) -> None:
        if self.used + len(more) > len(self.room):
            self.room = np.concatenate([self.room[: self.used], np.empty(max(self.used, 2 * len(more)), np.int64)])
        self.room[self.used : self.used + len(more)] = more
        self.used += len(more)


class _Chunks:
    """What a task knows of the chunks it has met: their words, as ranks of frequent words, or below 0 as numbers of others."""

    def __init__(self, pieces: Pieces, shared: tuple[np.ndarray, np.ndarray]):
        self.keys, self.ranks = shared
        self.find = re.compile(pieces.pattern).findall
        self.clear()

    def clear(self) -> None:
        self.index = _Numbers()
        self.begins, self.counts, self.flat = _Grown(), _Grown(), _Grown()
        self.others: list[str] = []

    def look(self, texts: list[str | None]) -> list[np.ndarray]:
        """The chunks of each text, by number."""
        if len(self.index) > HELD:
            self.clear()
        old, number = len(self.index), self.index.__getitem__
        order = []
        for text in texts:
            chunks = chunks_of(text, self.find)
            order.append(np.fromiter(map(number, chunks), np.int64, len(chunks)))
        found = [words_of(chunk, self.find) for chunk in islice(self.index, old, None)]
        if found:
            per = list(map(len, found))
            names = [w if len(w) <= LONG else key_of(w) for w in chain.from_iterable(found)]
            h = _hashes(names)
            value = np.full(len(h), -1, np.int64)
            if len(self.keys):
                k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                value = np.where(self.keys[k] == h, self.ranks[k], value)
            other = np.flatnonzero(value < 0)
            value[other] = -1 - len(self.others) - np.arange(len(other))
            self.others += [names[i] for i in other.tolist()]
            n = np.array(per, np.int64)
            self.begins.append(self.flat.used + np.cumsum(n) - n)
            self.counts.append(n)
            self.flat.append(value)
        return order


def _gather(flat: np.ndarray, begins: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n entries of flat from each of begins on, end to end."""
    ends = np.cumsum(n)
    at = np.repeat(begins - (ends - n), n)
    at += np.arange(len(at))
    return flat.take(at)


def _begin(pieces: Pieces, at: int, held: list[int], shared):
    """Batches (_row, columns of docs) to blocks of rows (_block, _data, _words, _rare): the held columns, numbers of words and
    digests of the texts as one Arrow stream; the words, as ranks of the frequent ones and, after these, places in the list
    of the block's distinct other words; and that list. The words' four bytes go one after the other, which packs well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, most = _Chunks(pieces, shared.value), len(shared.value[0])
        pack = zstandard.ZstdCompressor(1).compress
        for whole in batches:
            for begin, end in _slices(whole.column(at)):
                batch = whole.slice(begin, end - begin)
                texts = batch.column(at).to_pylist()
                order = chunks.look(texts)
                every = np.concatenate(order)
                n = chunks.counts.room.take(every)
                words = _gather(chunks.flat.room, chunks.begins.room.take(every), n)
                stops = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum([len(o) for o in order])])]
                other = words < 0
                which, place = np.unique(-1 - words[other], return_inverse=True)
                rare: dict[str, int] = {}
                spot = np.fromiter((rare.setdefault(chunks.others[k], len(rare)) for k in which.tolist()), np.int64, len(which))
                words[other] = most + spot[place]
                data = pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), pa.array(np.diff(stops)), pa.array([_digest(t) for t in texts], pa.binary())], [f"c{i}" for i in range(len(held) + 2)])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, data.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                    to.write_batch(data)
                planes = pack(np.ascontiguousarray(words.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(0, 1), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([planes], pa.binary()), pa.array([list(rare)], pa.list_(pa.string()))],
                    ["_block", "_data", "_words", "_rare"],
                )

    return run


def _rare_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_block, _at, key): a row for each word that a block leaves open."""
    for b in batches:
        for block, words in zip(b.column("_block").to_pylist(), b.column("_rare"), strict=True):
            n = len(words.values)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(n), pa.int32()), words.values], ["_block", "_at", "key"])


def _end(pieces: Pieces, names: list[str], check: bool, shared):
    """Blocks with the found words (_found: _at, ids) to the held columns, ids and whether they decode to the text."""
    decoded = _decoder(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, flat = shared.value
        most = len(starts) - 1
        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for data, planes, rare, found in zip(b.column("_data"), b.column("_words"), b.column("_rare"), b.column("_found"), strict=True):
                with pa.ipc.open_stream(data.as_buffer()) as source:
                    rows = source.read_next_batch()
                words = np.ascontiguousarray(np.frombuffer(unpack(planes.as_py()), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
                other = words >= most
                low = np.where(other, 0, words) if most else words
                n = np.where(other, 0, starts[low + 1] - starts[low]) if most else np.zeros(len(words), np.int64)
                if other.any():
                    open_ = len(rare.values)
                    if not found.is_valid or len(found.values) != open_:
                        raise RuntimeError("a word has no encoding")
                    place, lists = found.values.field("_at").to_numpy(), found.values.field("ids")
                    offsets = lists.offsets.to_numpy()
                    begins, counts = np.empty(open_, np.int64), np.empty(open_, np.int64)
                    begins[place], counts[place] = offsets[:-1], np.diff(offsets)
                    n[other] = counts[words[other] - most]
                    ids = np.empty(int(n.sum()), np.int32)
                    inside = np.repeat(other, n)
                    ids[inside] = _gather(lists.values.to_numpy(), begins[words[other] - most], n[other])
                    ids[~inside] = _gather(flat, starts[low[~other]] if most else low[~other], n[~other])
                else:
                    ids = _gather(flat, starts[low], n)
                per = rows.column(rows.num_columns - 2).to_numpy()
                stops = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(per)])]
                more = [pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(ids, pa.int32()))]
                if check:
                    more.append(pa.array([_digest(t) == d for t, d in zip(decoded(ids, stops), rows.column(rows.num_columns - 1).to_pylist(), strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-2], *more], names)

    return run


def encode(docs: DataFrame, pieces: Pieces | None = None, text: str = "text", added: str = "piece_ids", check: str | None = None, keep: list[str] | None = None, frequent: int = FREQUENT) -> DataFrame:
    """docs with the piece ids of text added. Distinct words are encoded once, by the lattice; the texts are then mapped.

    The sum of piece scores decides (unigram reading of the scores). check: a column that tells whether the ids decode to
    the text. keep: the columns of docs that the result has; all if none are named.

    The encodings of the frequent words are broadcast, a fixed number of them. The other words of the texts are joined with
    theirs, as (block, place, word), for blocks of rows that travel as one, and go back to their blocks. Rows are numbered where
    they are read, so docs must be a table or a checkpoint, which a repeated task reads in the same order; a block whose words are not all found is an error.

    Null and empty texts: an empty array. Repeated rows each get their ids. Words of any length: the fold's cost follows the
    length, and a word's edges come together in one task. Columns of the added names are replaced, other names don't matter.
    """
    pieces = pieces or load_pieces()
    spark = docs.sparkSession
    docs = docs.drop(added, *([check] if check else []))
    names = [c for c in (keep or docs.columns) if c not in (added, check)]
    columns = [*names, *([text] if text not in names else [])]
    with setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", KEYS_IN_MEMORY):
        known = checkpointed(lattice(word_slices(docs, pieces, text), pieces))
    least, by_hash, by_rank = _frequent(known, frequent)
    share = spark.sparkContext.broadcast
    # The columns go by their places: docs may have columns of any names.
    base = docs.select(F.monotonically_increasing_id().alias("_row"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    begin = _begin(pieces, 1 + columns.index(text), list(range(1, 1 + len(names))), share(by_hash))
    begun = base.mapInArrow(begin, "_block long, _data binary, _words binary, _rare array<string>").repartition("_block")
    rare = begun.mapInArrow(_rare_rows, "_block long, _at int, key string").join(known.where(F.col("c") < least).select("key", "ids"), "key")
    found = rare.groupBy("_block").agg(F.collect_list(F.struct("_at", "ids")).alias("_found"))
    made = [T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("check", T.BooleanType())] if check else [])]
    schema = T.StructType([*base.schema.fields[1 : 1 + len(names)], *made])
    out = begun.join(found.hint("shuffle_hash"), "_block", "left").mapInArrow(_end(pieces, schema.names, bool(check), share(by_rank)), schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.col("ids").alias(added), *([F.col("check").alias(check)] if check else []))


def decode_ids(ids: list[int], names: tuple[str, ...], byte_id: int) -> str:
    """The text of a list of ids; bytes that are no UTF-8 become replacement characters."""
    raw = b"".join(bytes([i - byte_id]) if byte_id <= i < byte_id + 256 else names[i].encode() for i in ids)
    text = raw.decode("utf-8", "replace").replace(SPACE, " ")
    return text[1:] if text[:1] == " " else text


def _decoder(pieces: Pieces):
    """A function from the ids of many texts, end to end, and where each begins, to the texts."""
    raw = [bytes([i - pieces.byte_id]) if pieces.byte_id <= i < pieces.byte_id + 256 else n.encode() for i, n in enumerate(pieces.names)]
    lengths = np.array([len(x) for x in raw], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.frombuffer(b"".join(raw), np.uint8)
    mark = SPACE.encode()

    def run(ids: np.ndarray, stops: np.ndarray) -> list[str]:
        ids = ids.astype(np.int64)
        n = lengths.take(ids)
        ends = np.cumsum(n)
        from_ = np.repeat(starts.take(ids) - (ends - n), n)
        from_ += np.arange(len(from_))
        whole = flat.take(from_).tobytes()
        at = np.concatenate([[0], ends])[stops]
        parts = (whole[a:z].replace(mark, b" ") for a, z in zip(at, at[1:], strict=False))
        return [(b[1:] if b[:1] == b" " else b).decode("utf-8", "replace") for b in parts]

    return run


def decode(rows: DataFrame, pieces: Pieces | None = None, ids: str = "piece_ids", added: str = "decoded") -> DataFrame:
    """rows with the text of their piece ids added; null ids give null, none the empty text."""
    decoded = _decoder(pieces or load_pieces())
    base = rows.drop(added)
    at = base.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                lists = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in batch.column(at)]
                stops = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in lists])]).astype(np.int64)
                texts = decoded(np.concatenate([x for x in lists if x is not None] or [np.empty(0, np.int64)]), stops)
                out = [None if x is None else t for x, t in zip(lists, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, added])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(added, T.StringType())]))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    found = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), check="round_trip", keep=["doc_id"])
    return found.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "round_trip")
