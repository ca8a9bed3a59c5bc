"""Language identification by cross-parsing: phrases of a text against the suffix automaton of each language."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_remainder, table

UNKNOWN = "und"
#: The automaton of a language is built from at most so many of its labelled texts, those of the least id hashes, ...
TRAIN_DOCS = 40
#: ... and of so many characters of them: whole texts as long as they fit, of a language with longer ones only the head of one.
TRAIN_CHARS = 240_000
#: The most frequent letters have a column in the dense tables of the automata; steps by other letters are searched for.
ALPHABET = 62
#: Cells (4 bytes each) of all dense tables; with more states than that allows for, all steps by letters are searched for.
DENSE_CELLS = 64_000_000
#: A text is parsed in windows of so many letters and spaces; a phrase ends with its window.
WINDOW = 1024


def training_texts(docs: DataFrame, usable: Column) -> list[tuple[str, str]]:
    """(lang, text) of a bounded sample of the labelled rows of every language: TRAIN_DOCS texts and TRAIN_CHARS characters, one text at least."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    long, h = F.length("text") > TRAIN_CHARS, F.xxhash64("text")
    # Which texts: found from hashes alone, so that no text is shuffled that isn't taken. A language has TRAIN_DOCS of them at most.
    first = W.partitionBy("lang").orderBy("long", "h")
    told = rows.select("lang", long.alias("long"), h.alias("h")).distinct().withColumn("k", F.row_number().over(first)).where(f"k <= {TRAIN_DOCS}").select("lang", "h")
    taken = rows.withColumn("h", h).join(F.broadcast(told), ["lang", "h"], "left_semi")
    # The head of a longer text begins with its first letter.
    head = F.substring(F.regexp_replace("text", r"^\P{L}+", ""), 1, TRAIN_CHARS)
    cut = taken.select("lang", F.when(long, head).otherwise(F.col("text")).alias("text"), "h", long.alias("long"))
    first = W.partitionBy("lang").orderBy("long", "h", "text")
    picked = cut.distinct().withColumn("k", F.row_number().over(first)).where(f"k <= {TRAIN_DOCS}")
    picked = picked.withColumn("chars", F.sum(F.length("text")).over(first.rowsBetween(W.unboundedPreceding, W.currentRow))).where(f"k = 1 OR chars <= {TRAIN_CHARS}")
    return sorted((r["lang"], r["text"]) for r in picked.select("lang", "text").collect())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def alphabet_of(texts: list[str]) -> np.ndarray:
    """Code points of all letters of the texts, the most frequent first. Their symbols: 2 and up; 1 is any other letter, 0 all else."""
    seen = np.bincount(np.concatenate([_codes(t.lower()) for t in texts] or [np.empty(0, np.uint32)]), minlength=128)
    letters = [c for c in np.flatnonzero(seen) if chr(c).isalpha()]
    letters.sort(key=lambda c: (-seen[c], c))
    return np.array(letters, np.uint32)


def symbol_map(letters: np.ndarray) -> np.ndarray:
    """The whole table of code points, letters of either case alike."""
    every = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.min_scalar_type(len(letters) + 1), 0x110000)
    for k, c in enumerate(letters):
        every[c] = k + 2
        for other in {chr(c).upper(), chr(c).title()}:
            if len(other) == 1 and other.lower() == chr(c):
                every[ord(other)] = k + 2
    return every


def squeezed(symbols: np.ndarray) -> np.ndarray:
    """Runs of other characters as one 0, none at the ends."""
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    out = symbols[keep]
    return out[1 if len(out) and out[0] == 0 else 0 : len(out) - 1 if len(out) > 1 and out[-1] == 0 else len(out)]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every factor of the symbols (built letter by letter)."""
    nexts: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


def _edges(texts: list[str], symbols: np.ndarray) -> np.ndarray:
    """(state, symbol, next) of the automaton of a language's texts."""
    # Texts are told apart by symbol 1, which is never followed.
    states = suffix_automaton([s for t in texts for s in [*squeezed(symbols[_codes(t)]).tolist(), 1]])
    return np.array([(k, c, to) for k, at in enumerate(states) for c, to in at.items() if c != 1], np.int32).reshape(-1, 3)


def packed_edges(edges: np.ndarray) -> bytes:
    """Edges in order of their states, column by column as differences, compressed: most lead to the next state."""
    state, symbol, to = edges.T.astype(np.int32)
    return zlib.compress(np.concatenate([np.diff(state, prepend=np.int32(0)), symbol, to - state]).astype(np.int32).tobytes(), 6)


def unpacked_edges(packed: bytes) -> np.ndarray:
    """What packed_edges took."""
    step, symbol, ahead = np.frombuffer(zlib.decompress(packed), np.int32).reshape(3, -1)
    state = np.cumsum(step, dtype=np.int32)
    return np.column_stack([state, symbol, state + ahead])


def train(samples: list[tuple[str, str]], spark: SparkSession | None = None) -> dict:
    """The model: languages, alphabet, and per language the edges (state, symbol, next) of its automaton, packed.

    With a session each automaton is built in a task of its own, which needs some hundred bytes a character; the driver passes
    the packed edges on and never unpacks them."""
    letters = alphabet_of([t for _, t in samples])
    by_lang: dict[str, list[str]] = {}
    for lang, text in samples:
        by_lang.setdefault(lang, []).append(text)
    langs = sorted(by_lang)
    if spark is None or not langs:
        symbols = symbol_map(letters)
        return {"langs": langs, "letters": letters, "edges": [packed_edges(_edges(by_lang[lang], symbols)) for lang in langs]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = symbol_map(letters)
        for b in batches:
            for k, texts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed_edges(_edges(texts, symbols))], pa.binary())], ["k", "edges"])

    rows = spark.createDataFrame([(k, by_lang[lang]) for k, lang in enumerate(langs)], "k int, texts array<string>").repartition(len(langs), "k")
    made = {r["k"]: bytes(r["edges"]) for r in rows.mapInArrow(run, "k int, edges binary").collect()}
    return {"langs": langs, "letters": letters, "edges": [made[k] for k in range(len(langs))]}


class Parser:
    """Dense tables, and sorted steps by rarer letters, made from a model on an executor; the states of all windows of a batch advance together."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.symbols = symbol_map(model["letters"])
        edges = [unpacked_edges(e) for e in model["edges"]]
        sizes = [int(e[:, [0, 2]].max(initial=0)) + 1 for e in edges]
        self.every = len(model["letters"]) + 2
        self.width = min(len(model["letters"]), ALPHABET) + 2
        if sum(sizes) * self.width > DENSE_CELLS:
            self.width = 2
        self.tables, self.steps = [], []
        for n, e in zip(sizes, edges, strict=True):
            rare = e[:, 1] >= self.width
            key = e[rare, 0].astype(np.int64) * self.every + e[rare, 1]
            order = np.argsort(key)
            self.steps.append((key[order], e[rare, 2][order] * self.width))
            e = e[~rare]
            t = np.full((n, self.width), -1, np.int32)
            t[e[:, 0], e[:, 1]] = e[:, 2] * self.width
            start = np.where(t[0] >= 0, t[0], 0)
            # A missing step ends the phrase: the next one begins with this symbol. It is kept as -1 - state.
            t = np.where(t >= 0, t, -1 - start)
            self.tables.append(np.ascontiguousarray(t, np.int32).ravel())

    def _searched(self, j: int, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Steps of language j by symbols that have no column, as the dense table would give them."""
        keys, to = self.steps[j]
        if not len(keys):
            return np.full(len(symbols), -1, np.int32)

        def step(from_: np.ndarray) -> np.ndarray:
            key = from_ * self.every + symbols
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[k] == key, to[k], -1)

        found = step(state.astype(np.int64) // self.width)
        return np.where(found >= 0, found, -1 - np.maximum(step(np.zeros(len(symbols), np.int64)), 0))

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each text, and the phrases that each language needs for it (text, language)."""
        parts, owner, letters = [], [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if not text:
                continue
            s = squeezed(self.symbols[_codes(text)])
            letters[k] = np.count_nonzero(s)
            for at in range(0, len(s), WINDOW):
                parts.append(s[at : at + WINDOW])
                owner.append(k)
        counts = np.zeros((len(texts), len(self.langs)), np.int64)
        if not parts:
            return letters, counts
        lengths = np.array([len(p) for p in parts])
        order = np.argsort(-lengths, kind="stable")
        grid = np.zeros((int(lengths.max()), len(parts)), self.symbols.dtype)
        for column, k in enumerate(order):
            grid[: lengths[k], column] = parts[k]
        alive = np.searchsorted(-lengths[order], -np.arange(len(grid)), side="left")
        owners = np.array(owner)[order]
        wide = (grid >= self.width).any(axis=1)
        for j, t in enumerate(self.tables):
            state = np.zeros(len(parts), np.int32)
            ended = np.zeros(len(parts), np.int64)
            for i in range(len(grid)):
                a = alive[i]
                if wide[i]:
                    far = grid[i, :a] >= self.width
                    to = t[state[:a] + np.where(far, 0, grid[i, :a])]
                    to[far] = self._searched(j, state[:a][far], grid[i, :a][far].astype(np.int64))
                else:
                    to = t[state[:a] + grid[i, :a]]
                broke = to < 0
                begun = np.where(broke, -1 - to, to)
                # A step that is missing ends the phrase before it, if there is one; a symbol that no phrase begins with is one.
                ended[:a] += broke & (state[:a] > 0)
                ended[:a] += begun == 0
                state[:a] = begun
            counts[:, j] = np.bincount(owners, weights=ended + (state > 0), minlength=len(texts))
        return letters, counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and phrases per letter of the best language for each text."""
        letters, counts = self.phrases(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        rate = counts / np.maximum(letters, 1)[:, None]
        best = rate.argmin(axis=1)
        low = rate[np.arange(len(texts)), best]
        other = np.partition(rate, 1, axis=1)[:, 1] if rate.shape[1] > 1 else np.ones(len(texts))
        score = np.where(letters > 0, np.clip(1 - low / np.maximum(other, 1e-9), 0, 1), 0.0)
        return [self.langs[b] if n else UNKNOWN for b, n in zip(best, letters, strict=True)], score, np.where(letters > 0, low, 0.0)


def identify(docs: DataFrame, model: dict, prefix: str = "") -> DataFrame:
    """docs with lang_pred, score (how far the best language is from the next, 0 to 1) and phrase_rate, each after prefix.

    The language that needs the fewest phrases per letter wins; of equal ones the first by name. Texts that are null or
    without a letter: und, score 0. Every letter of a text counts. Columns of the added names are replaced.
    """
    added = [prefix + "lang_pred", prefix + "score", prefix + "phrase_rate"]
    docs = docs.drop(*added)
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(shared.value)  # of this task alone: the tables are large, and workers live on
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                langs, score, rate = parser.predict(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], [*batch.schema.names, *added])

    kinds = (T.StringType(), T.DoubleType(), T.DoubleType())
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *map(T.StructField, added, kinds)]))


def in_training(doc_id: str = "doc_id") -> Column:
    return crc_remainder(F.col(doc_id), 4) != 2


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(training_texts(docs, in_training()), spark)
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (~in_training()).alias("held_out"), "lang_pred", "score", "phrase_rate")
