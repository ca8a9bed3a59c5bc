"""Document quality: a text classifier under hierarchical empirical-Bayes site rates."""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, table

#: The text classifier is fitted on at most so many labelled documents, those of the least id hashes.
FIT_ROWS = 8_000
#: What an unlabelled document's own score weighs in its site's rate, next to 1 for a label.
SOFT_WEIGHT = 0.2
#: Strength of the priors where the sites' own spread can't tell it.
MOST_STRENGTH = 1_000.0
#: Sites and paths up to which their rates are broadcast (about 100 bytes each); beyond, they are joined.
BROADCAST_SITES = 500_000
THRESHOLD = 0.5
SIGNS = (b"!", b"|", b"#", b"%", b"&", b"*", b"$", b".", b",", b"\n", b"http", b"=")
NAMES = (*(s.decode() for s in SIGNS), "upper", "digit", "distinct", "repeat", "pairs", "word_length", "log_words", "long_words", "high")
N = len(NAMES)


def features(text: bytes | None) -> list[float]:
    """Shares and counts of a whole text; zeros if it has no word."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * N
    size = len(text)
    kept = len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = size - len(text.translate(None, b"0123456789"))
    high = size - len(text.translate(None, bytes(range(128, 256))))
    repeat = sum(map(operator.eq, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lengths = size / n
    return [
        *(min(text.count(s) / n, 3.0) for s in SIGNS),
        (size - kept) / size,
        digits / size,
        len(set(words)) / n,
        repeat / n,
        pairs / max(n - 1, 1),
        min(lengths, 30.0) / 10,
        float(np.log1p(n)),
        sum(len(w) > 20 for w in words) / n,
        high / size,
    ]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> dict:
    """Logistic regression by Newton steps on standardised features and their squares; base is the logit of the fitted rate."""
    if not len(y):
        return {"mean": np.zeros(N), "sd": np.ones(N), "w": np.zeros(2 * N + 1), "base": 0.0}
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = _design(x, mean, sd)
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    rate = (y.sum() + 0.5) / (len(y) + 1)
    return {"mean": mean, "sd": sd, "w": w, "base": float(np.log(rate / (1 - rate)))}


def _design(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / sd, -6, 6)
    return np.hstack([z, z * z, np.ones((len(z), 1))])


def score_with(model: dict, x: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio good : poor of the texts, free of the fitted rate."""
    return np.clip(_design(x, model["mean"], model["sd"]) @ model["w"], -30, 30) - model["base"]


def _by_doc(labels: DataFrame) -> DataFrame:
    """(doc_id, y): the mean label of each document; null ids and labels are left out."""
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """The text classifier, from a bounded sample of labelled documents. No labels: it scores every text 0."""
    sample = _by_doc(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(2), b.column(0)], ["x", "y", "doc_id"])

    got = rows.mapInArrow(run, "x array<double>, y double, doc_id long").orderBy("doc_id", "x").limit(2 * fit_rows).toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, N)
    return fit(x, np.array(got["y"].to_pylist(), float))


def _scored(docs: DataFrame, model: dict, added: str, text: str = "text") -> DataFrame:
    """docs with the text's log-likelihood ratio added."""
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                b = whole.slice(k, 1024)
                x = np.array([features(t) for t in b.column(at).cast(pa.binary()).to_pylist()], float).reshape(-1, N)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score_with(shared.value, x), pa.float64())], [*b.schema.names, added])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(added, T.DoubleType())]))


def _keys(host: Column, path: Column) -> list[Column]:
    """Host and path as keys without nulls; a null host or path is a site of its own."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    return [key(host).alias("_host"), key(path).alias("_path")]


def _strength(rates: DataFrame, n: str, good: str, prior: Column) -> float:
    """Prior strength by moments: how much the groups' rates spread beyond what their sizes explain."""
    q = F.col(good) / F.col(n)
    row = rates.where(f"{n} > 0").agg(
        F.sum(F.col(n)).alias("n"),
        F.sum(F.col(n) * F.pow(q - prior, F.lit(2))).alias("spread"),
        F.sum(prior * (1 - prior)).alias("noise"),
        F.sum(F.col(n) * prior * (1 - prior)).alias("whole"),
    ).first()
    if not row["n"] or not row["whole"]:
        return MOST_STRENGTH
    between = (row["spread"] - row["noise"]) / row["n"]
    return float(min(MOST_STRENGTH, max(1.0, row["whole"] / row["n"] / between - 1))) if between > 0 else MOST_STRENGTH


def site_rates(docs: DataFrame, labels: DataFrame, model: dict, host: str = "source", path: str = "lang") -> tuple[DataFrame, dict]:
    """(_host, _path, host_rate, path_rate) for every site of docs, and the global figures.

    Each document gives its label, or else its own text score with SOFT_WEIGHT. Sums by path are made first (combined before
    the shuffle, so a hot host is no hot task), hosts from paths. A host's rate is shrunk to the global one, a path's to its
    host's; both strengths come from the spread of the groups.
    """
    slim = _scored(docs.select("doc_id", "text", F.col(host).alias("h"), F.col(path).alias("p")), model, "llr").select("doc_id", *_keys(F.col("h"), F.col("p")), "llr")
    seen = slim.join(_by_doc(labels), "doc_id", "left")
    weight = F.when(F.col("y").isNotNull(), 1.0).otherwise(SOFT_WEIGHT)
    soft = 1 / (1 + F.exp(-(F.col("llr") + model["base"])))
    paths = seen.groupBy("_host", "_path").agg(F.sum(weight).alias("n"), F.sum(weight * F.coalesce("y", soft)).alias("good"))
    paths = checkpointed(paths)
    hosts = checkpointed(paths.groupBy("_host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")))
    total = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good")).first()
    rate = (float(total["good"] or 0.0) + 0.5) / (float(total["n"] or 0.0) + 1)
    of_hosts = _strength(hosts, "host_n", "host_good", F.lit(rate))
    hosts = hosts.withColumn("host_rate", (F.col("host_good") + of_hosts * rate) / (F.col("host_n") + of_hosts))
    paths = paths.join(hosts, "_host")
    of_paths = _strength(paths, "n", "good", F.col("host_rate"))
    paths = paths.withColumn("path_rate", (F.col("good") + of_paths * F.col("host_rate")) / (F.col("n") + of_paths))
    return checkpointed(paths.select("_host", "_path", "host_rate", "path_rate")), {"rate": rate, "host_strength": of_hosts, "path_strength": of_paths}


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD, prefix: str = "_") -> DataFrame:
    """docs with text_score, host_rate, path_rate, quality (probability of good) and good (quality >= threshold), after prefix.

    The logit of quality is the text's log-likelihood ratio plus the logit of the path's rate. Null or word-free texts have
    the features of none. Null hosts and paths are sites of their own. Repeated rows get equal results and count as often
    as they occur. No labels: texts score 0 and every rate is 0.5, so all is good. Columns of the added names are replaced; other
    names don't matter. A site's rate includes the labels of its own documents, that of the document asked about among them.
    """
    added = [prefix + c for c in ("text_score", "host_rate", "path_rate", "quality", "good")]
    docs = docs.drop(*added)
    model = train(docs, labels)
    rates, _ = site_rates(docs, labels, model, host, path)
    # The columns go by their places, so that none is taken for one of the plan's own.
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    placed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in at.items()))
    scored = _scored(placed, model, "_llr", at["text"]).select("*", *_keys(F.col(at[host]), F.col(at[path])))
    out = scored.join(F.broadcast(rates) if rates.count() <= BROADCAST_SITES else rates, ["_host", "_path"], "left")
    q = F.col("path_rate")
    out = out.withColumn("_quality", 1 / (1 + F.exp(-(F.col("_llr") + F.ln(q / (1 - q))))))
    figures = (F.col("_llr"), F.col("host_rate"), q, F.col("_quality"), F.col("_quality") >= threshold)
    return out.select(*(F.col(n).alias(c) for c, n in at.items()), *(x.alias(c) for x, c in zip(figures, added, strict=True)))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = classify(docs, table(spark, sf_dir, "labels"), prefix="")
    return found.select("doc_id", "text_score", "host_rate", "path_rate", "quality", "good")
