"""A corpus pipeline of five stages: quality, language, near-duplicates, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A stage's
result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollbook.llm import langid, minhash, mixing, pieces, quality
from rollbook.llm.common import bound_batches, checkpointed, crc_remainder, free_prefix, table

#: Kept ids up to which they are broadcast (8 bytes each) when the texts are read again; beyond, they are joined by a shuffle.
BROADCAST_IDS = 2_000_000


#: How far the predicted language must be ahead of the next, and in how many characters, for a document to count as mislabelled.
LEAST_LEAD, LEAST_CHARS = 0.2, 300


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects. Labels come from the table labels."""
    prefix = free_prefix(docs, "quality")
    found = quality.classify(docs, table(spark, sf_dir, "labels"), prefix=prefix)
    return found.where(F.col(prefix + "good")).select(*_columns(docs))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents without a language, and those that are plainly not in the one that they name.

    Without a language: null texts and those without a letter. Plainly in another: the language predicted from the text is
    not that of the column lang, one of the learned ones, and is ahead of the next by LEAST_LEAD in LEAST_CHARS characters or
    more. Such a document is mislabelled; a short one, and one whose languages are close together, stays. A null lang or one that nobody taught says nothing: the document stays. With no
    labelled text all documents with a letter stay.
    """
    halves = []
    for half in (0, 1):
        # No document is judged by what its own label taught: each half by the texts of the other.
        mine = crc_remainder(F.col("doc_id"), 2) == half
        model = langid.train(langid.training_texts(docs, ~mine), spark)
        part = docs.where(mine)
        if not model["langs"]:
            halves.append(part.where(F.col("text").rlike(r"\p{L}")))
            continue
        prefix = free_prefix(docs, "language")
        found = langid.identify(part, model, prefix=prefix)
        said, score = F.col(prefix + "lang_pred"), F.col(prefix + "score")
        other = F.coalesce(F.col("lang").isin(model["langs"]) & (F.col("lang") != said), F.lit(False))
        other &= (score >= LEAST_LEAD) & (F.length("text") >= LEAST_CHARS)
        halves.append(found.where((said != langid.UNKNOWN) & ~other).select(*_columns(docs)))
    return halves[0].unionAll(halves[1])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group of near-duplicates (five-word shingles, similarity 0.8).

    Rows of one id are one document: the row of the least text stays, of equal texts the one least in the other columns.
    Rows without an id can't be told apart and stay.
    """
    found = minhash.near_duplicates(docs.select("doc_id", "text"), width=5, percent=80)
    kept = checkpointed(found.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept_id")).distinct())
    n = kept.count()
    out = docs.join(F.broadcast(kept) if n <= BROADCAST_IDS else kept, docs["doc_id"] == kept["_kept_id"], "left_semi")
    if out.count() > n:
        same = ["text", *(c for c in docs.columns if c not in ("doc_id", "text"))]
        least = W.partitionBy("doc_id").orderBy(*(F.col(f"`{c}`") for c in same))
        place = free_prefix(docs, "place")
        out = out.withColumn(place, F.row_number().over(least)).where(F.col(place) == 1).select(*_columns(docs))
    return out.unionByName(docs.where("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as the mix takes it."""
    prefix = free_prefix(docs, "mixing")
    found = mixing.mix(docs, prefix=prefix).where(F.col(prefix + "copies") > 0)
    return found.withColumn(prefix + "copies", F.explode(F.sequence(F.lit(1), F.col(prefix + "copies").cast("int")))).select(*_columns(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids."""
    bound_batches(spark)
    found = pieces.encode(docs, keep=["doc_id", "lang", "source"])
    return found.select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("quality", keep_good),
    ("language", keep_known_language),
    ("near_duplicates", keep_one_of_each),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: The quality classifier and the language identification are trained models: no SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
