"""The corpus pipeline: each stage against what it should keep, on the smallest tables and on odd rows."""

import collections

import corpus_pipeline
from pyspark.sql import functions as F
from test_dedup import brute


def stages(spark, docs, sf_dir):
    from rollbook.llm.common import checkpointed

    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = checkpointed(stage(spark, docs, sf_dir))
    return out


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = stages(spark, docs, sf_dir)
    assert list(got) == ["quality", "language", "near_duplicates", "mixing", "pieces"]
    assert all(got[n].columns == docs.columns for n in list(got)[:-1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in got["quality"].collect()}
    assert sum(labels[i] == 1 for i in labels if i in kept) >= 0.98 * sum(labels.values())
    language = [(r.doc_id, r.text) for r in got["language"].collect()]
    want = {i for i, (_, root) in brute(language, 5, 80).items() if i == root}
    assert {r.doc_id for r in got["near_duplicates"].collect()} == want and got["near_duplicates"].count() == len(want)
    copies = collections.Counter(r.doc_id for r in got["mixing"].collect())
    assert set(copies) <= want and max(copies.values()) <= 3
    assert collections.Counter(r.doc_id for r in got["pieces"].collect()) == copies


def test_mislabelled_documents_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 1500")
    swapped = docs.where("lang = 'en'").limit(1).withColumn("lang", F.lit("de")).withColumn("doc_id", F.lit(9_000_001).cast("long"))
    short = swapped.withColumn("text", F.substring("text", 1, 40)).withColumn("doc_id", F.lit(9_000_002).cast("long"))
    untaught = swapped.withColumn("lang", F.lit(None).cast("string")).withColumn("doc_id", F.lit(9_000_003).cast("long"))
    kept = {r.doc_id for r in corpus_pipeline.keep_known_language(spark, docs.unionByName(swapped).unionByName(short).unionByName(untaught), sf_dir).collect()}
    assert 9_000_001 not in kept and {9_000_002, 9_000_003} <= kept
    assert len(kept) >= docs.select("doc_id").distinct().count()


def test_columns_of_the_stages_own_names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    for name in ("_host", "_size", "_target", "_copies", "_quality_good", "_language_score", "_kept_id", "_row", "_block", "key"):
        docs = docs.withColumn(name, F.lit("mine"))
    got = stages(spark, docs, sf_dir)
    for name in ("quality", "language", "near_duplicates", "mixing"):
        assert got[name].columns == docs.columns and {tuple(r[5:]) for r in got[name].collect()} == {("mine",) * 10}


def test_least_row_of_an_id_stays(spark, sf_dir):
    rows = [(1, "one two three four five six", "en", b, 1) for b in ("z", "y")] + [(1, "another text that is not like it", "en", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [tuple(r) for r in corpus_pipeline.keep_one_of_each(spark, docs, sf_dir).collect()] == [rows[2]]


def test_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    extra = docs.limit(2)
    odd = spark.createDataFrame([(None, "Some words without a number here.", None, None, None), (8_000_001, None, "en", "s", 0), (8_000_002, "", None, None, 0), (8_000_003, "12 34", "en", "s", 5)], docs.schema)
    got = stages(spark, docs.unionByName(extra).unionByName(odd), sf_dir)
    assert not {8_000_001, 8_000_002, 8_000_003} & {r.doc_id for r in got["language"].collect()}
    ids = [r.doc_id for r in got["near_duplicates"].where("doc_id IS NOT NULL").collect()]
    assert len(ids) == len(set(ids))
    assert stages(spark, docs.limit(0), sf_dir)["pieces"].count() == 0
