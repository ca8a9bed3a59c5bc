"""Mixing sources to target weights by systematic sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, word_count

#: Slices by id hash of one size band, so that no window holds more than a small part of a source.
SLICES = 256
SEED = 7
MOST_COPIES = 3


def _hash16(text) -> F.Column:
    """0 to 65535 from the md5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source (no_source, src, source_size, target), from rows of sources and sizes.

    The sources in the order of code points, null last, weigh 1, 2, 3 and so on again. They share the sum of all sizes; no
    target passes MOST_COPIES times its source's size, and what is over goes to the others by weight. With the sources in
    the order of size over weight, the full ones are a prefix, so running sums give the final level at once. The windows
    run over one row per source.
    """
    per = sizes.groupBy("no_source", "src").agg(F.sum("size").alias("source_size"))
    named = W.orderBy("no_source", "src")
    n = len(weights)
    per = per.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(named) - 1) % n + 1).cast("int"))
    )
    per = per.withColumn("cap", (F.col("source_size") * MOST_COPIES).cast("double"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "no_source", "src")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumns(
        {
            "total": F.sum("source_size").over(everything).cast("double"),
            "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "weight_left": F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)),
        }
    )
    per = per.withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
    # The first source that its share does not fill sets the level; where all are full there is none.
    free = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct(F.col("cap") / F.col("weight"), "level")))
    per = per.withColumn("level", free.over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return per.select("no_source", "src", "source_size", target.alias("target"))


def mix(docs: DataFrame, seed: int = SEED, slices: int = SLICES, prefix: str = "_") -> DataFrame:
    """All rows of docs (doc_id, text, source, others) with size, source_size, target and copies added, each after prefix.

    Every document of a source expects target / source_size copies. The expected copies are summed along the source, from
    small to large documents, one offset by source is added, and a document is emitted once for each whole number that the
    running sum passes in it. Small to large keeps the words taken near the target; the order inside a size band is that
    of an id hash, the id and a hash of the text; rows alike in all of these may change places.

    Scale: a running sum over a whole source would be one task for a hot source. So the position of a document is that of
    its slice (size band and id hash; counts combined before the shuffle, at most slices times some hundred rows a source)
    plus its row number in the slice.

    Null or empty text: size 0, never changes the words taken. Null source: a source of its own, last. Null id: the
    text is hashed in its place. Repeated rows are separate documents. All sizes 0: targets 0, no copies. Empty table: no rows.
    Columns of the added names are replaced; other names don't matter.
    """
    added = [prefix + c for c in ("size", "source_size", "target", "copies")]
    names = [c for c in docs.columns if c not in added]
    # The columns go by their places, so that none is taken for one of the plan's own.
    at = {c: f"c{i}" for i, c in enumerate(names)}
    docs = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in at.items()))
    text, source, doc_id = (F.col(at[c]) for c in ("text", "source", "doc_id"))
    size = word_count(text)
    shift = F.greatest(F.length(F.bin("_size")) - 6, F.lit(0))
    rows = docs.withColumn("_size", size).withColumns(
        {
            "_no_source": source.isNull(),
            "_src": F.coalesce(source, F.lit("")),
            "_band": shift * 64 + F.expr("shiftright(_size, greatest(length(bin(_size)) - 6, 0))"),
            "_same": F.xxhash64(text),
            "_slice": _hash16(F.coalesce(doc_id.cast("string"), text, F.lit(""))) % slices,
        }
    )
    key = ["_no_source", "_src", "_band", "_slice"]
    slim = rows.select(*key, "_size")
    counted = slim.groupBy(*key).agg(F.count("*").alias("_n"), F.sum("_size").alias("_words"))
    sums = counted.select(F.col("_no_source").alias("no_source"), F.col("_src").alias("src"), F.col("_words").alias("size"))
    targets = source_targets(sums).select(
        F.col("no_source").alias("_no_source"), F.col("src").alias("_src"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target")
    )
    along = W.partitionBy("_no_source", "_src").orderBy("_band", "_slice")
    first = F.coalesce(F.sum("_n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counted.select(*key, first.alias("_first")).join(targets, ["_no_source", "_src"])
    starts = starts.withColumns(
        {
            "_rate": F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0),
            "_offset": _hash16(F.concat(F.lit(f"{seed}|"), F.col("_no_source").cast("string"), F.lit("|"), F.col("_src"))) / 65536.0,
        }
    )
    inside = W.partitionBy(*key).orderBy(doc_id, "_size", "_same")
    rows = rows.withColumn("_row", F.row_number().over(inside)).join(starts, key)
    position = F.col("_first") + F.col("_row")
    crossed = F.floor(F.col("_rate") * position + F.col("_offset")) - F.floor(F.col("_rate") * (position - 1) + F.col("_offset"))
    figures = (F.col("_size"), F.col("_source_size"), F.col("_target"), F.least(crossed, F.lit(MOST_COPIES)).cast("long"))
    return rows.select(*(F.col(n).alias(c) for c, n in at.items()), *(x.alias(c) for x, c in zip(figures, added, strict=True)))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # Only the size of a text goes through the shuffle.
    return mix(docs).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
        F.col("_copies").alias("copies"),
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 4))::BIGINT % 256 AS slice
  FROM documents),
b AS (
  SELECT *, greatest(length(bin(size)) - 6, 0) * 64 + (size >> greatest(length(bin(size)) - 6, 0)) AS band FROM d),
p AS (
  SELECT no_source, src, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY no_source, src) - 1) % 3 + 1 AS weight
  FROM b GROUP BY no_source, src),
q AS (SELECT *, (source_size * 3)::DOUBLE AS cap FROM p),
r AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, no_source, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS cap_before,
         sum(weight) OVER (ORDER BY cap / weight, no_source, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
         (sum(source_size) OVER ())::DOUBLE AS total
  FROM q),
l AS (SELECT *, (total - cap_before) / weight_left::DOUBLE AS lev FROM r),
f AS (SELECT arg_min(lev, cap / weight) FILTER (cap / weight >= lev) AS level FROM l),
t AS (SELECT no_source, src, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM l, f),
n AS (
  SELECT b.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('7|' || b.no_source::VARCHAR || '|' || b.src), 1, 4))::BIGINT / 65536.0::DOUBLE AS off,
         row_number() OVER (PARTITION BY b.no_source, b.src ORDER BY band, slice, doc_id NULLS FIRST, size) AS pos
  FROM b JOIN t USING (no_source, src))
SELECT doc_id, size, source_size, target,
       least(floor(rate * pos + off) - floor(rate * (pos - 1) + off), 3)::BIGINT * size AS taken,
       least(floor(rate * pos + off) - floor(rate * (pos - 1) + off), 3)::BIGINT AS copies
FROM n
"""
