"""What texts hold: identifiers with their notes, kinds of events with their numbers, blocks of pages as records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_END = r"(?i)</(?:p|li|div|h[1-6]|td)>|<br\s*/?>"


def plain(c: Column) -> Column:
    """A piece of markup without its tags, spaces as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"[ \t\r\n\f]+", " "))


def id_parts(c: Column, pattern: str, kinds: Mapping[str, str]) -> Column:
    """A struct of an identifier's parts: the pattern's groups by name, as their types; null if it is none of this grammar.

    A part that its type can't hold is null, and so is one that is empty."""
    part = lambda k, kind: F.regexp_extract(c, pattern, k).try_cast(kind) if kind != "string" else F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))
    return F.when(c.rlike(pattern), F.struct(*(part(k, kind).alias(n) for k, (n, kind) in enumerate(kinds.items(), 1))))


def registry(df: DataFrame, key: str, text: str, pattern: str, split: str = BLOCK_END) -> DataFrame:
    """(id, mentions, sources, note): every identifier (the pattern's first group) that the texts hold.

    A text is cut into blocks; each identifier of a block has the block's plain text as note. Of all notes of an identifier the longest stays, of
    these the last by order. mentions counts identifiers in blocks (one a block), sources the rows (by key) that hold it. Notes are compared
    before the shuffle, so an identifier that stands on every page sends one note a task. A null text holds nothing.
    """
    blocks = df.select(F.col(key).alias("key"), F.explode(F.split(text, split)).alias("block"))
    found = blocks.select("key", plain(F.col("block")).alias("note"), F.explode(F.array_distinct(F.regexp_extract_all("block", F.lit(pattern), F.lit(1)))).alias("id"))
    longest = F.max(F.struct(F.length("note").alias("size"), "note"))
    per = found.groupBy("id", "key").agg(F.count("*").alias("mentions"), longest.alias("best"))
    out = per.groupBy("id").agg(F.sum("mentions").alias("mentions"), F.count("*").alias("sources"), F.max("best").alias("best"))
    return out.select("id", "mentions", "sources", F.col("best.note").alias("note"))


def event_types(df: DataFrame, key: str, text: str, labels: Mapping[str, str], number: str = r"[0-9]+") -> DataFrame:
    """(key, types, mentions, numbers) for each row of df: the kinds of events that a text tells of, in the order in which they first come.

    labels: kind to pattern of a whole word, the first that a word matches counts. numbers: by kind the sum of the numbers that stand nearest to a word of it
    (of two as near the one before), null without any. Rows that hold words of no kind have empty arrays; a text's words are
    taken once, and only those that are of a kind or a number become rows. key tells rows apart; a null text has no words.
    """
    word = lambda w: F.coalesce(*(F.when(w.rlike(f"^(?:{p})$"), F.lit(n)) for n, p in labels.items()))
    words = df.select(F.col(key).alias("key"), F.posexplode(F.split(F.lower(text), r"[^\p{L}\p{N}]+")).alias("at", "w"))
    hits = words.select("key", "at", word(F.col("w")).alias("kind"), F.when(F.col("w").rlike(f"^(?:{number})$"), F.expr("try_cast(w AS BIGINT)")).alias("n")).where("kind IS NOT NULL OR n IS NOT NULL")
    along = W.partitionBy("key").orderBy("at")
    here = F.when(F.col("kind").isNotNull(), F.struct("at", "kind"))
    seen = hits.select("*", F.last(here, True).over(along).alias("b"), F.first(here, True).over(along.rowsBetween(W.currentRow, W.unboundedFollowing)).alias("a"))
    nearer = F.col("a.at").isNull() | (F.col("at") - F.col("b.at") <= F.col("a.at") - F.col("at"))
    bound = F.when(F.col("n").isNotNull(), F.when(nearer & F.col("b.at").isNotNull(), F.col("b.kind")).otherwise(F.col("a.kind")))
    each = seen.select("key", "at", F.coalesce("kind", bound).alias("kind"), F.col("kind").isNotNull().alias("told"), F.when(F.col("kind").isNull(), F.col("n")).alias("n"))
    per = each.where("kind IS NOT NULL").groupBy("key", "kind").agg(F.min(F.when(F.col("told"), F.col("at"))).alias("first"), F.count_if("told").alias("mentions"), F.sum("n").alias("numbers"))
    rows = per.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first", "kind", "mentions", "numbers"))).alias("r"))  # a row a kind
    out = df.select(F.col(key).alias("key")).join(rows, "key", "left")
    of = lambda name, kind: F.coalesce(F.transform("r", lambda x: x[name]), F.array().cast(f"array<{kind}>")).alias(name if name != "kind" else "types")
    return out.select(F.col("key").alias(key), of("kind", "string"), of("mentions", "bigint"), of("numbers", "bigint"))


def block_records(df: DataFrame, key: str, html: str, block: str, fields: Mapping[str, str]) -> DataFrame:
    """(key, place, a column for each field): the blocks of a page that a pattern finds, as records in page order.

    A field is the first group of its pattern in the block, as plain text, null if the block has none.
    """
    rows = df.select(F.col(key).alias("key"), F.posexplode(F.regexp_extract_all(html, F.lit(block), F.lit(0))).alias("place", "block"))
    field = lambda p: F.when(F.col("block").rlike(p), plain(F.regexp_extract("block", p, 1)))
    return rows.select(F.col("key").alias(key), "place", *(field(p).alias(n) for n, p in fields.items()))


def tag_inventory(df: DataFrame, xml: str, tags: Sequence[str] | None = None) -> DataFrame:
    """(tag, rows, uses): how many rows of markup hold each element, whatever its namespace's prefix, and how often; of tags only, if given."""
    names = F.regexp_extract_all(xml, F.lit(r"<(?:[A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*)[\s/>]"), F.lit(1))
    names = names if tags is None else F.filter(names, lambda t: t.isin(*tags))
    # Counted within the row: an element's uses are the names that are it.
    per = df.select(names.alias("names")).select(F.inline(F.transform(F.array_distinct("names"), lambda t: F.struct(t.alias("tag"), F.size(F.filter("names", lambda x: x == t)).alias("n")))))
    return per.groupBy("tag").agg(F.count("*").alias("rows"), F.sum("n").alias("uses"))


def adverb_interval(text: Column, day: Column, adverbs: Sequence[tuple[str, int, int]], default: tuple[int, int], slack: int = 1) -> tuple[Column, Column]:
    """First and last day that a report means: days before its own by the first adverb (pattern, from, to) that it holds, slack on either side."""
    lo, hi = F.lit(default[0]), F.lit(default[1])
    for pattern, a, b in reversed(adverbs):
        holds = F.coalesce(text.rlike(pattern), F.lit(False))
        lo, hi = F.when(holds, a).otherwise(lo), F.when(holds, b).otherwise(hi)
    return F.date_sub(day, lo + slack), F.date_add(day, slack - hi)


def in_months(c: Column, prefixes: Sequence[str]) -> Column:
    """Whether an ISO day (or its text) lies in one of the windows, each given by a beginning: a year, a month, a day."""
    text = c.cast("string")
    held = F.lit(False)
    for p in prefixes:
        held = held | text.startswith(p)
    return F.coalesce(held, F.lit(False))
