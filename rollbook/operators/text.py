"""Text: concordances, graded evidence, verdicts, distances."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concordance(df: DataFrame, doc: str, text: str, a: str, b: str, gap: int = 150, context: int = 120) -> DataFrame:
    """(doc, start, end, hits, excerpt): passages where a match of a and one of b stand within gap characters, either first.

    Each pair's span is widened by context on both sides; spans of a document that overlap become one. Offsets need all
    matches of a text, which no column function gives, so the texts go through Arrow.
    """

    def spans(body: str) -> list[tuple[int, int, int]]:
        left = [m.span() for m in re.finditer(a, body)]
        right = [m.span() for m in re.finditer(b, body)]
        # Matches come in order: each a meets only the b that begin near it.
        begins, longest = [t for t, _ in right], max((f - t for t, f in right), default=0)
        near = ((s, e, t, f) for s, e in left for t, f in right[bisect_left(begins, s - gap - longest) : bisect_right(begins, e + gap)])
        found = sorted((max(0, min(s, t) - context), min(len(body), max(e, f) + context)) for s, e, t, f in near if max(s, t) - min(e, f) <= gap)
        out: list[list[int]] = []
        for s, e in found:
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
                out[-1][2] += 1
            else:
                out.append([s, e, 1])
        return [tuple(x) for x in out]

    def run(batches):
        for rows in batches:
            got = [(d, s, e, n, body[s:e]) for d, body in zip(rows[doc], rows[text], strict=True) if body for s, e, n in spans(body)]
            yield pd.DataFrame(got, columns=[doc, "start", "end", "hits", "excerpt"])

    kind = dict(df.dtypes)[doc]
    return df.select(doc, text).mapInPandas(run, f"{doc} {kind}, start long, end long, hits long, excerpt string")


def first_window(text: Column, term: str, context: int) -> Column:
    """The characters around the first occurrence of a term; null without one."""
    at = F.instr(text, term)
    begin = F.greatest(F.lit(1), at - context)
    return F.when(at > 0, F.substring(text, begin, at - begin + len(term) + context))


def graded(paragraph: Column, page: Column, term: str, places: str, guard: str | None = None, near: int = 60) -> Column:
    """Evidence that a term is about a place: dateline, window, paragraph, page or none; null where the paragraph lacks the term.

    guard: a pattern that makes the term mean something else.
    """
    has = paragraph.rlike(term)
    if guard:
        has &= ~paragraph.rlike(guard)
    close = rf"(?s)(?:{places}).{{0,{near}}}(?:{term})|(?:{term}).{{0,{near}}}(?:{places})"
    grade = F.when(paragraph.rlike(rf"^\s*(?:{places})"), "dateline").when(paragraph.rlike(close), "window").when(paragraph.rlike(places), "paragraph")
    return F.when(has, grade.when(page.rlike(places), "page").otherwise("none"))


def verdict(df: DataFrame, doc: str, text: str, term: str, here: str, elsewhere: str) -> DataFrame:
    """(doc, verdict): here, other, mixed or untowned for documents that hold the term, else no term; over all rows of a document."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.groupBy(doc).agg(*(F.max(t.rlike(p)).alias(n) for n, p in (("_t", term), ("_h", here), ("_o", elsewhere))))
    out = F.when(~F.col("_t"), "no term").when(F.col("_h") & F.col("_o"), "mixed").when(F.col("_h"), "here").when(F.col("_o"), "other").otherwise("untowned")
    return rows.select(doc, out.alias("verdict"))


def nearest_distance(words: Column, a: str, b: str) -> Column:
    """The least distance in words between an a and a b; null unless both occur. One pass: a fold that remembers the last of each."""
    null = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("i"), null.alias("a"), null.alias("b"), null.alias("best"))

    def step(acc: Column, w: Column) -> Column:
        la, lb = F.when(w == a, acc["i"]).otherwise(acc["a"]), F.when(w == b, acc["i"]).otherwise(acc["b"])
        gap = F.when((w == a) | (w == b), F.abs(la - lb))
        return F.struct((acc["i"] + 1).alias("i"), la.alias("a"), lb.alias("b"), F.least(acc["best"], gap).alias("best"))

    return F.aggregate(words, start, step, lambda acc: acc["best"])


def union_forms(df: DataFrame, key: str, forms: Mapping[str, Column]) -> DataFrame:
    """(key, forms): which forms of a search hit each row, as one sorted list; rows with a hit only."""
    hits = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in forms.items())))
    rows = df.select(key, F.explode(hits).alias("form"))
    return rows.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("form")), "|").alias("forms"))


def longest_spans(spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of spans that overlap the longest stays; of equal ones the first."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans, key=lambda x: (-(x[1] - x[0]), x[0])):
        if all(e <= a or s >= b for a, b in out):
            out.append((s, e))
    return sorted(out)


def transfers(df: DataFrame, key: str, text: str, rules: Sequence[tuple[str, str]], noise: str, split: str = r"\s*[;|]\s*") -> DataFrame:
    """(key, segment, label): the segments of a remark (parted by ; or |, or as split says) by the first rule that matches; noise and unmatched ones go."""
    from ..functions.cells import first_match

    rows = df.select(key, F.posexplode(F.split(F.col(text), split)).alias("segment", "part"))
    return rows.where(~F.col("part").rlike(noise)).withColumn("label", first_match(F.col("part"), rules)).where("label IS NOT NULL").select(key, "segment", "label")
