"""Column builders for cell values: buckets, vocabularies, rules, keys."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Not recorded"
#: Texts that stand for no value, trimmed.
BLANKS = ("", "null", "undefined")


def facet_value(c: Column) -> Column:
    """The value to group by: trimmed text, or UNKNOWN for null, blank and the words that stand for null."""
    t = F.trim(c.cast("string"))
    return F.when(t.isNull() | t.isin(*BLANKS), F.lit(UNKNOWN)).otherwise(t)


def blank_to_null(c: Column) -> Column:
    """Trimmed text, null if empty."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def first_match(c: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first rule (pattern, label) that the text matches."""
    out = reduce(lambda acc, r: acc.when(c.rlike(r[0]), F.lit(r[1])) if acc is not None else F.when(c.rlike(r[0]), F.lit(r[1])), rules, None)
    return out.otherwise(F.lit(default))


def vocabulary(c: Column, mapping: dict[str, str]) -> Column:
    """The mapped value of the lower-cased, trimmed text; other values pass."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(F.trim(c))), c)


def closed(c: Column, allowed: Iterable[str], empty: str = "") -> Column:
    """The value if it is of the vocabulary, else empty."""
    return F.when(c.isin(*allowed), c).otherwise(F.lit(empty))


def multi_value(c: Column, mapping: dict[str, str], banned: Iterable[str] = (), split: str = r"\s*[|/]\s*", join: str = " | ") -> Column:
    """Splits a cell, maps its parts, drops banned and empty parts, keeps the first of equal parts, joins again."""
    parts = F.transform(F.split(F.trim(c), split), lambda p: vocabulary(p, mapping))
    kept = F.filter(parts, lambda p: (p != "") & ~p.isin(*banned) if list(banned) else p != "")
    return F.array_join(F.array_distinct(kept), join)


def recover(discarded: Column, allowed: Sequence[str], split: str = r"\s*,\s*") -> Column:
    """The first token of a discarded cell that the vocabulary has."""
    known = F.array(*map(F.lit, allowed))
    return F.try_element_at(F.filter(F.split(discarded, split), lambda p: F.array_contains(known, p)), F.lit(1))


def all_known(c: Column, allowed: Sequence[str], split: str = r"\s+") -> Column:
    """The cell if every part of it is known, else null."""
    known = F.array(*map(F.lit, allowed))
    return F.when(F.forall(F.split(c, split), lambda p: F.array_contains(known, p)), c)


def coarsen(c: Column) -> Column:
    """An address or name without numbers: digits and the marks before them go, spaces and stray commas are tidied."""
    t = F.regexp_replace(c, r"[#/-]*[0-9]+", "")
    t = F.regexp_replace(t, r"\s+", " ")
    return F.trim(F.regexp_replace(t, r"[ ,]+$", ""))


def loose_key(c: Column, articles: Sequence[str] = ("el", "al", "the", "de")) -> Column:
    """Lower-case letters and digits only, without articles."""
    words = F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*articles))
    return F.array_join(words, "")


#: Spellings of one sound, in this order.
SOUNDS = (("ou", "u"), ("ee", "i"), ("oo", "u"), ("q", "k"), ("c", "k"), ("ph", "f"))


def skeleton(c: Column) -> Column:
    """The loose key's first letter (V for any vowel) and the consonants after it, equal ones in a row once."""
    t = loose_key(c)
    for of, to in SOUNDS:
        t = F.replace(t, F.lit(of), F.lit(to))
    head = F.when(t.rlike("^[aeiouy]"), F.lit("V")).otherwise(F.substring(t, 1, 1))
    return F.concat(head, F.regexp_replace(F.regexp_replace(F.substring(t, 2, 1 << 30), "[aeiouyh]", ""), r"(.)\1+", "$1"))


def strip_range_prefix(c: Column) -> Column:
    """A chapter label without its leading code range."""
    return F.regexp_replace(c, r"^[VE]?[0-9]+-[VE]?[0-9]+\s+", "")


def code_category(c: Column) -> Column:
    """The category of the first code of a cell: E and V kept, numbers padded to three digits; null if it is no code."""
    first = F.trim(F.element_at(F.split(c, r"\|"), 1))
    letter, digits = F.regexp_extract(first, r"^([EV]?)([0-9]{1,3})(\.[0-9]*)?$", 1), F.regexp_extract(first, r"^([EV]?)([0-9]{1,3})(\.[0-9]*)?$", 2)
    return F.when(digits != "", F.concat(letter, F.lpad(digits, 3, "0")))


def html_to_text(c: Column) -> Column:
    """Markup to spaces, the common references decoded (twice escaped ones too), runs of space to one."""
    t = F.regexp_replace(c, "<[^>]+>", " ")
    for _ in range(2):
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def paragraphs(c: Column) -> Column:
    """The paragraphs of an HTML fragment, in order."""
    return F.split(c, r"(?i)</p>|<br\s*/?>")
