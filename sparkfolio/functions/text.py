"""Text normalisation for matching, once per chunk at ingest, and expressions on normalised text.

Full compatibility normalisation and case folding have no built-in, so ``normalized`` is an Arrow
UDF. It runs when chunks are stored; queries read its result and normalise needles with the same
Python functions on the driver.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.parser import HYPHENS

#: Characters of a snippet, of one for a pair of words, and what marks a cut (fixed values).
SNIPPET, NEAR_SNIPPET, DOTS = 260, 200, "..."


#: What a canonical part leaves out: all but letters and digits, and signs of length that count as hyphens.
_ODD, _ODD_BUT_STAR = (re.compile(rf"(?:[^\w{star}]|[_{re.escape(HYPHENS)}])+") for star in ("", "*"))


def normalize_text(text: str | None, *, ignore_width: bool = True, case_sensitive: bool = False) -> str:
    text = text or ""
    text = unicodedata.normalize("NFKC", text) if ignore_width else text
    return text if case_sensitive else text.casefold()


def canonical_part(text: str | None, *, case_sensitive: bool = False, keep_star: bool = False) -> str:
    """Letters and digits only, width folded; ``*`` too if it is kept."""
    return (_ODD_BUT_STAR if keep_star else _ODD).sub("", normalize_text(text, case_sensitive=case_sensitive))


def part_pattern(part: str) -> str:
    """A Java regular expression for a canonical part in which ``*`` stands for anything."""
    return ".*".join(quote(x) for x in part.split("*"))


def quote(literal: str) -> str:
    """A literal inside a Java regular expression."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E" if literal else ""


def normalized(text: Column, *, ignore_width: bool = True, case_sensitive: bool = False) -> Column:
    """struct(norm, part) of a text column; null counts as empty."""

    def fold(values: pd.Series) -> pd.DataFrame:
        values = values.fillna("")
        norm = values.str.normalize("NFKC") if ignore_width else values
        norm = norm if case_sensitive else norm.str.casefold()
        part = [_ODD.sub("", v) for v in norm] if ignore_width else [canonical_part(v, case_sensitive=case_sensitive) for v in values]
        return pd.DataFrame({"norm": norm, "part": part})

    return F.pandas_udf(fold, "norm string, part string")(text)


def occurrences(hay: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(hay) - F.length(F.replace(hay, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def near(hay: Column, left: str, right: str, distance: int) -> Column:
    """Whether two literals start within ``distance`` characters of each other."""
    if left == right:
        first, from_end = F.instr(hay, left), F.instr(F.reverse(hay), left[::-1])
        last = F.length(hay) - from_end - len(left) + 2
        return (first > 0) & (last > first) & (last - first <= distance)
    return hay.contains(left) & hay.contains(right) & hay.rlike(near_pattern(left, right, distance))


def near_pattern(left: str, right: str, distance: int) -> str:
    """A Java regular expression for two different literals that start within ``distance`` characters of each other."""
    ahead = lambda a, b: f"(?={quote(a)}).{{0,{distance}}}(?={quote(b)})"
    return f"(?s){ahead(left, right)}|{ahead(right, left)}"


def starts(hay: Column, needle: str) -> Column:
    """Where a literal begins, counted from 0, in order; occurrences may overlap."""
    pieces = F.split(hay, f"(?={quote(needle)})")
    told = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
        lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
        lambda acc: acc["out"],
    )
    none = F.expr("cast(array() as array<int>)")
    return F.when(~hay.contains(needle), none).when(hay.startswith(needle), told).otherwise(F.slice(told, F.lit(2), F.greatest(F.size(told) - 1, F.lit(0))))


def spans(hay: Column, left: str, right: str, distance: int) -> Column:
    """array(struct(left, right, distance)): for each start of ``left`` the nearest of ``right`` within ``distance``, ties to the one before.

    For two equal literals the first and the last start, as nearness of a term to itself asks for.
    """
    if left == right:
        at = starts(hay, left)
        first, last = F.array_min(at), F.array_max(at)
        pair = F.array(F.struct(first.alias("left"), last.alias("right"), (last - first).alias("distance")))
        return F.when((F.size(at) > 1) & (last - first <= distance), pair).otherwise(F.slice(pair, 1, 0))
    there = starts(hay, right)
    nearest = lambda a: F.array_min(F.transform(F.filter(there, lambda b: F.abs(b - a) <= distance), lambda b: F.struct(F.abs(b - a).alias("distance"), b.alias("right"))))
    each = F.transform(starts(hay, left), lambda a: F.struct(a.alias("a"), nearest(a).alias("b")))
    return F.transform(F.filter(each, lambda x: x["b"].isNotNull()), lambda x: F.struct(x["a"].alias("left"), x["b"]["right"].alias("right"), x["b"]["distance"].alias("distance")))


def caseless(text: Column) -> Column:
    """A text as names are ordered: lower case, and letters that have another spelling in upper case."""
    return F.replace(F.translate(F.lower(text), "ςſ", "σs"), F.lit("ß"), F.lit("ss"))


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def snippet(text: Column, needles: Column, size: Column | int = SNIPPET) -> Column:
    """The text, or a window of ``size`` characters around the first place of any needle, with dots where it is cut.

    ``needles`` is an array of normalised literals; their places are those in the lower-cased text.
    """
    flat = collapse_whitespace(text)
    size = F.lit(size) if isinstance(size, int) else size
    low = F.lower(flat)
    places = F.filter(F.transform(needles, lambda n: F.call_function("instr", low, n) - 1), lambda p: p >= 0)
    start = F.greatest(F.coalesce(F.array_min(places), F.lit(0)) - F.floor(size / 2).cast("int"), F.lit(0))
    end = F.least(start + size, F.length(flat))
    cut = F.concat(F.when(start > 0, DOTS).otherwise(""), F.substring(flat, start + 1, end - start), F.when(end < F.length(flat), DOTS).otherwise(""))
    return F.when(F.length(flat) <= size, flat).otherwise(cut)


def highlight(text: Column, needles: list[str]) -> Column:
    """Mark needles, longest first and without regard to case."""
    found = "|".join(quote(n) for n in sorted(set(filter(None, needles)), key=lambda n: (-len(n), n)))
    return F.regexp_replace(text, f"(?iu)({found})", "<mark>$1</mark>") if found else text


def location_label(location: Column, kind: Column) -> Column:
    mark = F.when(kind == "ocr", " [OCR]").when(kind == "pdf_text", " [PDF文字]").otherwise("")
    return F.concat(location, mark)


def page_of(location: Column) -> Column:
    """The first number of a location; null without one."""
    return F.nullif(F.regexp_extract(location, r"(\d+)", 1), F.lit("")).cast("int")
