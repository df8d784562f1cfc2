"""String and array helpers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    """True for null and for white space only."""
    return F.coalesce(F.trim(c) == "", F.lit(True))


def lines(text: Column) -> Column:
    """Lines without their ends; the empty rest after a final newline is no line."""
    unified = F.regexp_replace(text, "\r\n", "\n")
    return F.split(F.regexp_replace(unified, r"\n\z", ""), "\n", -1)


def squeezed(text: Column) -> Column:
    """White space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def contains_any(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def sorted_distinct(items: Column) -> Column:
    return F.array_sort(F.array_distinct(items))


def strings(*items: str) -> Column:
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def compact(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def uri_component(text: Column) -> Column:
    """Percent-encoding that leaves only letters, digits and -_.~ as they are."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def neighbour_pairs(items: Column) -> Column:
    """Each item joined to the next one. The array is an argument, not used inside the lambda, where it would be computed for every element."""
    following = F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))
    return F.array_compact(F.zip_with(items, following, lambda a, b: F.concat(a, b)))
