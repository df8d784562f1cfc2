"""The filter language: a flat conjunction of comparisons, compiled to a column expression.

    tag == 'rust' && has_code == true && path contains "brain/" && status != 'archived'
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 512
STRING_FIELDS = ("path", "title", "heading", "confidence", "status", "source_type", "valid_from", "valid_until", "updated", "supersedes", "superseded_by")
BOOLEAN_FIELDS = ("has_code", "has_link", "has_task_list", "has_incomplete_tasks")
TAG = "tag"
#: A comparison: field, operator, quoted text (a backslash keeps the next character) or a bare word.
CONDITION = re.compile(r"\s*(\w+)\s*(==|!=|\bcontains\b)\s*(?:'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|(\w+))\s*", re.S)


class FilterError(ValueError):
    pass


def parse(expression: str) -> list[tuple[str, str, str | bool]]:
    """(field, operator, value) of each comparison."""
    text = expression.strip()
    if not text:
        raise FilterError("the filter is empty")
    if len(text.encode()) > MAX_BYTES:
        raise FilterError(f"the filter is longer than {MAX_BYTES} bytes")
    if "||" in text or "(" in text or ")" in text:
        raise FilterError("only flat && conjunctions are supported")
    found, at = [], 0
    while True:
        m = CONDITION.match(text, at)
        if not m:
            raise FilterError(f"no comparison at {text[at : at + 30]!r}")
        field, operator = m[1], m[2]
        quoted = m[3] if m[3] is not None else m[4]
        found.append(checked(field, operator, re.sub(r"\\(.)", r"\1", quoted, flags=re.S) if quoted is not None else None, m[5]))
        at = m.end()
        if at == len(text):
            return found
        if not text.startswith("&&", at):
            raise FilterError(f"&& expected at {text[at : at + 30]!r}")
        at += 2


def checked(field: str, operator: str, quoted: str | None, word: str | None) -> tuple[str, str, str | bool]:
    if field in BOOLEAN_FIELDS:
        if operator == "contains":
            raise FilterError("boolean fields do not support contains")
        if word not in ("true", "false"):
            raise FilterError(f"{field} expects true or false")
        return field, operator, word == "true"
    if field == TAG and operator == "contains":
        raise FilterError("tag does not support contains")
    if field != TAG and field not in STRING_FIELDS:
        raise FilterError(f"unknown field {field}")
    if quoted is None:
        raise FilterError(f"{field} expects a quoted text")
    return field, operator, quoted


def condition(field: str, operator: str, value: str | bool) -> Column:
    """Null texts count as empty, null flags as false, null tags as none."""
    if field == TAG:
        has = F.coalesce(F.array_contains("tags", value), F.lit(False))
        return has if operator == "==" else ~has
    if field in BOOLEAN_FIELDS:
        same = F.coalesce(F.col(field), F.lit(False)) == F.lit(value)
        return same if operator == "==" else ~same
    text = F.coalesce(F.col(field), F.lit(""))
    if operator == "contains":
        return F.contains(F.lower(text), F.lower(F.lit(value)))
    return text == F.lit(value) if operator == "==" else text != F.lit(value)


def compile_filter(expression: str | None) -> Column:
    """The filter as a predicate; all rows for None or blank."""
    predicate = F.lit(True)
    for c in parse(expression) if expression and expression.strip() else []:
        predicate = predicate & condition(*c)
    return predicate


def apply_filter(chunks: DataFrame, expression: str | None) -> DataFrame:
    return chunks.filter(compile_filter(expression)) if expression and expression.strip() else chunks


def with_scope(expression: str | None, tags: list[str]) -> str | None:
    """The filter and each tag of an evaluation case's scope."""
    quoted = [f"tag == '{t.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}'" for t in tags]
    return " && ".join(([expression] if expression and expression.strip() else []) + quoted) or None


def above_score(results: DataFrame, least: float | None) -> DataFrame:
    """Rows whose score is finite and at least the threshold."""
    if least is None:
        return results
    if least != least or least in (float("inf"), float("-inf")):
        raise FilterError("the score threshold must be finite")
    return results.filter((F.col("score") >= least) & ~F.isnan("score") & (F.abs("score") != float("inf")))


def without_stale(results: DataFrame, include_stale: bool = False) -> DataFrame:
    return results if include_stale else results.filter("validity_state <> 'stale'")
