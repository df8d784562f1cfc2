"""Scores and boosts of search results as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strings

RRF_K = 60.0
KEYWORD_WEIGHT = VECTOR_WEIGHT = 0.35


def pick(value: Column, table: dict[str, float]) -> Column:
    """The number of a text in a small table, else 0."""
    found = F.lit(0.0)
    for key, number in table.items():
        found = F.when(value == key, F.lit(number)).otherwise(found)
    return found


def bm25_score(bm25: Column) -> Column:
    """1 / (1 + |bm25|): kept as it is known, though it falls as relevance rises; ranks carry the relevance."""
    return 1 / (1 + F.abs(bm25))


def distance_score(distance: Column) -> Column:
    return 1 / (1 + F.greatest(distance, F.lit(0.0)))


def rrf(*ranks: Column) -> Column:
    """Reciprocal rank fusion; null ranks add nothing."""
    return sum((F.coalesce(1 / (RRF_K + r), F.lit(0.0)) for r in ranks[1:]), F.coalesce(1 / (RRF_K + ranks[0]), F.lit(0.0)))


def path_boost(path: Column, query: Column) -> Column:
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != "")
    return F.when(F.exists(words, lambda w: F.contains(F.lower(path), w)), 0.08).otherwise(0.0)


def tag_boost(tags: Column, query: Column) -> Column:
    return F.when(F.coalesce(F.exists(tags, lambda t: F.contains(F.lower(query), F.lower(t))), F.lit(False)), 0.05).otherwise(0.0)


def recency_boost(mtime: Column, now: Column) -> Column:
    """mtime and now: timestamps."""
    days = F.greatest((F.unix_timestamp(now) - F.unix_timestamp(mtime)) / 86400.0, F.lit(0.0))
    return F.coalesce(0.03 / (1 + days / 30.0), F.lit(0.0))


def known(value: Column) -> Column:
    return F.lower(F.trim(value))


METADATA_CONFIDENCE = {"high": 0.03, "medium": 0.01, "low": -0.03}
METADATA_STATUS = {"active": 0.02, "mature": 0.02, "stale": -0.02, "archived": -0.04, "deprecated": -0.05}
METADATA_SOURCE = {"source": 0.01, "original": 0.01, "audit": 0.01, "manual_audit": 0.01}


def metadata_boost(has_code: Column, has_link: Column, has_tasks: Column, has_open_tasks: Column, confidence: Column, status: Column, source_type: Column) -> Column:
    flag = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    total = flag(has_code, 0.02) + flag(has_tasks, 0.02) + flag(has_open_tasks, -0.02) + flag(has_link, 0.01) + pick(known(confidence), METADATA_CONFIDENCE) + pick(known(status), METADATA_STATUS) + pick(known(source_type), METADATA_SOURCE)
    return F.least(F.greatest(total, F.lit(-0.08)), F.lit(0.08))


def keyword_overlap(query: Column, text: Column, tags: Column) -> Column:
    """0.1 for each query word in the text, 0.05 for each in a tag, 1 at most."""
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != "")
    each = lambda w: F.when(F.contains(F.lower(text), w), 0.1).otherwise(0.0) + F.when(F.coalesce(F.exists(tags, lambda t: F.contains(F.lower(t), w)), F.lit(False)), 0.05).otherwise(0.0)
    return F.least(F.aggregate(F.transform(words, each), F.lit(0.0), lambda a, b: a + b), F.lit(1.0))


#: Boosts by intent, then by tier or evidence type.
TIER_BOOSTS = {
    "historical": {"transcript": 0.05, "report": 0.05, "system_snapshot": 0.05, "raw": 0.03, "brain": 0.03},
    "concept": {"wiki": 0.04, "brain": 0.04},
    "config": {"report": 0.04, "system_snapshot": 0.04, "raw": 0.04, "brain": 0.04},
}
EVIDENCE_BOOSTS = {
    "historical": {"dialogue": 0.03, "event_record": 0.03, "system_record": 0.03, "source": 0.015, "memory": 0.015},
    "concept": {"concept": 0.03, "memory": 0.03},
    "config": {"event_record": 0.03, "system_record": 0.03, "source": 0.03, "memory": 0.03},
}
EVENT_BOOSTS = {"historical": 0.04, "config": 0.02}
TIER_CANDIDATE_BOOSTS = {
    "historical": {"transcript": 0.34, "report": 0.34, "system_snapshot": 0.34, "raw": 0.22, "brain": 0.22},
    "concept": {"wiki": 0.20, "brain": 0.20},
    "config": {"report": 0.24, "system_snapshot": 0.24, "raw": 0.24, "brain": 0.24},
}


def by_intent(intent: Column, value: Column, table: dict[str, dict[str, float]]) -> Column:
    found = F.lit(0.0)
    for name, inner in table.items():
        found = F.when(intent == name, pick(value, inner)).otherwise(found)
    return found


def graph_boost(base: Column, edges: Column) -> Column:
    """0.01 for each active edge, 0.03 at most; nothing for a score of 0.95 or more or one that is not finite."""
    idle = base.isNull() | F.isnan(base) | (F.abs(base) == float("inf")) | (base >= 0.95) | (edges <= 0)
    return F.when(idle, 0.0).otherwise(F.least(edges, F.lit(3)) * 0.01)


def sources_of(keyword: Column, vector: Column, reasons: Column) -> Column:
    """Which branches found a row: keyword, vector, then the others' reasons, each once."""
    own = F.array_compact(F.array(F.when(keyword, "keyword"), F.when(vector, "vector")))
    return F.array_distinct(F.concat(own, F.coalesce(reasons, strings())))
