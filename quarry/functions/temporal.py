"""Validity at a date, and the boosts that follow from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import pick
from .text import blank, contains_any

RECENT_CUES = ["recent", "recently", "latest", "current", "today", "现在", "最新", "当前"]
OLDEST_CUES = ["first", "earliest", "originally", "oldest", "最早", "原始", "历史"]
DEAD = ("stale", "superseded", "archived", "deprecated")
CONFIDENCE = {"verified": 0.025, "high": 0.025, "observed": 0.012, "medium": 0.012, "inferred": -0.01, "low": -0.01, "stale": -0.03}
STATUS = {"active": 0.025, "current": 0.025, "valid": 0.025, "draft": 0.005, "review": 0.005} | dict.fromkeys(DEAD, -0.04)


def to_date(value: Column) -> Column:
    """The date a text begins with; null if it is none."""
    return F.try_to_date(F.substring(F.trim(value), 1, 10), "yyyy-MM-dd")


def recent_cue(query: Column) -> Column:
    return contains_any(F.lower(query), RECENT_CUES)


def oldest_cue(query: Column) -> Column:
    return contains_any(F.lower(query), OLDEST_CUES)


def age_days(updated: Column, mtime: Column, at: Column) -> Column:
    return F.greatest(F.datediff(at, F.coalesce(to_date(updated), F.to_date(mtime))), F.lit(0))


def stale_reason(status: Column, valid_from: Column, valid_until: Column, superseded_by: Column, at: Column, historical: Column) -> Column:
    """Why a row is stale at a date, or null. historical: the date was asked for; then status and successors don't count."""
    state = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return (
        F.when(to_date(valid_from) > at, "not_yet_valid").when(~historical & state.isin(*DEAD), F.concat(F.lit("status:"), state))
        .when(to_date(valid_until) < at, "valid_until").when(~historical & ~blank(superseded_by), "superseded_by")
    )


def validity_state(reason: Column, historical: Column) -> Column:
    return F.when(reason.isNotNull(), "stale").when(historical, "historical").otherwise("current")


def freshness_boost(mode: str, query: Column, age: Column, state: Column) -> Column:
    """mode: off, balanced, recent or oldest."""
    by_mode = {
        "off": F.lit(0.0),
        "balanced": F.when(recent_cue(query) & (age <= 30), 0.03).when(age <= 30, 0.01).otherwise(0.0),
        "recent": F.when(age <= 30, 0.05).when(age <= 180, 0.02).otherwise(0.0),
        "oldest": F.when(oldest_cue(query) | (age >= 180), 0.03).otherwise(0.0),
    }
    return F.when(state == "stale", -0.02).when(age.isNull(), 0.0).otherwise(by_mode[mode])


def confidence_boost(confidence: Column) -> Column:
    return pick(F.lower(F.trim(confidence)), CONFIDENCE)


def status_boost(status: Column, state: Column) -> Column:
    return F.when(state == "stale", -0.04).otherwise(pick(F.lower(F.trim(status)), STATUS))


def evidence_boost(n_sources: Column) -> Column:
    return 0.005 * F.least(n_sources, F.lit(4))


def has_temporal_metadata(*columns: Column) -> Column:
    return ~blank(F.concat_ws("", *columns))
