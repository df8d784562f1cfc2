"""What kind of source a path is, and when its content happened."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any

EVIDENCE_TYPES = {"transcript": "dialogue", "report": "event_record", "system_snapshot": "system_record", "wiki": "concept", "brain": "memory", "raw": "source"}


def _path(path: Column) -> Column:
    return F.lower(F.ltrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/")))


def source_tier(path: Column, source_type: Column) -> Column:
    """By directory first, then by words of the source type; else a note."""
    p, s = _path(path), F.lower(F.trim(F.coalesce(source_type, F.lit(""))))
    return (
        F.when(p.rlike(r"(^|/)raw/transcripts/"), "transcript").when(p.rlike(r"^wiki/reports/|^reports/|/reports/"), "report").when(p.rlike(r"^raw/system-snapshots/|/system-snapshots/"), "system_snapshot")
        .when(p.startswith("wiki/"), "wiki").when(p.startswith("brain/"), "brain").when(p.startswith("raw/"), "raw")
        .when(contains_any(s, ["transcript", "dialogue", "conversation"]), "transcript").when(contains_any(s, ["report", "audit", "timeline"]), "report")
        .when(contains_any(s, ["snapshot", "system"]), "system_snapshot").otherwise("note")
    )


def evidence_type(tier: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, kind in EVIDENCE_TYPES.items():
        found = F.when(tier == name, kind).otherwise(found)
    return F.coalesce(found, F.lit("note"))


def iso_prefix(value: Column) -> Column:
    """The leading YYYY-MM-DD of a text, or null."""
    found = F.regexp_extract(F.trim(value), r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.when(found != "", found)


def path_date(path: Column) -> Column:
    """YYYY-MM-DD from a path: digits parted by / or - before eight digits in a row."""
    p = _path(path)
    parted, whole = r"(20\d{2})[/-](\d{2})[/-](\d{2})", r"(20\d{2})(\d{2})(\d{2})"
    of = lambda pattern: F.when(p.rlike(pattern), F.concat_ws("-", *[F.regexp_extract(p, pattern, k) for k in (1, 2, 3)]))
    return F.coalesce(of(parted), of(whole))


def event_time(path: Column, valid_from: Column, updated: Column, mtime: Column) -> Column:
    """YYYY-MM-DD of the first that is known: valid_from, updated, the path's date, the file's time (timestamp)."""
    return F.coalesce(iso_prefix(valid_from), iso_prefix(updated), path_date(path), F.date_format(mtime, "yyyy-MM-dd"))
