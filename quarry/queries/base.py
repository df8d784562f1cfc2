"""Inputs that the queries share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markdown import link_set, parse_notes, structure
from ..operators.index import Index
from ..sources.vault import VAULT_SQL, rendered_vault

#: The date of reference of all queries that need one.
NOW = "2024-12-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered_vault(spark, table(spark, sf_dir, "documents"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_notes(vault(spark, sf_dir))


_KEPT: dict = {}


def indexed(spark: SparkSession, sf_dir: str) -> Index:
    """The index over one chunk for each note, built at its first use in a session and kept."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        for old in _KEPT.values():
            if old.chunks.sparkSession.sparkContext.applicationId == key[0]:
                old.release()
        _KEPT.clear()
        _KEPT[key] = Index.of(note_chunks(spark, sf_dir))
    return _KEPT[key]


def note_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each note: chunk_id, path, title, heading (null), line_start, line_end, text, tags, links, flags, scalars, mtime."""
    notes = parsed(spark, sf_dir)
    return notes.select(
        F.concat(F.lit("chk_"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("chunk_id"), "path", "title", F.lit(None).cast("string").alias("heading"), F.lit(1).alias("line_start"),
        F.size(F.split("body", "\n")).alias("line_end"), F.col("body").alias("text"), "tags", link_set(F.col("body")).alias("links"), *[c.alias(n) for n, c in structure(F.col("body")).items()],
        "confidence", "status", "source_type", "valid_from", "valid_until", "supersedes", "superseded_by", "updated", "mtime",
    )


VAULT = f"vault AS ({VAULT_SQL.format(documents='documents')})"

_CLEAN = "trim(trim({0}), '\"''# ')"


def _scalar(key: str) -> str:
    return (
        f"list_filter(list_transform(list_filter(fl, lambda l: starts_with(trim(l), '{key}:')), lambda l: trim(trim(trim(substr(trim(l), {len(key) + 2})), '\"'''))),"
        f" lambda v: v <> '' AND NOT starts_with(v, '[') AND NOT starts_with(v, '{{'))[1] AS {key}"
    )


#: The notes parsed: doc_id, path, body, title, tags, links, the scalars and mtime (timestamp).
PARSED = VAULT + f"""
, cut AS (
  SELECT doc_id, path, mtime, CASE WHEN starts_with(source, '---' || chr(10)) AND strpos(substr(source, 5), chr(10) || '---' || chr(10)) > 0
    THEN substr(source, 5, strpos(substr(source, 5), chr(10) || '---' || chr(10)) - 1) END AS front,
    CASE WHEN starts_with(source, '---' || chr(10)) AND strpos(substr(source, 5), chr(10) || '---' || chr(10)) > 0
    THEN substr(source, 5 + strpos(substr(source, 5), chr(10) || '---' || chr(10)) + 4) ELSE source END AS body FROM vault
), lined AS (
  SELECT *, string_split(coalesce(front, ''), chr(10)) AS fl, string_split(body, chr(10)) AS bl FROM cut
), parsed AS (
  SELECT doc_id, path, body, bl, make_timestamp(mtime * 1000000) AS mtime,
    list_transform(list_filter(bl, lambda l: starts_with(ltrim(l), '# ')), lambda l: trim(substr(ltrim(l), 3)))[1] AS title,
    list_sort(list_distinct(list_filter(list_concat(
      flatten(list_transform(fl, lambda l: CASE
        WHEN starts_with(trim(l), 'tags:') THEN CASE
          WHEN starts_with(trim(substr(trim(l), 6)), '[') AND ends_with(trim(substr(trim(l), 6)), ']') THEN list_transform(string_split(trim(trim(substr(trim(l), 6)), '[]'), ','), lambda t: {_CLEAN.format('t')})
          WHEN trim(substr(trim(l), 6)) = '' THEN CAST([] AS VARCHAR[]) ELSE [{_CLEAN.format('substr(trim(l), 6)')}] END
        WHEN starts_with(trim(l), '-') THEN [{_CLEAN.format("ltrim(trim(l), '-')")}] ELSE CAST([] AS VARCHAR[]) END)),
      list_transform(regexp_extract_all(body, '(?:^|\\s)#([\\p{{L}}\\p{{N}}_/-]+)', 1), lambda t: {_CLEAN.format('t')})), lambda t: t <> ''))) AS tags,
    list_transform(regexp_extract_all(body, '!?\\[\\[([^\\]]+)\\]\\]', 1), lambda t: trim(t)) AS links,
    {", ".join(_scalar(k) for k in ("confidence", "status", "source_type", "valid_from", "valid_until", "supersedes", "superseded_by", "updated"))}
  FROM lined
)
"""

#: One chunk for each note.
CHUNKS = PARSED + """
, chunks AS (
  SELECT concat('chk_', lpad(CAST(doc_id AS VARCHAR), 8, '0')) AS chunk_id, path, title, CAST(NULL AS VARCHAR) AS heading, 1 AS line_start, len(bl) AS line_end, body AS text, tags,
    list_sort(list_distinct(links)) AS links,
    len(list_filter(bl, lambda l: regexp_matches(ltrim(l), '^(```|~~~)'))) > 0 AS has_code,
    contains(body, 'http://') OR contains(body, 'https://') OR contains(body, '[[') OR (contains(body, '[') AND contains(body, '](')) AS has_link,
    len(list_filter(bl, lambda l: regexp_matches(ltrim(l), '^[-*] \\[[ xX]\\]'))) > 0 AS has_task_list,
    len(list_filter(bl, lambda l: regexp_matches(ltrim(l), '^[-*] \\[ \\]'))) > 0 AS has_incomplete_tasks,
    confidence, status, source_type, valid_from, valid_until, supersedes, superseded_by, updated, mtime
  FROM parsed
)
"""

TIER = """CASE WHEN regexp_matches(lower({p}), '(^|/)raw/transcripts/') THEN 'transcript' WHEN regexp_matches(lower({p}), '^wiki/reports/|^reports/|/reports/') THEN 'report'
  WHEN regexp_matches(lower({p}), '^raw/system-snapshots/|/system-snapshots/') THEN 'system_snapshot' WHEN starts_with(lower({p}), 'wiki/') THEN 'wiki' WHEN starts_with(lower({p}), 'brain/') THEN 'brain'
  WHEN starts_with(lower({p}), 'raw/') THEN 'raw' WHEN regexp_matches(lower(coalesce({s}, '')), 'transcript|dialogue|conversation') THEN 'transcript'
  WHEN regexp_matches(lower(coalesce({s}, '')), 'report|audit|timeline') THEN 'report' WHEN regexp_matches(lower(coalesce({s}, '')), 'snapshot|system') THEN 'system_snapshot' ELSE 'note' END"""

EVIDENCE = "CASE {t} WHEN 'transcript' THEN 'dialogue' WHEN 'report' THEN 'event_record' WHEN 'system_snapshot' THEN 'system_record' WHEN 'wiki' THEN 'concept' WHEN 'brain' THEN 'memory' WHEN 'raw' THEN 'source' ELSE 'note' END"

EVENT_TIME = """coalesce(nullif(regexp_extract(trim({f}), '^(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), ''), nullif(regexp_extract(trim({u}), '^(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), ''),
  CASE WHEN regexp_matches({p}, '(20\\d{{2}})[/-](\\d{{2}})[/-](\\d{{2}})') THEN regexp_replace(regexp_extract({p}, '20\\d{{2}}[/-]\\d{{2}}[/-]\\d{{2}}'), '/', '-', 'g')
       WHEN regexp_matches({p}, '20\\d{{2}}\\d{{2}}\\d{{2}}') THEN regexp_replace(regexp_extract({p}, '20\\d{{6}}'), '(....)(..)(..)', '\\1-\\2-\\3') END, strftime({m}, '%Y-%m-%d'))"""


def event_time_sql(path="path", valid_from="valid_from", updated="updated", mtime="mtime") -> str:
    return EVENT_TIME.format(p=f"lower({path})", f=valid_from, u=updated, m=mtime)


def rows(spark: SparkSession, schema: str, values: list[tuple]) -> DataFrame:
    return spark.createDataFrame(values, schema)


def values_sql(name: str, columns: str, values: list[tuple]) -> str:
    """A CTE of literal rows."""

    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, list):
            return "[" + ", ".join(map(literal, v)) + "]" if v else "CAST([] AS VARCHAR[])"
        return "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in values)
    return f"{name}({columns}) AS (VALUES {body})"
