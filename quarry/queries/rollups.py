"""Windows, themes and the topic ledger over the rendered vault and the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.redact import SECRET_LINE_SQL
from ..operators import rollups as ro
from .base import PARSED, VAULT, parsed, rows, table, values_sql, vault

DAYS = ["2024-01-01", "2024-02-29", "2024-03-31", "2024-09-01", "2024-12-31"]
DAY = "2024-03-17"


def windows(spark, sf):
    d = rows(spark, "day string", [(x,) for x in DAYS]).select(F.to_date("day").alias("day"))
    return d.select("day", *[ro.window_start(m, F.col("day")).alias(m) for m in ro.MODES])


def dated(spark, sf):
    return parsed(spark, sf).select("path", ro.source_date(F.col("path"), F.col("mtime")).alias("source_date"))


def marked(spark, sf):
    """Notes and generated roll-ups."""
    n = vault(spark, sf).select("path", "mtime", F.lit(False).alias("generated"))
    made = spark.range(40).select(F.concat(F.lit("brain/daily/2024-03-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"), F.when(F.col("id") < 28, ".md").otherwise("-x.md")).alias("path"), F.timestamp_seconds(F.lit(1710000000)).alias("mtime"), (F.col("id") % 5 != 0).alias("generated"))
    return n.unionByName(made)


def selected(spark, sf):
    out = None
    for mode in ("daily", "weekly", "monthly"):
        own = ro.select_sources(marked(spark, sf), mode, DAY, 30).select(F.lit(mode).alias("mode"), "path", "kind", "position", "selected")
        out = own if out is None else out.unionByName(own)
    return out


def behind(spark, sf):
    return ro.background(marked(spark, sf), DAY)


def planned(spark, sf):
    return spark.range(1).select(F.explode(ro.plan(F.lit("2023-12-28").cast("date"), F.lit("2024-02-05").cast("date"))).alias("r")).select("r.day", "r.mode")


def sources(spark, sf):
    return parsed(spark, sf).select("path", "title", "tags", "links", F.col("body").alias("text"))


def terms(spark, sf):
    return ro.source_terms(sources(spark, sf), "text")


def themes(spark, sf):
    return ro.themes(sources(spark, sf))


SLUGS = ["Some Topic/Name", "  --x--  ", "日本語", "audit", "Vault", "a", "under_score:colon", "é only", "反思", "Hermes", "M3", "codex"]


def slugs(spark, sf):
    return rows(spark, "raw string", [(x,) for x in SLUGS]).select("raw", ro.slug(F.col("raw")).alias("slug"), ro.theme_key(F.col("raw")).alias("key"))


def observed(spark, sf):
    """Observations from events: a topic for each user of a type, on the day."""
    e = table(spark, sf, "events")
    topic = F.concat(F.col("event_type"), F.lit("-"), (F.col("user_id") % 9).cast("string"))
    mode = F.when(F.col("event_id") % 11 == 0, "weekly").when(F.col("event_id") % 3 == 0, "manual").otherwise("daily")
    return e.select(topic.alias("topic_key"), F.concat(F.lit("Title "), topic).alias("title"), mode.alias("mode"), F.to_date("ts").alias("day"), F.when(F.col("value") > 50, "medium").otherwise("low").alias("confidence"), F.array(F.concat(F.lit("raw/"), F.col("event_type"))).alias("source_paths"), F.array(F.col("event_type")).alias("source_hashes"))


def ledger(spark, sf):
    return ro.ledger(observed(spark, sf)).select("topic_key", "title", "first_seen", "last_seen", "repeat_count", F.size("distinct_dates").alias("days"), "confidence", "modes", "source_paths")


def promoted(spark, sf):
    led = ro.ledger(observed(spark, sf)).withColumn("promotion_status", F.when(F.col("topic_key").like("%-3"), "proposed").otherwise("none"))
    return ro.promotable(led, "daily").select("topic_key", F.lit("daily").alias("mode")).unionByName(ro.promotable(led.withColumn("confidence", F.lit("high")), "weekly").select("topic_key", F.lit("weekly").alias("mode")))


WRITES = [("a", "body "), ("b", "body"), ("c", "new"), ("d", "x")]
HELD = [("a", "body", True), ("b", "body edited", False), ("c", "old", True)]


def writes(spark, sf):
    return ro.promotion_writes(rows(spark, "topic_key string, body string", WRITES), rows(spark, "topic_key string, body string, generated boolean", HELD))


def groups(spark, sf):
    picked = ro.select_sources(marked(spark, sf), "monthly", DAY, 200)
    return ro.grouped_cards(picked).groupBy("group_no").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path"))


CARDS = [(0, "writer", "h1", True), (0, "auditor", "h1", True), (1, "writer", "h1", True), (1, "auditor", "h2", True), (2, "writer", "h1", True), (3, "writer", "h3", True), (3, "auditor", "h3", False)]


def cards(spark, sf):
    return ro.cards_pass(rows(spark, "group_no int, role string, draft_hash string, passed boolean", CARDS))


def numbered(spark, sf):
    return table(spark, sf, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), (F.col("doc_id") + 1).cast("int").alias("position"), "text")


def receipts(spark, sf):
    return ro.anchors(numbered(spark, sf)).select("anchor", "path", "quote_hash")


def budgeted(spark, sf):
    return ro.within_budget(numbered(spark, sf)).select("position", "running")


TEXTS = [("t1", "Good, see [S1]."), ("t2", "No anchor."), ("t3", "```x``` [S1]"), ("t4", " "), ("t5", "Only [BG1]"), ("t6", "see [S9] and [S2]")]


def reflections(spark, sf):
    return rows(spark, "id string, text string", TEXTS).select("id", ro.acceptable(F.col("text"), F.array(F.lit("S1"), F.lit("S2"))).alias("ok"))


def diffed(spark, sf):
    n = vault(spark, sf).select("doc_id", "path", F.sha2(F.col("source").cast("binary"), 256).alias("hash"))
    return ro.snapshot_diff(n.filter("doc_id % 9 <> 1"), n.filter("doc_id % 9 <> 2").withColumn("hash", F.when(F.col("doc_id") % 9 == 3, F.lit("x")).otherwise(F.col("hash"))))


def checked(spark, sf):
    n = parsed(spark, sf)
    return ro.validators(n, {"has_title": F.col("title").isNotNull(), "has_tags": F.size("tags") > 0, "short": F.length("body") < 5000, "has_status": F.col("status").isNotNull()}, "path")


def transcripts(spark, sf):
    n = vault(spark, sf)
    return n.select("path", F.sha2(ro.transcript_body(F.col("source"), 1 << 20).cast("binary"), 256).alias("sha"), F.length(ro.transcript_body(F.col("source"))).alias("n"))


def marks(spark, sf):
    files = vault(spark, sf).select("doc_id", "path", F.sha2(F.col("source").cast("binary"), 256).alias("hash"), "mtime", F.octet_length("source").alias("size"))
    held = ro.watermarks(files.filter("doc_id % 5 <> 2"), "daily", "run-1", "ok").withColumn("hash", F.when(F.col("path").like("brain/%"), F.lit("old")).otherwise(F.col("hash")))
    failed = held.withColumn("last_status", F.when(F.col("path").like("wiki/en/1%"), "failed").otherwise(F.col("last_status")))
    return ro.unprocessed(files, failed).select("path")


def after_write(spark, sf):
    files = vault(spark, sf).select("doc_id", "path", F.sha2(F.col("source").cast("binary"), 256).alias("hash"), F.octet_length("source").cast("long").alias("size"))
    held = files.filter("doc_id % 6 <> 1").withColumn("hash", F.when(F.col("doc_id") % 6 == 2, F.lit("old")).otherwise(F.col("hash")))
    return ro.written_state(files.drop("doc_id"), held, files.filter("doc_id % 4 <> 3"))


TITLES = ["# 2024-03-01 Session: The harbour plan", "## notes", "ab", "Chat log | weekly_review", "  spaced   out  ", "2024/01/02"]


def title_themes(spark, sf):
    return rows(spark, "raw string", [(x,) for x in TITLES]).select("raw", ro.title_theme(F.col("raw")).alias("theme"))


QUERIES = {
    "l15_watermarks": marks, "l23_after_write": after_write, "b25_title_themes": title_themes,
    "l01_windows": windows, "l02_source_dates": dated, "l04_l05_selection": selected, "l03_background": behind, "l16_plan": planned, "l07_terms": terms, "l06_l08_themes": themes, "l09_theme_keys": slugs, "l10_l11_ledger": ledger, "l13_promotable": promoted,
    "l14_writes": writes, "l17_groups": groups, "l26_cards": cards, "l18_receipts": receipts, "l24_budget": budgeted, "l25_reflections": reflections, "l19_diff": diffed, "l21_validators": checked, "b24_transcript_body": transcripts,
}

_DATE = "coalesce(TRY_CAST(replace(nullif(regexp_extract(path, '^raw/transcripts/[^/]+/(\\d{4}/\\d{1,2}/\\d{1,2})/', 1), ''), '/', '-') AS DATE), TRY_CAST(nullif(regexp_extract(path, '^brain/(?:daily|weekly|monthly|yearly)/(\\d{4}-\\d{2}-\\d{2})\\.md$', 1), '') AS DATE), CAST(mtime AS DATE))"
_MARKED = f"""{VAULT}, marked AS (SELECT path, make_timestamp(mtime * 1000000) AS mtime, FALSE AS generated FROM vault UNION ALL SELECT concat('brain/daily/2024-03-', lpad(CAST(i % 28 + 1 AS VARCHAR), 2, '0'), CASE WHEN i < 28 THEN '.md' ELSE '-x.md' END), make_timestamp(1710000000000000), i % 5 <> 0 FROM range(40) r(i)), md AS (SELECT *, {_DATE} AS d FROM marked)"""


def _sel(mode: str, start: str, lower: str) -> str:
    return f"""SELECT '{mode}' AS mode, path, kind, row_number() OVER (ORDER BY kind, path) AS position FROM (SELECT path, CASE WHEN starts_with(path, 'raw/') THEN 'raw' WHEN generated AND ({lower}) THEN 'generated' END AS kind FROM md WHERE d BETWEEN DATE '{start}' AND DATE '{DAY}') WHERE kind IS NOT NULL"""


_SEL = " UNION ALL ".join((_sel("daily", DAY, "FALSE"), _sel("weekly", "2024-03-11", "starts_with(path, 'brain/daily/')"), _sel("monthly", "2024-03-01", "starts_with(path, 'brain/daily/') OR starts_with(path, 'brain/weekly/')")))
# Written out, so that the comparison does not read the operator's lists.
_STOP = """('the', 'and', 'for', 'with', 'from', 'this', 'that', 'you', 'are', 'was', 'were', 'not', 'but', 'into', 'about', 'have', 'has', 'had', 'will', 'can', 'use', 'uses', 'using', 'see', 'note', 'notes', 'your', 'they', 'them',
 'what', 'when', 'then', 'than', 'there', 'here', 'which', 'would', 'could', 'should', 'also', 'just', 'only', 'more', 'most', 'some', 'any', 'all', 'one', 'two', 'out', 'its', 'his', 'her', 'our',
 'raw', 'conversation', 'transcript', 'source', 'source-evidence', 'text', 'redacted', 'compaction', 'reference', 'summary', 'metadata', 'session', 'sha256', 'type', 'status', 'trust', 'tier', 'primary', 'archived', 'started', 'ended')"""
_SAME = """WHEN 'hermes' THEN 'hermes' WHEN '赫尔墨斯' THEN 'hermes' WHEN 'obsidian' THEN 'second-brain' WHEN 'vault' THEN 'second-brain' WHEN '第二大脑' THEN 'second-brain' WHEN '二脑' THEN 'second-brain' WHEN 'codex' THEN 'codex'
 WHEN 'minimax' THEN 'minimax' WHEN 'm3' THEN 'minimax' WHEN '审计' THEN 'audit' WHEN 'audit' THEN 'audit' WHEN '反思' THEN 'reflection' WHEN 'reflect' THEN 'reflection' WHEN 'reflection' THEN 'reflection'"""


def _terms(col: str, where: str = "TRUE") -> str:
    words = f"list_filter(string_split(lower(regexp_replace(x, '[^A-Za-z0-9_\\-]+', ' ', 'g')), ' '), lambda w: length(w) >= 3 AND w NOT IN {_STOP})"
    pairs = "list_transform(range(1, length(other)), lambda i: substr(other, i, 2))"
    text = f"(SELECT path, x, regexp_replace(x, '[\\x00-\\x7F]|[^\\p{{L}}\\p{{N}}]', '', 'g') AS other FROM (SELECT path, coalesce({col}, '') AS x FROM src WHERE {where}))"
    return f"(SELECT path, term, count(*) AS freq FROM (SELECT path, unnest(list_concat({words}, {pairs})) AS term FROM {text}) GROUP BY path, term HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, term) <= 12)"


_SLUG = "trim(regexp_replace(regexp_replace({0}, '[^a-z0-9\\-_ /:]', '', 'g'), '[\\-_ /:]+', '-', 'g'), '-')"
_KEY = f"CASE WHEN length(lower(trim({{0}}))) < 2 THEN NULL ELSE CASE lower(trim({{0}})) {_SAME} ELSE 'content-' || nullif({_SLUG.format('lower(trim({0}))')}, '') END END"
_SRC = f"{PARSED}, src AS (SELECT path, title, tags, links, body AS text FROM parsed)"
_OBS = """obs AS (SELECT event_type || '-' || CAST(user_id % 9 AS VARCHAR) AS topic_key, CASE WHEN event_id % 11 = 0 THEN 'weekly' WHEN event_id % 3 = 0 THEN 'manual' ELSE 'daily' END AS mode, CAST(ts AS DATE) AS day, CASE WHEN value > 50 THEN 2 ELSE 1 END AS c, event_type FROM events),
 led AS (SELECT topic_key, min(day) AS first_seen, max(day) AS last_seen, count(DISTINCT (mode, day)) AS repeat_count, count(DISTINCT day) AS days, greatest(max(c), CASE WHEN count(DISTINCT day) >= 3 THEN 3 WHEN count(DISTINCT day) = 2 THEN 2 ELSE 1 END) AS r, list_sort(list(DISTINCT mode)) AS modes, list_sort(list(DISTINCT 'raw/' || event_type)) AS source_paths FROM obs WHERE mode <> 'weekly' GROUP BY topic_key)"""

SQL = {
    "l15_watermarks": f"WITH {VAULT} SELECT path FROM vault WHERE doc_id % 5 = 2 OR starts_with(path, 'brain/') OR starts_with(path, 'wiki/en/1')",
    "l23_after_write": f"WITH {VAULT}, s AS (SELECT path, CASE doc_id % 6 WHEN 1 THEN 'missing' WHEN 2 THEN 'stale' ELSE 'fresh' END AS state, doc_id % 4 <> 3 AS smoke FROM vault) SELECT *, state <> 'fresh' OR NOT smoke AS degraded FROM s",
    "b25_title_themes": "SELECT * FROM (VALUES ('# 2024-03-01 Session: The harbour plan', 'The harbour plan'), ('## notes', NULL), ('ab', NULL), ('Chat log | weekly_review', 'weekly review'), ('  spaced   out  ', 'spaced out'), ('2024/01/02', NULL)) t(raw, theme)",
    "l01_windows": "WITH d AS (SELECT CAST(x AS DATE) AS day FROM (VALUES " + ", ".join(f"('{x}')" for x in DAYS) + ") t(x)) SELECT day, day AS daily, day AS manual, CAST(date_trunc('week', day) AS DATE) AS weekly, CAST(date_trunc('month', day) AS DATE) AS monthly, CAST(date_trunc('year', day) AS DATE) AS yearly FROM d",
    "l02_source_dates": f"WITH {PARSED} SELECT path, {_DATE} AS source_date FROM parsed",
    "l04_l05_selection": f"WITH {_MARKED}, s AS ({_SEL}) SELECT *, position <= 30 AS selected FROM s",
    "l03_background": f"WITH {_MARKED} SELECT path, d AS source_date, row_number() OVER (ORDER BY path DESC) AS position FROM md WHERE starts_with(path, 'brain/daily/') AND generated AND d >= DATE '2024-03-10' AND d < DATE '2024-03-17' QUALIFY position <= 7",
    "l16_plan": "WITH d AS (SELECT CAST(unnest(generate_series(DATE '2023-12-28', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day) SELECT day, 'daily' AS mode FROM d UNION ALL SELECT day, 'weekly' FROM d WHERE dayofweek(day) = 0 UNION ALL SELECT day, 'monthly' FROM d WHERE day(day) = 1 UNION ALL SELECT day, 'yearly' FROM d WHERE day(day) = 1 AND month(day) = 1",
    "l07_terms": f"WITH {_SRC} SELECT path, term, freq FROM {_terms('text')}",
    "l06_l08_themes": f"""WITH {_SRC}, e AS (SELECT path, term, 1 AS w FROM (SELECT path, unnest(list_distinct(list_concat(tags, links))) AS term FROM src) UNION ALL SELECT path, term, freq FROM {_terms('text')} UNION ALL SELECT path, term, freq * 4 FROM {_terms('title', "starts_with(path, 'raw/transcripts/')")}),
      k AS (SELECT path, w, {_KEY.format('term')} AS key FROM e), c AS (SELECT key, CAST(sum(w) AS BIGINT) AS occurrences, count(DISTINCT path) AS spread FROM k WHERE key IS NOT NULL GROUP BY key HAVING sum(w) >= 2 OR count(DISTINCT path) >= 2) SELECT *, row_number() OVER (ORDER BY spread DESC, occurrences DESC, key) AS place FROM c QUALIFY place <= 8""",
    "l09_theme_keys": f"WITH {values_sql('s', 'raw', [(x,) for x in SLUGS])} SELECT raw, {_SLUG.format('lower(raw)')} AS slug, {_KEY.format('raw')} AS key FROM s",
    "l10_l11_ledger": f"WITH {_OBS} SELECT topic_key, 'Title ' || topic_key AS title, first_seen, last_seen, repeat_count, days, CASE r WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence, modes, source_paths FROM led",
    "l13_promotable": f"WITH {_OBS} SELECT topic_key, 'daily' AS mode FROM led WHERE days >= 3 AND r = 3 AND NOT topic_key LIKE '%-3' UNION ALL SELECT topic_key, 'weekly' FROM led WHERE repeat_count >= 2 AND NOT topic_key LIKE '%-3'",
    "l14_writes": "SELECT * FROM (VALUES ('a', 'unchanged'), ('b', 'refused'), ('c', 'write'), ('d', 'write')) t(topic_key, action)",
    "l17_groups": f"WITH {_MARKED}, s AS ({_SEL}) SELECT CAST((position - 1) // 40 AS INTEGER) AS group_no, count(*) AS n, min(path) AS first_path FROM s WHERE mode = 'monthly' GROUP BY ALL",
    "l26_cards": "SELECT * FROM (VALUES (0, TRUE), (1, FALSE), (2, FALSE), (3, FALSE)) t(group_no, passed)",
    "l18_receipts": "SELECT 'S' || CAST(doc_id + 1 AS VARCHAR) AS anchor, 'd/' || CAST(doc_id AS VARCHAR) AS path, sha256(substr(array_to_string(list_transform(string_split(text, chr(10)), lambda l: CASE WHEN regexp_matches(l, '" + SECRET_LINE_SQL + "') THEN '[REDACTED]' ELSE l END), chr(10)), 1, 180)) AS quote_hash FROM documents",
    "l24_budget": "WITH r AS (SELECT doc_id + 1 AS position, CAST(sum(length(text)) OVER (ORDER BY doc_id) AS BIGINT) AS running FROM documents) SELECT * FROM r WHERE position <= 24 AND (position = 1 OR running <= 28000)",
    "l25_reflections": "SELECT * FROM (VALUES ('t1', TRUE), ('t2', FALSE), ('t3', FALSE), ('t4', FALSE), ('t5', FALSE), ('t6', TRUE)) t(id, ok)",
    "l19_diff": f"WITH {VAULT} SELECT path, CASE WHEN doc_id % 9 = 2 THEN 'removed' WHEN doc_id % 9 IN (1, 3) THEN 'changed' ELSE 'unchanged' END AS change FROM vault",
    "l21_validators": f"WITH {PARSED}, f AS (SELECT path, list_filter([CASE WHEN title IS NULL THEN 'has_title' END, CASE WHEN len(tags) = 0 THEN 'has_tags' END, CASE WHEN length(body) >= 5000 THEN 'short' END, CASE WHEN status IS NULL THEN 'has_status' END], lambda x: x IS NOT NULL) AS failed FROM parsed) SELECT *, len(failed) = 0 AS ok FROM f",
}
