"""Calendar windows over dated notes, themes, and the ledger of topics that recur on different days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.redact import redact_lines
from ..functions.text import neighbour_pairs, strings
from .ordering import numbered

MODES = ("daily", "manual", "weekly", "monthly", "yearly")
#: Which generated roll-ups a mode reads.
LOWER_LEVELS = {"weekly": ["brain/daily/"], "monthly": ["brain/daily/", "brain/weekly/"], "yearly": ["brain/daily/", "brain/weekly/", "brain/monthly/"]}
BACKGROUND_DAYS = 7
MAX_THEMES, TERMS_PER_SOURCE, LEAST_FREQUENCY, TITLE_WEIGHT = 8, 12, 2, 4
GROUP = 40
RANKS = {"low": 1, "medium": 2, "high": 3}
PROMOTE_DATES, PROMOTE_REPEATS = 3, 2
EVIDENCE_CHARS, EVIDENCE_SOURCES = 28_000, 24
# Words that are no theme (English ones, then those of transcripts' frames), and names of one theme.
THEME_STOPWORDS = [
    "the", "and", "for", "with", "from", "this", "that", "you", "are", "was", "were", "not", "but", "into", "about", "have", "has", "had", "will", "can", "use", "uses", "using", "see", "note", "notes", "your", "they", "them",
    "what", "when", "then", "than", "there", "here", "which", "would", "could", "should", "also", "just", "only", "more", "most", "some", "any", "all", "one", "two", "out", "its", "his", "her", "our",
    "raw", "conversation", "transcript", "source", "source-evidence", "text", "redacted", "compaction", "reference", "summary", "metadata", "session", "sha256", "type", "status", "trust", "tier", "primary", "archived", "started", "ended",
]
SYNONYMS = {
    "hermes": "hermes", "赫尔墨斯": "hermes", "obsidian": "second-brain", "vault": "second-brain", "第二大脑": "second-brain", "二脑": "second-brain", "codex": "codex", "minimax": "minimax", "m3": "minimax",
    "审计": "audit", "audit": "audit", "反思": "reflection", "reflect": "reflection", "reflection": "reflection",
}


def window_start(mode: str, day: Column) -> Column:
    """The first day of a mode's window, which ends with the day itself."""
    return {"daily": day, "manual": day, "weekly": F.trunc(day, "week"), "monthly": F.trunc(day, "month"), "yearly": F.trunc(day, "year")}[mode].cast("date")


def source_date(path: Column, mtime: Column) -> Column:
    """A transcript's date from its directories, a roll-up's from its name, else the file's."""
    parts = F.regexp_extract(path, r"^raw/transcripts/[^/]+/(\d{4}/\d{1,2}/\d{1,2})/", 1)
    named = F.regexp_extract(path, r"^brain/(?:daily|weekly|monthly|yearly)/(\d{4}-\d{2}-\d{2})\.md$", 1)
    return F.coalesce(F.try_to_date(F.nullif(parts, F.lit("")), "yyyy/M/d"), F.try_to_date(F.nullif(named, F.lit("")), "yyyy-MM-dd"), F.to_date(mtime))


def starts_with_any(path: Column, prefixes: list[str]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | path.startswith(p)
    return found


def select_sources(notes: DataFrame, mode: str, day: str, most: int, raw_prefixes: tuple[str, ...] = ("raw/",)) -> DataFrame:
    """Sources of a run: path, kind (generated, raw), position, selected. Generated roll-ups come first, by path; beyond `most`, rejected.

    notes: path, mtime, generated (whether the engine wrote it).
    """
    at = F.lit(day).cast("date")
    dated = notes.withColumn("source_date", source_date(F.col("path"), F.col("mtime"))).filter((F.col("source_date") >= window_start(mode, at)) & (F.col("source_date") <= at))
    kind = F.when(starts_with_any(F.col("path"), list(raw_prefixes)), "raw").when(F.col("generated") & starts_with_any(F.col("path"), LOWER_LEVELS.get(mode, [])), "generated")
    order = [F.when(F.col("kind") == "generated", 0).otherwise(1), F.asc("path")]
    placed = numbered(dated.withColumn("kind", kind).filter("kind is not null"), order)
    return placed.select("path", "kind", "source_date", "position", (F.col("position") <= most).alias("selected"))


def background(notes: DataFrame, day: str, days: int = BACKGROUND_DAYS) -> DataFrame:
    """Generated daily notes of the days before, without the day itself, newest path first: path, position."""
    at = F.lit(day).cast("date")
    dated = notes.filter(F.col("path").startswith("brain/daily/") & F.col("generated")).withColumn("source_date", source_date(F.col("path"), F.col("mtime")))
    near = dated.filter((F.col("source_date") >= F.date_sub(at, days)) & (F.col("source_date") < at))
    first = near.orderBy(F.desc("path")).limit(days)
    return first.withColumn("position", F.row_number().over(Window.orderBy(F.desc("path")))).select("path", "source_date", "position")


def plan(first: Column, last: Column) -> Column:
    """The runs between two days: array of (day, mode). Daily always, weekly on Sundays, monthly on the 1st, yearly on January 1st."""
    days = F.sequence(first, last)
    each = lambda d: F.array_compact(F.array(
        F.struct(d.alias("day"), F.lit("daily").alias("mode")), F.when(F.dayofweek(d) == 1, F.struct(d.alias("day"), F.lit("weekly").alias("mode"))),
        F.when(F.dayofmonth(d) == 1, F.struct(d.alias("day"), F.lit("monthly").alias("mode"))), F.when((F.dayofmonth(d) == 1) & (F.month(d) == 1), F.struct(d.alias("day"), F.lit("yearly").alias("mode")))))
    return F.flatten(F.transform(days, each))


def slug(text: Column) -> Column:
    """ASCII letters and digits, other separators to one dash; empty if nothing is left."""
    kept = F.regexp_replace(F.lower(text), r"[^a-z0-9\-_ /:]", "")
    return F.btrim(F.regexp_replace(kept, r"[\-_ /:]+", "-"), F.lit("-"))


def theme_key(raw: Column) -> Column:
    """The key of a theme: a known name, else a slug; null if nothing is left of it."""
    word, key = F.lower(F.trim(raw)), F.lit(None).cast("string")
    for name, canonical in SYNONYMS.items():
        key = F.when(word == name, canonical).otherwise(key)
    s = slug(word)
    return F.when(F.length(word) < 2, F.lit(None).cast("string")).otherwise(F.coalesce(key, F.when(s != "", F.concat(F.lit("content-"), s))))


def plain_terms(text: Column) -> Column:
    """All ASCII words of three characters or more that may be a theme, and neighbouring pairs of other letters; repeats kept."""
    words = F.filter(F.split(F.lower(F.regexp_replace(text, r"[^A-Za-z0-9_\-]+", " ")), " "), lambda w: (F.length(w) >= 3) & ~w.isin(THEME_STOPWORDS))
    other = F.regexp_replace(text, r"[\x00-\x7F]|[^\p{L}\p{N}]", "")
    pairs = neighbour_pairs(F.filter(F.split(other, ""), lambda c: c != ""))
    return F.concat(words, pairs)


def source_terms(sources: DataFrame, column: str) -> DataFrame:
    """path, term, freq: terms that a source holds twice or more, its first TERMS_PER_SOURCE."""
    counts = sources.select("path", F.explode(plain_terms(F.coalesce(F.col(column), F.lit("")))).alias("term")).groupBy("path", "term").agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= LEAST_FREQUENCY)
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("freq"), "term"))
    return counts.withColumn("place", place).filter(F.col("place") <= TERMS_PER_SOURCE).drop("place")


def themes(sources: DataFrame, most: int = MAX_THEMES) -> DataFrame:
    """The themes of a run: key, occurrences, spread, place. sources: path, title, tags, links, text.

    Tags and links count once each, terms by their frequency, a transcript's title terms four times theirs. Kept are themes of two
    occurrences or two sources.
    """
    signals = sources.select("path", F.explode(F.array_distinct(F.concat("tags", "links"))).alias("term"), F.lit(1).cast("long").alias("weight"))
    body = source_terms(sources, "text").select("path", "term", F.col("freq").alias("weight"))
    titles = source_terms(sources.filter(F.col("path").startswith("raw/transcripts/")), "title").select("path", "term", (F.col("freq") * TITLE_WEIGHT).alias("weight"))
    every = signals.unionByName(body).unionByName(titles).withColumn("key", theme_key(F.col("term"))).filter("key is not null")
    counted = every.groupBy("key").agg(F.sum("weight").alias("occurrences"), F.countDistinct("path").alias("spread")).filter((F.col("occurrences") >= 2) | (F.col("spread") >= 2))
    best = counted.orderBy(F.desc("spread"), F.desc("occurrences"), "key").limit(most)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("spread"), F.desc("occurrences"), "key")))


def confidence_of_days(days: Column) -> Column:
    return F.when(days >= 3, "high").when(days == 2, "medium").otherwise("low")


def confidence_rank(value: Column) -> Column:
    found = F.lit(0)
    for name, n in RANKS.items():
        found = F.when(value == name, n).otherwise(found)
    return found


def rank_name(rank: Column) -> Column:
    return F.when(rank >= 3, "high").when(rank == 2, "medium").otherwise("low")


def occurrence_id(topic: Column, mode: Column, day: Column, paths: Column, hashes: Column) -> Column:
    return F.concat(F.lit("occurrence:"), F.sha2(F.to_json(F.struct(topic.alias("topic"), mode.alias("mode"), day.cast("string").alias("date"), paths.alias("paths"), hashes.alias("hashes"))).cast("binary"), 256))


def ledger(observations: DataFrame) -> DataFrame:
    """The ledger of all observations of daily and manual runs; a row for each topic.

    observations: topic_key, title, mode, day, confidence, source_paths, source_hashes. Repeats of the same occurrence count once. The
    confidence is the strongest seen, or that of the number of days, whichever is more.
    """
    seen = observations.filter(F.col("mode").isin("daily", "manual") & (F.size("source_paths") > 0)).withColumn("occurrence", occurrence_id(F.col("topic_key"), F.col("mode"), F.col("day"), F.col("source_paths"), F.col("source_hashes")))
    grouped = seen.groupBy("topic_key").agg(
        F.max_by("title", "day").alias("title"), F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.countDistinct("occurrence").alias("repeat_count"), F.array_sort(F.collect_set("day")).alias("distinct_dates"),
        F.max(confidence_rank(F.col("confidence"))).alias("_own"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("source_paths")))).alias("source_paths"), F.array_sort(F.collect_set("mode")).alias("modes"),
    )
    strongest = F.greatest("_own", confidence_rank(confidence_of_days(F.size("distinct_dates"))))
    return grouped.withColumn("confidence", rank_name(strongest)).drop("_own").withColumn("promotion_status", F.lit("none"))


def promotable(ledger_rows: DataFrame, mode: str) -> DataFrame:
    """Topics that recur often enough to be proposed, and are not proposed or settled yet."""
    often = F.size("distinct_dates") >= PROMOTE_DATES if mode in ("daily", "manual") else F.col("repeat_count") >= PROMOTE_REPEATS
    return ledger_rows.filter(often & (F.col("confidence") == "high") & ~F.col("promotion_status").isin("proposed", "accepted", "superseded"))


def promotion_writes(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """What a promotion would write: write, unchanged, or refused where a person has edited. candidates: topic_key, body; existing: topic_key, body, generated."""
    e = existing.select("topic_key", F.sha2(F.trim("body").cast("binary"), 256).alias("e_hash"), F.col("generated").alias("e_generated"))
    c = candidates.withColumn("c_hash", F.sha2(F.trim("body").cast("binary"), 256)).join(e, "topic_key", "left")
    return c.select("topic_key", F.when(F.col("e_hash").isNull(), "write").when(~F.col("e_generated"), "refused").when(F.col("e_hash") == F.col("c_hash"), "unchanged").otherwise("write").alias("action"))


def grouped_cards(sources: DataFrame, size: int = GROUP) -> DataFrame:
    """Sources in groups of at most `size` in their order: path, position, group_no."""
    return sources.withColumn("group_no", F.floor((F.col("position") - 1) / size).cast("int"))


def cards_pass(cards: DataFrame) -> DataFrame:
    """Whether each group's writer and auditor agree and all have passed: group_no, passed. cards: group_no, role, draft_hash, passed."""
    paired = cards.groupBy("group_no").agg(F.collect_set("role").alias("roles"), F.countDistinct("draft_hash").alias("drafts"), F.bool_and("passed").alias("passed"))
    return paired.select("group_no", (F.array_contains("roles", "writer") & F.array_contains("roles", "auditor") & (F.col("drafts") == 1) & F.col("passed")).alias("passed"))


def anchors(sources: DataFrame, excerpt: int = 180) -> DataFrame:
    """Receipts of sources: S1, S2, … by position, with the redacted excerpt and its digest. sources: path, position, text."""
    quote = F.substring(redact_lines(F.col("text")), 1, excerpt)
    return sources.select(F.concat(F.lit("S"), F.col("position").cast("string")).alias("anchor"), "path", quote.alias("quote")).withColumn("quote_hash", F.sha2(F.col("quote").cast("binary"), 256))


def within_budget(items: DataFrame, chars: int = EVIDENCE_CHARS, most: int = EVIDENCE_SOURCES) -> DataFrame:
    """The first items whose running length stays within the budget; the first is always kept. items: position, text."""
    run = F.sum(F.length("text")).over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    return items.filter(F.col("position") <= most).withColumn("running", run).filter((F.col("position") == 1) | (F.col("running") <= chars))


def acceptable(text: Column, known_anchors: Column) -> Column:
    """A reflection that says something, has no code fence and cites a known source anchor."""
    cites = F.exists(known_anchors, lambda a: F.contains(text, F.concat(F.lit("["), a, F.lit("]"))))
    return (F.trim(text) != "") & ~text.contains("```") & cites


def snapshot_diff(old: DataFrame, new: DataFrame, profile_changed: bool = False) -> DataFrame:
    """path, change (changed, removed, unchanged) between digests; a changed profile or a first run changes all. old, new: path, hash."""
    o, n = old.select("path", F.col("hash").alias("o")), new.select("path", F.col("hash").alias("n"))
    return o.join(n, "path", "full_outer").select("path", F.when(F.col("n").isNull(), "removed").when(F.lit(profile_changed) | F.col("o").isNull() | (F.col("o") != F.col("n")), "changed").otherwise("unchanged").alias("change"))


def watermarks(selected: DataFrame, profile: str, run_id: str, status: str) -> DataFrame:
    """The sidecar of a run: for each file what it was when the run read it. selected: path, hash, mtime, size."""
    return selected.select(F.lit(profile).alias("profile"), "path", "hash", "mtime", "size", F.lit(run_id).alias("last_processed_run"), F.lit(status).alias("last_status"))


def unprocessed(files: DataFrame, marks: DataFrame) -> DataFrame:
    """Files that no run has read well as they are now: new, changed, or of a run that failed. files: path, hash."""
    done = marks.filter("last_status = 'ok'").select("path", "hash")
    return files.join(done, ["path", "hash"], "left_anti")


def written_state(written: DataFrame, indexed: DataFrame, found: DataFrame) -> DataFrame:
    """After a write: path, state (fresh, stale or missing in the index), smoke (whether the smoke search found it), degraded.

    written: path, hash, size; indexed: path, hash, size of what the index holds; found: path of the smoke search's results.
    """
    held = indexed.select("path", F.col("hash").alias("i_hash"), F.col("size").alias("i_size"))
    hit = found.select("path").distinct().withColumn("smoke", F.lit(True))
    state = F.when(F.col("i_hash").isNull(), "missing").when((F.col("i_hash") == F.col("hash")) & (F.col("i_size") == F.col("size")), "fresh").otherwise("stale")
    out = written.join(held, "path", "left").join(hit, "path", "left").select("path", state.alias("state"), F.coalesce("smoke", F.lit(False)).alias("smoke"))
    return out.withColumn("degraded", (F.col("state") != "fresh") | ~F.col("smoke"))


def validators(rows: DataFrame, checks: dict[str, Column], key: str) -> DataFrame:
    """Names of the checks that a row fails: key, failed, ok."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in checks.items()]))
    return rows.select(key, failed.alias("failed")).withColumn("ok", F.size("failed") == 0)


def title_theme(text: Column) -> Column:
    """The theme of a title without date, session words and punctuation; null below three characters."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^#+\s*", ""), r"\d{4}[-/]\d{2}[-/]\d{2}", " "), r"(?i)\b(transcript|session|chat|log|notes?)\b|[|:：_–—-]+", " "))
    squeezed = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return F.when(F.length(squeezed) >= 3, squeezed)


def transcript_body(text: Column, most: int = 8000) -> Column:
    """Spoken text of a transcript: no frontmatter, code fences, headings and metadata lines."""
    body = F.regexp_replace(F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", ""), r"(?s)(```|~~~).*?(\1|\z)", "")
    kept = F.filter(F.split(body, "\n"), lambda x: ~F.ltrim(x).startswith("#") & ~x.rlike(r"^\s*(- )?[A-Za-z_ ]{2,20}:\s") & (F.trim(x) != ""))
    return F.substring(F.array_join(kept, "\n"), 1, most)
