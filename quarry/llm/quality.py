"""Operator 7: quality rules with cross-document line frequency; DataFrame functions only.

Base figures of a text: words (runs of other than the six kinds of white space), code points in words, symbols of
`#*$%&|<>`, lines with a word that equal an earlier line, and words inside windows of 8 words that the text holds twice
or more. A text of fewer than MIN_WORDS words, or with more than 30 repeated words in 100, fails.

Line frequency: a line with a word is normalised (A-Z lower-cased, digit runs to 0, white space to one space, trimmed)
and hashed; for each host (the `source` column) the documents (distinct ids) that hold it are counted. A line that more
than max(MIN_DOCUMENTS, SHARE of the host's documents) of the host's documents hold is taken out. A document is depleted, and
not kept, if fewer than MIN_LEFT words or fewer than LEFT_SHARE of its words are left.

Ids are told apart before they are counted, by line, host and id, so a line that a third of all documents hold is spread
over the tasks. Frequent lines of many rows (HOT_ROWS, or a HOT_LINES-th of all lines if that is more, so HOT_LINES of
them at most) are broadcast to the documents' lines; for the others, no key has more rows than that.

Null and empty texts have no words and fail. Rows that repeat an id are one document where lines are counted, and are
judged each for itself. Null sources are one host. Rows without an id are judged, but count as no document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialised, table

SPACE = r"[\x20\x09-\x0D]"
WINDOW, MIN_WORDS, REPEATED_PERCENT = 8, 20, 30
MIN_DOCUMENTS, SHARE, MIN_LEFT, LEFT_SHARE, HOT_ROWS, HOT_LINES = 20, 0.01, 10, 0.3, 1000, 100_000
BLANKS = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))


def windows(words: Column) -> Column:
    """A hash of each window of WINDOW words; equal windows are taken for equal hashes within one text."""
    at = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])
    return F.when(F.size(words) < WINDOW, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - WINDOW, F.lit(0))), at))


def with_repeated_words(df: DataFrame) -> DataFrame:
    """hashes to n_repeat_words: the words inside windows that occur twice or more, as the length of the union of their places.

    Each step is a column of its own: inside a lambda, an expression would be computed for every element.
    """
    places = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    twice = lambda e, k: (F.get("places", k - 1)["h"] == e["h"]) | (F.get("places", k + 1)["h"] == e["h"])
    starts = F.sort_array(F.transform(F.filter("places", lambda e, k: F.coalesce(twice(e, k), F.lit(False))), lambda e: e["i"]))
    own = F.transform("starts", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - s, F.lit(WINDOW))))
    total = F.coalesce(F.aggregate(own, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")
    return df.withColumn("places", places).drop("hashes").withColumn("starts", starts).drop("places").withColumn("n_repeat_words", total).drop("starts")


def normalised(line: Column) -> Column:
    folded = F.regexp_replace(F.regexp_replace(F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[0-9]+", "0"), SPACE + "+", " ")
    return F.btrim(folded, F.lit(" "))


def frequent_lines(lines: DataFrame, min_documents: int = MIN_DOCUMENTS, share: float = SHARE) -> DataFrame:
    """host, h, documents, rows (that hold it): the lines above the host's limit."""
    hosts = lines.groupBy("host").agg(F.count_distinct("doc_id").alias("host_documents")).withColumnRenamed("host", "a_host")
    own = F.array_distinct(F.transform("lines", lambda x: x["h"]))
    counts = lines.select("host", "doc_id", F.explode(own).alias("h")).groupBy("host", "h").agg(F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("rows")).filter(F.col("documents") > min_documents)
    return counts.join(hosts, F.col("host").eqNullSafe(F.col("a_host"))).filter(F.col("documents") > F.col("host_documents") * share).select("host", "h", "documents", "rows")


def text_figures(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, text_hash, host, the base figures, and lines: an array of (hash of the normalised line, words)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    first = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.col("source").alias("host"), words_of(F.col("text")).alias("words"), lines.alias("own_lines"),
        F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long").alias("word_chars"), F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    hashed = F.transform("own_lines", lambda x: F.struct(F.xxhash64(normalised(x)).alias("h"), F.size(words_of(x)).alias("w")))
    duplicates = (F.size("own_lines") - F.size(F.array_distinct("own_lines"))).cast("long")
    second = first.select("doc_id", "text_hash", "host", "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"), duplicates.alias("n_dup_lines"), windows(F.col("words")).alias("hashes"), hashed.alias("lines"))
    return with_repeated_words(second)


def assess(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, share: float = SHARE) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_removed, kept."""
    figures = materialised(text_figures(docs))  # one pass over the texts; what follows is narrow
    found = figures.select("doc_id", "text_hash", "host", "lines")
    base = figures.drop("lines")
    n_lines = figures.agg(F.sum(F.size("lines"))).first()[0] or 0
    frequent = materialised(frequent_lines(found, min_documents, share).select(F.col("host").alias("f_host"), F.col("h").alias("f_h"), (F.col("rows") > max(HOT_ROWS, n_lines // HOT_LINES)).alias("hot")))
    copies = found.withColumn("copy", F.monotonically_increasing_id())  # a step before the explode, which would number lines
    rows = copies.select("doc_id", "text_hash", "host", "copy", F.explode("lines").alias("line")).select("doc_id", "text_hash", "host", "copy", "line.h", "line.w")
    same = F.col("host").eqNullSafe(F.col("f_host")) & (F.col("h") == F.col("f_h"))
    marked = rows.join(F.broadcast(frequent.filter("hot")), same, "left")
    names = ("doc_id", "text_hash", "host", "copy", "h", "w")
    hit = marked.filter("hot").select(*names).unionByName(marked.filter("hot is null").select(*names).join(frequent.filter("not hot"), same).select(*names))
    # rows that repeat an id, text and source would each add their lines to all of them
    removed = hit.groupBy("doc_id", "text_hash", "host", "copy").agg(F.sum("w").alias("words_removed"))
    removed = removed.groupBy("doc_id", "text_hash", "host").agg(F.max("words_removed").alias("words_removed"))
    removed = removed.select(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash"), F.col("host").alias("r_host"), "words_removed")
    on = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash")) & F.col("host").eqNullSafe(F.col("r_host"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("words_removed", F.lit(0))
    return (
        base.join(removed, on, "left").withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (left >= MIN_LEFT) & (left >= F.col("n_words") * LEFT_SHARE))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce("words_removed", F.lit(0)).cast("long").alias("words_removed"), "kept")
    )


def op7(spark, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents")).drop("words_removed")


OP7_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS win FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)
), twice AS (
  SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, win) AS n FROM w) WHERE n > 1
), rep AS (
  SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r
), lines AS (
  SELECT r, doc_id, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY r
), hosts AS (
  SELECT source, count(DISTINCT doc_id) AS docs FROM d GROUP BY source
), frequent AS (
  SELECT l.source, norm FROM (SELECT source, norm, count(DISTINCT doc_id) AS n FROM lines GROUP BY source, norm) l
  JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source WHERE n > 20 AND n > docs * 0.01
), gone AS (
  SELECT r, sum(n) AS removed FROM lines l JOIN frequent f ON l.norm = f.norm AND l.source IS NOT DISTINCT FROM f.source GROUP BY r
), base AS (
  SELECT d.doc_id, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed, 0) AS removed
  FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND n_words - removed >= 10 AND n_words - removed >= n_words * 0.3 AS kept
FROM judged
"""
