"""A vault of Markdown notes: directory scans, point scans, and a deterministic vault rendered from a documents table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRUNED = (".obsidian", ".trash", ".git", "node_modules", "target", ".index")

#: One SQL text for Spark and for other engines: notes with frontmatter, headings, links, tags, tasks and code from `documents`.
VAULT_SQL = """
SELECT doc_id,
       CASE doc_id % 8
         WHEN 0 THEN concat('raw/transcripts/', source, '/2024/', mm, '/', dd, '/', id, '.md')
         WHEN 1 THEN concat('wiki/reports/2024-', mm, '-', dd, '-', id, '.md')
         WHEN 2 THEN concat('raw/system-snapshots/2024', mm, dd, '/', id, '.md')
         WHEN 3 THEN concat('wiki/', lang, '/', id, '.md')
         WHEN 4 THEN concat('brain/', id, '.md')
         WHEN 5 THEN concat('raw/', source, '/', id, '.md')
         WHEN 6 THEN concat('project-', source, '/', id, '.md')
         ELSE concat('notes/', lang, '/Note ', id, '.md') END AS path,
       concat(
         CASE WHEN doc_id % 3 = 2 THEN '' ELSE concat('---', nl,
           CASE WHEN doc_id % 2 = 0 THEN concat('tags: [', lang, ', "', source, '", topic', CAST(doc_id % 10 AS STRING), ']') ELSE concat('tags: ', source, nl, '- topic', CAST(doc_id % 10 AS STRING)) END, nl,
           CASE doc_id % 7 WHEN 0 THEN 'confidence: high' WHEN 1 THEN 'confidence: Medium' WHEN 2 THEN 'confidence: low' WHEN 3 THEN 'confidence: verified' ELSE 'confidence:' END, nl,
           CASE doc_id % 11 WHEN 0 THEN 'status: active' WHEN 1 THEN 'status: stale' WHEN 2 THEN 'status: "draft"' WHEN 3 THEN 'status: Archived' WHEN 4 THEN 'status: mature' ELSE 'kind: note' END, nl,
           CASE doc_id % 5 WHEN 0 THEN 'source_type: audit' WHEN 1 THEN 'source_type: dialogue log' WHEN 2 THEN 'source_type: system snapshot' ELSE 'source_type: [list]' END, nl,
           CASE WHEN doc_id % 4 = 1 THEN concat('valid_from: 2024-', mm, '-', dd, 'T08:00:00Z', nl) ELSE '' END,
           CASE WHEN doc_id % 6 = 1 THEN concat('valid_until: 2024-', mm, '-28', nl) ELSE '' END,
           CASE WHEN doc_id % 13 = 3 THEN concat('superseded_by: ', nxt, '.md', nl) ELSE '' END,
           CASE WHEN doc_id % 9 = 4 THEN concat('updated: 2024-', mm, '-', dd, nl) ELSE '' END, '---', nl) END,
         CASE WHEN doc_id % 5 = 4 THEN '' ELSE concat('# Title ', CAST(doc_id % 50 AS STRING), nl) END,
         text, nl, '## Links of ', id, nl,
         CASE WHEN doc_id % 2 = 0 THEN concat('See [[', nxt, ']] and ![[wiki/x/', far, '.md|that one]].', nl) ELSE concat('Related: [[Title ', CAST((doc_id + 7) % 50 AS STRING), '#part]] #', lang, ' #topic/', source, nl) END,
         CASE WHEN doc_id % 10 = 0 THEN concat('- [ ] open', nl, '- [x] done', nl) WHEN doc_id % 10 = 1 THEN concat('* [X] done', nl) ELSE '' END,
         CASE WHEN doc_id % 12 = 0 THEN concat('```', nl, '# no heading', nl, '```', nl, 'https://example.org/', id, nl) ELSE '' END) AS source,
       1704067200 + (doc_id % 365) * 86400 AS mtime
FROM (
  SELECT doc_id, CAST(doc_id AS STRING) AS id, CAST(doc_id + 1 AS STRING) AS nxt, CAST(doc_id * 7 % 1000 AS STRING) AS far, coalesce(lang, 'xx') AS lang, coalesce(source, 'none') AS source, coalesce(text, '') AS text, chr(10) AS nl,
         lpad(CAST(doc_id % 12 + 1 AS STRING), 2, '0') AS mm, lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0') AS dd
  FROM {documents}
) d
"""


def rendered_vault(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, path, source, mtime (timestamp) from a documents table."""
    notes = spark.sql(VAULT_SQL, documents=documents)
    return notes.withColumn("mtime", F.timestamp_seconds("mtime"))


def pruned(path: Column, names: tuple[str, ...] = PRUNED) -> Column:
    """True if any part of the path is a directory that is never scanned."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names)))


def with_content_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumns({"size": F.octet_length(content).cast("long"), "hash": F.sha2(F.col(content), 256)})


def scan_vault(spark: SparkSession, root: str) -> DataFrame:
    """All Markdown files under a directory: path (relative), mtime, size, hash, source; by path. Pruned directories are left out before contents are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    base = root.rstrip("/")
    relative = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^.*?" + _quoted(base) + "/", "")
    files = found.withColumn("path", relative).filter(~pruned(F.col("path")))
    return with_content_hash(files).select("path", F.col("modificationTime").alias("mtime"), "size", "hash", F.decode("content", "UTF-8").alias("source")).orderBy("path")


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def unsafe_path(path: Column) -> Column:
    """Why a relative path is refused, or null: absolute, climbing, or not Markdown."""
    return F.when(path.startswith("/"), "absolute").when(F.array_contains(F.split(path, "/"), ".."), "parent").when(~F.lower(path).endswith(".md"), "not_markdown").when(F.trim(path) == "", "empty")


def scan_paths(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The listed paths' files, each once, by path; wanted: path. Raises nothing: refused paths are in refused_paths."""
    safe = wanted.filter(unsafe_path(F.col("path")).isNull()).select("path").dropDuplicates(["path"])
    return files.join(safe, "path", "left_semi").orderBy("path")


def refused_paths(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Listed paths that are not scanned: path, reason."""
    listed = wanted.select("path").dropDuplicates(["path"]).withColumn("reason", unsafe_path(F.col("path")))
    missing = listed.filter("reason is null").join(files, "path", "left_anti").withColumn("reason", F.lit("missing"))
    return listed.filter("reason is not null").unionByName(missing)


def synthetic_vault(spark: SparkSession, n: int, generation: int = 0) -> DataFrame:
    """path, source of n deterministic notes for stress tests."""
    number = F.format_string("%05d", "id")
    source = F.concat(F.lit("---\ntags: [stress, topic"), number, F.lit(f", generation{generation}]\n---\n# Note "), number, F.lit("\n"), F.repeat(F.concat(F.lit("anchor"), number, F.lit(" ")), 8), F.lit(f"\ntopic body of generation {generation}\n"))
    return spark.range(n).select(F.concat(F.lit("notes/"), number, F.lit(".md")).alias("path"), source.alias("source"))


def representative_sample(notes: DataFrame, quotas: dict[str, int], total: int, salt: str = "sample") -> DataFrame:
    """Deterministic stratified sample: by path prefix up to each quota in hash order, then any others in hash order up to the total."""
    from pyspark.sql import Window

    bucket = F.lit(None).cast("string")
    for prefix in sorted(quotas, key=len):
        bucket = F.when(F.col("path").startswith(prefix), prefix).otherwise(bucket)
    limit = F.lit(0)
    for prefix, quota in quotas.items():
        limit = F.when(F.col("bucket") == prefix, quota).otherwise(limit)
    order = F.sha2(F.concat_ws("\u0000", F.lit(salt), F.col("path")).cast("binary"), 256)
    ranked = notes.withColumns({"bucket": bucket, "order": order}).withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("order", "path")))
    # WindowGroupLimit keeps at most `total` rows of each task in the last ranking
    first = F.when(F.col("bucket").isNotNull() & (F.col("place") <= limit), 0).otherwise(1)
    return ranked.withColumn("turn", first).orderBy("turn", "order", "path").limit(total).select(*notes.columns, "bucket", "turn")
