"""Scans, parsing, chunks, tiers, dates, links and redaction over the rendered vault."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import redact, tiers
from ..functions.markdown import SCALARS, link_key, path_stem, structure, title_key
from ..functions.text import squeezed, uri_component
from ..operators import chunking
from ..operators.ranking import evidence_uri, open_uri
from ..sources import vault as sources
from .base import CHUNKS, EVIDENCE, PARSED, TIER, VAULT, event_time_sql, note_chunks, parsed, rows, table, vault, values_sql



def scan(spark, sf):
    return sources.with_content_hash(vault(spark, sf), "source").filter(~sources.pruned(F.col("path"))).select("path", "mtime", "size", "hash")


SAFE = [("wiki/en/3.md",), ("wiki/en/3.md",), ("/etc/x.md",), ("../x.md",), ("a/../../b.md",), ("notes/x.txt",), ("missing.md",), ("brain/4.md",), ("brain/12.md",)]


def point_scan(spark, sf):
    files, wanted = vault(spark, sf).select("path", "doc_id"), rows(spark, "path string", SAFE)
    return sources.scan_paths(files, wanted).select("path", F.lit("scanned").alias("result")).unionByName(sources.refused_paths(files, wanted).select("path", F.col("reason").alias("result")))


def sampled(spark, sf):
    return sources.representative_sample(vault(spark, sf).select("path", "doc_id"), {"wiki/": 20, "raw/": 30, "brain/": 5}, 100).select("path", "bucket", "turn")


def scalars(spark, sf):
    return parsed(spark, sf).select("path", *SCALARS)


def links(spark, sf):
    n = parsed(spark, sf)
    return n.select("path", F.explode("links").alias("link")).select("path", "link", link_key(F.col("link")).alias("key"))


def keys(spark, sf):
    return parsed(spark, sf).select("path", path_stem(F.col("path")).alias("stem"), title_key(F.col("title")).alias("title_key"))


def flags(spark, sf):
    n = parsed(spark, sf)
    return n.select("path", *[c.alias(k) for k, c in structure(F.col("body")).items()])


def chunk_link_sets(spark, sf):
    return note_chunks(spark, sf).select("chunk_id", "links")


def embedding_input(spark, sf):
    c = note_chunks(spark, sf)
    return c.select("chunk_id", F.sha2(chunking.embedding_text(F.col("title"), F.col("heading"), F.col("tags"), F.col("text")).cast("binary"), 256).alias("input_sha"))


def tier(spark, sf):
    n = parsed(spark, sf)
    t = tiers.source_tier(F.col("path"), F.col("source_type"))
    return n.select("path", t.alias("tier"), tiers.evidence_type(t).alias("evidence_type"), tiers.event_time(F.col("path"), F.col("valid_from"), F.col("updated"), F.col("mtime")).alias("event_time"))


def uris(spark, sf):
    c = note_chunks(spark, sf)
    return c.select("chunk_id", evidence_uri(F.col("chunk_id")).alias("evidence_uri"), open_uri(F.col("path"), F.col("line_start")).alias("open_uri"), uri_component(F.concat(F.lit("a*b~c+d &é/"), F.col("path"))).alias("encoded"))


def cards(spark, sf):
    c = note_chunks(spark, sf)
    return c.select("chunk_id", F.coalesce("title", "heading", "path").alias("title"), squeezed(F.substring("text", 1, 400)).alias("excerpt"))


def preview(spark, sf):
    c = note_chunks(spark, sf)
    return c.select("path", F.substring("text", 1, 200).alias("preview"), (F.length("text") > 200).alias("truncated"))


def redacted(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(redact.redact_lines(F.coalesce("text", F.lit(""))).cast("binary"), 256).alias("sha"), redact.looks_secret(F.coalesce("text", F.lit(""))).alias("secret"))


def secret_scan(spark, sf):
    d = table(spark, sf, "documents")
    return redact.scan_secrets(d.select(F.col("doc_id").cast("string").alias("path"), "text"))


def packed_chunks(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("body"), F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("tags"))
    return chunking.chunk(d).groupBy("path").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("line_end").alias("last_line"), F.sum(F.octet_length("text")).alias("bytes"))


def section_chunks(spark, sf):
    return chunking.chunk(parsed(spark, sf), max_bytes=1 << 30).select("path", "heading", "line_start", "line_end", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


def chunks_full(spark, sf):
    return chunking.chunk(parsed(spark, sf), overlap=120).select("chunk_id", "path", "heading", "line_start", "line_end", F.octet_length("text").alias("bytes"), "has_code", "has_task_list")


def synthetic(spark, sf):
    return sources.synthetic_vault(spark, 50, 3)


def tag_histogram(spark, sf):
    return parsed(spark, sf).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("notes"))


def concepts(spark, sf):
    return parsed(spark, sf).filter(F.col("path").startswith("wiki/") & ~F.col("path").startswith("wiki/reports/")).select("path", F.coalesce("title", path_stem(F.col("path"))).alias("concept"))


def attachments(spark, sf):
    refs = parsed(spark, sf).select("path", F.explode("links").alias("link")).select("path", F.trim(F.regexp_extract("link", r"^([^|#]*)", 1)).alias("target")).filter("target <> ''")
    ext = F.lower(F.regexp_extract("target", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext.isin("png", "jpg", "jpeg", "gif", "svg", "webp"), "image").when(ext == "pdf", "pdf").when(ext == "md", "note").when(ext == "", "link").otherwise("other")
    return refs.groupBy("target").agg(F.array_sort(F.collect_set("path")).alias("sources")).withColumn("kind", kind)


QUERIES = {
    "a01_scan": scan, "a03_point_scan": point_scan, "a12_synthetic_vault": synthetic, "a13_representative_sample": sampled, "b01_body": lambda s, d: parsed(s, d).select("path", F.sha2(F.col("body").cast("binary"), 256).alias("body_sha")),
    "b02_title": lambda s, d: parsed(s, d).select("path", "title"), "b03_b04_tags": lambda s, d: parsed(s, d).select("path", "tags"), "b05_b13_links": links, "b06_scalars": scalars, "b07_b09_chunks": chunks_full,
    "b07_packed_chunks": packed_chunks, "b07_section_chunks": section_chunks, "b11_structure": flags, "b12_chunk_links": chunk_link_sets, "b14_keys": keys, "b15_embedding_input": embedding_input, "b16_b18_tiers": tier,
    "b19_uris": uris, "b20_b21_cards": cards, "b22_redact": redacted, "p08_secret_scan": secret_scan, "n10_tag_histogram": tag_histogram, "n11_concepts": concepts, "n12_attachments": attachments, "n13_preview": preview,
}

_ENC = "replace(replace(url_encode({0}), '+', '%20'), '%7E', '~')"

SQL = {
    "a01_scan": f"WITH {VAULT} SELECT path, make_timestamp(mtime * 1000000) AS mtime, strlen(source) AS size, sha256(source) AS hash FROM vault",
    "a03_point_scan": f"""WITH {VAULT}, {values_sql('wanted', 'path', SAFE)}, w AS (SELECT DISTINCT path, CASE WHEN starts_with(path, '/') THEN 'absolute' WHEN list_contains(string_split(path, '/'), '..') THEN 'parent'
        WHEN NOT lower(path) LIKE '%.md' THEN 'not_markdown' END AS reason FROM wanted)
        SELECT path, coalesce(reason, CASE WHEN path IN (SELECT path FROM vault) THEN 'scanned' ELSE 'missing' END) AS result FROM w""",
    "a12_synthetic_vault": "SELECT concat('notes/', lpad(CAST(i AS VARCHAR), 5, '0'), '.md') AS path, concat('---', chr(10), 'tags: [stress, topic', lpad(CAST(i AS VARCHAR), 5, '0'), ', generation3]', chr(10), '---', chr(10), '# Note ', lpad(CAST(i AS VARCHAR), 5, '0'), chr(10), repeat(concat('anchor', lpad(CAST(i AS VARCHAR), 5, '0'), ' '), 8), chr(10), 'topic body of generation 3', chr(10)) AS source FROM range(50) t(i)",
    "a13_representative_sample": f"""WITH {VAULT}, b AS (SELECT path, CASE WHEN starts_with(path, 'wiki/') THEN 'wiki/' WHEN starts_with(path, 'raw/') THEN 'raw/' WHEN starts_with(path, 'brain/') THEN 'brain/' END AS bucket, sha256(concat('sample', chr(0), path)) AS o FROM vault),
        r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY o, path) AS place FROM b),
        t AS (SELECT *, CASE WHEN bucket IS NOT NULL AND place <= CASE bucket WHEN 'wiki/' THEN 20 WHEN 'raw/' THEN 30 ELSE 5 END THEN 0 ELSE 1 END AS turn FROM r)
        SELECT path, bucket, turn FROM t ORDER BY turn, o, path LIMIT 100""",
    "b01_body": f"WITH {PARSED} SELECT path, sha256(body) AS body_sha FROM parsed",
    "b02_title": f"WITH {PARSED} SELECT path, title FROM parsed",
    "b03_b04_tags": f"WITH {PARSED} SELECT path, tags FROM parsed",
    "b05_b13_links": f"WITH {PARSED}, l AS (SELECT path, unnest(links) AS link FROM parsed) SELECT path, link, lower(trim(regexp_extract(regexp_replace(trim(regexp_extract(link, '^([^|#]*)', 1)), '\\.md$', ''), '([^/]*)$', 1))) AS key FROM l",
    "b06_scalars": f"WITH {PARSED} SELECT path, {', '.join(SCALARS)} FROM parsed",
    "b07_section_chunks": f"""WITH {PARSED}, l AS (SELECT path, title, unnest(bl) AS line, unnest(range(1, len(bl) + 1)) AS no, len(bl) AS n FROM parsed), f AS (
          SELECT *, sum(CASE WHEN starts_with(ltrim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fences FROM l WHERE no < n OR line <> ''),
        h AS (SELECT *, regexp_matches(ltrim(line), '^#+\\s*[^#\\s]') AND coalesce(fences, 0) % 2 = 0 AS is_head, length(regexp_extract(ltrim(line), '^#+')) AS level FROM f),
        b AS (SELECT *, sum(CASE WHEN is_head THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY no) AS section FROM h),
        s AS (SELECT path, section, min(no) AS line_start, max(no) AS line_end, string_agg(line, chr(10) ORDER BY no) AS text, max(CASE WHEN is_head THEN trim(regexp_replace(ltrim(line), '^#+', '')) END) AS head, max(CASE WHEN is_head THEN level END) AS level FROM b GROUP BY path, section)
        SELECT path, CASE WHEN level = 2 AND EXISTS (SELECT 1 FROM s o WHERE o.path = s.path AND o.level = 1 AND o.section < s.section) THEN (SELECT o.head FROM s o WHERE o.path = s.path AND o.level = 1 AND o.section < s.section ORDER BY o.section DESC LIMIT 1) || ' > ' || head ELSE head END AS heading,
          line_start, line_end, sha256(trim(text, ' ' || chr(9) || chr(10))) AS sha FROM s WHERE trim(text, ' ' || chr(9) || chr(10)) <> ''""",
    "b11_structure": f"WITH {CHUNKS} SELECT path, has_code, has_link, has_task_list, has_incomplete_tasks FROM chunks",
    "b12_chunk_links": f"WITH {CHUNKS} SELECT chunk_id, links FROM chunks",
    "b14_keys": f"WITH {PARSED} SELECT path, lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.md$', '')) AS stem, nullif(lower(trim(title)), '') AS title_key FROM parsed",
    "b15_embedding_input": f"WITH {CHUNKS} SELECT chunk_id, sha256(concat_ws(chr(10), CASE WHEN title IS NOT NULL THEN 'title: ' || title END, CASE WHEN len(tags) > 0 THEN 'tags: ' || array_to_string(tags, ', ') END, text)) AS input_sha FROM chunks",
    "b16_b18_tiers": f"WITH {PARSED}, t AS (SELECT path, {TIER.format(p='path', s='source_type')} AS tier, {event_time_sql()} AS event_time FROM parsed) SELECT path, tier, {EVIDENCE.format(t='tier')} AS evidence_type, event_time FROM t",
    "b19_uris": f"WITH {CHUNKS} SELECT chunk_id, 'quarry://chunk/' || chunk_id AS evidence_uri, 'obsidian://open?path=' || {_ENC.format('path')} || '&line=1' AS open_uri, {_ENC.format(chr(39) + 'a*b~c+d &é/' + chr(39) + ' || path')} AS encoded FROM chunks",
    "b20_b21_cards": f"WITH {CHUNKS} SELECT chunk_id, coalesce(title, path) AS title, trim(regexp_replace(substr(text, 1, 400), '\\s+', ' ', 'g')) AS excerpt FROM chunks",
    "b22_redact": f"SELECT doc_id, sha256(array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: CASE WHEN regexp_matches(l, '{redact.SECRET_LINE_SQL}') THEN '[REDACTED]' ELSE l END), chr(10))) AS sha, regexp_matches(coalesce(text, ''), '{redact.SECRET_LINE_SQL}') AS secret FROM documents",
    "p08_secret_scan": f"WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS path, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents) SELECT path, CAST(line_no AS INTEGER) AS line_no FROM l WHERE regexp_matches(line, '{redact.SECRET_LINE_SQL}')",
    "n10_tag_histogram": f"WITH {PARSED}, t AS (SELECT unnest(tags) AS tag FROM parsed) SELECT tag, count(*) AS notes FROM t GROUP BY tag",
    "n11_concepts": f"WITH {PARSED} SELECT path, coalesce(title, lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.md$', ''))) AS concept FROM parsed WHERE starts_with(path, 'wiki/') AND NOT starts_with(path, 'wiki/reports/')",
    "n12_attachments": f"""WITH {PARSED}, l AS (SELECT path, unnest(links) AS link FROM parsed), t AS (SELECT path, trim(regexp_extract(link, '^([^|#]*)', 1)) AS target FROM l)
        SELECT target, list_sort(list(DISTINCT path)) AS sources, CASE WHEN lower(regexp_extract(target, '\\.([A-Za-z0-9]+)$', 1)) = 'md' THEN 'note' WHEN regexp_extract(target, '\\.([A-Za-z0-9]+)$', 1) = '' THEN 'link' ELSE 'other' END AS kind FROM t WHERE target <> '' GROUP BY target""",
    "n13_preview": f"WITH {CHUNKS} SELECT path, substr(text, 1, 200) AS preview, length(text) > 200 AS truncated FROM chunks",
}
