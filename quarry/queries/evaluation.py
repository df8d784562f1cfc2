"""Retrieval quality, feedback, the query log, reasoning, health and integrity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import governance as gov
from .base import PARSED, VAULT, note_chunks, parsed, rows, table, values_sql, vault


def qrels(spark, sf):
    """A case for each customer with orders."""
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").cast("string").alias("case_id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("o"), (F.col("o_orderkey") % 7).cast("string")))).alias("expected_paths"))


def ranked(spark, sf):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("case_id"), F.concat(F.lit("o"), (F.col("o_orderkey") % 11).cast("string")).alias("path"), place.alias("rank")).filter("rank <= 12")


def cases(spark, sf):
    return ev.case_metrics(qrels(spark, sf), ranked(spark, sf), 10)


def case_rows(spark, sf):
    return cases(spark, sf).select("case_id", "rank", F.round("recall", 6).alias("recall"), F.round("ndcg", 6).alias("ndcg"), F.round("mrr", 6).alias("mrr"), "hit_1", "hit_3", "hit_k", "results", "files", F.round("duplicate_rate", 6).alias("duplicate_rate"))


def matched(spark, sf):
    return ev.matched(qrels(spark, sf), ranked(spark, sf))


def totals(spark, sf):
    return ev.summary(cases(spark, sf))


def compared(spark, sf):
    shifted = ranked(spark, sf).withColumn("rank", F.when(F.col("path") == "o3", F.col("rank") + 1).otherwise(F.col("rank"))).filter("case_id <> '10'")
    base = cases(spark, sf).filter("case_id <> '20'")
    return ev.compare(base, ev.case_metrics(qrels(spark, sf).filter("case_id <> '10'"), shifted, 10), ["recall", "ndcg", "mrr"])


def gated(spark, sf):
    return ev.gate(totals(spark, sf), {"recall": (">=", 0.5), "ndcg": (">=", 0.99), "zero_hit": ("<=", 5), "mrr": (">=", 0.1)})


def spread(spark, sf):
    return ev.percentiles(table(spark, sf, "events"), "value", ["event_type"], [50, 95]).join(ev.percentiles(table(spark, sf, "events"), "value", ["event_type"], [50, 95], rounded=True).withColumnsRenamed({"p50": "r50", "p95": "r95"}), "event_type")


PHRASES = [("k1", ["a.md"], ["Hello World", "gone", " "]), ("k2", ["b.md"], ["hello"])]
SNIPS = [("k1", "a.md", "say hello world now"), ("k1", "c.md", "gone is here"), ("k2", "a.md", "hello"), ("k2", "b.md", "hell")]


def phrases(spark, sf):
    q, r = rows(spark, "case_id string, expected_paths array<string>, expected_phrases array<string>", PHRASES), rows(spark, "case_id string, path string, snippet string", SNIPS)
    return ev.matched_phrases(q, r).select("case_id", "phrase", F.lit("expected").alias("scope")).unionByName(ev.matched_phrases(q, r, anywhere=True).select("case_id", "phrase", F.lit("any").alias("scope")))


FOUND = [("k1", 1, ["vector"]), ("k1", 2, ["vector", "keyword"]), ("k1", 3, ["vector", "path"]), ("k1", 4, ["vector"]), ("k2", 1, ["keyword"]), ("k2", 2, ["route", "link", "temporal"])]


def shares(spark, sf):
    return ev.source_shares(rows(spark, "case_id string, rank int, sources array<string>", FOUND))


FEEDBACK = [
    (1, "selected", "chk_00000003", "Find  the Report", "{}"), (2, "Corrected", None, None, '{"query": "find the report", "expected_paths": ["b.md", "a.md"]}'), (3, "corrected", None, "other", '{"path": "x.md"}'), (4, "selected", "chk_00000004", "", "{}"),
    (5, "ignored", None, "zzz", '{"path": "x.md"}'), (6, "selected", None, "no path", "{}"), (7, "clicked", "chk_00000004", "Other", None), (8, "useful", "chk_00000012", "third", "{}"), (9, "selected", "chk_00000003", "FIND THE REPORT", "{}"),
]


def feedback(spark, sf):
    e = rows(spark, "id int, event string, chunk_id string, query string, payload string", FEEDBACK)
    return ev.feedback_cases(e, note_chunks(spark, sf).select("chunk_id", "path"))


OLD_CASES = [("Find", ["a"]), ("keep", ["k"]), ("same", ["s", "t"])]
NEW_CASES = [("find", ["b", "a"]), ("SAME", ["t"]), ("fresh", ["f"])]


def merged(spark, sf):
    return ev.merge_cases(rows(spark, "query string, expected_paths array<string>", OLD_CASES), rows(spark, "query string, expected_paths array<string>", NEW_CASES))


def log(spark, sf):
    e = table(spark, sf, "events")
    query = F.concat(F.lit("how "), F.when(F.col("event_id") % 3 == 0, "to find the").otherwise("find"), F.lit(" "), F.col("event_type"), F.when(F.col("event_id") % 500 == 0, " 什么").otherwise(""))
    return e.select(F.col("event_id").alias("id"), query.alias("query"), (F.col("event_id") % 5).alias("returned"), F.when(F.col("event_id") % 5 > 2, 1).otherwise(0).alias("text_only"), F.when(F.col("event_id") % 5 == 4, 2).otherwise(0).alias("confirmed"))


def weak(spark, sf):
    return log(spark, sf).select("query").distinct().select("query", ev.weak_terms(F.col("query")).alias("weak_terms"))


def log_sums(spark, sf):
    return ev.log_metrics(log(spark, sf), 100)


def tuned(spark, sf):
    e = log(spark, sf).withColumn("weak_terms", ev.weak_terms(F.col("query")))
    stop = ev.stopword_proposal(e, 5, ["to"], 100).select(F.col("term").alias("change"), F.col("n").cast("double").alias("value"))
    return stop.unionByName(ev.penalty_proposal(ev.log_metrics(e, 100), 0.9).select(F.lit("penalty").alias("change"), F.col("penalty").alias("value")))


MESSAGES = ["Unknown embedding provider x", "embedding profile mismatch: a", "index has no embeddings", "dimension mismatch 3", "bad API key", "vault is missing", "invalid flag", "file is corrupt", "no such table: chunks", "cannot open database", "boom", "vault unreadable"]


def classified(spark, sf):
    return rows(spark, "message string", [(m,) for m in MESSAGES]).select("message", ev.classify_error(F.col("message")).alias("code"))


CODES = [(1, []), (2, ["no_embeddings"]), (3, ["no_embeddings", "invalid_argument"]), (4, ["store_corrupt"]), (5, ["invalid_argument"])]


def health(spark, sf):
    return rows(spark, "id int, codes array<string>", CODES).select("id", ev.health_state(F.col("codes")).alias("state"))


def status(spark, sf):
    c = note_chunks(spark, sf).select("chunk_id", "path")
    return ev.status_counts(c, c.filter("chunk_id like '%3'"))


def hashed(spark, sf):
    return vault(spark, sf).select("path", F.sha2(F.col("source").cast("binary"), 256).alias("hash"), F.octet_length("source").cast("long").alias("size"))


def manifest(spark, sf):
    return ev.manifest(hashed(spark, sf))


def sealed(spark, sf):
    return ev.manifest_digest(ev.manifest(hashed(spark, sf)))


def tampered(spark, sf):
    f = hashed(spark, sf)
    return ev.verify_manifest(ev.manifest(f, 16), ev.manifest(f.withColumn("hash", F.when(F.col("path") == "brain/4.md", "0").otherwise(F.col("hash"))), 16)).select("state")


def repeated(spark, sf):
    return ev.duplicates(table(spark, sf, "documents"), F.sha2(F.col("text").cast("binary"), 256), "text_sha")


RUNS = [("r1", True), ("r2", True), ("r3", False)]


def runs(spark, sf):
    return ev.last_run(rows(spark, "run_id string, complete boolean", RUNS))


WORK = [("d1", "ok"), ("d1", "skipped"), ("d2", "failed"), ("d2", "ok"), ("d3", "ok")]


def worker(spark, sf):
    return ev.worker_status(rows(spark, "day string, status string", WORK))


ASKED = [("q1", "architecture decision review", 0.9), ("q2", "erinan", 0.3), ("q3", "conflict between raw source", 0.8), ("q4", "zzzzqqq reason", None), ("q5", "links of", 0.8), ("q6", "title 12", None)]


def notes_text(spark, sf):
    return parsed(spark, sf).select("path", F.col("body").alias("text"))


def asked(spark):
    return rows(spark, "query_id string, raw string, confidence double", ASKED)


def evidence(spark, sf):
    return gov.evidence(notes_text(spark, sf), asked(spark))


def reasoned(spark, sf):
    edges = parsed(spark, sf).limit(0).select(F.col("path").alias("source_path"), F.col("path").alias("target_path"), F.col("title").alias("relation"))
    return gov.reasoning(notes_text(spark, sf), edges, asked(spark)).select("query_id", "reasons", "evidence", "n_relations", F.round("answer_confidence", 6).alias("answer_confidence"))


HEALTH = [("h1", [], 5, 0, 0), ("h2", [], 5, 2, 0), ("h3", [], 5, 0, 1), ("h4", [], 5, 1, 1), ("h5", ["no_embeddings"], 5, 0, 0), ("h6", ["no_embeddings"], None, None, None), ("h7", [], None, None, None)]


def maintained(spark, sf):
    return ev.maintenance(rows(spark, "id string, codes array<string>, queries int, zero_hit int, missing_phrases int", HEALTH))


def tried(spark, sf):
    e = log(spark, sf).withColumn("weak_terms", ev.weak_terms(F.col("query")))
    return ev.dry_run(e, {"stopwords": ["to"], "penalty": 0.9, "last_id": 100}, 3).select("events", "eligible", "stopwords", F.round("penalty", 6).alias("penalty"), "text_only_ratio", "confirmed_ratio")


PROPOSED = [("p1", "a.md", "b.md", "supports", 0.5, "proposal", "two\nlines"), ("p2", "a.md", None, None, 0.12345, "rejected", "x")]


def diffs(spark, sf):
    p = rows(spark, "id string, source_path string, target_path string, relation string, confidence double, status string, rationale string", PROPOSED)
    return p.select("id", gov.diff_text(*[F.col(c) for c in ("source_path", "target_path", "id", "relation", "confidence", "status", "rationale")]).alias("diff"))


QUERIES = {
    "p05_maintain": maintained, "m17_dry_run": tried, "n04_diff": diffs,
    "m01_matched": matched, "m02_case_metrics": case_rows, "m03_summary": totals, "m05_m08_compare": compared, "m09_gate": gated, "m07_percentiles": spread, "m04_phrases": phrases, "m06_source_shares": shares, "m10_feedback": feedback, "m11_merge": merged,
    "m14_weak_terms": weak, "m13_log_metrics": log_sums, "m15_proposal": tuned, "p04_errors": classified, "p02_health": health, "p01_status": status, "p06_manifest": manifest, "p06_sealed": sealed, "p06_tampered": tampered, "p09_duplicates": repeated,
    "a14_runs": runs, "l27_worker": worker, "n05_evidence": evidence, "n06_n09_reasoning": reasoned,
}

_Q = """qr AS (SELECT CAST(o_custkey AS VARCHAR) AS case_id, list_sort(list(DISTINCT 'o' || CAST(o_orderkey % 7 AS VARCHAR))) AS expected_paths FROM orders GROUP BY o_custkey),
 rk AS (SELECT CAST(o_custkey AS VARCHAR) AS case_id, 'o' || CAST(o_orderkey % 11 AS VARCHAR) AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 12)"""


def _cases(name: str, rk: str, where: str = "TRUE") -> str:
    return f"""{name}_t AS (SELECT * FROM {rk} WHERE rank <= 10), {name}_m AS (SELECT t.case_id, t.path, min(rank) AS rank FROM {name}_t t JOIN qr ON qr.case_id = t.case_id AND list_contains(expected_paths, path) GROUP BY ALL),
 {name}_h AS (SELECT case_id, min(rank) AS rank, count(*) AS found, sum(1 / log2(rank + 1)) AS dcg FROM {name}_m GROUP BY case_id), {name}_s AS (SELECT case_id, count(*) AS results, count(DISTINCT path) AS files FROM {name}_t GROUP BY case_id),
 {name} AS (SELECT qr.case_id, h.rank, coalesce(found / CAST(len(expected_paths) AS DOUBLE), 0) AS recall, coalesce(dcg / list_sum(list_transform(range(1, least(len(expected_paths), 10) + 1), lambda k: 1 / log2(k + 1))), 0) AS ndcg, coalesce(1.0 / h.rank, 0) AS mrr, coalesce(h.rank <= 1, FALSE) AS hit_1, coalesce(h.rank <= 3, FALSE) AS hit_3, coalesce(h.rank <= 10, FALSE) AS hit_k,
   coalesce(results, 0) AS results, coalesce(files, 0) AS files, coalesce((results - files) / CAST(results AS DOUBLE), 0) AS duplicate_rate FROM qr LEFT JOIN {name}_h h USING (case_id) LEFT JOIN {name}_s USING (case_id) WHERE {where})"""


_TOTAL = "SELECT count(*) AS queries, count_if(hit_1) AS top1, count_if(hit_3) AS hit_3, count_if(hit_k) AS hits, count_if(NOT hit_k) AS zero_hit, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr, round(avg(duplicate_rate), 6) AS duplicate_rate, round(avg(files), 6) AS files FROM cs"
_LOG = "lg AS (SELECT event_id AS id, 'how ' || CASE WHEN event_id % 3 = 0 THEN 'to find the' ELSE 'find' END || ' ' || event_type || CASE WHEN event_id % 500 = 0 THEN ' 什么' ELSE '' END AS query, event_id % 5 AS returned, CASE WHEN event_id % 5 > 2 THEN 1 ELSE 0 END AS text_only, CASE WHEN event_id % 5 = 4 THEN 2 ELSE 0 END AS confirmed FROM events)"
_WEAK = "list_sort(list_distinct(list_concat(list_filter(regexp_split_to_array(lower(query), '[^\\p{L}\\p{N}]+'), lambda t: list_contains(" + str(ev.WEAK_TERMS) + ", t)), list_filter(" + str(ev.WEAK_PHRASES) + ", lambda t: contains(query, t)))))"
_LM = "SELECT count(*) AS events, CAST(sum(returned) AS BIGINT) AS returned, CAST(sum(text_only) AS BIGINT) AS text_only, CAST(sum(confirmed) AS BIGINT) AS confirmed, max(id) AS latest_id, round(sum(text_only) / CAST(sum(returned) AS DOUBLE), 9) AS text_only_ratio, round(sum(confirmed) / CAST(sum(returned) AS DOUBLE), 9) AS confirmed_ratio FROM lg WHERE id > 100"
_HASH = f"{VAULT}, f AS (SELECT path, sha256(source) AS hash, strlen(source) AS size, CAST(CAST(CAST(concat('0x', substr(sha256(path), 1, 12)) AS BIGINT) AS HUGEINT) * (SELECT greatest(16, count(*) // 64) FROM vault) // 281474976710656 AS BIGINT) AS bucket FROM vault), mf AS (SELECT bucket, sha256(string_agg(path || chr(0) || hash, chr(10) ORDER BY path)) AS digest, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM f GROUP BY bucket)"
_ASK = values_sql("asked", "query_id, raw, confidence", ASKED)
_EV = f"""{_ASK}, nt AS (SELECT path, body AS text FROM parsed), hp AS (SELECT query_id, path, CASE WHEN contains(lower(text), lower(raw)) THEN 3 ELSE 0 END + len(list_filter(regexp_split_to_array(lower(raw), '\\s+'), lambda w: strlen(w) >= 2 AND (contains(lower(text), w) OR contains(lower(path), w)))) AS points FROM nt, asked),
 bp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, path) AS place FROM hp WHERE points > 0 QUALIFY place <= 5), fp AS (SELECT path, row_number() OVER (ORDER BY path) AS place FROM nt QUALIFY place <= 3), el AS (SELECT query_id, path, points, place FROM bp UNION ALL SELECT query_id, path, 0, place FROM asked, fp WHERE query_id NOT IN (SELECT query_id FROM bp))"""


def _has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(raw), '{w}')" for w in words) + ")"


SQL = {
    "p05_maintain": "SELECT * FROM (VALUES ('h1', 'passed', CAST([] AS VARCHAR[]), 'ready', TRUE), ('h2', 'zero_hit', ['smoke_query_failed'], 'unhealthy', FALSE), ('h3', 'phrases', ['smoke_query_failed'], 'unhealthy', FALSE), ('h4', 'zero_hit_and_phrases', ['smoke_query_failed'], 'unhealthy', FALSE), ('h5', 'not_ready', ['no_embeddings', 'smoke_query_failed'], 'unhealthy', FALSE), ('h6', 'skipped', ['no_embeddings'], 'needs_index', FALSE), ('h7', 'skipped', CAST([] AS VARCHAR[]), 'ready', TRUE)) t(id, eval, codes, state, ok)",
    "m17_dry_run": f"WITH {_LOG}, lm AS ({_LM}), t AS (SELECT term FROM (SELECT unnest({_WEAK}) AS term FROM lg WHERE id > 100) WHERE term <> 'to' GROUP BY term HAVING count(*) >= 3 ORDER BY count(*) DESC, term LIMIT 2) SELECT events, events >= 3 AS eligible, (SELECT list(term ORDER BY term) FROM t) AS stopwords, CASE WHEN text_only_ratio > 0.25 THEN 0.87 WHEN text_only_ratio < 0.05 THEN 0.93 END AS penalty, text_only_ratio, confirmed_ratio FROM lm",
    "n04_diff": "SELECT id, array_to_string([a, b, c, d, e, f, g, ''], chr(10)) AS diff FROM (VALUES ('p1', '--- a/a.md', '+++ b/b.md', '@@ semantic proposal p1', 'relation: supports', 'confidence: 0.500', 'status: proposal', 'rationale: two lines'), ('p2', '--- a/a.md', '+++ b/<missing-target>', '@@ semantic proposal p2', 'relation: unknown', 'confidence: 0.123', 'status: rejected', 'rationale: x')) t(id, a, b, c, d, e, f, g)",
    "m01_matched": f"WITH {_Q} SELECT r.case_id, path, min(rank) AS rank FROM rk r JOIN qr ON qr.case_id = r.case_id AND list_contains(expected_paths, path) GROUP BY ALL",
    "m02_case_metrics": f"WITH {_Q}, {_cases('cs', 'rk')} SELECT case_id, rank, round(recall, 6) AS recall, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr, hit_1, hit_3, hit_k, results, files, round(duplicate_rate, 6) AS duplicate_rate FROM cs",
    "m03_summary": f"WITH {_Q}, {_cases('cs', 'rk')} {_TOTAL}",
    "m05_m08_compare": f"""WITH {_Q}, r2 AS (SELECT case_id, path, CASE WHEN path = 'o3' THEN rank + 1 ELSE rank END AS rank FROM rk WHERE case_id <> '10'), {_cases('b', 'rk', "qr.case_id <> '20'")}, {_cases('v', 'r2', "qr.case_id <> '10'")},
      d AS (SELECT coalesce(b.case_id, v.case_id) AS case_id, b.case_id AS bi, v.case_id AS vi, round(v.recall - b.recall, 6) + 0.0 AS d_recall, round(v.ndcg - b.ndcg, 6) + 0.0 AS d_ndcg, round(v.mrr - b.mrr, 6) + 0.0 AS d_mrr FROM b FULL JOIN v USING (case_id))
      SELECT case_id, d_recall, d_ndcg, d_mrr, CASE WHEN vi IS NULL THEN 'missing' WHEN bi IS NULL THEN 'new' WHEN d_recall < 0 OR d_ndcg < 0 OR d_mrr < 0 THEN 'worse' WHEN d_recall > 0 OR d_ndcg > 0 OR d_mrr > 0 THEN 'better' ELSE 'same' END AS state FROM d""",
    "m09_gate": f"WITH {_Q}, {_cases('cs', 'rk')}, t AS ({_TOTAL}) SELECT 'recall' AS metric, recall AS value, '>=' AS op, 0.5 AS threshold, recall >= 0.5 AS ok FROM t UNION ALL SELECT 'ndcg', ndcg, '>=', 0.99, ndcg >= 0.99 FROM t UNION ALL SELECT 'zero_hit', CAST(zero_hit AS DOUBLE), '<=', 5.0, zero_hit <= 5 FROM t UNION ALL SELECT 'mrr', mrr, '>=', 0.1, mrr >= 0.1 FROM t",
    "m07_percentiles": "WITH k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(CASE WHEN k = least(n * 50 // 100, n - 1) THEN value END) AS p50, max(CASE WHEN k = least(n * 95 // 100, n - 1) THEN value END) AS p95, max(CASE WHEN k = CAST(round((n - 1) * 50 / 100.0) AS BIGINT) THEN value END) AS r50, max(CASE WHEN k = CAST(round((n - 1) * 95 / 100.0) AS BIGINT) THEN value END) AS r95 FROM k GROUP BY event_type",
    "m04_phrases": "SELECT * FROM (VALUES ('k1', 'Hello World', 'expected'), ('k1', 'Hello World', 'any'), ('k1', 'gone', 'any'), ('k2', 'hello', 'any')) t(case_id, phrase, scope)",
    "m06_source_shares": "SELECT * FROM (VALUES ('k1', 2, 1), ('k2', 0, 1)) t(case_id, vector_only, confirmed)",
    "m10_feedback": f"WITH {PARSED}, p AS (SELECT arg_min(path, doc_id) FILTER (doc_id = 3) AS p3, max(path) FILTER (doc_id = 4) AS p4, max(path) FILTER (doc_id = 12) AS p12 FROM parsed), c AS (SELECT 'Find the Report' AS query, [p3, 'b.md', 'a.md'] AS expected_paths, [1, 2, 9] AS event_ids FROM p UNION ALL SELECT 'other', ['x.md'], [3] FROM p UNION ALL SELECT 'third', [p12], [8] FROM p) SELECT 'feedback-' || substr(sha1(query || chr(0) || array_to_string(expected_paths, chr(0))), 1, 12) AS case_id, * FROM c",
    "m11_merge": "SELECT * FROM (VALUES ('Find', ['a', 'b'], 'updated'), ('keep', ['k'], 'kept'), ('same', ['s', 't'], 'unchanged'), ('fresh', ['f'], 'added')) t(query, expected_paths, change)",
    "m14_weak_terms": f"WITH {_LOG} SELECT DISTINCT query, {_WEAK} AS weak_terms FROM lg",
    "m13_log_metrics": f"WITH {_LOG} {_LM}",
    "m15_proposal": f"WITH {_LOG}, lm AS ({_LM}), t AS (SELECT term AS change, CAST(count(*) AS DOUBLE) AS value FROM (SELECT unnest({_WEAK}) AS term FROM lg WHERE id > 100) WHERE term <> 'to' GROUP BY term HAVING count(*) >= 3 ORDER BY count(*) DESC, term LIMIT 2) SELECT * FROM t UNION ALL SELECT 'penalty', CASE WHEN text_only_ratio > 0.25 THEN 0.87 WHEN text_only_ratio < 0.05 THEN 0.93 END FROM lm",
    "p04_errors": "SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{c}')" for m, c in zip(MESSAGES, ["unknown_provider", "profile_mismatch", "no_embeddings", "dimension_mismatch", "provider_down", "vault_unreadable", "invalid_argument", "store_corrupt", "schema_missing", "store_open_failed", "internal", "vault_unreadable"])) + ") t(message, code)",
    "p02_health": "SELECT * FROM (VALUES (1, 'ready'), (2, 'needs_index'), (3, 'degraded'), (4, 'unhealthy'), (5, 'degraded')) t(id, state)",
    "p01_status": f"WITH {VAULT} SELECT count(DISTINCT path) AS files, count(*) AS chunks, count_if(doc_id % 10 = 3) AS embedded, count_if(doc_id % 10 <> 3) AS missing, FALSE AS complete FROM vault",
    "p06_manifest": f"WITH {_HASH} SELECT * FROM mf",
    "p06_sealed": f"WITH {_HASH} SELECT sha256(string_agg(digest, '' ORDER BY bucket)) AS digest, CAST(sum(files) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM mf",
    "p06_tampered": "SELECT 'changed' AS state",
    "p09_duplicates": "SELECT sha256(text) AS text_sha, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "a14_runs": "SELECT 3 AS runs, 'r2' AS latest",
    "l27_worker": "SELECT * FROM (VALUES ('d1', TRUE, 'skipped'), ('d2', FALSE, 'failed'), ('d3', TRUE, 'ok')) t(day, ok, status)",
    "n05_evidence": f"WITH {PARSED}, {_EV} SELECT * FROM el",
    "n06_n09_reasoning": f"""WITH {PARSED}, {_EV}, pp AS (SELECT query_id, list(path ORDER BY place) AS paths FROM el GROUP BY query_id), rr AS (SELECT query_id, paths, list_sort(list_filter([CASE WHEN {_has(gov.REASON_CUES)} THEN 'explicit_high_level_intent' END, CASE WHEN confidence < 0.55 THEN 'low_confidence' END, CASE WHEN {_has(gov.CONFLICT_CUES)} THEN 'conflict' END,
      CASE WHEN len(paths) >= 2 AND {_has(gov.CROSS_CUES)} THEN 'cross_concept_synthesis' END, CASE WHEN len(list_filter(paths, lambda p: starts_with(p, 'raw/') OR starts_with(p, 'source/'))) > 0 AND {_has(gov.RAW_CUES)} THEN 'undigested_raw' END], lambda x: x IS NOT NULL)) AS reasons FROM asked JOIN pp USING (query_id))
      SELECT query_id, reasons, CASE WHEN len(reasons) > 0 THEN paths ELSE [] END AS evidence, CASE WHEN len(reasons) > 0 AND len(paths) >= 2 THEN 1 ELSE 0 END AS n_relations, CASE WHEN len(reasons) > 0 THEN round(least(0.45 + 0.08 * len(paths) + 0.05 * CASE WHEN len(paths) >= 2 THEN 1 ELSE 0 END, 0.86), 6) END AS answer_confidence FROM rr""",
}
