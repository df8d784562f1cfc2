"""Query analysis, filters, candidate branches, scores, validity and ranking over one chunk for each note."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, temporal
from ..operators import filters, query_analysis, ranking, retrieval
from ..plans import search as plans
from ..sources.shared import settled, stored
from .base import CHUNKS, EVIDENCE, NOW, TIER, event_time_sql, indexed, note_chunks, rows, table, values_sql

ASKED = [
    ("q01", "the and with"), ("q02", "path:wiki/reports"), ("q03", "#topic3"), ("q04", "when was the timeline of Title 12 started?"), ("q05", "config error: system snapshot port"), ("q06", "Title 12"),
    ("q07", "rag eval embedding retrieval"), ("q08", "wiki/en/3.md"), ("q09", "tag:en"), ("q10", "definition of the"), ("q11", "  "), ("q12", "latest audit status of links and open tasks"), ("q13", "links"), ("q14", "什么时候 开始"), ("q15", "erer (the) don't 'quote'"), ("q16", "thisonwhbleon"), ("q17", "Thanonontioniner"), ("q18", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"),
]
SHORT_LIST = ["the", "of"]


def asked(spark):
    return rows(spark, "query_id string, raw string", ASKED)


def analyzed(spark, sf):
    a = query_analysis.analyze(asked(spark), expand=True)
    return a.select("query_id", "normalized", "route", "intent", "terms", "expanded", "keyword_mode", "scoring_text", F.transform("keyword_terms", lambda t: F.concat(t["term"], F.when(t["prefix"], "*").otherwise(""))).alias("keyword_terms"), "routes_attempted")


def route_terms(spark, sf):
    return query_analysis.analyze(asked(spark)).select("query_id", "patterns", "route_terms")


def stopped(spark, sf):
    return query_analysis.analyze(asked(spark), stopwords=SHORT_LIST).select("query_id", "terms")


def cues(spark, sf):
    return asked(spark).select("query_id", temporal.recent_cue(F.col("raw")).alias("recent"), temporal.oldest_cue(F.col("raw")).alias("oldest"))


FILTERS = {
    "f1": "tag == 'topic3' && has_link == true", "f2": "path contains \"WIKI/\" && status != 'stale'", "f3": "tag != 'en' && confidence == 'high'", "f4": "has_task_list == true && has_incomplete_tasks != true",
    "f5": "source_type contains 'AUDIT' && title contains 'title 1'", "f6": "valid_from contains '2024-0' && superseded_by == ''", "f7": "heading == '' && updated != ''",
}
FILTERS_SQL = {
    "f1": "list_contains(tags, 'topic3') AND has_link", "f2": "contains(lower(path), 'wiki/') AND coalesce(status, '') <> 'stale'", "f3": "NOT list_contains(tags, 'en') AND coalesce(confidence, '') = 'high'",
    "f4": "has_task_list AND NOT has_incomplete_tasks", "f5": "contains(lower(coalesce(source_type, '')), 'audit') AND contains(lower(coalesce(title, '')), 'title 1')",
    "f6": "contains(coalesce(valid_from, ''), '2024-0') AND coalesce(superseded_by, '') = ''", "f7": "coalesce(updated, '') <> ''",
}


def filtered(spark, sf):
    chunks, out = note_chunks(spark, sf), None
    for name, expression in FILTERS.items():
        own = filters.apply_filter(chunks, expression).select(F.lit(name).alias("filter"), "chunk_id")
        out = own if out is None else out.unionByName(own)
    return out


def scoped(spark, sf):
    return filters.apply_filter(note_chunks(spark, sf), filters.with_scope("has_link == true", ["topic3", "en"])).select("chunk_id")


def index_of(spark, sf):
    return retrieval.postings(note_chunks(spark, sf))


def postings(spark, sf):
    return index_of(spark, sf).groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def keyword(spark, sf):
    index, a = stored(index_of(spark, sf)), query_analysis.analyze(asked(spark))  # read three times
    return retrieval.keyword_candidates(index, retrieval.query_terms(a), retrieval.corpus_size(index)).select("query_id", "chunk_id", "keyword_rank", F.round("keyword_score", 6).alias("keyword_score"))


def query_vectors(spark, sf):
    return table(spark, sf, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("query_id"), "embedding")


def vector(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    return retrieval.vector_candidates(v, query_vectors(spark, sf), 20).select("query_id", "chunk_id", "vector_rank", F.round("vector_score", 6).alias("vector_score"))


def filtered_vector(spark, sf):
    v = table(spark, sf, "embeddings").filter("label in (1, 3, 5)").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding")
    return retrieval.vector_candidates(v, query_vectors(spark, sf), 10).select("query_id", "chunk_id", "vector_rank", F.round("distance", 6).alias("distance"))


def exact_backend(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    chunks = d.select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.array("lang", "source").alias("tags"))
    v = d.select(F.col("doc_id").cast("string").alias("chunk_id"), "embedding")
    q = rows(spark, "query_id string, raw string", [("53", "the en src3"), ("3", "of and to")])
    qv = table(spark, sf, "embeddings").filter("vec_id in (3, 53)").select(F.col("vec_id").cast("string").alias("query_id"), "embedding")
    found = retrieval.exact_scan(chunks, v, query_analysis.analyze(q), qv)
    return found.select("query_id", "chunk_id", F.round("keyword_score", 6).alias("keyword_score"), F.round(F.col("score") + 1e-9, 6).alias("score"))


def routed(spark, sf):
    return retrieval.route_candidates(note_chunks(spark, sf), query_analysis.analyze(asked(spark))).select("query_id", "chunk_id", F.round("route_score", 6).alias("route_score"), "route_reasons")


def tiered(spark, sf):
    return retrieval.tier_candidates(note_chunks(spark, sf), query_analysis.analyze(asked(spark))).select("query_id", "chunk_id", F.round("tier_score", 6).alias("tier_score"), "tier_reasons")


def branches(spark, sf):
    index, a = indexed(spark, sf), settled(query_analysis.analyze(asked(spark)))
    kw = retrieval.keyword_candidates(index.postings, retrieval.query_terms(a), index.size, words=index.words)
    none = spark.createDataFrame([], "query_id string, chunk_id string, vector_rank int, vector_score double")
    return settled(retrieval.pool(kw, none, retrieval.route_candidates(index.chunks, a), retrieval.tier_candidates(index.chunks, a)))


def pooled(spark, sf):
    return branches(spark, sf).select("query_id", "chunk_id", F.round("pool_score", 9).alias("pool_score"), "pool_rank")


def outgoing(spark, sf):
    return retrieval.outgoing_links(note_chunks(spark, sf))


def backlinked(spark, sf):
    seeds = note_chunks(spark, sf).filter(F.col("path").startswith("brain/")).select("chunk_id")
    return retrieval.backlinks(note_chunks(spark, sf), seeds)


def evidence_links(spark, sf):
    return retrieval.link_evidence(note_chunks(spark, sf))


def expansion(spark, sf):
    found = branches(spark, sf).select("query_id", "chunk_id", F.col("pool_score").alias("score"))
    return retrieval.expand_links(found, indexed(spark, sf).chunks, 5)


CONTEXT = [("c%d" % k, "f%d.md" % (k % 3), 1 + 10 * (k // 3), 8 + 10 * (k // 3)) for k in range(24)]
SEEDS = [("c4",), ("c9",), ("c23",)]


def context(spark, sf):
    chunks = rows(spark, "chunk_id string, path string, line_start int, line_end int", CONTEXT)
    return retrieval.context(chunks, rows(spark, "chunk_id string", SEEDS), 2)


IDS = ["chk_00000012", "chk_00000003", "chk_99999999", "chk_00000012", "chk_00000007"]


def point_get(spark, sf):
    return retrieval.get_by_ids(note_chunks(spark, sf), IDS).select("position", "chunk_id", F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 50).alias("head"))


NUMBERS = [(1, -3.5, 0.7, 1, 3), (2, 0.0, -1.0, None, 1), (3, 12.25, 2.0, 80, None), (4, 1e-6, 0.0, None, None)]


def score_parts(spark, sf):
    n = rows(spark, "id int, bm25 double, distance double, keyword_rank int, vector_rank int", NUMBERS)
    return n.select("id", F.round(scoring.bm25_score(F.col("bm25")), 9).alias("keyword_score"), F.round(scoring.distance_score(F.col("distance")), 9).alias("vector_score"), F.round(scoring.rrf(F.col("keyword_rank"), F.col("vector_rank")), 9).alias("fusion"), scoring.graph_boost(F.col("distance"), F.col("keyword_rank")).alias("graph_boost"))


def boosts(spark, sf):
    c = note_chunks(spark, sf)
    q = F.lit("Wiki topic3 EN report")
    return c.select(
        "chunk_id", scoring.path_boost(F.col("path"), q).alias("path_boost"), scoring.tag_boost(F.col("tags"), q).alias("tag_boost"), F.round(scoring.recency_boost(F.col("mtime"), F.lit(NOW).cast("timestamp")), 9).alias("recency"),
        (F.round(scoring.metadata_boost(*[F.col(x) for x in ("has_code", "has_link", "has_task_list", "has_incomplete_tasks", "confidence", "status", "source_type")]), 6) + 0.0).alias("metadata"),
        F.round(scoring.keyword_overlap(q, F.col("text"), F.col("tags")), 6).alias("overlap"),
    )


def validity(spark, sf):
    c, out = note_chunks(spark, sf), None
    for name, at, past in (("now", NOW, False), ("mid", "2024-06-15", True)):
        day = F.lit(at).cast("date")
        reason = temporal.stale_reason(F.col("status"), F.col("valid_from"), F.col("valid_until"), F.col("superseded_by"), day, F.lit(past))
        own = c.select(F.lit(name).alias("day"), "chunk_id", reason.alias("stale_reason"), temporal.validity_state(reason, F.lit(past)).alias("state"), temporal.age_days(F.col("updated"), F.col("mtime"), day).alias("age_days"))
        out = own if out is None else out.unionByName(own)
    return out


def temporal_boosts(spark, sf):
    c = note_chunks(spark, sf)
    day = F.lit("2024-06-15").cast("date")
    reason = temporal.stale_reason(F.col("status"), F.col("valid_from"), F.col("valid_until"), F.col("superseded_by"), day, F.lit(False))
    c = c.withColumns({"state": temporal.validity_state(reason, F.lit(False)), "age": temporal.age_days(F.col("updated"), F.col("mtime"), day)})
    fresh = [temporal.freshness_boost(m, F.lit(q), F.col("age"), F.col("state")).alias(f"fresh_{m}") for m, q in (("off", ""), ("balanced", "latest news"), ("recent", ""), ("oldest", "the earliest"))]
    return c.select("chunk_id", *fresh, temporal.confidence_boost(F.col("confidence")).alias("confidence_boost"), temporal.status_boost(F.col("status"), F.col("state")).alias("status_boost"), temporal.evidence_boost(F.size("tags")).alias("evidence_boost"))


def scored(spark, sf):
    chunks, a = indexed(spark, sf).chunks, query_analysis.analyze(asked(spark))
    r = retrieval.materialise(branches(spark, sf), chunks).join(a.select("query_id", "raw", "scoring_text", "intent"), "query_id")
    return ranking.final_score(r, F.lit(NOW).cast("timestamp"))


def final_scores(spark, sf):
    return scored(spark, sf).select("query_id", "chunk_id", F.round(F.col("score") + 1e-9, 6).alias("score"), F.round("tier_boost", 6).alias("tier_boost"), F.round("intent_boost", 6).alias("intent_boost"), F.round("event_boost", 6).alias("event_boost"), "sources")


def quality(spark, sf):
    return ranking.temporal_quality(scored(spark, sf), F.col("raw"), F.lit(NOW).cast("date")).select("query_id", "chunk_id", F.round(F.col("score") + 1e-9, 5).alias("score"), "validity_state", F.array_contains("sources", "temporal").alias("temporal"))


def searched(spark, sf):
    found = plans.search(indexed(spark, sf), asked(spark), NOW, plans.SearchOptions(limit=5, link_depth=1, expand=True))
    return found.select("query_id", "rank", "chunk_id", "path", F.round(F.col("score") + 1e-9, 5).alias("score"), "validity_state")


def flagship(spark, sf):
    found = plans.search(indexed(spark, sf), asked(spark), NOW, plans.SearchOptions(limit=5, diverse=False))
    return found.select("query_id", "rank", "chunk_id", "path", F.round(F.col("score") + 1e-9, 5).alias("score"), "validity_state")


def traced(spark, sf):
    return plans.trace(indexed(spark, sf), asked(spark))


ORDERED = [("q", "b.md", 1, "c1", 0.5), ("q", "a.md", 9, "c2", 0.5), ("q", "a.md", 1, "c4", 0.5), ("q", "a.md", 1, "c3", 0.5), ("q", "z.md", 1, "c5", float("nan")), ("q", "y.md", 1, "c6", float("inf")), ("q", "x.md", 1, "c7", 0.9), ("r", "x.md", 1, "c7", -1.0)]


def ordered(spark, sf):
    return ranking.top(rows(spark, "query_id string, path string, line_start int, chunk_id string, score double", ORDERED), 6).select("query_id", "rank", "chunk_id")


MMR = [("q", "same.md", 1, "c1", 1.0), ("q", "same.md", 5, "c2", 0.99), ("q", "other.md", 1, "c3", 0.94), ("q", "far.md", 1, "c4", 0.30), ("q", "same.md", 9, "c5", 0.97), ("p", "x.md", 1, "d1", 0.4)]


def mmr(spark, sf):
    return ranking.diversify(rows(spark, "query_id string, path string, line_start int, chunk_id string, score double", MMR), 3).select("query_id", "chunk_id", "diverse_rank")


def file_diverse(spark, sf):
    r = rows(spark, "query_id string, path string, line_start int, chunk_id string, score double", MMR)
    return ranking.file_diverse(ranking.top(r, 10)).select("query_id", "chunk_id", "position")


def rerank(spark, sf):
    r = rows(spark, "query_id string, path string, line_start int, chunk_id string, score double", MMR).withColumn("sources", F.array(F.lit("keyword")))
    model = F.length("chunk_id") * F.lit(0.7) - F.col("line_start") / 10
    return ranking.top(ranking.reranked(r, model), 10).select("query_id", "chunk_id", "rank", F.round(F.col("score") + 1e-9, 6).alias("score"))


def penalty(spark, sf):
    s = scored(spark, sf)
    return ranking.keyword_only_penalty(s, 0.8).select("query_id", "chunk_id", F.round("optimizer_adjustment", 6).alias("adjustment"))


PROPOSED = [("same.md", "other.md", 0.9, True, "alpha beta gamma"), ("far.md", "same.md", 1.0, False, "alpha beta"), ("far.md", "other.md", 1.0, True, "alpha beta"), ("same.md", "other.md", 1.0, False, "alpha only")]


def side_boost(spark, sf):
    r = ranking.top(rows(spark, "query_id string, path string, line_start int, chunk_id string, score double", MMR), 10).withColumn("query", F.lit("Alpha beta 检索"))
    p = rows(spark, "source_path string, target_path string, confidence double, accepted boolean, summary string", PROPOSED)
    return ranking.proposal_boost(r, p).select("query_id", "chunk_id", F.round("side_boost", 6).alias("side_boost"), "boosted_rank")


def snippets(spark, sf):
    c = note_chunks(spark, sf)
    return c.select("chunk_id", ranking.snippet(F.col("text"), F.array(F.lit("links"), F.lit("see"), F.lit("zzz"))).alias("snippet"))


def json_lines(spark, sf):
    r = ranking.top(rows(spark, "query_id string, path string, line_start int, chunk_id string, score double", MMR), 2)
    return ranking.as_json_lines(r, ["chunk_id", "path"])


def rerank_texts(spark, sf):
    c = note_chunks(spark, sf)
    return c.select("chunk_id", F.sha2(ranking.rerank_text(F.col("title"), F.col("heading"), F.col("path"), F.col("text")).cast("binary"), 256).alias("sha"))


def by_score(spark, sf):
    return filters.above_score(rows(spark, "query_id string, path string, line_start int, chunk_id string, score double", ORDERED), 0.5).select("query_id", "chunk_id")


QUERIES = {
    "d01_d08_analysis": analyzed, "d05_stopwords": stopped, "d07_route_terms": route_terms, "d09_cues": cues, "e01_e07_filters": filtered, "e08_min_score": by_score, "e10_scope": scoped, "f01_postings": postings, "f01_keyword": keyword,
    "f02_vector": vector, "f03_filtered_vector": filtered_vector, "f04_exact": exact_backend, "f05_f06_routes": routed, "f07_f09_tiers": tiered, "f10_pool": pooled, "f12_link_expansion": expansion, "f13_outgoing": outgoing, "f14_backlinks": backlinked,
    "f15_context": context, "f16_link_evidence": evidence_links, "f17_get": point_get, "g01_g07_scores": score_parts, "g03_g09_boosts": boosts, "g08_snippet": snippets, "g11_g13_final": final_scores, "h01_validity": validity, "h02_h05_boosts": temporal_boosts,
    "h06_quality": quality, "i01_order": ordered, "i02_mmr": mmr, "i04_rerank": rerank, "i05_rerank_text": rerank_texts, "i06_penalty": penalty, "i07_side_boost": side_boost, "i08_file_diverse": file_diverse, "i10_json_lines": json_lines, "p07_trace": traced, "search": flagship, "search_full": searched,
}

_ASKED = values_sql("asked", "query_id, raw", ASKED)


def _any(expr: str, cues: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{c}')" for c in cues) + ")"


def _analysis(expand: bool = False, stop: list[str] | None = None) -> str:
    table_ = "CASE t " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in query_analysis.EXPANSIONS.items()) + " ELSE CAST([] AS VARCHAR[]) END"
    exp = f"CASE WHEN route IN ('path', 'tag') THEN CAST([] AS VARCHAR[]) ELSE list_filter(flatten(list_transform(terms, lambda t: {table_})), lambda x: NOT list_contains(terms, x)) END" if expand else "CAST([] AS VARCHAR[])"
    return f"""{_ASKED}, a1 AS (SELECT query_id, raw, lower(trim(raw)) AS folded, trim(regexp_replace(regexp_replace(raw, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS normalized FROM asked),
    a2 AS (SELECT *, list_filter(string_split(normalized, ' '), lambda t: t <> '') AS terms FROM a1),
    a3 AS (SELECT *, CASE WHEN contains(folded, '/') OR contains(folded, '.md') OR starts_with(folded, 'path:') THEN 'path' WHEN contains(folded, '#') OR starts_with(folded, 'tag:') THEN 'tag' WHEN len(terms) <= 1 OR length(raw) <= 12 THEN 'short' ELSE 'semantic' END AS route,
      CASE WHEN {_any("folded || ' ' || normalized", query_analysis.HISTORICAL_CUES)} THEN 'historical' WHEN {_any("folded || ' ' || normalized", query_analysis.CONFIG_CUES)} THEN 'config'
      WHEN {_any("folded || ' ' || normalized", query_analysis.CONCEPT_CUES)} OR (len(terms) <= 2 AND length(folded) <= 16) THEN 'concept' ELSE 'general' END AS intent FROM a2),
    a4 AS (SELECT *, {exp} AS exp0 FROM a3), a5 AS (SELECT *, list_filter(exp0, lambda x, i: list_position(exp0, x) = i) AS expanded FROM a4),
    a6 AS (SELECT *, list_sort(list_distinct(list_concat(list_filter([folded, normalized], lambda p: trim(p) <> ''), expanded))) AS patterns, list_sort(list_distinct(list_concat(terms, expanded))) AS all_terms FROM a5),
    a7 AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(list_concat(patterns, all_terms), lambda t: lower(trim(regexp_replace(regexp_replace(regexp_replace(trim(t), '^(path:)+', ''), '^(tag:)+', ''), '^#+', ''), '"''()'))),
      lambda t: length(t) >= 2 AND NOT regexp_matches(trim(t), '\\s') AND NOT list_contains({query_analysis.ROUTE_STOP_TERMS}, t)))) AS route_terms,
      CASE WHEN len(all_terms) = 0 THEN normalized ELSE array_to_string(all_terms, ' ') END AS scoring_text,
      CASE WHEN len(all_terms) = 0 THEN 'none' WHEN len(expanded) = 0 THEN 'and' ELSE 'or' END AS keyword_mode,
      list_transform(all_terms, lambda t: {{'term': lower(t), 'prefix': CASE WHEN len(expanded) = 0 THEN route = 'short' AND len(all_terms) = 1 ELSE route = 'short' AND length(t) <= 12 END}}) AS keyword_terms,
      list_sort(list_filter(['keyword', CASE WHEN route IN ('path', 'short') THEN 'path' END, CASE WHEN route = 'tag' THEN 'tag' END, 'vector'], lambda x: x IS NOT NULL)) AS routes_attempted FROM a6)"""


_POSTINGS = """, tok AS (SELECT chunk_id, unnest(list_filter(regexp_split_to_array(lower(concat_ws(' ', title, heading, text, array_to_string(tags, ' '))), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS token FROM chunks),
 postings AS (SELECT chunk_id, token, count(*) AS tf, sum(count(*)) OVER (PARTITION BY chunk_id) AS dl FROM tok GROUP BY chunk_id, token), size AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT chunk_id, dl FROM postings))"""
_KEYWORD = """, qt AS (SELECT query_id, keyword_mode, len(keyword_terms) AS n_terms, unnest(keyword_terms) AS t FROM a7 WHERE keyword_mode <> 'none'),
 hit AS (SELECT query_id, keyword_mode, n_terms, t.term AS term, chunk_id, sum(tf) AS tf, max(dl) AS dl FROM qt JOIN postings p ON CASE WHEN t.prefix THEN starts_with(p.token, t.term) ELSE p.token = t.term END GROUP BY ALL),
 df AS (SELECT query_id, term, count(*) AS df FROM hit GROUP BY query_id, term),
 bm AS (SELECT query_id, keyword_mode, n_terms, chunk_id, count(*) AS found, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM hit JOIN df USING (query_id, term), size GROUP BY ALL),
 kw AS (SELECT query_id, chunk_id, bm25, 1 / (1 + abs(bm25)) AS keyword_score, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, chunk_id) AS keyword_rank FROM bm WHERE keyword_mode = 'or' OR found = n_terms QUALIFY keyword_rank <= 80)"""
_H = "(contains(lower(path), t) OR contains(lower(coalesce(title, '')), t) OR contains(lower(coalesce(heading, '')), t) OR contains(lower(CAST(to_json(tags) AS VARCHAR)), t))"
_ROUTE = f""", rt AS (SELECT query_id, chunk_id, t, lower(path) = t AS same, contains(lower(path), t) AS p, contains(lower(coalesce(title, '')), t) AS ti, contains(lower(CAST(to_json(tags) AS VARCHAR)), t) AS tg
   FROM (SELECT query_id, unnest(route_terms) AS t FROM a7), chunks WHERE {_H}),
 route0 AS (SELECT query_id, chunk_id, count(*) * sum(CASE WHEN same THEN 0.18 WHEN p THEN 0.12 ELSE 0 END + CASE WHEN ti THEN 0.08 ELSE 0 END + CASE WHEN tg THEN 0.10 ELSE 0 END) AS route_score,
   list_filter([CASE WHEN bool_or(p) THEN 'path' END, CASE WHEN bool_or(ti) THEN 'title' END, CASE WHEN bool_or(tg) THEN 'tag' END], lambda x: x IS NOT NULL) AS route_reasons FROM rt GROUP BY query_id, chunk_id),
 route AS (SELECT * FROM route0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(route_score, 9) DESC, chunk_id) <= 50)"""
_TIER = f""", tr AS (SELECT chunk_id, lower(concat_ws(' ', path, coalesce(title, ''), coalesce(heading, ''), CAST(to_json(tags) AS VARCHAR), text, coalesce(source_type, ''))) AS hay, {TIER.format(p='path', s='source_type')} AS tier, {event_time_sql()} AS event_time, lower(path) AS p, lower(coalesce(source_type, '')) AS s FROM chunks),
 tm AS (SELECT *, list_filter([CASE WHEN regexp_matches(p, '(^|/)raw/transcripts/') OR regexp_matches(s, 'transcript|dialogue') THEN 'transcript' END, CASE WHEN regexp_matches(p, '^wiki/reports/|^reports/|/reports/') OR regexp_matches(s, 'report|audit') THEN 'report' END,
   CASE WHEN regexp_matches(p, '^raw/system-snapshots/|/system-snapshots/') OR regexp_matches(s, 'snapshot|system') THEN 'system_snapshot' END, CASE WHEN starts_with(p, 'wiki/') THEN 'wiki' END, CASE WHEN starts_with(p, 'brain/') THEN 'brain' END, CASE WHEN starts_with(p, 'raw/') THEN 'raw' END], lambda x: x IS NOT NULL) AS member FROM tr),
 tq AS (SELECT query_id, intent, route_terms, CASE intent WHEN 'historical' THEN ['transcript', 'report', 'system_snapshot', 'raw', 'brain'] WHEN 'concept' THEN ['wiki', 'brain'] WHEN 'config' THEN ['report', 'system_snapshot', 'raw', 'brain'] END AS wanted FROM a7),
 th AS (SELECT query_id, chunk_id, intent, tier, event_time, len(list_filter(route_terms, lambda t: contains(hay, t))) AS matched FROM tm, tq WHERE wanted IS NOT NULL AND len(list_intersect(member, wanted)) > 0),
 tier0 AS (SELECT query_id, chunk_id, CASE intent WHEN 'historical' THEN CASE WHEN tier IN ('transcript', 'report', 'system_snapshot') THEN 0.34 WHEN tier IN ('raw', 'brain') THEN 0.22 ELSE 0 END WHEN 'concept' THEN CASE WHEN tier IN ('wiki', 'brain') THEN 0.20 ELSE 0 END
   ELSE CASE WHEN tier IN ('report', 'system_snapshot', 'raw', 'brain') THEN 0.24 ELSE 0 END END + CASE WHEN event_time IS NOT NULL THEN 0.08 ELSE 0 END + least(matched, 4) * 0.025 AS tier_score,
   list_filter(['intent_tier', 'source_tier:' || tier, CASE WHEN event_time IS NOT NULL THEN 'event_time' END], lambda x: x IS NOT NULL) AS tier_reasons FROM th WHERE matched > 0),
 tier AS (SELECT * FROM tier0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(tier_score, 9) DESC, chunk_id) <= 60)"""
_POOL = """, pool0 AS (SELECT query_id, chunk_id, keyword_rank, keyword_score, route_score, route_reasons, tier_score, tier_reasons, coalesce(1.0 / (60 + keyword_rank), 0) + CASE WHEN route_score IS NULL THEN 0 ELSE least(route_score / 61.0, 0.05) END + CASE WHEN tier_score IS NULL THEN 0 ELSE least(tier_score / 61.0, 0.06) END AS pool_score
   FROM kw FULL JOIN route USING (query_id, chunk_id) FULL JOIN tier USING (query_id, chunk_id)),
 pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(pool_score, 12) DESC, chunk_id) AS pool_rank FROM pool0 QUALIFY pool_rank <= 200)"""
BRANCHES = f"{CHUNKS}, {_analysis()}{_POSTINGS}{_KEYWORD}{_ROUTE}{_TIER}{_POOL}"
_LINKS = """, lk AS (SELECT chunk_id, lower(trim(regexp_extract(regexp_replace(trim(regexp_extract(link, '^([^|#]*)', 1)), '\\.md$', ''), '([^/]*)$', 1))) AS key FROM (SELECT chunk_id, unnest(links) AS link FROM chunks)),
 tk AS (SELECT chunk_id, lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.md$', '')) AS key FROM chunks UNION SELECT chunk_id, lower(trim(title)) FROM chunks WHERE trim(title) <> ''),
 og AS (SELECT DISTINCT l.chunk_id AS source_id, t.chunk_id AS target_id FROM lk l JOIN tk t USING (key) WHERE l.chunk_id <> t.chunk_id AND key <> '')"""


def _pick(expr: str, table_: dict) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table_.items()) + " ELSE 0 END"


def _by_intent(value: str, table_: dict) -> str:
    return "CASE intent " + " ".join(f"WHEN '{k}' THEN {_pick(value, v)}" for k, v in table_.items()) + " ELSE 0 END"


_METADATA = f"""least(greatest(CASE WHEN has_code THEN 0.02 ELSE 0 END + CASE WHEN has_task_list THEN 0.02 ELSE 0 END - CASE WHEN has_incomplete_tasks THEN 0.02 ELSE 0 END + CASE WHEN has_link THEN 0.01 ELSE 0 END
 + {_pick('lower(trim(confidence))', scoring.METADATA_CONFIDENCE)} + {_pick('lower(trim(status))', scoring.METADATA_STATUS)} + {_pick('lower(trim(source_type))', scoring.METADATA_SOURCE)}, -0.08), 0.08)"""
_RECENCY = f"0.03 / (1 + greatest(epoch(TIMESTAMP '{NOW}') - epoch(mtime), 0) / 86400.0 / 30.0)"


def _words(q: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({q}), '\\s+'), lambda w: w <> '')"


_SCORED = f""", sc AS (SELECT p.*, c.path, c.title, c.status, c.confidence, c.valid_from, c.valid_until, c.supersedes, c.superseded_by, c.updated, c.mtime, c.source_type, c.line_start, a.raw, a.intent, a.scoring_text, {TIER.format(p='path', s='source_type')} AS source_tier, {event_time_sql()} AS event_time,
   CASE WHEN len(list_filter({_words('scoring_text')}, lambda w: contains(lower(path), w))) > 0 THEN 0.08 ELSE 0 END AS path_boost, CASE WHEN len(list_filter(tags, lambda t: contains(lower(scoring_text), lower(t)))) > 0 THEN 0.05 ELSE 0 END AS tag_boost, {_RECENCY} AS recency, {_METADATA} AS metadata
   FROM pool p JOIN chunks c USING (chunk_id) JOIN a7 a USING (query_id)),
 sc1 AS (SELECT *, {_by_intent('source_tier', scoring.TIER_BOOSTS)} AS tier_boost, {_by_intent(EVIDENCE.format(t='source_tier'), scoring.EVIDENCE_BOOSTS)} AS intent_boost, CASE WHEN event_time IS NOT NULL THEN {_pick('intent', scoring.EVENT_BOOSTS)} ELSE 0 END AS event_boost FROM sc),
 sc2 AS (SELECT *, 0.35 * coalesce(keyword_score, 0) + coalesce(1.0 / (60 + keyword_rank), 0) + path_boost + tag_boost + coalesce(route_score, 0) + coalesce(tier_score, 0) + recency + metadata + tier_boost + intent_boost + event_boost AS score,
   list_concat(CASE WHEN keyword_rank IS NOT NULL THEN ['keyword'] ELSE [] END, list_concat(coalesce(route_reasons, []), coalesce(tier_reasons, []))) AS sources FROM sc1)"""


def _reason(at: str, past: bool) -> str:
    day = lambda c: f"TRY_CAST(substr(trim({c}), 1, 10) AS DATE)"
    dead = "" if past else "WHEN lower(trim(coalesce(status, ''))) IN ('stale', 'superseded', 'archived', 'deprecated') THEN 'status:' || lower(trim(status))"
    after = "" if past else "WHEN trim(coalesce(superseded_by, '')) <> '' THEN 'superseded_by'"
    return f"CASE WHEN {day('valid_from')} > DATE '{at}' THEN 'not_yet_valid' {dead} WHEN {day('valid_until')} < DATE '{at}' THEN 'valid_until' {after} END"


def _age(at: str) -> str:
    return f"greatest(date_diff('day', coalesce(TRY_CAST(substr(trim(updated), 1, 10) AS DATE), CAST(mtime AS DATE)), DATE '{at}'), 0)"


def _fresh(mode: str, cue: str, state: str = "state", age: str = "age") -> str:
    body = {"off": "0", "balanced": f"CASE WHEN {cue} AND {age} <= 30 THEN 0.03 WHEN {age} <= 30 THEN 0.01 ELSE 0 END", "recent": f"CASE WHEN {age} <= 30 THEN 0.05 WHEN {age} <= 180 THEN 0.02 ELSE 0 END", "oldest": f"CASE WHEN {cue} OR {age} >= 180 THEN 0.03 ELSE 0 END"}[mode]
    return f"CASE WHEN {state} = 'stale' THEN -0.02 WHEN {age} IS NULL THEN 0 ELSE {body} END"


_CONF, _STAT = _pick("lower(trim(confidence))", temporal.CONFIDENCE), _pick("lower(trim(status))", temporal.STATUS)
_META = "concat_ws('', confidence, status, source_type, valid_from, valid_until, supersedes, superseded_by, updated)"
_RECENT, _OLD = _any("lower(raw)", temporal.RECENT_CUES), _any("lower(raw)", temporal.OLDEST_CUES)
_QUALITY = f""", tv AS (SELECT *, {_reason(NOW, False)} AS stale_reason, {_age(NOW)} AS age, trim({_META}) <> '' OR {_RECENT} OR {_OLD} AS applies FROM sc2), tw AS (SELECT *, CASE WHEN stale_reason IS NOT NULL THEN 'stale' ELSE 'current' END AS state FROM tv),
 tx AS (SELECT * EXCLUDE (score), score + CASE WHEN applies THEN {_fresh('balanced', _RECENT)} + {_CONF} + CASE WHEN state = 'stale' THEN -0.04 ELSE {_STAT} END + 0.005 * least(len(sources), 4) ELSE 0 END AS score FROM tw WHERE state <> 'stale')"""
_R5 = "query_id, path, line_start, chunk_id, score"

SQL = {
    "d01_d08_analysis": f"WITH {_analysis(True)} SELECT query_id, normalized, route, intent, terms, expanded, keyword_mode, scoring_text, list_transform(keyword_terms, lambda t: t.term || CASE WHEN t.prefix THEN '*' ELSE '' END) AS keyword_terms, routes_attempted FROM a7",
    "d05_stopwords": f"WITH {_analysis()} SELECT query_id, CASE WHEN len(list_filter(terms, lambda t: lower(t) NOT IN ('the', 'of'))) = 0 THEN terms ELSE list_filter(terms, lambda t: lower(t) NOT IN ('the', 'of')) END AS terms FROM a7",
    "d07_route_terms": f"WITH {_analysis()} SELECT query_id, patterns, route_terms FROM a7",
    "d09_cues": f"WITH {_ASKED} SELECT query_id, {_RECENT} AS recent, {_OLD} AS oldest FROM asked",
    "e01_e07_filters": f"WITH {CHUNKS} " + " UNION ALL ".join(f"SELECT '{k}' AS filter, chunk_id FROM chunks WHERE {p}" for k, p in FILTERS_SQL.items()),
    "e10_scope": f"WITH {CHUNKS} SELECT chunk_id FROM chunks WHERE has_link AND list_contains(tags, 'topic3') AND list_contains(tags, 'en')",
    "f01_postings": f"WITH {CHUNKS}{_POSTINGS} SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM postings GROUP BY token",
    "f01_keyword": f"WITH {CHUNKS}, {_analysis()}{_POSTINGS}{_KEYWORD} SELECT query_id, chunk_id, keyword_rank, round(keyword_score, 6) AS keyword_score FROM kw",
    "f02_vector": "WITH p AS (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, CAST(v.vec_id AS VARCHAR) AS chunk_id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS d FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), chunk_id) AS vector_rank FROM p) SELECT query_id, chunk_id, vector_rank, round(1 / (1 + d), 6) AS vector_score FROM r WHERE vector_rank <= 20",
    "f03_filtered_vector": "WITH p AS (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, CAST(v.vec_id AS VARCHAR) AS chunk_id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS d FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND v.label IN (1, 3, 5)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), chunk_id) AS vector_rank FROM p) SELECT query_id, chunk_id, vector_rank, round(d, 6) AS distance FROM r WHERE vector_rank <= 10",
    "f04_exact": f"""WITH {values_sql('q', 'query_id, words', [('53', ['en', 'src3', 'the']), ('3', ['and', 'of', 'to'])])}, c AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, text, [lang, source] AS tags, embedding FROM documents JOIN embeddings ON doc_id = vec_id),
      s AS (SELECT query_id, chunk_id, least(list_sum(list_transform(words, lambda w: CASE WHEN contains(lower(text), w) THEN 0.1 ELSE 0 END + CASE WHEN len(list_filter(tags, lambda t: contains(lower(t), w))) > 0 THEN 0.05 ELSE 0 END)), 1.0) AS keyword_score, list_distance(CAST(c.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS d FROM q JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = query_id, c)
      SELECT query_id, chunk_id, round(keyword_score, 6) AS keyword_score, round(0.35 * keyword_score + 0.35 / (1 + d) + 1e-9, 6) AS score FROM s""",
    "f05_f06_routes": f"WITH {CHUNKS}, {_analysis()}{_ROUTE} SELECT query_id, chunk_id, round(route_score, 6) AS route_score, route_reasons FROM route",
    "f07_f09_tiers": f"WITH {CHUNKS}, {_analysis()}{_TIER} SELECT query_id, chunk_id, round(tier_score, 6) AS tier_score, tier_reasons FROM tier",
    "f10_pool": f"WITH {BRANCHES} SELECT query_id, chunk_id, round(pool_score, 9) AS pool_score, pool_rank FROM pool",
    "f12_link_expansion": f"""WITH {BRANCHES}{_LINKS}, best AS (SELECT query_id, chunk_id FROM pool QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pool_score DESC, chunk_id) <= 5),
      near AS (SELECT DISTINCT query_id, target_id AS chunk_id FROM best JOIN og ON chunk_id = source_id UNION SELECT DISTINCT query_id, source_id FROM best JOIN og ON chunk_id = target_id)
      SELECT n.query_id, n.chunk_id, 0.03 AS link_boost, p.chunk_id IS NULL AS is_new FROM near n LEFT JOIN pool p USING (query_id, chunk_id)""",
    "f13_outgoing": f"WITH {CHUNKS}{_LINKS} SELECT source_id, target_id FROM og",
    "f14_backlinks": f"WITH {CHUNKS}{_LINKS} SELECT source_id, target_id FROM og JOIN chunks ON chunk_id = target_id WHERE starts_with(path, 'brain/')",
    "f15_context": f"""WITH {values_sql('c', 'chunk_id, path, line_start, line_end', CONTEXT)}, {values_sql('s', 'chunk_id', SEEDS)}, p AS (SELECT s.chunk_id AS seed_id, CASE WHEN o.line_end < m.line_start THEN 'before' WHEN o.line_start > m.line_end THEN 'after' END AS relation, o.* FROM s JOIN c m USING (chunk_id) JOIN c o ON o.path = m.path),
      r AS (SELECT seed_id, relation, chunk_id, row_number() OVER (PARTITION BY seed_id, relation ORDER BY CASE WHEN relation = 'before' THEN -line_end ELSE line_start END) AS distance FROM p WHERE relation IS NOT NULL) SELECT * FROM r WHERE distance <= 2""",
    "f16_link_evidence": f"WITH {CHUNKS}{_LINKS}, b AS (SELECT target_id, list_sort(list(source_id)) AS b FROM og GROUP BY target_id) SELECT chunk_id, links AS outgoing, coalesce(b, []) AS backlinks FROM chunks LEFT JOIN b ON target_id = chunk_id",
    "f17_get": f"WITH {CHUNKS} SELECT list_position(['chk_00000012', 'chk_00000003', 'chk_99999999', 'chk_00000007'], chunk_id) AS position, chunk_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 50) AS head FROM chunks WHERE chunk_id IN ('chk_00000012', 'chk_00000003', 'chk_00000007')",
    "g01_g07_scores": f"WITH {values_sql('n', 'id, bm25, distance, keyword_rank, vector_rank', NUMBERS)} SELECT id, round(1 / (1 + abs(bm25)), 9) AS keyword_score, round(1 / (1 + greatest(distance, 0)), 9) AS vector_score, round(coalesce(1.0 / (60 + keyword_rank), 0) + coalesce(1.0 / (60 + vector_rank), 0), 9) AS fusion, CASE WHEN distance >= 0.95 THEN 0.0 WHEN keyword_rank IS NULL THEN 0.03 ELSE least(keyword_rank, 3) * 0.01 END AS graph_boost FROM n",
    "g03_g09_boosts": f"""WITH {CHUNKS} SELECT chunk_id, CASE WHEN len(list_filter(['wiki', 'topic3', 'en', 'report'], lambda w: contains(lower(path), w))) > 0 THEN 0.08 ELSE 0.0 END AS path_boost, CASE WHEN len(list_filter(tags, lambda t: contains('wiki topic3 en report', lower(t)))) > 0 THEN 0.05 ELSE 0.0 END AS tag_boost,
      round({_RECENCY}, 9) AS recency, round({_METADATA}, 6) + 0.0 AS metadata, round(least(list_sum(list_transform(['wiki', 'topic3', 'en', 'report'], lambda w: CASE WHEN contains(lower(text), w) THEN 0.1 ELSE 0 END + CASE WHEN len(list_filter(tags, lambda t: contains(lower(t), w))) > 0 THEN 0.05 ELSE 0 END)), 1.0), 6) AS overlap FROM chunks""",
    "g11_g13_final": f"WITH {BRANCHES}{_SCORED} SELECT query_id, chunk_id, round(score + 1e-9, 6) AS score, round(tier_boost, 6) AS tier_boost, round(intent_boost, 6) AS intent_boost, round(event_boost, 6) AS event_boost, sources FROM sc2",
    "h01_validity": f"WITH {CHUNKS}, v AS (SELECT 'now' AS day, chunk_id, {_reason(NOW, False)} AS stale_reason, {_age(NOW)} AS age_days FROM chunks UNION ALL SELECT 'mid', chunk_id, {_reason('2024-06-15', True)}, {_age('2024-06-15')} FROM chunks) SELECT *, CASE WHEN stale_reason IS NOT NULL THEN 'stale' WHEN day = 'mid' THEN 'historical' ELSE 'current' END AS state FROM v",
    "h02_h05_boosts": f"""WITH {CHUNKS}, v AS (SELECT *, CASE WHEN {_reason('2024-06-15', False)} IS NOT NULL THEN 'stale' ELSE 'current' END AS state, {_age('2024-06-15')} AS age FROM chunks)
      SELECT chunk_id, {_fresh('off', 'true')} * 1.0 AS fresh_off, {_fresh('balanced', 'true')} AS fresh_balanced, {_fresh('recent', 'true')} AS fresh_recent, {_fresh('oldest', 'true')} AS fresh_oldest, {_CONF} AS confidence_boost, CASE WHEN state = 'stale' THEN -0.04 ELSE {_STAT} END AS status_boost, 0.005 * least(len(tags), 4) AS evidence_boost FROM v""",
    "h06_quality": f"WITH {BRANCHES}{_SCORED}{_QUALITY} SELECT query_id, chunk_id, round(score + 1e-9, 5) AS score, state AS validity_state, applies AS temporal FROM tx",
    "e08_min_score": "SELECT * FROM (VALUES ('q', 'c1'), ('q', 'c2'), ('q', 'c4'), ('q', 'c3'), ('q', 'c7')) t(query_id, chunk_id)",
    "i01_order": "SELECT * FROM (VALUES ('q', 1, 'c7'), ('q', 2, 'c3'), ('q', 3, 'c4'), ('q', 4, 'c2'), ('q', 5, 'c1'), ('q', 6, 'c6'), ('r', 1, 'c7')) t(query_id, rank, chunk_id)",
    "i02_mmr": f"WITH {values_sql('e', 'query_id, chunk_id, diverse_rank', [('q', 'c1', 1), ('q', 'c3', 2), ('q', 'c2', 3), ('q', 'c5', 4), ('q', 'c4', 5), ('p', 'd1', 1)])} SELECT * FROM e",
    "i04_rerank": f"WITH {values_sql('r', _R5, MMR)}, m AS (SELECT *, least(greatest(length(chunk_id) * 0.7 - line_start / 10, 0), 1) + 0.01 * score AS s FROM r) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, path, line_start, chunk_id) AS rank, round(s + 1e-9, 6) AS score FROM m",
    "i05_rerank_text": f"WITH {CHUNKS} SELECT chunk_id, sha256(concat_ws(chr(10), title, heading, path, substr(text, 1, 2000))) AS sha FROM chunks",
    "i06_penalty": f"WITH {BRANCHES}{_SCORED} SELECT query_id, chunk_id, round(CASE WHEN sources = ['keyword'] THEN score * (0.8 - 1) ELSE 0 END, 6) AS adjustment FROM sc2",
    "i07_side_boost": f"WITH {values_sql('e', 'query_id, chunk_id, side_boost, boosted_rank', [('q', 'c1', 0.0, 1), ('q', 'c2', 0.0, 2), ('q', 'c3', 0.0495, 3), ('q', 'c5', 0.0, 4), ('q', 'c4', 0.035, 5), ('p', 'd1', 0.0, 1)])} SELECT * FROM e",
    "i08_file_diverse": f"WITH {values_sql('r', _R5, MMR)}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, line_start, chunk_id) AS rank FROM r), a AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY rank) = 1 AS lead_ FROM k) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY NOT lead_, rank) AS position FROM a",
    "i10_json_lines": "SELECT * FROM (VALUES ('q', 1, '{\"rank\":1,\"chunk_id\":\"c1\",\"path\":\"same.md\"}'), ('q', 2, '{\"rank\":2,\"chunk_id\":\"c2\",\"path\":\"same.md\"}'), ('p', 1, '{\"rank\":1,\"chunk_id\":\"d1\",\"path\":\"x.md\"}')) t(query_id, rank, line)",
    "p07_trace": f"WITH {BRANCHES} SELECT query_id, 'keyword' AS stage, count(*) AS rows FROM kw GROUP BY ALL UNION ALL SELECT query_id, 'route', count(*) FROM route GROUP BY ALL UNION ALL SELECT query_id, 'tier', count(*) FROM tier GROUP BY ALL",
    "search": f"WITH {BRANCHES}{_SCORED}{_QUALITY}, r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, line_start, chunk_id) AS rank, chunk_id, path, round(score + 1e-9, 5) AS score, state AS validity_state FROM tx) SELECT * FROM r WHERE rank <= 5",
}
