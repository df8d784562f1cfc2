"""Similarity candidates between notes and decisions about them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import similarity as sim
from ..sources.shared import stored
from .base import PARSED, parsed, rows, table, values_sql


def notes(spark, sf):
    return parsed(spark, sf)


def feature_sizes(spark, sf):
    return sim.features(notes(spark, sf)).select("path", F.size("tokens").alias("n_tokens"), F.array_sort("tags").alias("tags"), F.sha2(F.array_join(F.array_sort("tokens"), " ").cast("binary"), 256).alias("tokens_sha"))


def scopes(spark, sf):
    n = notes(spark, sf)
    return n.select("path", sim.scope(F.col("path"), F.concat("tags", F.when(F.col("doc_id") % 9 == 0, F.array(F.lit("#Project/Alpha"))).otherwise(F.array(F.lit("x"))))).alias("scope"))


def pools(spark, sf):
    return sim.blocks(sim.features(notes(spark, sf)))


def lexical(spark, sf):
    f = sim.numbered_features(sim.features(notes(spark, sf)))
    counts = sim.item_counts(f)
    found = sim.with_paths(f, sim.lexical_best(f, counts, sim.pooled(f, counts), 6))
    return found.select("source_path", "target_path", "kind", F.round("lexical", 6).alias("lexical"), "rank")


def linked(spark, sf):
    return sim.link_pairs(notes(spark, sf))


def vectors(spark, sf):
    n = notes(spark, sf).select("doc_id", "path")
    return n.join(table(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id")).select("path", "embedding")


def embedded(spark, sf):
    f = sim.numbered_features(sim.features(notes(spark, sf)))
    held = sim.numbered_vectors(f, vectors(spark, sf))
    found = sim.with_paths(f, sim.embedding_pairs(sim.pooled(f, sim.item_counts(f), held), held))
    return found.select("source_path", "target_path", F.round("embedding", 6).alias("embedding"), "embedding_rank")


def fused(spark, sf):
    n = notes(spark, sf)
    f = sim.numbered_features(sim.features(n))
    counts = sim.item_counts(f)
    pairs = stored(sim.pooled(f, counts).drop("votes"))
    words, near = sim.lexical_best(f, counts, pairs, 6), sim.embedding_pairs(pairs, sim.numbered_vectors(f, vectors(spark, sf)))
    out = sim.fuse(sim.link_pairs(n), sim.with_paths(f, words), sim.with_paths(f, near))
    return out.select("source_path", "target_path", "kind", F.round("rrf", 6).alias("rrf"), F.round("rank_score", 6).alias("rank_score"), F.round("final", 6).alias("final"), F.transform("source_ranks", lambda r: F.concat_ws(":", r["source"], r["rank"].cast("string"))).alias("sources"))


def best(spark, sf):
    return sim.neighbours(notes(spark, sf), "digest_low", 10).select("source_path", "target_path", "kind", F.round("rank_score", 6).alias("rank_score"))


def budgets(spark, sf):
    return rows(spark, "profile string, proposals int, candidates int", [(p, n, sim.candidate_limit(p, n)) for p in sim.BUDGETS for n in (0, 5, 40, 1000)])


CANDIDATES = [("c1", "brain/4.md", "brain/12.md", 0.8, 0.7), ("c2", "brain/4.md", "gone.md", 0.6, 0.6), ("c3", "brain/12.md", "brain/20.md", 0.5, 0.4), ("c4", "brain/20.md", "brain/28.md", 0.3, 0.2)]
DECISIONS = [(1, "c1", True, "Supports", 0.9), (2, "c9", True, None, 0.5), (3, "c2", True, "refines", 0.4), (4, "c3", False, "refines", 0.4), (5, "c3", True, "likes", 0.4), (6, "c3", True, None, None), (7, "c4", True, "part_of", 1.5)]


def decided(spark, sf):
    c = rows(spark, "candidate_id string, source_path string, target_path string, rank_score double, lexical double", CANDIDATES)
    d = rows(spark, "seq int, candidate_id string, keep boolean, relation string, confidence double", DECISIONS)
    return sim.decide(d, c, notes(spark, sf), 2).select("seq", "candidate_id", "outcome", F.round("confidence", 6).alias("confidence"), "relation")


WORDS = ["supports", "MENTION", "duplicates", "contrasts-with", " supersede ", "implements", "component_of", "banana", None]


def relations(spark, sf):
    return rows(spark, "raw string", [(w,) for w in WORDS]).select("raw", sim.normal_relation(F.col("raw")).alias("relation"))


def heuristics(spark, sf):
    return sim.heuristic_proposals(notes(spark, sf), sim.link_pairs(notes(spark, sf)), 60)


def fallbacks(spark, sf):
    n = notes(spark, sf)
    return sim.fallback_proposals(sim.neighbours(n, "eval", 40), "digest_low", 20).select("source_path", "target_path", F.round("rank_score", 6).alias("rank_score"))


REPLIES = [(1, '[{"candidate_id":"a","keep":true,"relation":"supports","confidence":0.5},{"candidate_id":"b","keep":false}]'), (2, '{"decisions":[{"candidate_id":"c","keep":true}]}'), (3, '{"candidate_id":"d","keep":true,"confidence":1}'), (4, "not json")]


def replies(spark, sf):
    return sim.parse_decisions(rows(spark, "batch int, reply string", REPLIES)).select("batch", "at", "candidate_id", "keep", "relation", "confidence")


def blurbs(spark, sf):
    n = notes(spark, sf)
    return n.select("path", sim.document_blurb(F.col("path"), F.col("title"), F.col("tags"), F.col("body"), 300).alias("blurb"))


def top_terms(spark, sf):
    return sim.doc_terms(sim.features(notes(spark, sf)))


def by_length(source, target):
    """A stand-in for a model: blurbs of like length are alike."""
    return 1 / (1 + F.abs(F.length(source) - F.length(target)) / 8.0)


def reranking(spark, sf):
    out = sim.reranked(sim.neighbours(notes(spark, sf), "eval", 40), notes(spark, sf), "digest_low", by_length)
    return out.select("source_path", "target_path", F.round("reranker", 6).alias("reranker"), F.round("rrf", 6).alias("rrf"), F.round("rank_score", 6).alias("rank_score"), F.round("final", 6).alias("final"))


def fallback_run(spark, sf):
    return sim.proposals(notes(spark, sf), "digest_low", 20, scorer=by_length).select("source_path", "target_path", "relation", F.round("confidence", 6).alias("confidence"), "origin")


QUERIES = {
    "k14_reranked": reranking, "k20_run": fallback_run,
    "k01_features": feature_sizes, "k04_scopes": scopes, "k06_pools": pools, "k05_k07_lexical": lexical, "k08_links": linked, "k09_embedded": embedded, "k11_fused": fused, "k12_neighbours": best, "k13_budgets": budgets, "k15_k21_decisions": decided,
    "k16_heuristics": heuristics, "k17_fallbacks": fallbacks, "k18_relations": relations, "k22_replies": replies, "b21_blurbs": blurbs, "m20_top_terms": top_terms,
}

_STOP = "(" + ", ".join(f"'{w}'" for w in sim.STOPWORDS) + ")"


def _tokens(e: str) -> str:
    other = f"regexp_replace({e}, '[\\x00-\\x7F]|[^\\p{{L}}\\p{{N}}]', '', 'g')"
    return (
        f"list_distinct(list_concat(list_filter(string_split(lower(regexp_replace({e}, '[^A-Za-z0-9_\\-]+', ' ', 'g')), ' '), lambda w: length(w) >= 2 AND w NOT IN {_STOP}), list_concat(list_transform(range(1, length({other}) + 1), lambda i: substr({other}, i, 1)),"
        f" list_transform(range(1, length({other})), lambda i: substr({other}, i, 2)))))"
    )


_SQUEEZE = "trim(regexp_replace(substr(body, 1, 1400), '\\s+', ' ', 'g'))"


def _features(where: str = "TRUE") -> str:
    return f"""{PARSED}, nt AS (SELECT * FROM parsed WHERE {where}), feats AS (SELECT path, title, list_distinct(list_transform(tags, lambda t: lower(trim(t)))) AS tags, {_tokens(f"concat_ws(' ', path, coalesce(title, ''), array_to_string(tags, ' '), {_SQUEEZE})")} AS tokens, {_tokens("coalesce(title, '')")} AS words FROM nt)"""


_USEFUL = f"length(item) BETWEEN 3 AND 48 AND item NOT IN {_STOP}"
_POOLS = f""", en AS (SELECT 'token' AS kind, path, item, 1 AS v FROM (SELECT path, unnest(tokens) AS item FROM feats) WHERE {_USEFUL} UNION ALL SELECT 'tag', path, item, 3 FROM (SELECT path, unnest(tags) AS item FROM feats) WHERE item <> '' UNION ALL SELECT 'title', path, item, 2 FROM (SELECT path, unnest(words) AS item FROM feats) WHERE {_USEFUL}),
 rare AS (SELECT kind, item FROM en GROUP BY ALL HAVING count(*) BETWEEN 2 AND CASE WHEN kind = 'token' THEN 96 ELSE 64 END), ix AS (SELECT en.* FROM en JOIN rare USING (kind, item)),
 vt AS (SELECT a.path AS source_path, b.path AS target_path, CAST(sum(a.v) AS BIGINT) AS votes FROM ix a JOIN ix b ON a.kind = b.kind AND a.item = b.item AND a.path <> b.path GROUP BY ALL),
 pools AS (SELECT * FROM vt QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY votes DESC, target_path) <= 160)"""
_SCOPE = "coalesce(replace(list_filter(list_transform({t}, lambda t: lower(ltrim(trim(t), '#'))), lambda t: regexp_matches(t, '^(project:|project/|scope:)'))[1], '/', ':'), CASE WHEN regexp_matches(lower(regexp_extract(path, '^([^/]+)/', 1)), '^project[-_]') THEN lower(regexp_extract(path, '^([^/]+)/', 1)) END)"
_CONT = "CASE WHEN least(len({a}), len({b})) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / CAST(least(len({a}), len({b})) AS DOUBLE) END"
_LEX = f""", sf AS (SELECT path, tags, list_transform(tokens, lambda t: hash(t)) AS th, {_SCOPE.format(t='tags')} AS scope FROM feats), lx0 AS (SELECT source_path, target_path, {_CONT.format(a='s.th', b='t.th')} AS tok, {_CONT.format(a='s.tags', b='t.tags')} AS tg FROM pools JOIN sf s ON s.path = source_path JOIN sf t ON t.path = target_path WHERE s.scope IS NULL OR t.scope IS NULL OR s.scope = t.scope),
 lx1 AS (SELECT source_path, target_path, CASE WHEN tg > 0 THEN 'lexical_tag' ELSE 'lexical' END AS kind, greatest(least(0.72 * tok + 0.28 * tg, 1.0), 0.18 * tg) AS lexical FROM lx0 WHERE least(0.72 * tok + 0.28 * tg, 1.0) >= 0.12 OR tg > 0),
 lx AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY round(lexical, 9) DESC, target_path) AS rank FROM lx1 QUALIFY rank <= {{cap}})"""
_FOLD = "lower(regexp_replace(trim(trim({0}), '/'), '(\\.md)+$', ''))"
_LINK = f""", ky AS (SELECT path, unnest([{_FOLD.format('path')}, {_FOLD.format("regexp_replace(regexp_extract(path, '([^/]*)$', 1), '[.][^.]*$', '')")}, {_FOLD.format('title')}]) AS key FROM nt), lu AS (SELECT key, min(path) AS target_path FROM ky WHERE key <> '' GROUP BY key),
 lk AS (SELECT DISTINCT n.path AS source_path, target_path, 'link' AS kind, 0.78 AS lexical FROM (SELECT path, unnest(links) AS link FROM nt) n JOIN lu ON lu.key = {_FOLD.format("regexp_extract(link, '^([^|#]*)', 1)")} WHERE n.path <> target_path)"""
_EMB = """, ev AS (SELECT path, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM parsed JOIN embeddings ON doc_id = vec_id), em0 AS (SELECT source_path, target_path, least(greatest(list_cosine_similarity(a.e, b.e), 0), 1) AS embedding FROM pools JOIN ev a ON a.path = source_path JOIN ev b ON b.path = target_path),
 em AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY round(embedding, 9) DESC, target_path) AS embedding_rank FROM em0 WHERE embedding >= 0.18 QUALIFY embedding_rank <= 8)"""
_FUSE = """, f0 AS (SELECT source_path, target_path, kind, lexical, [struct_pack(source := 'link', rank := 1)] AS ranks FROM lk UNION ALL SELECT source_path, target_path, kind, lexical, CASE WHEN kind = 'lexical_tag' THEN [struct_pack(source := 'lexical', rank := rank), struct_pack(source := 'lexical_tag', rank := 1)] ELSE [struct_pack(source := 'lexical', rank := rank)] END FROM lx WHERE (source_path, target_path) NOT IN (SELECT (source_path, target_path) FROM lk)),
 f1 AS (SELECT source_path, target_path, coalesce(kind, 'embedding') AS kind, coalesce(lexical, 0) AS lexical, embedding, list_sort(list_concat(coalesce(ranks, []), CASE WHEN embedding_rank IS NOT NULL THEN [struct_pack(source := 'embedding', rank := embedding_rank)] ELSE [] END)) AS sr FROM f0 FULL JOIN {em} USING (source_path, target_path)),
 f2 AS (SELECT *, list_sum(list_transform(sr, lambda r: 1 / (60.0 + r.rank))) AS rrf, CASE WHEN embedding IS NOT NULL THEN 0.72 * embedding + 0.28 * lexical ELSE lexical END AS rank_score FROM f1)"""
_NOEM = "(SELECT source_path, target_path, CAST(NULL AS DOUBLE) AS embedding, CAST(NULL AS BIGINT) AS embedding_rank FROM lk LIMIT 0)"
_WHOLE = _features() + _POOLS

_BLURB = "length(substr(trim(regexp_replace(concat_ws(chr(10), 'path: ' || path, 'title: ' || coalesce(title, ''), 'tags: ' || array_to_string(tags, ', '), body), '\\s+', ' ', 'g')), 1, 900))"
_RERANK = """, nb AS (SELECT * FROM f2 ORDER BY round(rank_score, 9) DESC, source_path, target_path LIMIT {limit}), bl AS (SELECT path, """ + _BLURB + """ AS n FROM parsed), pl AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY round(lexical, 9) DESC, target_path) AS place FROM nb),
 rr AS (SELECT pl.*, CASE WHEN place <= 12 THEN 1 / (1 + abs(s.n - t.n) / 8.0) END AS reranker FROM pl JOIN bl s ON s.path = source_path JOIN bl t ON t.path = target_path),
 fin AS (SELECT source_path, target_path, reranker, rrf + CASE WHEN reranker IS NULL THEN 0 ELSE 1 / (60.0 + place) END AS rrf, CASE WHEN reranker IS NULL THEN rank_score ELSE 0.82 * reranker + 0.18 * rank_score END AS rank_score FROM rr)"""

SQL = {
    "k14_reranked": f"WITH {_WHOLE}{_LEX.format(cap=12)}{_LINK}{_FUSE.format(em=_NOEM)}{_RERANK.format(limit=320)} SELECT source_path, target_path, round(reranker, 6) AS reranker, round(rrf, 6) AS rrf, round(rank_score, 6) AS rank_score, round(least(greatest(0.74 * rank_score + 0.26 * least(12 * rrf, 1.0), 0), 1), 6) AS final FROM fin",
    "k20_run": f"WITH {_WHOLE}{_LEX.format(cap=3)}{_LINK}{_FUSE.format(em=_NOEM)}{_RERANK.format(limit=24)} SELECT source_path, target_path, 'supports' AS relation, round(rank_score, 6) AS confidence, 'fallback' AS origin FROM fin WHERE rank_score >= 0.72 ORDER BY round(fin.rank_score, 9) DESC, source_path, target_path LIMIT 20",
    "k01_features": f"WITH {_features()} SELECT path, len(tokens) AS n_tokens, list_sort(tags) AS tags, sha256(array_to_string(list_sort(tokens), ' ')) AS tokens_sha FROM feats",
    "k04_scopes": f"WITH {PARSED} SELECT path, {_SCOPE.format(t='''list_concat(tags, CASE WHEN doc_id % 9 = 0 THEN ['#Project/Alpha'] ELSE ['x'] END)''')} AS scope FROM parsed",
    "k06_pools": f"WITH {_features()}{_POOLS} SELECT source_path, target_path, votes FROM pools",
    "k05_k07_lexical": f"WITH {_features()}{_POOLS}{_LEX.format(cap=6)} SELECT source_path, target_path, kind, round(lexical, 6) AS lexical, rank FROM lx",
    "k08_links": f"WITH {_features()}{_LINK} SELECT source_path, target_path, kind, lexical FROM lk",
    "k09_embedded": f"WITH {_WHOLE}{_EMB} SELECT source_path, target_path, round(embedding, 6) AS embedding, embedding_rank FROM em",
    "k11_fused": f"WITH {_WHOLE}{_LEX.format(cap=6)}{_LINK}{_EMB}{_FUSE.format(em='em')} SELECT source_path, target_path, kind, round(rrf, 6) AS rrf, round(rank_score, 6) AS rank_score, round(least(greatest(0.74 * rank_score + 0.26 * least(12 * rrf, 1.0), 0), 1), 6) AS final, list_transform(sr, lambda r: r.source || ':' || CAST(r.rank AS VARCHAR)) AS sources FROM f2",
    "k12_neighbours": f"WITH {_WHOLE}{_LEX.format(cap=3)}{_LINK}{_FUSE.format(em=_NOEM)} SELECT source_path, target_path, kind, round(rank_score, 6) AS rank_score FROM f2 ORDER BY round(rank_score, 9) DESC, source_path, target_path LIMIT 20",
    "k13_budgets": "SELECT * FROM (VALUES " + ", ".join(f"('{p}', {n}, {min(max(max(n, 1) * b['multiplier'], b['least']), b['most'])})" for p, b in sim.BUDGETS.items() for n in (0, 5, 40, 1000)) + ") t(profile, proposals, candidates)",
    "k15_k21_decisions": "SELECT * FROM (VALUES (1, 'c1', 'accepted', 0.865, 'supports'), (2, 'c9', 'candidate_not_in_evidence', NULL, NULL), (3, 'c2', 'path_not_in_notes', NULL, NULL), (4, 'c3', 'not_kept', NULL, NULL), (5, 'c3', 'relation_not_allowed', NULL, NULL), (6, 'c3', 'accepted', 0.435, 'supports'), (7, 'c4', 'budget_exhausted', NULL, NULL)) t(seq, candidate_id, outcome, confidence, relation)",
    "k16_heuristics": f"WITH {_features()}{_LINK}, h AS (SELECT 'metadata' AS kind, path AS source_path, CAST(NULL AS VARCHAR) AS target_path, 0.6 AS confidence, 0 AS turn FROM nt WHERE title IS NULL UNION ALL SELECT 'edge', source_path, target_path, 0.42, 1 FROM lk) SELECT kind, source_path, target_path, confidence FROM h ORDER BY source_path, turn, target_path LIMIT 60",
    "k17_fallbacks": f"WITH {_WHOLE}{_LEX.format(cap=12)}{_LINK}{_FUSE.format(em=_NOEM)}, b AS (SELECT * FROM f2 ORDER BY round(rank_score, 9) DESC, source_path, target_path LIMIT 320) SELECT source_path, target_path, round(rank_score, 6) AS rank_score FROM b WHERE rank_score >= 0.72 ORDER BY round(b.rank_score, 9) DESC, source_path, target_path LIMIT 20",
    "k18_relations": "SELECT * FROM (VALUES ('supports', 'supports'), ('MENTION', 'supports'), ('duplicates', 'refines'), ('contrasts-with', 'contradicts'), (' supersede ', 'replaces'), ('implements', 'depends_on'), ('component_of', 'part_of'), ('banana', 'supports'), (NULL, 'supports')) t(raw, relation)",
    "k22_replies": "SELECT * FROM (VALUES (1, 0, 'a', TRUE, 'supports', 0.5), (1, 1, 'b', FALSE, NULL, NULL), (2, 0, 'c', TRUE, NULL, NULL), (3, 0, 'd', TRUE, NULL, 1.0)) t(batch, \"at\", candidate_id, keep, relation, confidence)",
    "b21_blurbs": f"WITH {PARSED} SELECT path, substr(trim(regexp_replace(concat_ws(chr(10), 'path: ' || path, 'title: ' || coalesce(title, ''), 'tags: ' || array_to_string(tags, ', '), body), '\\s+', ' ', 'g')), 1, 300) AS blurb FROM parsed",
    "m20_top_terms": f"WITH {_features()}, e AS (SELECT path, item AS token FROM (SELECT path, unnest(tokens) AS item FROM feats) WHERE {_USEFUL}), c AS (SELECT token, count(*) AS notes FROM e GROUP BY token) SELECT path, token, notes, row_number() OVER (PARTITION BY path ORDER BY notes DESC, token) AS place FROM e JOIN c USING (token) QUALIFY place <= 8",
}
