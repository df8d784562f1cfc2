"""Candidate generation for a batch of queries: keyword, vector, route and tier branches, their union, and joins around results.

Queries are rows, so a batch is one job. Branches keep their best k by window rankings, which Spark prunes map-side.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..functions.markdown import link_key, path_stem, title_key
from ..functions.tiers import event_time, source_tier
from ..sources.shared import settled, stored

KEYWORD_DEPTH, VECTOR_DEPTH, ROUTE_DEPTH, TIER_DEPTH, POOL_CAP = 80, 80, 50, 60, 200
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Characters by which prefixes meet tokens; tokens of a batch that are sent to all tasks at most.
PREFIX_KEY, BROADCAST_ROWS = 3, 200_000
#: Rows of a link key's sources and targets that one block of its pairs has at most (about), and ids in a block's copies of a list.
LINK_BLOCK, LINK_IDS = 2048, 4_000_000
#: Query vectors compared in one pass over the table; more queries make more passes.
QUERY_BLOCK = 2048
#: Distances that a task computes at once.
CELLS = 1 << 20
TIERS_OF = {"historical": ["transcript", "report", "system_snapshot", "raw", "brain"], "concept": ["wiki", "brain"], "config": ["report", "system_snapshot", "raw", "brain"]}


def ranked(df: DataFrame, by: str, order: list, most: int | None = None, name: str = "rank") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    out = df.withColumn(name, place)
    return out if most is None else out.filter(F.col(name) <= most)


# Keyword index


def postings(chunks: DataFrame, key: str = "chunk_id", columns: tuple[str, ...] = ("title", "heading", "text", "tags")) -> DataFrame:
    """chunk_id, token, tf, dl. Tokens are counted within each row, so the index is built without a shuffle."""
    parts = [F.array_join(c, " ") if dict(chunks.dtypes)[c].startswith("array") else F.col(c) for c in columns]
    tokens = chunks.select(key, F.sort_array(text.word_tokens(F.concat_ws(" ", *parts))).alias("tokens"))
    first = F.filter(F.sequence(F.lit(0), F.greatest(F.size("tokens") - 1, F.lit(0))), lambda i: (i < F.size("tokens")) & ((i == 0) | (F.get("tokens", i) != F.get("tokens", i - 1))))
    runs = tokens.select(key, "tokens", F.size("tokens").alias("dl"), first.alias("starts"))
    each = F.transform("starts", lambda s, k: F.struct(F.get("tokens", s).alias("token"), (F.coalesce(F.get("starts", k + 1), F.col("dl")) - s).alias("tf")))
    return runs.select(key, "dl", F.explode(each).alias("e")).select(key, "e.token", "e.tf", "dl")


def corpus_size(chunks_postings: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: n (chunks with a token), avgdl."""
    return chunks_postings.groupBy(key).agg(F.first("dl").alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def query_terms(analyzed: DataFrame) -> DataFrame:
    """query_id, keyword_mode, n_terms, term, prefix: a row for each term."""
    return analyzed.filter("keyword_mode <> 'none'").select("query_id", "keyword_mode", F.size("keyword_terms").alias("n_terms"), F.explode("keyword_terms").alias("t")).select("query_id", "keyword_mode", "n_terms", "t.term", "t.prefix")


def vocabulary(chunks_postings: DataFrame) -> DataFrame:
    """token, df: the index's distinct tokens."""
    return chunks_postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def begins(token: Column) -> Column:
    """A token's beginnings of 1 to PREFIX_KEY characters."""
    return F.transform(F.sequence(F.lit(1), F.least(F.length(token), F.lit(PREFIX_KEY))), lambda n: F.substring(token, F.lit(1), n))


def term_tokens(words: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, keyword_mode, n_terms, term, token: the tokens that each term stands for.

    A prefix term meets the vocabulary by the equality of their first PREFIX_KEY characters (or of all, if it has fewer), and
    what meets is checked in full, so a prefix may be of any length.
    """
    named = ("query_id", "keyword_mode", "n_terms", "term")
    exact = terms.filter("not prefix").select(*named, F.col("term").alias("token"))
    keyed = words.select("token", F.explode(begins(F.col("token"))).alias("begin"))
    asked = terms.filter("prefix").withColumn("key", F.substring("term", 1, PREFIX_KEY))
    prefixed = asked.join(keyed, F.col("key") == F.col("begin")).filter(F.col("token").startswith(F.col("term"))).select(*named, "token")
    return exact.unionByName(prefixed)


def keyword_candidates(index: DataFrame, terms: DataFrame, size: DataFrame, depth: int = KEYWORD_DEPTH, key: str = "chunk_id", words: DataFrame | None = None) -> DataFrame:
    """BM25 over the postings: query_id, chunk_id, bm25 (higher is better), keyword_score, keyword_rank.

    A prefix term stands for all tokens that begin with it; its frequency is theirs together. The tokens that queries name are
    settled and counted: up to BROADCAST_ROWS they go to the postings, which then aren't shuffled before they are cut down.
    words: vocabulary(), if the index keeps it.
    """
    wanted = settled(term_tokens(vocabulary(index) if words is None else words, terms))
    hits = index.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "token").groupBy("query_id", "keyword_mode", "n_terms", "term", key).agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    frequency = hits.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    gain = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.join(frequency, ["query_id", "term"]).join(F.broadcast(size)).groupBy("query_id", "keyword_mode", "n_terms", key).agg(F.sum(gain).alias("bm25"), F.count(F.lit(1)).alias("found"))
    kept = scored.filter((F.col("keyword_mode") == "or") | (F.col("found") == F.col("n_terms"))).select("query_id", key, "bm25", scoring.bm25_score(F.col("bm25")).alias("keyword_score"))
    return ranked(kept, "query_id", [F.desc(F.round("bm25", 9)), F.asc(key)], depth, "keyword_rank")


# Vectors


def best_of(distance: np.ndarray, names: np.ndarray, depth: int) -> np.ndarray:
    """Places of the `depth` nearest, by distance rounded to 9 places and then by name."""
    if len(distance) > depth:
        near = np.flatnonzero(distance <= np.partition(distance, depth - 1)[depth - 1] + 1e-8)
    else:
        near = np.arange(len(distance))
    return near[np.lexsort((names[near].astype(str), np.round(distance[near], 9)))][:depth]


def nearest(queries: list[tuple[str, np.ndarray]], depth: int, key: str):
    """Per task: the best `depth` rows of each query by L2 distance in double precision.

    One matrix product a batch finds bounds of all distances; only rows whose bound could be among the best are measured.
    """
    schema = pa.schema([("query_id", pa.string()), (key, pa.string()), ("distance", pa.float64())])
    by_dim: dict[int, list[tuple[str, np.ndarray]]] = {}
    for query_id, q in queries:
        by_dim.setdefault(len(q), []).append((query_id, q))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            size = pc.list_value_length(lists).fill_null(-1).to_numpy(zero_copy_only=False)
            for dim, asked in by_dim.items():
                rows = np.flatnonzero(size == dim)
                if not len(rows):
                    continue
                x = np.asarray(lists.take(pa.array(rows)).flatten()).astype(np.float64).reshape(-1, dim)
                names = np.array(ids.take(pa.array(rows)).to_pylist(), dtype=object)
                norms, step = (x**2).sum(axis=1), max(1, CELLS // len(rows))
                for at in range(0, len(asked), step):
                    few = asked[at : at + step]
                    q = np.stack([v for _, v in few])
                    squares = (q**2).sum(axis=1)
                    rough = (-2 * q) @ x.T  # squared distances, but for rounding
                    rough += norms
                    rough += squares[:, None]
                    slack = 1e-9 * (norms.max() + squares) + 1e-12
                    for k, (query_id, v) in enumerate(few):
                        held_d, held_n = best.get(query_id, (np.zeros(0), np.zeros(0, object)))
                        own = rough[k]
                        limit = np.partition(own, depth - 1)[depth - 1] if len(own) > depth else np.inf
                        if len(held_d) >= depth:
                            limit = min(limit, (held_d[-1] + 1e-8) ** 2)
                        near = np.flatnonzero(own <= limit + 2 * slack[k] + 1e-7 * abs(limit) if np.isfinite(limit) else np.ones(len(own), bool))
                        if not len(near):
                            continue
                        d, n = np.concatenate((held_d, np.sqrt(((x[near] - v) ** 2).sum(axis=1)))), np.concatenate((held_n, names[near]))
                        order = best_of(d, n, depth)
                        best[query_id] = (d[order], n[order])
        rows = [(q, n, float(x)) for q, (d, names) in best.items() for x, n in zip(d, names)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


def measured(queries: list[tuple[str, np.ndarray]], key: str):
    """The L2 distance of every row to each query of its size, in double precision; rows are passed on as they come."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            size = pc.list_value_length(lists).fill_null(-1).to_numpy(zero_copy_only=False)
            for query_id, q in queries:
                rows = pa.array(np.flatnonzero(size == len(q)))
                if len(rows):
                    x = np.asarray(lists.take(rows).flatten()).astype(np.float64).reshape(-1, len(q))
                    yield pa.RecordBatch.from_arrays([pa.array([query_id] * len(rows), pa.string()), ids.take(rows), pa.array(np.sqrt(((x - q) ** 2).sum(axis=1)))], names=["query_id", key, "distance"])

    return run


def vector_candidates(vectors: DataFrame, query_vectors: DataFrame, depth: int = VECTOR_DEPTH, key: str = "chunk_id") -> DataFrame:
    """Exact nearest neighbours by L2: query_id, chunk_id, distance, vector_score, vector_rank.

    vectors: chunk_id, embedding, filtered before (a filter never loses matches); query_vectors: query_id, embedding. A block of at
    most QUERY_BLOCK query vectors goes to the tasks with the function; each task returns its best rows of each query.
    """
    asked = [(r["query_id"], np.array(r["embedding"], dtype=np.float64)) for r in query_vectors.select("query_id", "embedding").toLocalIterator() if r["embedding"]]
    found = None
    for at in range(0, max(1, len(asked)), QUERY_BLOCK):
        part = vectors.select(F.col(key).cast("string").alias(key), "embedding").mapInArrow(nearest(asked[at : at + QUERY_BLOCK], depth, key), f"query_id string, `{key}` string, distance double")
        found = part if found is None else found.unionByName(part)
    scored = found.withColumn("vector_score", scoring.distance_score(F.col("distance")))
    return ranked(scored, "query_id", [F.asc(F.round("distance", 9)), F.asc(key)], depth, "vector_rank")


def exact_scan(chunks: DataFrame, vectors: DataFrame, analyzed: DataFrame, query_vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The exact backend: every chunk is scored for each query by word overlap and distance; no caps. For few queries."""
    asked = [(r["query_id"], np.array(r["embedding"], dtype=np.float64)) for r in query_vectors.select("query_id", "embedding").toLocalIterator() if r["embedding"]]
    found = vectors.select(F.col(key).cast("string").alias(key), "embedding").mapInArrow(measured(asked, key), f"query_id string, `{key}` string, distance double")
    distances = found.withColumn("vector_score", scoring.distance_score(F.col("distance")))
    joined = distances.join(chunks, key).join(analyzed.select("query_id", "scoring_text"), "query_id")
    overlap = scoring.keyword_overlap(F.col("scoring_text"), F.col("text"), F.col("tags"))
    return joined.withColumn("keyword_score", overlap).select("query_id", key, "keyword_score", "vector_score", (0.35 * F.col("keyword_score") + 0.35 * F.col("vector_score")).alias("score"))


# Route and tier branches


def sent(asked: DataFrame) -> DataFrame:
    """A batch's queries, computed once; up to BROADCAST_ROWS of them go to all tasks, else Spark may send the chunks to the few tasks of the queries."""
    held = settled(asked)
    return F.broadcast(held) if held.count() <= BROADCAST_ROWS else held


def route_candidates(chunks: DataFrame, analyzed: DataFrame, depth: int = ROUTE_DEPTH, key: str = "chunk_id") -> DataFrame:
    """Rows whose path, title, heading or tags hold a query's terms: query_id, chunk_id, route_score, route_reasons.

    A row's score over all terms counts once for each term that it holds. Each query's terms are tested against a row in one
    pass (containment has no equality to join by).
    """
    fields = {"path": F.lower("path"), "title": F.lower(F.coalesce("title", F.lit(""))), "heading": F.lower(F.coalesce("heading", F.lit(""))), "tag": F.lower(F.to_json("tags"))}
    folded = chunks.select(key, *[c.alias(f"_{n}") for n, c in fields.items()])
    holds = lambda n, t: F.contains(F.col(f"_{n}"), t)
    asked = sent(analyzed.select("query_id", "route_terms"))
    weight = lambda t: (
        F.when(F.col("_path") == t, 0.18).when(holds("path", t), 0.12).otherwise(0.0) + F.when(holds("title", t), 0.08).otherwise(0.0)
        + F.when(holds("heading", t), 0.08).otherwise(0.0) + F.when(holds("tag", t), 0.10).otherwise(0.0)
    )
    total = F.aggregate(F.transform("route_terms", weight), F.lit(0.0), lambda a, b: a + b)
    matching = F.size(F.filter("route_terms", lambda t: holds("path", t) | holds("title", t) | holds("heading", t) | holds("tag", t)))
    reason = lambda n: F.when(F.exists("route_terms", lambda t: holds(n, t)), n)
    any_term = F.exists(F.col("route_terms"), lambda t: holds("path", t) | holds("title", t) | holds("heading", t) | holds("tag", t))
    hits = folded.join(asked, any_term).select("query_id", key, (total * matching).alias("route_score"), text.compact(*[reason(n) for n in fields]).alias("route_reasons"))
    kept = ranked(hits, "query_id", [F.desc(F.round("route_score", 9)), F.asc(key)], depth, "route_rank")
    return kept.drop("route_rank")


def tier_candidates(chunks: DataFrame, analyzed: DataFrame, depth: int = TIER_DEPTH, key: str = "chunk_id") -> DataFrame:
    """Rows of the tiers that a query's intent prefers and that hold one of its terms: query_id, chunk_id, tier_score, tier_reasons; by score, then id."""
    p, s = F.lower("path"), F.lower(F.coalesce("source_type", F.lit("")))
    member = {
        "transcript": p.rlike(r"(^|/)raw/transcripts/") | text.contains_any(s, ["transcript", "dialogue"]),
        "report": p.rlike(r"^wiki/reports/|^reports/|/reports/") | text.contains_any(s, ["report", "audit"]),
        "system_snapshot": p.rlike(r"^raw/system-snapshots/|/system-snapshots/") | text.contains_any(s, ["snapshot", "system"]),
        "wiki": p.startswith("wiki/"), "brain": p.startswith("brain/"), "raw": p.startswith("raw/"),
    }
    hay = F.lower(F.concat_ws(" ", "path", F.coalesce("title", F.lit("")), F.coalesce("heading", F.lit("")), F.to_json("tags"), "text", F.coalesce("source_type", F.lit(""))))
    rows = chunks.select(key, hay.alias("hay"), text.compact(*[F.when(c, n) for n, c in member.items()]).alias("member"), source_tier(F.col("path"), F.col("source_type")).alias("tier"), event_time(F.col("path"), F.col("valid_from"), F.col("updated"), F.col("mtime")).alias("event_time"))
    wanted = F.lit(None).cast("array<string>")
    for name, tiers in TIERS_OF.items():
        wanted = F.when(F.col("intent") == name, text.strings(*tiers)).otherwise(wanted)
    asked = analyzed.select("query_id", "intent", "route_terms", wanted.alias("wanted")).filter("wanted is not null and size(route_terms) > 0")
    asked = sent(asked)
    found = rows.join(asked, F.arrays_overlap("member", "wanted") & F.exists("route_terms", lambda t: F.contains(F.col("hay"), t)))
    matched = F.size(F.filter("route_terms", lambda t: F.contains(F.col("hay"), t)))
    score = scoring.by_intent(F.col("intent"), F.col("tier"), scoring.TIER_CANDIDATE_BOOSTS) + F.when(F.col("event_time").isNotNull(), 0.08).otherwise(0.0) + F.least(matched, F.lit(4)) * 0.025
    reasons = text.compact(F.lit("intent_tier"), F.concat(F.lit("source_tier:"), F.col("tier")), F.when(F.col("event_time").isNotNull(), "event_time"))
    hits = found.select("query_id", key, score.alias("tier_score"), reasons.alias("tier_reasons"))
    return ranked(hits, "query_id", [F.desc(F.round("tier_score", 9)), F.asc(key)], depth, "tier_rank").drop("tier_rank")


def pool(keyword: DataFrame, vector: DataFrame, route: DataFrame, tier: DataFrame, cap: int = POOL_CAP, key: str = "chunk_id") -> DataFrame:
    """The union of the branches with its score, at most `cap` rows a query: one shuffle by (query, chunk)."""
    columns = {"keyword_rank": "int", "keyword_score": "double", "vector_rank": "int", "vector_score": "double", "route_score": "double", "route_reasons": "array<string>", "tier_score": "double", "tier_reasons": "array<string>"}
    every = None
    for branch in (keyword, vector, route, tier):
        own = branch.select("query_id", F.col(key).cast("string").alias(key), *[(F.col(c) if c in branch.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
        every = own if every is None else every.unionByName(own)
    merged = every.groupBy("query_id", key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])
    capped = lambda c, most: F.coalesce(F.least(F.greatest(F.col(c), F.lit(0.0)) / (scoring.RRF_K + 1), F.lit(most)), F.lit(0.0))
    scored = merged.withColumn("pool_score", scoring.rrf(F.col("keyword_rank"), F.col("vector_rank")) + capped("route_score", 0.05) + capped("tier_score", 0.06))
    return ranked(scored, "query_id", [F.desc(F.round("pool_score", 12)), F.asc(key)], cap, "pool_rank")


def materialise(candidates: DataFrame, chunks: DataFrame, predicate: Column | None = None, key: str = "chunk_id") -> DataFrame:
    """The wide rows of candidates, read late; the filter holds here again."""
    rows = chunks if predicate is None else chunks.filter(predicate)
    return rows.join(candidates, key)


# Links and context


def link_targets(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Which keys a chunk answers to: its path's stem and its title; target_id, stem, link_key."""
    stem = path_stem(F.col("path"))
    return chunks.select(F.col(key).alias("target_id"), stem.alias("stem"), F.explode(F.array_distinct(F.array_compact(F.array(stem, title_key(F.col("title")))))).alias("link_key")).filter("link_key <> ''")


def link_sources(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """source_id, link_keys (all of the chunk's), link_key: a row for each key that a chunk's links name."""
    keys = F.filter(F.array_distinct(F.transform("links", link_key)), lambda k: k != "")
    return chunks.select(F.col(key).alias("source_id"), keys.alias("link_keys")).select("source_id", "link_keys", F.explode("link_keys").alias("link_key"))


def linked_pairs(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """source_id, target_id of links, each pair once, not to itself; of link_sources() and link_targets().

    A pair that both the target's stem and its title make is the stem's, so pairs are told apart where they arise and none is
    shuffled. A key of many sources and targets is cut into blocks of LINK_BLOCK by LINK_BLOCK rows, so no task has all of its pairs.
    """
    sources, targets = stored(sources), stored(targets)
    n_s, n_t = (df.groupBy("link_key").agg(F.count(F.lit(1)).alias("n")) for df in (sources, targets))
    blocks = lambda c: F.ceil(F.col(c) / LINK_BLOCK).cast("int")
    hot = stored(n_s.withColumnRenamed("n", "n_s").join(n_t.withColumnRenamed("n", "n_t"), "link_key").filter((F.col("n_s") > LINK_BLOCK) | (F.col("n_t") > LINK_BLOCK)).select("link_key", blocks("n_s").alias("s_parts"), blocks("n_t").alias("t_parts")))
    own = lambda df, name, parts: F.when(F.col(parts) > 1, F.pmod(F.xxhash64(name), parts).cast("int")).otherwise(0)
    every = lambda parts: F.explode(F.when(F.col(parts) > 1, F.sequence(F.lit(0), F.col(parts) - 1)).otherwise(F.array(F.lit(0))))
    small = hot.count() <= BROADCAST_ROWS
    salted = lambda df: df.join(F.broadcast(hot) if small else hot, "link_key", "left")
    s = salted(sources).withColumn("s_part", own(sources, "source_id", "s_parts")).select("source_id", "link_keys", "link_key", "s_part", every("t_parts").alias("t_part"))
    t = salted(targets).withColumn("t_part", own(targets, "target_id", "t_parts")).select("target_id", "stem", "link_key", "t_part", every("s_parts").alias("s_part"))
    first = (F.col("link_key") == F.col("stem")) | ~F.array_contains("link_keys", F.col("stem"))
    return s.join(t, ["link_key", "s_part", "t_part"]).filter((F.col("source_id") != F.col("target_id")) & first).select("source_id", "target_id")


def outgoing_links(chunks: DataFrame, seeds: DataFrame | None = None, key: str = "chunk_id") -> DataFrame:
    """source_id, target_id of links between chunks: by stem or by title, many to many, each pair once, not to itself."""
    sources = chunks if seeds is None else chunks.join(seeds.select(key).distinct(), key, "left_semi")
    return linked_pairs(link_sources(sources, key), link_targets(chunks, key))


def backlinks(chunks: DataFrame, seeds: DataFrame, key: str = "chunk_id") -> DataFrame:
    """source_id, target_id of links that point at a seed."""
    return linked_pairs(link_sources(chunks, key), link_targets(chunks.join(seeds.select(key).distinct(), key, "left_semi"), key))


def expand_links(results: DataFrame, chunks: DataFrame, limit: int, boost: float = 0.03, seeds: int = 10, key: str = "chunk_id") -> DataFrame:
    """Neighbours of each query's best rows by links in either direction: query_id, chunk_id, link_boost, is_new.

    results: query_id, chunk_id, score. Rows already found get the boost; others are new.
    """
    best = ranked(results, "query_id", [F.desc("score"), F.asc(key)], min(limit, seeds), "seed_rank").select("query_id", key)
    out = outgoing_links(chunks, best, key).select("source_id", "target_id")
    back = backlinks(chunks, best, key).select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    near = best.join(out.unionByName(back), F.col(key) == F.col("source_id")).select("query_id", F.col("target_id").alias(key)).distinct()
    known = results.select("query_id", key).distinct().withColumn("known", F.lit(True))
    return near.join(known, ["query_id", key], "left").select("query_id", key, F.lit(boost).alias("link_boost"), F.col("known").isNull().alias("is_new"))


def link_evidence(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """chunk_id, outgoing (link texts, sorted), backlinks (ids, sorted).

    The ids that name a key are gathered once for the key, not for each of its targets; a target merges the lists of its two keys.
    Targets of a key are spread over blocks, each with a copy of the list, and the lists of titles come last: none is shuffled again.
    """
    own = stored(chunks.select(key, text.sorted_distinct(F.col("links")).alias("outgoing"), path_stem(F.col("path")).alias("stem"), F.coalesce(title_key(F.col("title")), F.lit("")).alias("title_key")))
    named = stored(link_sources(chunks, key).groupBy("link_key").agg(F.sort_array(F.collect_set("source_id")).alias("ids")))
    block = F.pmod(F.xxhash64(key), F.lit(1 << 30))

    def with_lists(left: DataFrame, by: str, name: str) -> DataFrame:
        targets = own.filter(F.col(by) != "").groupBy(F.col(by).alias("link_key")).agg(F.count(F.lit(1)).alias("n"))
        sizes = targets.join(named.select("link_key", F.size("ids").alias("m")), "link_key")
        parts = stored(sizes.select("link_key", F.ceil(F.col("n") * F.col("m") / LINK_IDS).cast("int").alias("parts")).filter("parts > 1"))
        parts = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts
        lists = named.join(parts, "link_key", "left").select("link_key", F.col("ids").alias(name), F.explode(F.when(F.col("parts") > 1, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0)))).alias("part"))
        spread = left.withColumn("link_key", F.col(by)).join(parts, "link_key", "left").withColumn("part", F.when(F.col("parts") > 1, F.pmod(block, F.col("parts")).cast("int")).otherwise(0)).drop("parts")
        return spread.join(lists, ["link_key", "part"], "left").drop("link_key", "part")

    both = with_lists(with_lists(own, "stem", "by_stem"), "title_key", "by_title")
    none = text.strings()
    stem_ids, title_ids = F.when(F.col("stem") != "", F.coalesce("by_stem", none)).otherwise(none), F.when(F.col("title_key") != "", F.coalesce("by_title", none)).otherwise(none)
    merged = F.when(F.size(stem_ids) == 0, title_ids).when(F.size(title_ids) == 0, stem_ids).otherwise(F.sort_array(F.array_union(stem_ids, title_ids)))
    return both.select(key, "outgoing", F.array_remove(merged, F.col(key)).alias("backlinks"))


def context(chunks: DataFrame, seeds: DataFrame, radius: int, key: str = "chunk_id") -> DataFrame:
    """Chunks of the same file within `radius` before and after each seed: seed_id, relation, chunk_id, distance.

    A range join on the file: before, those that end above the seed's first line, nearest first; after, the mirror image.
    """
    wanted = chunks.join(seeds.select(key).distinct(), key, "left_semi").select(F.col(key).alias("seed_id"), "path", F.col("line_start").alias("s_start"), F.col("line_end").alias("s_end"))
    others = chunks.select("path", key, "line_start", "line_end")
    side = F.when(F.col("line_end") < F.col("s_start"), "before").when(F.col("line_start") > F.col("s_end"), "after")
    pairs = others.join(wanted, "path").withColumn("relation", side).filter("relation is not null")
    order = F.when(F.col("relation") == "before", -F.col("line_end")).otherwise(F.col("line_start"))
    near = pairs.withColumn("distance", F.row_number().over(Window.partitionBy("seed_id", "relation").orderBy(order, key)))
    return near.filter(F.col("distance") <= radius).select("seed_id", "relation", key, "distance")


def get_by_ids(chunks: DataFrame, ids: list[str], most: int = 50, key: str = "chunk_id") -> DataFrame:
    """Rows of the ids in their order, each once; missing ones are left out. position: the id's place."""
    if len(ids) > most:
        raise ValueError(f"at most {most} ids")
    wanted = list(dict.fromkeys(ids))
    return chunks.filter(F.col(key).isin(wanted)).withColumn("position", F.array_position(text.strings(*wanted), F.col(key)).cast("int")).orderBy("position")
