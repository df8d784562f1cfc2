"""A batch of searches as one plan: branches, pool, links, validity, reranking, diversity, threshold and top k."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import filters, query_analysis, ranking, retrieval
from ..operators.index import Index
from ..sources.shared import settled


@dataclass(frozen=True)
class SearchOptions:
    limit: int = 10
    filter: str | None = None
    expand: bool = False
    link_depth: int = 0
    include_stale: bool = False
    as_of: str | None = None
    freshness: str = "balanced"
    boosts: bool = True
    min_score: float | None = None
    diverse: bool = True
    text_only_ratio: float = 1.0
    stopwords: tuple[str, ...] = ()
    reranker: Column | None = None
    edges: DataFrame | None = None

    def __post_init__(self):
        if not 1 <= self.limit <= 50:
            raise ValueError("the limit is 1 to 50")
        if self.link_depth not in (0, 1):
            raise ValueError("links are followed to depth 1 at most")
        if self.freshness not in ("off", "balanced", "recent", "oldest"):
            raise ValueError(f"unknown freshness mode {self.freshness}")


def check_space(vectors_model: tuple, query_model: tuple) -> None:
    """Vectors of different models or sizes are never compared."""
    if vectors_model != query_model:
        raise ValueError(f"the index holds vectors of {vectors_model}, the query is of {query_model}")


def search(index: Index, queries: DataFrame, now: str, options: SearchOptions = SearchOptions(), query_vectors: DataFrame | None = None) -> DataFrame:
    """Results of all queries: query_id, rank, chunk_id, path, line_start, score, its parts, sources, validity and evidence.

    The filter goes to the chunks before any branch takes its best rows, so it reaches the scan and no branch loses matches to it.
    Sizes are those of all chunks. The analyzed queries and the pool, ids and scores only, are settled once: what follows reads
    them several times.
    """
    chunks = filters.apply_filter(index.chunks, options.filter)
    asked = settled(query_analysis.analyze(queries, options.expand, list(options.stopwords)))
    terms = retrieval.query_terms(asked)
    postings = index.postings if not options.filter else index.postings.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    keyword = retrieval.keyword_candidates(postings, terms, index.size, words=index.words)
    if index.vectors is not None and query_vectors is not None:
        held = index.vectors if not options.filter else index.vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
        vector = retrieval.vector_candidates(held, query_vectors)
    else:
        vector = keyword.sparkSession.createDataFrame([], "query_id string, chunk_id string, vector_rank int, vector_score double")
    pooled = settled(retrieval.pool(keyword, vector, retrieval.route_candidates(chunks, asked), retrieval.tier_candidates(chunks, asked)))
    rows = retrieval.materialise(pooled, chunks).join(asked.select("query_id", "raw", "scoring_text", "intent", "route"), "query_id")
    reference = F.lit(options.as_of or now).cast("date")
    rows = ranking.final_score(rows, F.lit(now).cast("timestamp"), options.boosts)
    if options.link_depth:
        rows = settled(rows)
        near = settled(retrieval.expand_links(rows.select("query_id", "chunk_id", "score"), chunks, options.limit))
        old = rows.join(near.select("query_id", "chunk_id", "link_boost"), ["query_id", "chunk_id"], "left").withColumns({"score": F.col("score") + F.coalesce("link_boost", F.lit(0.0)), "sources": F.when(F.col("link_boost").isNotNull(), F.array_union("sources", F.array(F.lit("link")))).otherwise(F.col("sources"))})
        blank = {c: F.lit(None).cast(t) for c, t in dict(pooled.dtypes).items() if c not in ("query_id", "chunk_id")}
        new = near.filter("is_new").select("query_id", "chunk_id", "link_boost").withColumns(blank).join(chunks, "chunk_id").join(asked.select("query_id", "raw", "scoring_text", "intent", "route"), "query_id")
        new = ranking.final_score(new, F.lit(now).cast("timestamp"), options.boosts).withColumns({"score": F.col("score") + F.col("link_boost"), "sources": F.array_union("sources", F.array(F.lit("link")))})
        rows = old.unionByName(new)
    rows = ranking.temporal_quality(rows, F.col("raw"), reference, bool(options.as_of), options.freshness, options.boosts, options.include_stale)
    if options.edges is not None:
        rows = ranking.graph_boosted(rows, options.edges)
    if options.reranker is not None:
        rows = ranking.reranked(rows, options.reranker)
    if options.text_only_ratio != 1.0:
        rows = ranking.keyword_only_penalty(rows, options.text_only_ratio)
    if options.diverse:
        ordered = ranking.diversify(rows, options.limit)
        rows = filters.above_score(ordered, options.min_score)
        return ranking.top(rows, options.limit, [F.asc("diverse_rank")]).drop("diverse_rank")
    return ranking.top(filters.above_score(rows, options.min_score), options.limit)


def trace(index: Index, queries: DataFrame) -> DataFrame:
    """How many rows each branch gives each query: query_id, stage, rows."""
    asked = settled(query_analysis.analyze(queries))
    chunks = index.chunks
    stages = {"keyword": retrieval.keyword_candidates(index.postings, retrieval.query_terms(asked), index.size, words=index.words), "route": retrieval.route_candidates(chunks, asked), "tier": retrieval.tier_candidates(chunks, asked)}
    out = None
    for name, df in stages.items():
        counted = df.groupBy("query_id").agg(F.count(F.lit(1)).alias("rows")).select("query_id", F.lit(name).alias("stage"), "rows")
        out = counted if out is None else out.unionByName(counted)
    return out
