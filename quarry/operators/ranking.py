"""What happens to results after retrieval: final score, validity, order, diversity, reranking and evidence."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring, temporal
from ..functions.markdown import SCALARS
from ..functions.text import squeezed, uri_component
from ..functions.tiers import event_time, evidence_type, source_tier

MMR_LAMBDA, MMR_MARGIN, MMR_PER_FILE = 0.72, 0.12, 2
SNIPPET_BEFORE, SNIPPET_AFTER, SNIPPET_GAP, SNIPPET_WINDOWS, SNIPPET_CHARS = 30, 60, 12, 3, 180


def finite(score: Column) -> Column:
    """The score, with NaN and infinities last."""
    lost = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    return F.when(lost, F.lit(float("-inf"))).otherwise(score)


def result_order(score: str = "score") -> list:
    return [F.desc(finite(F.col(score))), F.asc("path"), F.asc("line_start"), F.asc("chunk_id")]


def final_score(rows: DataFrame, now: Column, boosts: bool = True) -> DataFrame:
    """rows: materialised candidates joined with their queries (scoring_text, intent). Adds each part of the score and `score`."""
    flag = lambda c: c if boosts else F.lit(0.0)
    parts = rows.withColumns({"source_tier": source_tier(F.col("path"), F.col("source_type")), "event_time": event_time(F.col("path"), F.col("valid_from"), F.col("updated"), F.col("mtime"))})
    parts = parts.withColumn("evidence_type", evidence_type(F.col("source_tier")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    parts = parts.withColumns({
        "fusion": scoring.rrf(F.col("keyword_rank"), F.col("vector_rank")),
        "path_boost": scoring.path_boost(F.col("path"), F.col("scoring_text")), "tag_boost": scoring.tag_boost(F.col("tags"), F.col("scoring_text")),
        "route_boost": zero("route_score") + zero("tier_score"), "recency_boost": scoring.recency_boost(F.col("mtime"), now),
        "metadata_boost": flag(scoring.metadata_boost(*[F.col(c) for c in ("has_code", "has_link", "has_task_list", "has_incomplete_tasks", "confidence", "status", "source_type")])),
        "tier_boost": flag(scoring.by_intent(F.col("intent"), F.col("source_tier"), scoring.TIER_BOOSTS)),
        "intent_boost": flag(scoring.by_intent(F.col("intent"), F.col("evidence_type"), scoring.EVIDENCE_BOOSTS)),
        "event_boost": flag(F.when(F.col("event_time").isNotNull(), scoring.pick(F.col("intent"), scoring.EVENT_BOOSTS)).otherwise(0.0)),
    })
    total = scoring.KEYWORD_WEIGHT * zero("keyword_score") + scoring.VECTOR_WEIGHT * zero("vector_score")
    for part in ("fusion", "path_boost", "tag_boost", "route_boost", "recency_boost", "metadata_boost", "tier_boost", "intent_boost", "event_boost"):
        total = total + F.col(part)
    reasons = F.concat(F.coalesce("route_reasons", F.array().cast("array<string>")), F.coalesce("tier_reasons", F.array().cast("array<string>")))
    return parts.withColumns({"score": total, "sources": scoring.sources_of(F.col("keyword_rank").isNotNull(), F.col("vector_rank").isNotNull(), reasons)})


def temporal_quality(rows: DataFrame, query: Column, at: Column, historical: bool = False, mode: str = "balanced", boosts: bool = True, include_stale: bool = False) -> DataFrame:
    """Adds validity and the temporal boosts. at: the date of reference; historical: it was asked for."""
    past = F.lit(historical)
    out = rows.withColumns({"age_days": temporal.age_days(F.col("updated"), F.col("mtime"), at), "stale_reason": temporal.stale_reason(F.col("status"), F.col("valid_from"), F.col("valid_until"), F.col("superseded_by"), at, past)})
    out = out.withColumn("validity_state", temporal.validity_state(F.col("stale_reason"), past))
    applies = temporal.has_temporal_metadata(*[F.col(c) for c in SCALARS]) | past | temporal.recent_cue(query) | temporal.oldest_cue(query) | F.lit(mode in ("recent", "oldest"))
    when = lambda c: F.when(applies, c).otherwise(0.0) if boosts else F.lit(0.0)
    out = out.withColumns({
        "freshness_boost": when(temporal.freshness_boost(mode, query, F.col("age_days"), F.col("validity_state"))), "confidence_boost": when(temporal.confidence_boost(F.col("confidence"))),
        "status_boost": when(temporal.status_boost(F.col("status"), F.col("validity_state"))), "evidence_boost": when(temporal.evidence_boost(F.size("sources"))),
    })
    out = out.withColumns({"score": F.col("score") + F.col("freshness_boost") + F.col("confidence_boost") + F.col("status_boost") + F.col("evidence_boost"), "sources": F.when(applies, F.array_union("sources", F.array(F.lit("temporal")))).otherwise(F.col("sources"))})
    return out if include_stale else out.filter("validity_state <> 'stale'")


def graph_boosted(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows whose note has active edges gain by their number, within bounds. edges: source_path, target_path, state."""
    ends = edges.filter("state = 'active'").select(F.explode(F.array_distinct(F.array("source_path", "target_path"))).alias("path"))
    counts = ends.groupBy("path").agg(F.count(F.lit(1)).alias("active_edges"))
    out = rows.join(counts, "path", "left").withColumn("graph_boost", scoring.graph_boost(F.col("score"), F.coalesce("active_edges", F.lit(0))))
    return out.withColumns({"score": F.col("score") + F.col("graph_boost"), "sources": F.when(F.col("graph_boost") > 0, F.array_union("sources", F.array(F.lit("graph")))).otherwise(F.col("sources"))}).drop("active_edges")


def quality_summary(rows: DataFrame) -> DataFrame:
    boosts = [F.col(c) for c in ("freshness_boost", "confidence_boost", "status_boost", "evidence_boost")]
    return rows.withColumns({"quality": F.struct(*boosts, (boosts[0] + boosts[1] + boosts[2] + boosts[3]).alias("total_boost")), "evidence_count": F.size("sources")})


def diverse(per_file: int = MMR_PER_FILE, weight: float = MMR_LAMBDA, margin: float = MMR_MARGIN, limit: int = 10) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Greedy choice for one query: relevance against files already chosen.

    A row loses 1 - weight if its file was chosen, 1 more if it lies further than the margin below the best row left, and 1 more if its
    file has its share. The first `limit` are chosen so, the rest follow in order.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order_no"])
        left, chosen, used = list(rows.itertuples(index=False)), [], {}
        while left and len(chosen) < limit:
            best = max(r.relevance for r in left)

            def worth(r):
                n = used.get(r.path, 0)
                return weight * r.relevance - (1 - weight) * (n > 0) - (bool(chosen) and best - r.relevance > margin) - (n >= per_file)

            pick = left[0]
            for r in left[1:]:
                if worth(r) > worth(pick) or (worth(r) == worth(pick) and r.path < pick.path and r.line_start <= pick.line_start):
                    pick = r
            left.remove(pick)
            chosen.append(pick)
            used[pick.path] = used.get(pick.path, 0) + 1
        out = pd.DataFrame(chosen + left, columns=rows.columns)
        out["diverse_rank"] = range(1, len(out) + 1)
        return out[["query_id", "chunk_id", "diverse_rank"]]

    return run


def diversify(results: DataFrame, limit: int = 10, **options) -> DataFrame:
    """Adds diverse_rank: at most a pool (200 rows) of each query goes to one Python call; only ids, paths and scores do."""
    narrow = results.select("query_id", "chunk_id", "path", "line_start", finite(F.col("score")).alias("relevance"), F.row_number().over(Window.partitionBy("query_id").orderBy(*result_order())).alias("order_no"))
    found = narrow.groupBy("query_id").applyInPandas(diverse(limit=limit, **options), "query_id string, chunk_id string, diverse_rank int")
    return results.join(found, ["query_id", "chunk_id"])


def top(results: DataFrame, limit: int, by: list | None = None) -> DataFrame:
    """The first rows of each query with `rank`."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*(by or result_order())))
    return results.withColumn("rank", place).filter(F.col("rank") <= limit)


def reranked(results: DataFrame, model_score: Column) -> DataFrame:
    """A model's score, held to [0, 1], leads; the old score breaks near ties."""
    clamped = F.least(F.greatest(model_score, F.lit(0.0)), F.lit(1.0))
    return results.withColumns({"reranker_score": clamped, "score": clamped + 0.01 * F.col("score"), "sources": F.array_union("sources", F.array(F.lit("reranker")))})


def rerank_text(title: Column, heading: Column, path: Column, text: Column, most: int = 2000) -> Column:
    return F.concat_ws("\n", title, heading, path, F.substring(text, 1, most))


def keyword_only_penalty(results: DataFrame, ratio: float) -> DataFrame:
    """Multiplies the score of rows that only keywords found."""
    alone = (F.size("sources") == 1) & F.array_contains("sources", "keyword")
    return results.withColumns({"optimizer_adjustment": F.when(alone, F.col("score") * (ratio - 1)).otherwise(0.0), "score": F.when(alone, F.col("score") * ratio).otherwise(F.col("score"))})


def file_diverse(results: DataFrame) -> DataFrame:
    """The first row of each file, then the others, in order: adds position. results: query_id, rank, path."""
    again = F.when(F.row_number().over(Window.partitionBy("query_id", "path").orderBy("rank")) == 1, 0).otherwise(1)
    return results.withColumn("again", again).withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("again", "rank"))).drop("again")


def overlap_tokens(text: Column) -> Column:
    """Distinct ASCII words of two letters or more, and single CJK characters."""
    return F.array_distinct(F.concat(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{2,}"), 0), F.regexp_extract_all(text, F.lit("[一-鿿]"), 0)))


def proposal_boost(results: DataFrame, proposals: DataFrame, least_overlap: int = 2) -> DataFrame:
    """Results near the top row by a proposal rise; the top row stays first. Adds side_boost and boosted_rank.

    results: query_id, rank, path, score, query; proposals: source_path, target_path, confidence, accepted, summary. A proposal counts if
    it joins the top row's path with the row's and shares `least_overlap` tokens with the query.
    """
    anchor = results.filter("rank = 1").select("query_id", F.col("path").alias("anchor"))
    p = proposals.select("source_path", "target_path", "confidence", "accepted", overlap_tokens(F.col("summary")).alias("p_tokens"))
    both = p.unionByName(p.select(F.col("target_path").alias("source_path"), F.col("source_path").alias("target_path"), "confidence", "accepted", "p_tokens"))
    near = results.join(anchor, "query_id").join(both, (F.col("anchor") == F.col("source_path")) & (F.col("path") == F.col("target_path")))
    near = near.filter(F.size(F.array_intersect(overlap_tokens(F.col("query")), "p_tokens")) >= least_overlap)
    gain = F.when(F.col("accepted"), F.least(0.055 * F.col("confidence"), F.lit(0.075))).otherwise(F.least(0.035 * F.col("confidence"), F.lit(0.05)))
    gains = near.groupBy("query_id", "chunk_id").agg(F.max(gain).alias("side_boost"))
    out = results.join(gains, ["query_id", "chunk_id"], "left").withColumn("side_boost", F.coalesce("side_boost", F.lit(0.0)))
    return out.withColumn("boosted_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.when(F.col("rank") == 1, 0).otherwise(1), F.desc(F.col("score") + F.col("side_boost")), "rank")))


def snippet(text: Column, query_terms: Column) -> Column:
    """Up to three parts around the first place of each term, joined; the text's beginning without one. query_terms: folded, distinct, sorted."""
    length = F.length(text)
    places = F.transform(query_terms, lambda t: F.struct(F.instr(F.lower(text), t).alias("p"), F.length(t).alias("n")))
    windows = F.transform(F.filter(places, lambda w: w["p"] > 0), lambda w: F.struct(F.greatest(w["p"] - 1 - SNIPPET_BEFORE, F.lit(0)).alias("s"), F.least(w["p"] - 1 + w["n"] + SNIPPET_AFTER, length).alias("e")))

    def add(merged: Column, w: Column) -> Column:
        last = F.element_at(merged, -1)
        joined = F.concat(F.slice(merged, F.lit(1), F.size(merged) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], w["e"]).alias("e"))))
        return F.when((F.size(merged) > 0) & (w["s"] <= F.try_element_at(merged, F.lit(-1))["e"] + SNIPPET_GAP), joined).otherwise(F.concat(merged, F.array(w)))

    merged = F.aggregate(F.array_sort(windows), F.array().cast("array<struct<s:int,e:int>>"), add)
    parts = F.transform(F.slice(merged, 1, SNIPPET_WINDOWS), lambda w: squeezed(F.substring(text, w["s"] + 1, w["e"] - w["s"])))
    return F.when(F.size(merged) == 0, squeezed(F.substring(text, 1, SNIPPET_CHARS))).otherwise(F.array_join(F.filter(parts, lambda p: p != ""), " … "))


def evidence_uri(chunk_id: Column, scheme: str = "quarry") -> Column:
    return F.concat(F.lit(f"{scheme}://chunk/"), uri_component(chunk_id))


def open_uri(path: Column, line: Column, scheme: str = "obsidian") -> Column:
    return F.concat(F.lit(f"{scheme}://open?path="), uri_component(path), F.lit("&line="), line.cast("string"))


def card(results: DataFrame) -> DataFrame:
    """The compact view: no text; the title falls back to the heading, then the path."""
    dropped = [c for c in ("text", "snippet", "context") if c in results.columns]
    return results.withColumn("title", F.coalesce("title", "heading", "path")).drop(*dropped)


def as_json_lines(results: DataFrame, columns: list[str]) -> DataFrame:
    return results.select("query_id", "rank", F.to_json(F.struct("rank", *columns)).alias("line"))
