"""Proposals under review, evidence for answers, and what triggers a closer look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any
from .retrieval import sent

# Words that ask for a closer look.
REASON_CUES = ["判断", "取舍", "复盘", "架构", "综合", "推理", "结论", "为什么", "tradeoff", "trade-off", "architecture", "reason", "synthesis", "decision", "review"]
CONFLICT_CUES = ["冲突", "矛盾", "conflict", "contradict", "disagree"]
CROSS_CUES = ["和", "与", "关系", "关联", "cross", "between", "compare", "versus"]
RAW_CUES = ["raw", "未整理", "未消化", "undigested", "source"]
TRIGGER_CONFIDENCE = 0.55


def backlog(proposals: DataFrame, states: DataFrame, cap: int) -> DataFrame:
    """Proposals of all runs, the newest run first, each id once, with its state; position counts from 1. proposals: run_id, line_no, id."""
    newest = [F.desc("run_id"), F.asc("line_no")]
    first = proposals.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy(*newest))).filter("_k = 1").drop("_k")
    kept = first.orderBy(*newest).limit(cap).withColumn("position", F.row_number().over(Window.orderBy(*newest)))
    return kept.join(states.withColumnRenamed("proposal_id", "id").withColumnRenamed("state", "status"), "id", "left").withColumn("status", F.coalesce("status", F.lit("proposal")))


def backlog_counts(proposals: DataFrame, cap: int) -> DataFrame:
    n = proposals.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("id").alias("ids"))
    return n.select("total", (F.col("total") - F.col("ids")).alias("duplicates"), (F.col("ids") > cap).alias("capped"))


def approvals(judged: DataFrame, allowed: DataFrame, asked: DataFrame) -> DataFrame:
    """What becomes of requests to approve: approved, or why not. judged: graph.judged; allowed: proposal_id; asked: id."""
    known = judged.select("id", F.coalesce("reject_reason", F.lit("")).alias("reason"), F.lit(True).alias("known"))
    listed = allowed.select(F.col("proposal_id").alias("id"), F.lit(True).alias("listed")).distinct()
    a = asked.join(known, "id", "left").join(listed, "id", "left")
    return a.select("id", F.when(F.col("known").isNull(), "unknown_proposal").when(F.col("reason") != "", F.col("reason")).when(F.col("listed").isNull(), "not_allowlisted").otherwise("approved").alias("decision"))


def diff_text(source: Column, target: Column, ident: Column, relation: Column, confidence: Column, status: Column, rationale: Column) -> Column:
    """A proposal as a textual difference. The layout is a fixed value."""
    head = F.format_string("--- a/%s\n+++ b/%s\n@@ semantic proposal %s\n", source, F.coalesce(target, F.lit("<missing-target>")), ident)
    body = F.format_string("relation: %s\nconfidence: %.3f\nstatus: %s\nrationale: %s\n", F.coalesce(relation, F.lit("unknown")), confidence, status, F.replace(rationale, F.lit("\n"), F.lit(" ")))
    return F.concat(head, body)


def evidence(notes: DataFrame, queries: DataFrame, most: int = 5, fallback: int = 3) -> DataFrame:
    """Notes that support a query: query_id, path, points, place. The whole phrase gives 3, each word 1; with no hit the first paths.

    notes: path, text; queries: query_id, raw.
    """
    q = queries.select("query_id", F.lower("raw").alias("phrase"), F.filter(F.split(F.lower("raw"), r"\s+"), lambda w: F.octet_length(w) >= 2).alias("words"))
    q = sent(q)
    text, path = F.lower("text"), F.lower("path")
    points = F.when((F.col("phrase") != "") & F.contains(text, F.col("phrase")), 3).otherwise(0) + F.size(F.filter("words", lambda w: F.contains(text, w) | F.contains(path, w)))
    hit = notes.join(q, F.exists("words", lambda w: F.contains(text, w) | F.contains(path, w)) | F.contains(text, F.col("phrase"))).select("query_id", "path", points.alias("points")).filter("points > 0")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("points"), "path"))
    best = hit.withColumn("place", place).filter(F.col("place") <= most)
    first = notes.select("path").orderBy("path").limit(fallback).withColumn("place", F.row_number().over(Window.orderBy("path")))
    rest = queries.select("query_id").join(best.select("query_id").distinct(), "query_id", "left_anti").join(first).select("query_id", "path", F.lit(0).alias("points"), "place")
    return best.unionByName(rest)


def trigger_reasons(query: Column, confidence: Column, paths: Column) -> Column:
    """Why a question asks for reasoning, sorted."""
    q = F.lower(query)
    raw = F.exists(paths, lambda p: p.startswith("raw/") | p.startswith("source/"))
    return F.array_sort(F.array_compact(F.array(
        F.when(contains_any(q, REASON_CUES), "explicit_high_level_intent"), F.when(confidence < TRIGGER_CONFIDENCE, "low_confidence"), F.when(contains_any(q, CONFLICT_CUES), "conflict"),
        F.when((F.size(paths) >= 2) & contains_any(q, CROSS_CUES), "cross_concept_synthesis"), F.when(raw & contains_any(q, RAW_CUES), "undigested_raw"),
    )))


def activated(edges: DataFrame, evidence_paths: DataFrame) -> DataFrame:
    """Edges that touch the evidence of a query; without any, an edge between its first two paths. evidence_paths: query_id, path, place."""
    e = evidence_paths.select("query_id", "path")
    by_end = lambda c: edges.join(e, F.col(c) == F.col("path")).select("query_id", "source_path", "target_path", "relation")
    touching = by_end("source_path").unionByName(by_end("target_path")).distinct()
    pair = evidence_paths.groupBy("query_id").agg(F.min_by("path", "place").alias("source_path"), F.max(F.when(F.col("place") == 2, F.col("path"))).alias("target_path")).filter("target_path is not null")
    made = pair.join(touching.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "source_path", "target_path", F.lit("related").alias("relation"))
    return touching.unionByName(made)


def answer_confidence(n_evidence: Column, n_relations: Column) -> Column:
    return F.least(0.45 + 0.08 * n_evidence + 0.05 * n_relations, F.lit(0.86))


def reasoning(notes: DataFrame, edges: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, reasons, evidence (paths), relations (count), confidence. queries: query_id, raw, confidence. Without a reason, no evidence."""
    found = evidence(notes, queries)
    paths = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("paths"))
    n = activated(edges, found).groupBy("query_id").agg(F.count(F.lit(1)).alias("relations"))
    q = queries.join(paths, "query_id", "left").join(n, "query_id", "left").withColumn("reasons", trigger_reasons(F.col("raw"), F.col("confidence"), F.col("paths")))
    on = F.size("reasons") > 0
    e, r = F.when(on, F.col("paths")).otherwise(F.array().cast("array<string>")), F.when(on, F.coalesce("relations", F.lit(0))).otherwise(F.lit(0))
    return q.select("query_id", "reasons", e.alias("evidence"), r.alias("n_relations"), F.when(on, answer_confidence(F.size("paths"), F.coalesce("relations", F.lit(0)))).alias("answer_confidence"))
