"""The typed knowledge graph: edges from links and proposals, ids, conflicts and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markdown import link_key, path_stem
from ..functions.text import strings
from ..sources.vault import unsafe_path

RELATIONS = ("supports", "refines", "contradicts", "replaces", "depends_on", "part_of")
#: Audit words to states.
STATES = {"approved": "active", "accepted": "active", "active": "active", "rejected": "rejected", "superseded": "superseded", "proposal": "proposal", "proposed": "proposal", "pending": "proposal", "conflict": "conflict"}
LINK_CONFIDENCE = 0.78


def edge_id(source: Column, relation: Column, target: Column, state: Column, proposal: Column) -> Column:
    """Deterministic: the parts' digest, the state with a capital."""
    seed = F.concat_ws("\u0000", source, relation, target, F.initcap(state), F.coalesce(proposal, F.lit("")))
    return F.concat(F.lit("edge-"), F.substring(F.sha2(seed.cast("binary"), 256), 1, 16))


def with_ids(edges: DataFrame) -> DataFrame:
    return edges.withColumn("id", edge_id(F.col("source_path"), F.col("relation"), F.col("target_path"), F.col("state"), F.col("proposal_id")))


def link_edges(notes: DataFrame) -> DataFrame:
    """Active `supports` edges from links: a key names a note by its stem first, else by its title; of several the last path counts."""
    stems = notes.groupBy(F.trim(path_stem(F.col("path"))).alias("key")).agg(F.max("path").alias("by_stem"))
    titles = notes.filter("title is not null").groupBy(link_key(F.col("title")).alias("key")).agg(F.max("path").alias("by_title"))
    links = notes.select("path", F.explode("links").alias("link")).select(F.col("path").alias("source_path"), link_key(F.col("link")).alias("key")).distinct()
    found = links.join(stems, "key", "left").join(titles, "key", "left").withColumn("target_path", F.coalesce("by_stem", "by_title")).filter("target_path is not null and target_path <> source_path")
    edges = found.select("source_path", "target_path").distinct().select(
        "source_path", "target_path", F.lit("supports").alias("relation"), F.lit("active").alias("state"), F.lit(LINK_CONFIDENCE).alias("confidence"), F.lit("link").alias("source"), F.lit(None).cast("string").alias("proposal_id"), F.array("source_path", "target_path").alias("evidence_paths"))
    return with_ids(edges)


def audit_states(audit: DataFrame) -> DataFrame:
    """proposal_id, state: the last known word of each. audit: line_no, proposal_id, status."""
    state = F.lit(None).cast("string")
    for word, name in STATES.items():
        state = F.when(F.lower(F.trim("status")) == word, name).otherwise(state)
    return audit.withColumn("state", state).filter("state is not null").groupBy("proposal_id").agg(F.max_by("state", "line_no").alias("state"))


def judged(proposals: DataFrame, files: DataFrame) -> DataFrame:
    """Adds reject_reason, null for sound ones. proposals: id, source_path, target_path, relation, evidence_paths; files: path.

    Paths must be relative, inside the vault and known; the target must be among the evidence. The first fault counts.
    """
    known = files.select("path").distinct()
    paths = proposals.select("id", F.explode(F.array_distinct(F.concat(F.array("source_path"), F.when(F.col("target_path").isNotNull(), F.array("target_path")).otherwise(strings()), "evidence_paths"))).alias("path"))
    bad = paths.join(known.withColumn("known", F.lit(True)), "path", "left").filter(F.col("known").isNull() | unsafe_path(F.col("path")).isNotNull())
    bad = bad.groupBy("id").agg(F.collect_set("path").alias("bad"))
    p = proposals.join(bad, "id", "left").withColumn("bad", F.coalesce("bad", strings()))
    reason = (
        F.when(~F.coalesce(F.trim("relation").isin(*RELATIONS), F.lit(False)), "relation_not_allowed").when(F.array_contains("bad", F.col("source_path")), "unsafe_or_missing_source_path")
        .when(F.col("target_path").isNull(), "missing_target_path").when(F.array_contains("bad", F.col("target_path")), "unsafe_or_missing_target_path")
        .when(F.arrays_overlap("bad", "evidence_paths"), "unsafe_or_missing_evidence_path").when(~F.array_contains("evidence_paths", F.col("target_path")), "target_not_in_evidence")
    )
    return p.withColumn("reject_reason", reason).drop("bad")


def proposal_edges(proposals: DataFrame, files: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of sound proposals, in the state of the audit or proposed; and the others with their reasons."""
    found = judged(proposals, files)
    sound = found.filter("reject_reason is null").join(states.withColumnRenamed("proposal_id", "id"), "id", "left")
    confidence = F.when(F.isnan("confidence") | F.col("confidence").isNull() | (F.abs("confidence") == float("inf")), 0.0).otherwise(F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)))
    edges = sound.select("source_path", "target_path", F.trim("relation").alias("relation"), F.coalesce("state", F.lit("proposal")).alias("state"), confidence.alias("confidence"), F.lit("proposal").alias("source"), F.col("id").alias("proposal_id"), "evidence_paths")
    return with_ids(edges), found.filter("reject_reason is not null").select("id", "source_path", "target_path", "relation", "reject_reason")


def first_of_each(rows: DataFrame, order: list, by: str = "id") -> DataFrame:
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter("_place = 1").drop("_place")


def mark_conflicts(edges: DataFrame) -> DataFrame:
    """Active edges of a pair with more than one relation become conflicts, with new ids."""
    pair = Window.partitionBy("source_path", "target_path")
    relations = F.size(F.collect_set(F.when(F.col("state") == "active", F.col("relation"))).over(pair))
    marked = edges.withColumn("state", F.when((F.col("state") == "active") & (relations > 1), "conflict").otherwise(F.col("state")))
    return with_ids(marked.drop("id"))


def rebuild(notes: DataFrame, proposals: DataFrame, audit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole graph and the rejected proposals."""
    from_proposals, rejected = proposal_edges(proposals, notes, audit_states(audit))
    every = first_of_each(link_edges(notes).unionByName(from_proposals), ["source", "confidence"])
    return mark_conflicts(every), rejected


def neighbourhood(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """Edges that touch an asked path or have an asked id: asked, direction, id and ends. asked: key."""
    sides = [edges.join(asked, F.col(c) == F.col("key")).select(F.col("key").alias("asked"), F.lit(d).alias("direction"), "id", "source_path", "target_path", "relation", "state") for c, d in (("id", "edge"), ("source_path", "outgoing"), ("target_path", "incoming"))]
    return sides[0].unionByName(sides[1]).unionByName(sides[2])
