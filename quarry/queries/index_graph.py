"""Incremental index maintenance, the graph and its governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import governance, graph
from ..operators import index as ix
from .base import PARSED, VAULT, note_chunks, parsed, rows, table, values_sql, vault


def snapshots(spark, sf):
    """Two states of the vault: in the second, some notes are gone, some changed and some new."""
    now = vault(spark, sf).select("doc_id", "path", F.sha2(F.col("source").cast("binary"), 256).alias("hash"))
    old = now.filter("doc_id % 20 <> 7").select("path", F.when(F.col("doc_id") % 20 == 3, F.lit("other")).otherwise(F.col("hash")).alias("hash"))
    new = now.filter("doc_id % 20 <> 11").select("path", "hash")
    return old, new


def classified(spark, sf):
    return ix.classify(*snapshots(spark, sf))


def profile_changed(spark, sf):
    return ix.classify(*snapshots(spark, sf), profile_changed=True).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def reindexed(spark, sf):
    old, new = snapshots(spark, sf)
    table_ = old.withColumn("generation", F.lit(0))
    return ix.replaced(table_, new.withColumn("generation", F.lit(1)), ix.classify(old, new))


def cascaded(spark, sf):
    chunks = note_chunks(spark, sf).select("chunk_id", "path")
    vectors = chunks.select("chunk_id", F.length("path").alias("dim"))
    left, by_chunk = ix.cascade(chunks.filter("path like 'brain/%'").select("path"), chunks, vectors)
    return left.select("chunk_id").join(by_chunk, "chunk_id", "full_outer")


def upserted(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("v"))
    return ix.upsert(c, c.filter("c_custkey % 3 = 0").withColumn("v", F.col("v") + 1).unionByName(c.limit(0)), ["c_custkey"])


def reused(spark, sf):
    chunks = note_chunks(spark, sf).select("chunk_id", "path")
    vectors = chunks.filter("chunk_id like '%5'").select("chunk_id", F.when(F.col("chunk_id").like("%15"), "m2").otherwise("m1").alias("model"), F.lit(2).alias("dim"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    kept, todo = ix.reuse_vectors(chunks, vectors, "m1", 2)
    return kept.select("chunk_id", F.lit("reused").alias("state")).unionByName(todo.select("chunk_id", F.lit("embed").alias("state")))


def migrated(spark, sf):
    old = note_chunks(spark, sf).select("chunk_id", "text", "has_code")
    return ix.with_columns_added(old, {"has_code": F.lit(None), "has_link": F.col("text").contains("[[")}).drop("text")


def fingerprint(spark, sf):
    return spark.range(1).select(ix.space_fingerprint("mock", "m", 16, "exact").alias("fingerprint"))


SETTINGS = [("schema_version", "5"), ("model", "a"), ("dim", "16"), ("backend", "exact"), ("max_chars", "1200")]


def guarded(spark, sf):
    return ix.profile_mismatch(rows(spark, "key string, value string", SETTINGS), {"model": "b", "dim": "16", "max_chars": "800"})


def edges(spark, sf):
    return graph.link_edges(parsed(spark, sf)).select("id", "source_path", "target_path", "relation", "state", "confidence")


PROPOSALS = [
    ("p1", "brain/4.md", "brain/12.md", "supports", 0.9, ["brain/4.md", "brain/12.md"]), ("p2", "brain/4.md", "brain/12.md", " refines ", 1.7, ["brain/12.md"]), ("p3", "brain/4.md", None, "supports", 0.5, ["brain/4.md"]),
    ("p4", "../x.md", "brain/12.md", "supports", 0.5, ["brain/12.md"]), ("p5", "brain/4.md", "gone.md", "part_of", 0.5, ["gone.md"]), ("p6", "brain/4.md", "brain/12.md", "likes", 0.5, ["brain/12.md"]), ("p7", "brain/4.md", "brain/12.md", "replaces", 0.5, ["brain/4.md"]),
    ("p8", "brain/4.md", "brain/12.md", "depends_on", float("nan"), ["brain/12.md", "/abs.md"]), ("p9", "brain/20.md", "brain/12.md", "contradicts", -1.0, ["brain/12.md"]),
]
AUDIT = [(1, "p1", "approved"), (2, "p2", "rejected"), (3, "p2", "Approved"), (4, "p9", "unknown"), (5, "p9", "superseded"), (6, "p9", "??")]
P_SCHEMA = "id string, source_path string, target_path string, relation string, confidence double, evidence_paths array<string>"


def proposals(spark):
    return rows(spark, P_SCHEMA, PROPOSALS)


def audit(spark):
    return rows(spark, "line_no int, proposal_id string, status string", AUDIT)


def judged(spark, sf):
    return graph.judged(proposals(spark), parsed(spark, sf)).select("id", "reject_reason")


def last_states(spark, sf):
    return graph.audit_states(audit(spark))


def whole(spark, sf):
    built, _ = graph.rebuild(parsed(spark, sf), proposals(spark), audit(spark))
    return built.select("id", "source_path", "target_path", "relation", "state", "confidence", "proposal_id")


def explained(spark, sf):
    built = graph.link_edges(parsed(spark, sf))
    return graph.neighbourhood(built, rows(spark, "key string", [("brain/4.md",), ("wiki/en/3.md",)])).select("asked", "direction", "source_path", "target_path")


RUNS = [("run-1", 1, "a", 0.5), ("run-1", 2, "b", 0.6), ("run-2", 1, "b", 0.7), ("run-2", 2, "c", 0.8), ("run-3", 1, "a", 0.9), ("run-3", 2, "d", 0.1), ("run-3", 3, "a", 0.2)]


def backlog(spark, sf):
    r = rows(spark, "run_id string, line_no int, id string, confidence double", RUNS)
    a = rows(spark, "line_no int, proposal_id string, status string", [(1, "b", "rejected")])
    return governance.backlog(r, graph.audit_states(a), 3).select("id", "run_id", "status", "position")


def approvals(spark, sf):
    return governance.approvals(graph.judged(proposals(spark), parsed(spark, sf)), rows(spark, "proposal_id string", [("p1",), ("p2",), ("p5",)]), rows(spark, "id string", [("p1",), ("p5",), ("p9",), ("zz",)])).select("id", "decision")


QUERIES = {
    "a08_audit_states": last_states, "c01_classify": classified, "c01_profile_change": profile_changed, "c02_reindex": reindexed, "c05_reuse": reused, "c06_cascade": cascaded, "c07_upsert": upserted, "c09_migrate": migrated, "c10_fingerprint": fingerprint, "c08_p03_guard": guarded,
    "j01_link_edges": edges, "j02_judged": judged, "j05_j07_graph": whole, "j06_neighbourhood": explained, "n01_backlog": backlog, "n03_approvals": approvals,
}

_SNAP = f"""WITH {VAULT}, o AS (SELECT path, CASE WHEN doc_id % 20 = 3 THEN 'other' ELSE sha256(source) END AS hash FROM vault WHERE doc_id % 20 <> 7), n AS (SELECT path, sha256(source) AS hash FROM vault WHERE doc_id % 20 <> 11),
 c AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.hash <> n.hash THEN 'updated' ELSE 'unchanged' END AS change FROM o FULL JOIN n ON o.path = n.path)"""
_KEY = "lower(trim(regexp_extract(regexp_replace(trim(regexp_extract({0}, '^([^|#]*)', 1)), '\\.md$', ''), '([^/]*)$', 1)))"
_STEM = "lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.md$', ''))"
_ID = "'edge-' || substr(sha256(concat_ws(chr(0), source_path, relation, target_path, upper(substr(state, 1, 1)) || substr(state, 2), coalesce(proposal_id, ''))), 1, 16)"


def _edges(where: str = "TRUE") -> str:
    return f"""notes AS (SELECT * FROM parsed WHERE {where}), st AS (SELECT {_STEM} AS key, max(path) AS p FROM notes GROUP BY ALL), tt AS (SELECT {_KEY.format('title')} AS key, max(path) AS p FROM notes WHERE title IS NOT NULL GROUP BY ALL),
    ll AS (SELECT path AS source_path, {_KEY.format('link')} AS key FROM (SELECT path, unnest(links) AS link FROM notes)), le AS (SELECT DISTINCT source_path, coalesce(st.p, tt.p) AS target_path, 'supports' AS relation, 'active' AS state, 0.78 AS confidence, CAST(NULL AS VARCHAR) AS proposal_id
      FROM ll LEFT JOIN st USING (key) LEFT JOIN tt USING (key) WHERE coalesce(st.p, tt.p) <> source_path)"""


_P = [(i, s, t, r, None if c != c else c, e) for i, s, t, r, c, e in PROPOSALS]
_PROP = values_sql("proposals", "id, source_path, target_path, relation, confidence, evidence_paths", _P)
_AUD = values_sql("audit", "line_no, proposal_id, status", AUDIT) + ", states AS (SELECT proposal_id, arg_max(CASE lower(trim(status)) WHEN 'approved' THEN 'active' ELSE lower(trim(status)) END, line_no) AS state FROM audit WHERE lower(trim(status)) IN ('approved', 'rejected', 'superseded') GROUP BY proposal_id)"
_BAD = "({0} IS NULL OR {0} NOT IN (SELECT path FROM {1}) OR starts_with({0}, '/') OR contains({0}, '..'))"


def _judged(of: str) -> str:
    return f"""judged AS (SELECT *, CASE WHEN trim(relation) NOT IN ('supports', 'refines', 'contradicts', 'replaces', 'depends_on', 'part_of') THEN 'relation_not_allowed' WHEN {_BAD.format('source_path', of)} THEN 'unsafe_or_missing_source_path' WHEN target_path IS NULL THEN 'missing_target_path'
      WHEN {_BAD.format('target_path', of)} THEN 'unsafe_or_missing_target_path' WHEN EXISTS (SELECT 1 FROM (SELECT unnest(evidence_paths) AS e) WHERE e NOT IN (SELECT path FROM {of})) THEN 'unsafe_or_missing_evidence_path' WHEN NOT list_contains(evidence_paths, target_path) THEN 'target_not_in_evidence' END AS reject_reason FROM proposals)"""


SQL = {
    "a08_audit_states": f"WITH {_AUD} SELECT proposal_id, state FROM states",
    "c01_classify": f"{_SNAP} SELECT * FROM c",
    "c01_profile_change": f"{_SNAP} SELECT CASE WHEN change = 'unchanged' THEN 'updated' ELSE change END AS change, count(*) AS n FROM c GROUP BY ALL",
    "c02_reindex": f"{_SNAP} SELECT path, n.hash, CASE WHEN change = 'unchanged' THEN 0 ELSE 1 END AS generation FROM c JOIN n USING (path) WHERE change <> 'deleted'",
    "c05_reuse": f"WITH {VAULT} SELECT concat('chk_', lpad(CAST(doc_id AS VARCHAR), 8, '0')) AS chunk_id, CASE WHEN doc_id % 10 = 5 AND doc_id % 100 <> 15 THEN 'reused' ELSE 'embed' END AS state FROM vault",
    "c06_cascade": f"WITH {VAULT} SELECT concat('chk_', lpad(CAST(doc_id AS VARCHAR), 8, '0')) AS chunk_id, length(path) AS dim FROM vault WHERE NOT starts_with(path, 'brain/')",
    "c07_upsert": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS v FROM customer",
    "c09_migrate": f"WITH {VAULT} SELECT concat('chk_', lpad(CAST(doc_id AS VARCHAR), 8, '0')) AS chunk_id, contains(source, chr(10) || '```') AS has_code, contains(source, '[[') AS has_link FROM vault",
    "c10_fingerprint": "SELECT sha256(concat('mock', chr(0), 'm', chr(0), '16', chr(0), 'exact')) AS fingerprint",
    "c08_p03_guard": "SELECT * FROM (VALUES ('model', 'a', 'b'), ('max_chars', '1200', '800')) t(key, stored, expected)",
    "j01_link_edges": f"WITH {PARSED}, {_edges()} SELECT {_ID} AS id, source_path, target_path, relation, state, confidence FROM le",
    "j02_judged": f"WITH {PARSED}, {_PROP}, {_judged('parsed')} SELECT id, reject_reason FROM judged",
    "j05_j07_graph": f"""WITH {PARSED}, {_edges("TRUE")}, {_PROP}, {_AUD}, {_judged('notes')}, pe AS (SELECT source_path, target_path, trim(relation) AS relation, coalesce(state, 'proposal') AS state, CASE WHEN confidence IS NULL THEN 0 ELSE least(greatest(confidence, 0), 1) END AS confidence, id AS proposal_id FROM judged LEFT JOIN states ON id = states.proposal_id WHERE reject_reason IS NULL),
      e AS (SELECT * FROM le UNION ALL SELECT * FROM pe), k AS (SELECT source_path, target_path FROM e WHERE state = 'active' GROUP BY ALL HAVING count(DISTINCT relation) > 1),
      m AS (SELECT e.* REPLACE (CASE WHEN state = 'active' AND (source_path, target_path) IN (SELECT (source_path, target_path) FROM k) THEN 'conflict' ELSE state END AS state) FROM e) SELECT {_ID} AS id, source_path, target_path, relation, state, confidence, proposal_id FROM m""",
    "j06_neighbourhood": f"WITH {PARSED}, {_edges()} SELECT source_path AS asked, 'outgoing' AS direction, source_path, target_path FROM le WHERE source_path IN ('brain/4.md', 'wiki/en/3.md') UNION ALL SELECT target_path, 'incoming', source_path, target_path FROM le WHERE target_path IN ('brain/4.md', 'wiki/en/3.md')",
    "n01_backlog": f"WITH {values_sql('r', 'run_id, line_no, id, confidence', RUNS)}, f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY run_id DESC, line_no) AS k FROM r), o AS (SELECT *, row_number() OVER (ORDER BY run_id DESC, line_no) AS position FROM f WHERE k = 1) SELECT id, run_id, CASE WHEN id = 'b' THEN 'rejected' ELSE 'proposal' END AS status, position FROM o WHERE position <= 3",
    "n03_approvals": "SELECT * FROM (VALUES ('p1', 'approved'), ('p5', 'unsafe_or_missing_target_path'), ('p9', 'not_allowlisted'), ('zz', 'unknown_proposal')) t(id, decision)",
}
