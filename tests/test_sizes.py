"""Results do not depend on slices and blocks, and what a step keeps or repeats is bounded."""

import hashlib
import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import chunking, evaluation, retrieval, similarity
from quarry.queries import base
from quarry.sources.shared import shared_folder

SF = "/root/testdata/sf0.001"


def kept_bytes(spark):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(shared_folder(spark).removeprefix("file:")) for f in names)


def plain_lexical(feats, pairs, most):
    """The best of each source by the definition: containment of tokens and tags, the scope, the floor."""
    out = {}
    for s, t in pairs:
        (stok, stag, sscope), (ttok, ttag, tscope) = feats[s], feats[t]
        if sscope and tscope and sscope != tscope:
            continue
        part = lambda a, b: len(a & b) / min(len(a), len(b)) if a and b else 0.0
        token, tag = part(stok, ttok), part(stag, ttag)
        score = min(0.72 * token + 0.28 * tag, 1.0)
        if score >= similarity.LEXICAL_FLOOR or tag > 0:
            out.setdefault(s, []).append((-round(max(score, 0.18 * tag), 9), t))
    return {(s, t, k) for s, found in out.items() for k, (_, t) in enumerate(sorted(found)[:most], 1)}


@pytest.mark.parametrize("slice_notes, codes", [(7, 20), (1000, 32_767)])
def test_lexical_scores_in_slices(spark, monkeypatch, slice_notes, codes):
    monkeypatch.setattr(similarity, "SLICE_NOTES", slice_notes)
    monkeypatch.setattr(similarity, "SHORT_CODES", codes)
    feats = similarity.features(base.parsed(spark, SF)).limit(40).persist()
    f = similarity.numbered_features(feats)
    counts = similarity.item_counts(f)
    pools = similarity.pooled(f, counts)
    held = {r.path: (set(r.tokens), set(r.tags), r.scope) for r in feats.withColumn("scope", similarity.scope(F.col("path"), F.col("tags"))).collect()}
    pairs = [(r.source_path, r.target_path) for r in similarity.with_paths(f, similarity.each_pair(pools)).collect()]
    found = {(r.source_path, r.target_path, r["rank"]) for r in similarity.with_paths(f, similarity.lexical_best(f, counts, pools, 3)).collect()}
    assert found == plain_lexical(held, pairs, 3)


def test_candidates_keep_little_on_disk(spark):
    """Sets are kept once, as columns: whole rows of tokens and index entries took ten times the input."""
    from quarry.queries import similarity as queries

    before = kept_bytes(spark)
    queries.pools(spark, "/root/testdata/sf0.01").write.format("noop").mode("overwrite").save()
    assert kept_bytes(spark) - before < 2 * os.path.getsize("/root/testdata/sf0.01/documents.parquet")


@pytest.mark.parametrize("block, ids", [(2, 3), (2048, 4_000_000)])
def test_links_in_blocks(spark, monkeypatch, block, ids):
    monkeypatch.setattr(retrieval, "LINK_BLOCK", block)
    monkeypatch.setattr(retrieval, "LINK_IDS", ids)
    rows = [(f"c{k}", f"n/{k}.md", "Hot" if k % 2 else f"{k}" if k % 3 else None, ["Hot", f"{k + 1}", "x/0.md|zero", " "] if k % 4 < 2 else ["hot#part"]) for k in range(12)]
    chunks = spark.createDataFrame(rows, "chunk_id string, path string, title string, links array<string>")
    keys = {c: {p[2:-3].lower(), (t or "").lower()} - {""} for c, p, t, _ in rows}
    named = {c: {x.split("|")[0].split("#")[0].split("/")[-1].removesuffix(".md").strip().lower() for x in links} - {""} for c, _, _, links in rows}
    want = sorted((s, t) for s in named for t in keys if s != t and named[s] & keys[t])
    links = retrieval.outgoing_links(chunks)
    assert sorted((r.source_id, r.target_id) for r in links.collect()) == want
    evidence = {r.chunk_id: r.backlinks for r in retrieval.link_evidence(chunks).collect()}
    assert evidence == {c: sorted(s for s, t in want if t == c) for c in keys}
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]  # pairs aren't shuffled to be told apart


def test_manifest_seal_is_the_digest_of_all_buckets(spark):
    """Of many buckets too: a tree of digests gave another one beyond 64 of them."""
    files = spark.range(1000).select(F.format_string("p%04d", "id").alias("path"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("hash"), F.col("id").alias("size"))
    held = evaluation.manifest(files, 300)
    seal = evaluation.manifest_digest(held).collect()
    digests = [r.digest for r in held.orderBy("bucket").collect()]
    assert [(r.digest, r.files, r.bytes) for r in seal] == [(hashlib.sha256("".join(digests).encode()).hexdigest(), 1000, 499_500)]


def peak_mb(run):
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def test_nearest_holds_few_distances_at_once():
    rng = np.random.default_rng(0)
    queries = [(str(k), v) for k, v in enumerate(rng.normal(size=(1000, 8)))]
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(10_000)]), pa.array(list(rng.normal(size=(10_000, 8))), pa.list_(pa.float64()))], names=["chunk_id", "embedding"])
    assert peak_mb(lambda: list(retrieval.nearest(queries, 5, "chunk_id")([batch]))) < 40  # all distances are 80 MB


def test_exact_scan_ranks_nothing(spark):
    """All rows of a query were sorted in one task, for a rank that nothing read."""
    from quarry.queries import search

    assert "Window" not in search.exact_backend(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_chunks_are_passed_on_as_they_are_cut():
    body = "\n".join(f"# {k}\nline {k}" for k in range(400))
    batch = pa.RecordBatch.from_arrays([pa.array([f"p{k}" for k in range(300)]), pa.array([body] * 300)], names=["path", "body"])
    schema = T.StructType([T.StructField("path", T.StringType()), *chunking.PIECE.fields])
    found = 0

    def run():
        nonlocal found
        for b in chunking.cut(1200, 0, schema, 1)([batch]):
            assert b.num_rows <= 2000
            found += b.num_rows

    assert peak_mb(run) < 10 and found == 300 * 400


def test_queries_go_to_the_chunks(spark):
    """Else the chunks are sent to the queries' few tasks."""
    from quarry.operators import governance, query_analysis

    chunks, asked = base.note_chunks(spark, SF), spark.createDataFrame([("q", "when was the config report started")], "query_id string, raw string")
    analyzed = query_analysis.analyze(asked)
    for found in (retrieval.route_candidates(chunks, analyzed), retrieval.tier_candidates(chunks, analyzed), governance.evidence(chunks, asked)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoopJoin BuildRight, Inner" in plan
