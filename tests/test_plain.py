"""Operators without an SQL counterpart against plain Python over the test tables, and what has no query of its own."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking, evaluation, ordering, ranking, retrieval, rollups, similarity
from quarry.queries import notes as note_queries
from quarry.queries import search as search_queries
from quarry.queries.base import note_chunks, parsed, vault

SF = "/root/testdata/sf0.001"


def df(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def plain_sections(body, most, overlap):
    """Chunks by index: each line's heading state first, then cuts."""
    lines = body.replace("\r\n", "\n").split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    open_, state = None, []
    for line in lines:
        bare = line.lstrip()
        head = None if open_ else re.match(r"(#{1,6})(?!#)\s*(\S.*)$", bare)
        state.append((head, open_ is not None))
        mark = re.match(r"```|~~~", bare)
        if mark and open_ in (None, mark[0]):
            open_ = mark[0] if open_ is None else None
    most = max(200, most)
    overlap = min(max(0, overlap), most // 2)
    out, stack, first = [], [], 0  # first: index of the chunk's first line
    weigh = lambda a, b: sum(len(x.encode()) + 1 for x in lines[a:b])
    text = lambda a, b: "\n".join(lines[a:b]).strip()
    crumb = lambda: " > ".join(t for _, t in stack) or None
    for k, (head, fenced) in enumerate(state):
        if head:
            if text(first, k):
                out.append((crumb(), first + 1, k, text(first, k)))
                first = k
            level = len(head[1])
            stack = [x for x in stack if x[0] < level] + [(level, head[2].strip())]
        if weigh(first, k + 1) > most and not fenced and text(first, k):
            out.append((crumb(), first + 1, k, text(first, k)))
            n, size = 0, 0
            while overlap and n < k - first and not (n and size + len(lines[k - 1 - n]) + 1 > overlap) and size < overlap:
                size += len(lines[k - 1 - n]) + 1
                n += 1
            first = k - (n if overlap and n < k - first else 0)
    if text(first, len(lines)):
        out.append((crumb(), first + 1, len(lines), text(first, len(lines))))
    return out


@pytest.mark.parametrize("most,overlap", [(1200, 0), (1200, 120), (100, 5000), (300, 40)])
def test_chunks_against_plain(spark, most, overlap):
    notes = parsed(spark, SF)
    expected = sorted((r.path, *map(str, c)) for r in notes.select("path", "body").collect() for c in plain_sections(r.body or "", most, overlap))
    found = chunking.chunk(notes, most, overlap).select("path", "heading", "line_start", "line_end", "text")
    assert sorted((r.path, *map(str, (r.heading, r.line_start, r.line_end, r.text))) for r in found.collect()) == expected


def test_chunk_queries_cover_all_notes(spark):
    expected = {r.path: plain_sections(r.body, 1200, 120) for r in parsed(spark, SF).select("path", "body").collect()}
    assert note_queries.chunks_full(spark, SF).count() == sum(map(len, expected.values()))
    ids = [r.chunk_id for r in chunking.chunk(parsed(spark, SF), overlap=120).collect()]
    assert len(set(ids)) == len(ids) and all(re.fullmatch("chk_[0-9a-f]{24}", x) for x in ids)


def plain_snippet(text, terms):
    folded, spans = text.lower(), []
    for t in terms:
        at = folded.find(t)
        if at >= 0:
            spans.append((max(0, at - 30), min(len(text), at + len(t) + 60)))
    merged = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1] + 12:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    squeeze = lambda x: re.sub(r"\s+", " ", x, flags=re.ASCII).strip()
    return " … ".join(filter(None, (squeeze(text[s:e]) for s, e in merged[:3]))) if merged else squeeze(text[:180])


def test_snippets_against_plain(spark):
    texts = {r.chunk_id: r.text for r in note_chunks(spark, SF).select("chunk_id", "text").collect()}
    found = {r.chunk_id: r.snippet for r in search_queries.snippets(spark, SF).collect()}
    assert found == {k: plain_snippet(t, ["links", "see", "zzz"]) for k, t in texts.items()}
    many = note_chunks(spark, SF).select("chunk_id", ranking.snippet(F.col("text"), F.array(*map(F.lit, ["a", "on", "the", "topic"]))).alias("s"))
    assert {r.chunk_id: r.s for r in many.collect()} == {k: plain_snippet(t, ["a", "on", "the", "topic"]) for k, t in texts.items()}


def plain_transcript(text):
    if text.startswith("---\n") and (end := text.find("\n---\n", 4)) >= 0:
        text = text[end + 5 :]
    while m := re.search("```|~~~", text):
        end = text.find(m[0], m.end())
        text = text[: m.start()] + (text[end + 3 :] if end >= 0 else "")
    kept = [x for x in text.split("\n") if not x.lstrip(" ").startswith("#") and not re.match(r"\s*(- )?[A-Za-z_ ]{2,20}:\s", x) and x.strip(" ")]
    return "\n".join(kept)


def test_transcripts_against_plain(spark):
    n = vault(spark, SF)
    found = {r.path: r.body for r in n.select("path", rollups.transcript_body(F.col("source"), 1 << 20).alias("body")).collect()}
    assert found == {r.path: plain_transcript(r.source) for r in n.collect()}


def test_numbered_against_plain(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(50), rng.randrange(9)) for k in range(500)]
    found = ordering.numbered(df(spark, "id int, a int, v int", rows).repartition(6), [F.desc("a"), F.col("id")], "no", {"total": F.col("v")}).collect()
    at, total = 0, 0
    for (i, a, v), r in zip(sorted(rows, key=lambda r: (-r[1], r[0])), sorted(found, key=lambda r: r.no)):
        at, total = at + 1, total + v
        assert (r.id, r.no, r.total) == (i, at, total)
    assert ordering.numbered(df(spark, "id int, a int, v int", []), [F.col("id")]).count() == 0


def test_nearest_against_plain(spark):
    rng = np.random.default_rng(5)
    points = [(f"c{k:03d}", rng.integers(0, 4, 6).astype(float).tolist()) for k in range(400)] + [("n1", None), ("n2", []), ("n3", [1.0, 2.0])]
    asked = [(f"q{k}", rng.integers(0, 4, 6).astype(float).tolist()) for k in range(30)] + [("q99", [1.0, 2.5]), ("q98", [])]
    found = retrieval.vector_candidates(df(spark, "chunk_id string, embedding array<double>", points).repartition(5), df(spark, "query_id string, embedding array<double>", asked), 7).collect()
    expected = set()
    for q, v in asked:
        near = sorted((round(float(np.linalg.norm(np.array(p) - np.array(v))), 9), c) for c, p in points if p and v and len(p) == len(v))[:7]
        expected |= {(q, c, k) for k, (_, c) in enumerate(near, 1)}
    assert {(r.query_id, r.chunk_id, r.vector_rank) for r in found} == expected


def test_prefixes_of_any_length(spark):
    words = ["authentication", "authenticate", "author", "a" * 40, "a" * 39 + "b", "日本語のとても長いことばがここにある", "x"]
    chunks = df(spark, "chunk_id string, title string, heading string, text string, tags array<string>", [(f"c{k}", None, None, w, []) for k, w in enumerate(words)])
    index = retrieval.postings(chunks)
    for term in ("authentication", "authenticat", "aut", "a", "x", "a" * 39, "a" * 40, "日本語のとても長いことばが", "none"):
        terms = df(spark, "query_id string, keyword_mode string, n_terms int, term string, prefix boolean", [("q", "and", 1, term, True)])
        found = retrieval.keyword_candidates(index, terms, retrieval.corpus_size(index)).collect()
        assert {r.chunk_id for r in found} == {f"c{k}" for k, w in enumerate(words) if w.startswith(term)}, term


def test_small_vaults_are_compared_pair_by_pair(spark):
    feats = similarity.features(parsed(spark, SF)).limit(60)
    every = {(r.source_path, r.target_path) for r in similarity.candidate_pairs(feats).collect()}
    paths = [r.path for r in feats.collect()]
    assert every == {(a, b) for a in paths for b in paths if a != b}
    assert similarity.candidate_pairs(similarity.features(parsed(spark, "/root/testdata/sf0.01"))).filter("votes = 0").count() == 0


def test_model_run_takes_decisions(spark):
    notes = parsed(spark, SF)
    sent = []

    def client(payloads):
        sent.extend(payloads.collect())
        first = min(sent, key=lambda r: (r.batch, int(r.candidate_id[1:])))
        return df(spark, "batch int, reply string", [(0, f'[{{"candidate_id": "{first.candidate_id}", "keep": true, "relation": "refines", "confidence": 0.5}}, {{"candidate_id": "c999", "keep": true}}]')])

    found = similarity.proposals(notes, "digest_low", 5, client=client).collect()
    assert len(found) == 1 and found[0].relation == "refines" and found[0].origin == "model" and 0 < found[0].confidence < 1
    assert len(sent) == similarity.BUDGETS["digest_low"]["decisions"] and {r.batch for r in sent} == {0, 1}


def test_settings_by_hand():
    s = evaluation.set_state(evaluation.initial_state(), 0.8, [" The ", "of"], [])
    assert s["penalty"] == 0.8 and s["stopwords"] == ["of", "the"] and s["previous"]["penalty"] == 1.0
    assert evaluation.set_state(s, remove=["OF"])["stopwords"] == ["the"]
    for bad in ({}, {"penalty": 0.1}, {"penalty": float("nan")}):
        with pytest.raises(ValueError):
            evaluation.set_state(s, **bad)


def test_graph_edges_lift_scores(spark):
    rows = df(spark, "path string, score double, sources array<string>", [("a", 0.5, []), ("b", 0.96, []), ("c", 0.5, []), ("d", 0.5, [])])
    edges = df(spark, "source_path string, target_path string, state string", [("a", x, "active") for x in "bcwxyz"] + [("d", "e", "conflict"), ("c", "c", "active")])
    found = {r.path: (round(r.score, 6), r.sources) for r in ranking.graph_boosted(rows, edges).collect()}
    assert found == {"a": (0.53, ["graph"]), "b": (0.96, []), "c": (0.52, ["graph"]), "d": (0.5, [])}
