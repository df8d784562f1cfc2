"""Operator 9: SimHash near-duplicates by covering locality-sensitive hashing (Pagh, 2016).

Fingerprints are 64 bits over the XXH64 (seed 42) of word shingles. Each of the 64 bit places gets a non-zero vector of
radius+1 bits; for every non-zero v of as many bits there is a table whose mask has the places with an odd product with
v. The vectors of at most `radius` differing places span less than the whole space, so some v is orthogonal to all of
them: in that table the two fingerprints agree. Every pair within the radius meets in some table, and each meeting is
verified, so links are exact.

Equal fingerprints are one node, so a group of copies costs one row; a bucket gives a spanning forest of its links,
not its pairs. A bucket of many different fingerprints is searched by parts: of radius+1 parts of its free bits one
is equal in any linked pair. Components are found in the shared folder (components.py).

Null and empty texts, and texts without a word, have fingerprint zero and link like any other. Rows with a null id
get a fingerprint, link with nothing and have a null component. Rows that repeat an id are one node if their texts agree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, materialised, quoted, table
from .components import components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Shingles hashed together, and fingerprints of a bucket compared at once.
PART, AT_ONCE = 1 << 15, 1024
FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
EDGES = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned SimHash of a text's lower-cased (A-Z) word shingles; 0 without a word."""
    import xxhash

    words = text.lower().split()  # bytes: ASCII letters, and just the six kinds of white space
    if not words:
        return 0
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    starts = [0, *[e + 1 for e in ends[: n - 1]]]
    stops = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    sums = np.zeros(64, dtype=np.int64)
    for k in range(0, n, PART):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + PART], stops[k : k + PART])], dtype="<u8")
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def fingerprint_batches(shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py() or b"", shingle) for x in b.column(1)], dtype=np.uint64)
            yield batch(FINGERPRINTS, doc_id=b.column(0), fp=fps.view(np.int64))

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(fingerprint_batches(shingle), "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks, as signed longs, of which any two words within the radius agree on one."""
    space = (1 << (radius + 1)) - 1
    masks = [sum(1 << i for i in range(bits) if ((i % space + 1) & v).bit_count() % 2) for v in range(1, space + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def linked(fps: np.ndarray, radius: int, free: list[int] | None = None, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of indexes of different fingerprints within the radius, in parts of bounded size; a pair may come twice."""
    if len(fps) <= at_once:
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
        i, j = np.nonzero(np.triu(near, 1))
        if len(i):
            yield i, j
        return
    free = free if free is not None else [b for b in range(64) if (fps >> np.uint64(b) & np.uint64(1)).any() and not (fps >> np.uint64(b) & np.uint64(1)).all()]
    for part in np.array_split(np.array(free), radius + 1):
        mask = np.uint64(sum(1 << int(b) for b in part))
        order = np.argsort(fps & mask, kind="stable")
        keys = (fps & mask)[order]
        for group in np.split(order, np.flatnonzero(keys[1:] != keys[:-1]) + 1):
            if len(group) > 1:
                for i, j in linked(fps[group], radius, None if len(group) < len(fps) else [b for b in free if b not in set(part.tolist())], at_once):
                    yield group[i], group[j]


def forest(pairs: Iterable[tuple[np.ndarray, np.ndarray]], nodes: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that connect what the pairs connect: each node but a tree's least with another of its tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    src, dst = [], []
    for i, j in pairs:
        for a, b in zip(nodes[i].tolist(), nodes[j].tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                src.append(a)
                dst.append(b)
    return src, dst


def link_batches(radius: int):
    """Sorted (table, key, fp, node) to edges; a bucket may go on in the next batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def buckets(t, k, fp, node):
            starts = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (k[1:] != k[:-1]))))
            sizes = np.diff(np.append(starts, len(t)))
            two = starts[sizes == 2]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            src, dst = node[near].tolist(), node[near + 1].tolist()
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                a, b = forest(linked(fp[s : s + n], radius), node[s : s + n])
                src += a
                dst += b
            return batch(EDGES, src=src, dst=dst)

        for b in batches:
            if not b.num_rows:
                continue
            c = [np.asarray(b.column(x)) for x in range(4)]
            c[2] = c[2].view(np.uint64)
            last = (c[0] == c[0][-1]) & (c[1] == c[1][-1])
            cut = len(last) - int(last[::-1].argmin()) if not last.all() else 0
            if held and (cut or held[-1][0][-1] != c[0][0] or held[-1][1][-1] != c[1][0]):
                if cut:
                    held.append(tuple(x[:cut] for x in c))
                    yield buckets(*[np.concatenate(x) for x in zip(*held)])
                    held = [tuple(x[cut:] for x in c)]
                else:  # this batch is one bucket, not the one that is held
                    yield buckets(*[np.concatenate(x) for x in zip(*held)])
                    held = [tuple(c)]
            elif cut:
                yield buckets(*[x[:cut] for x in c])
                held = [tuple(x[cut:] for x in c)]
            else:
                held.append(tuple(c))
        if held:
            yield buckets(*[np.concatenate(x) for x in zip(*held)])

    return run


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """nodes: fp (all different), node. Edges src, dst of a forest that connects the same nodes as all links within the radius."""
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(covering_masks(radius))])
    rows = nodes.select(F.explode(keys).alias("b"), "fp", "node").select("b.t", "b.k", "fp", "node")
    return rows.repartition("t", "k").sortWithinPartitions("t", "k").mapInArrow(link_batches(radius), "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per document: doc_id, fp, component_id (the smallest id reachable by links, its own included)."""
    fps = materialised(fingerprints(docs, shingle))
    nodes = materialised(fps.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(fingerprint_links(nodes, radius))
    by_fp = nodes.join(found, nodes["node"] == found["id"], "left").select(F.col("fp").alias("n_fp"), F.coalesce("component", "node").alias("component_id"))
    by_fp = materialised(by_fp)
    return fps.join(by_fp, (F.col("fp") == F.col("n_fp")) & F.col("doc_id").isNotNull(), "left").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents, with their own columns, of which each component keeps the one with the smallest id."""
    gone = near_duplicates(docs, shingle, radius).filter("component_id < doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))


def op9(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
