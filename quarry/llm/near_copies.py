"""Near-copies for the pipeline: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from SimHash. A set's fingerprint has TABLES * KEY_BITS = 768 bits, each the majority of its shingles'
bits; two sets of similarity s differ in a bit with probability acos(2s / (1 + s)) / pi (equal sizes), 0.1516 at 0.8.
Every KEY_BITS of them are the key of a table, so a pair at 0.8 shares a key with probability 1 - (1 - 0.8484^12)^64 =
0.9999, and a nearer pair with more; very small sets differ in more bits, those of 4 and 5 shingles in 0.1875. In a
bucket, sets whose sizes allow the similarity and which differ in at most RADIUS of the first 384 bits are near (a pair
at 0.8 differs in 58 on average, 7 more or less; unlike ones in 192). What nearness connects, in any table, is a group. With fewer than
four shingles no other set is similar enough, so there is no key. KEY_BITS fits tables of some ten million documents:
with more, raise it, and TABLES with it, as buckets grow with the documents.

Texts with one set are one node. Every pair of a group is decided by the exact similarity of its sets (of 64-bit
hashes), unless others have linked the two before:

1. the members of a group are compared with its centre, the node that meets most others in its buckets;
2. where members of a group are still in several trees, those outside its largest tree are compared with all others.

Both go by units of bounded size: members are dealt into blocks of about BLOCK shingles by a hash, and a unit holds two
blocks, or one with a centre. So no group, however large, has its sets held by one task, and no pair of a group is a
row. A bucket's fingerprints are held by one task.

Words are as in simhash.py; a text of fewer words than a shingle is one shingle, and texts without a word have equal
sets. Rows with a null id link with nothing and stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, give_back, materialised, quoted
from .components import components
from .substrings import mixed

SHINGLE, TABLES, KEY_BITS, SEED = 5, 64, 12, 42
#: Words of a fingerprint that are compared, and the most bits in which near ones differ.
COMPARED, RADIUS = 6, 93
#: The least similarity of a link, as a fraction.
SIMILARITY = (4, 5)
#: Shingles whose meetings are taken at once; shingles of a block; what a set counts for besides its own.
PART, BLOCK, LEAST = 1024, 1 << 18, 256
#: Sets of a bucket above which its large clusters are taken out first; a large cluster; how many small ones end that; comparisons, and pairs, held at once.
MANY, LARGE, TRIES, CELLS = 4096, 64, 64, 1 << 18
FLIPS = np.random.default_rng(SEED).integers(0, 1 << 64, TABLES * KEY_BITS // 64, dtype=np.uint64)
NODES = pa.schema([("doc_id", pa.int64()), ("_row", pa.int64()), ("node", pa.int64()), ("weight", pa.int64()), ("keys", pa.list_(pa.int32())), ("fp", pa.list_(pa.int64()))])
MEMBERS = pa.schema([("least", pa.int64()), ("node", pa.int64()), ("n", pa.int64())])
SETS = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])
LINKS = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted different hashes of a text's lower-cased (A-Z) word shingles."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    starts = [0, *[e + 1 for e in ends[: n - 1]]]
    stops = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """The SimHash of a set of shingles: its bits, each 1 if set in over half of the shingles' hashes."""
    sums = np.zeros(64 * len(FLIPS), dtype=np.int64)
    for k in range(0, len(found), 255):  # sums of so many fit a byte
        bits = np.unpackbits(mixed(found[k : k + 255, None] ^ FLIPS).astype("<u8").view(np.uint8).ravel(), bitorder="little")
        sums += bits.reshape(-1, len(sums)).sum(axis=0, dtype=np.uint8)
    return 2 * sums > len(found)


def table_keys(bits: np.ndarray) -> np.ndarray:
    """A key for each table: its number and its bits of the fingerprint."""
    return (bits.reshape(TABLES, KEY_BITS) @ (1 << np.arange(KEY_BITS)) + (np.arange(TABLES) << KEY_BITS)).astype(np.int32)


def node_of(found: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def node_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    over, under = SIMILARITY
    for b in batches:
        nodes, weights, keys, fps = np.zeros(b.num_rows, dtype=np.int64), np.zeros(b.num_rows, dtype=np.int64), [], []
        for k, x in enumerate(b.column(2)):  # one set at a time
            found = shingles(x.as_py() or b"")
            nodes[k], weights[k] = node_of(found), len(found) + LEAST
            bits = fingerprint(found)
            keys.append(table_keys(bits) if len(found) * under >= (len(found) + 1) * over else None)
            fps.append(np.packbits(bits[: 64 * COMPARED], bitorder="little").view("<i8"))
        yield batch(NODES, doc_id=b.column(0), _row=b.column(1), node=nodes, weight=weights, keys=keys, fp=fps)
    give_back()


def are_near(a: np.ndarray, b: np.ndarray, size: np.ndarray, fps: list[np.ndarray]) -> np.ndarray:
    """Whether the sets at a and at b may be similar."""
    over, under = SIMILARITY
    apart = sum(np.bitwise_count(f[a] ^ f[b]).astype(np.int16) for f in fps)
    return (apart <= RADIUS) & (np.minimum(size[a], size[b]) * under >= np.maximum(size[a], size[b]) * over)


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the least place of its cluster) once the places at a are with those at b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def large_clusters(rows: np.ndarray, size: np.ndarray, fps: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Whole clusters of a large bucket, one after the other, until the next are small."""
    small = 0
    while len(rows) > MANY and small < TRIES:
        members, rows = [rows[:1]], rows[1:]
        waiting = members[0]
        while len(waiting) and len(rows):
            some = waiting[: max(1, CELLS // len(rows))]
            near = are_near(some[:, None], rows[None, :], size, fps).any(axis=0)
            members.append(rows[near])
            waiting, rows = np.concatenate((waiting[len(some) :], rows[near])), rows[~near]
        found = np.concatenate(members)
        small = 0 if len(found) > LARGE else small + 1
        yield found


def cluster_labels(key: np.ndarray, size: np.ndarray, fps: list[np.ndarray]) -> np.ndarray:
    """key, size: ascending. For each row the first one of its cluster."""
    over, under = SIMILARITY
    label, open_rows = np.arange(len(key)), np.ones(len(key), dtype=bool)
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
        if e - s > MANY:
            for found in large_clusters(np.arange(s, e), size, fps):
                label[found], open_rows[found] = found.min(), False
    rows = np.flatnonzero(open_rows)
    place = (key[rows].astype(np.int64) << 40) + size[rows]
    reach = np.searchsorted(place, (key[rows].astype(np.int64) << 40) + size[rows] * under // over, side="right")  # sets after that are too large
    at, step, held, pairs = np.arange(len(rows)), 1, 0, []
    while True:
        at = at[reach[at] > at + step]
        near = at[are_near(rows[at], rows[at + step], size, fps)]
        pairs.append((rows[near], rows[near + step]))
        held, step = held + len(near), step + 1
        if held > CELLS or not len(at):
            label, held, pairs = united(label, *map(np.concatenate, zip(*pairs))), 0, []
        if not len(at):
            return label


def clusters(key: np.ndarray, weight: np.ndarray, node: np.ndarray, *fps: np.ndarray) -> pa.RecordBatch:
    """The members of each cluster, with its least node and its size."""
    label = cluster_labels(key, weight - LEAST, [f.view(np.uint64) for f in fps])  # of signed numbers, the bits of the absolute value would be counted
    n = np.bincount(label, minlength=len(label))[label]
    least = np.full(len(label), np.iinfo(np.int64).max)
    np.minimum.at(least, label, node)
    rows = np.flatnonzero(n > 1)
    return batch(MEMBERS, least=least[label[rows]], node=node[rows], n=n[rows])


def cluster_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, weight, node, words of the fingerprint), sorted by the first two, to members of clusters; a bucket may go on in the next batch."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        c = [np.asarray(x) for x in b.columns]
        last = int(np.searchsorted(c[0], c[0][-1]))
        if last or held and held[0][0][0] != c[0][0]:
            whole = [*held, [x[:last] for x in c]]
            yield clusters(*map(np.concatenate, zip(*whole)))
            held = []
        held.append([x[last:] for x in c])
    if held:
        yield clusters(*map(np.concatenate, zip(*held)))
    held = []
    give_back()


def set_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield batch(SETS, node=b.column(0), hashes=[shingles(x.as_py() or b"").astype("<u8").tobytes() for x in b.column(1)])
    give_back()


def similar(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which sets on the left have the least similarity or more with which on the right: a matrix."""
    over, under = SIMILARITY
    a, b = np.concatenate(left), np.concatenate(right)
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    common = np.intersect1d(a, b)
    places = []
    for hashes, n in zip((a, b), sizes):
        at = np.searchsorted(common, hashes)
        held = np.flatnonzero((at < len(common)) & (common[np.minimum(at, len(common) - 1)] == hashes)) if len(common) else np.zeros(0, dtype=np.int64)
        held = held[np.argsort(at[held], kind="stable")]
        places.append((at[held], np.repeat(np.arange(len(n)), n)[held], len(n)))
    both = np.zeros((len(left), len(right)))
    for start in range(0, len(common), PART):
        parts = []
        for at, row, n in places:
            i, j = np.searchsorted(at, (start, start + PART))
            parts.append(np.zeros((n, PART), dtype=np.float32))
            parts[-1][row[i:j], at[i:j] - start] = 1
        both += parts[0] @ parts[1].T
    return both * under >= (sizes[0][:, None] + sizes[1][None, :] - both) * over


def forest(near: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links of a symmetric matrix that connect what all its links connect."""
    seen = np.zeros(len(near), dtype=bool)
    for first in range(len(near)):
        if seen[first]:
            continue
        seen[first], waiting = True, [first]
        while waiting:
            x = waiting.pop()
            new = np.flatnonzero(near[x] & ~seen).tolist()
            seen[new] = True
            waiting += new
            for y in new:
                yield x, y


def unit_links(sides: tuple[dict[int, np.ndarray], dict[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links within the left side if there is no right one, else between the sides."""
    left, right = (list(side.values()) for side in sides)
    if not left or not right and len(left) < 2:
        return []
    if right:
        near = np.zeros((len(left) + len(right),) * 2, dtype=bool)
        near[: len(left), len(left) :] = similar(left, right)
        near |= near.T
    else:
        near = similar(left, left)
    nodes = [*sides[0], *sides[1]]
    return [(nodes[x], nodes[y]) for x, y in forest(near)]


def link_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(of, one, other, side, node, hashes), sorted by the first three, which name a unit, to links."""
    at, sides = None, ({}, {})
    for b in batches:
        found = []
        for *unit, side, node, hashes in zip(*[b.column(k).to_pylist() for k in range(5)], b.column(5)):
            if unit != at:
                found += unit_links(sides)
                at, sides = unit, ({}, {})
            sides[side][node] = np.frombuffer(hashes.as_py(), dtype="<u8")
        yield batch(LINKS, src=[x for x, _ in found], dst=[y for _, y in found])
    found = unit_links(sides)
    yield batch(LINKS, src=[x for x, _ in found], dst=[y for _, y in found])
    sides = None
    give_back()


def star_links(found: DataFrame) -> DataFrame:
    """found: least, node. Links src, dst that connect the same nodes: each node, and its other leasts, with the smallest of its leasts.

    A node has a least in each table at most, so TABLES of them at most. Nodes of a group share most of theirs: of 16 links
    a node on the check tool's table with hot groups 1.4 are left.
    """
    met = found.filter("least <> node").groupBy("node").agg(F.collect_set("least").alias("leasts"))
    return met.select(F.array_min("leasts").alias("src"), F.explode(F.array_append("leasts", F.col("node"))).alias("dst")).filter("src <> dst").distinct()


def blocks_of(weight: Column) -> Column:
    return F.ceil(weight / BLOCK).cast("int")


def dealt(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(SEED)), blocks).cast("int")


def centre_units(pairs: DataFrame) -> DataFrame:
    """pairs: centre, node, weight. Units of a centre (left) and a block of others (right)."""
    blocks = pairs.groupBy("centre").agg(blocks_of(F.sum("weight")).alias("blocks"))
    right = materialised(pairs.join(blocks, "centre").select(F.col("centre").alias("of"), dealt(F.col("blocks")).alias("one"), F.lit(-1).alias("other"), F.lit(1).alias("side"), "node"))
    return right.unionByName(right.select("of", "one", "other", F.lit(0).alias("side"), F.col("of").alias("node")).distinct())


def tile_units(members: DataFrame) -> DataFrame:
    """members: key, node, weight, tree. Units of two blocks of a key, or one with itself, but not two of its largest tree."""
    trees = members.groupBy("key", "tree").agg(F.sum("weight").alias("weight"))
    largest = trees.groupBy("key").agg(F.max(F.struct("weight", "tree")).alias("most"), F.sum("weight").alias("weight"))
    largest = largest.filter("most.weight < weight").select("key", "most.tree", blocks_of(F.col("most.weight")).alias("first"), blocks_of(F.col("weight") - F.col("most.weight")).alias("more"))
    rows = members.join(largest.withColumnRenamed("tree", "most"), "key")
    own = F.col("tree") == F.col("most")
    rows = rows.select("key", "node", F.when(own, dealt(F.col("first"))).otherwise(F.col("first") + dealt(F.col("more"))).alias("block"), F.when(own, F.col("first")).otherwise(F.lit(0)).alias("from"), (F.col("first") + F.col("more") - 1).alias("to"))
    rows = rows.withColumn("with", F.explode(F.sequence("from", "to")))
    return rows.select(F.col("key").alias("of"), F.least("block", "with").alias("one"), F.greatest("block", "with").alias("other"), F.when(F.col("block") > F.col("with"), 1).otherwise(0).alias("side"), "node")


def links(units: DataFrame, sets: DataFrame) -> DataFrame:
    rows = units.join(sets, "node").select("of", "one", "other", "side", "node", "hashes")
    return rows.repartition("of", "one", "other").sortWithinPartitions("of", "one", "other").mapInArrow(link_batches, "src long, dst long")


def near_copies(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, _row (tells texts of one id apart). Per id and _row: doc_id, _row, component_id, a long."""
    texts = docs.filter("doc_id is not null").select("doc_id", "_row", F.col("text").cast("binary").alias("text"))
    rows = materialised(texts.mapInArrow(node_batches, "doc_id long, _row long, node long, weight long, keys array<int>, fp array<long>"))
    nodes = materialised(rows.groupBy("node").agg(F.min(F.struct("doc_id", "_row")).alias("of"), F.first("weight").alias("weight"), F.first("keys").alias("keys"), F.first("fp").alias("fp")))
    keyed = nodes.select(F.explode("keys").alias("key"), "weight", "node", *[F.get("fp", F.lit(k)).alias(f"fp{k}") for k in range(COMPARED)])
    buckets = keyed.repartition("key").sortWithinPartitions("key", "weight")
    found = materialised(buckets.mapInArrow(cluster_batches, "least long, node long, n long"))
    groups = components(star_links(found))
    meetings = found.groupBy("node").agg(F.sum("n").alias("meetings")).join(nodes.select("node", "weight"), "node")
    grouped = materialised(meetings.join(groups, F.col("node") == F.col("id"), "left").select(F.coalesce("component", "node").alias("key"), "node", "weight", "meetings"))
    centres = grouped.groupBy("key").agg(F.max(F.struct("meetings", "node")).alias("most"), F.count(F.lit(1)).alias("n")).select("key", F.col("most.node").alias("centre"), "n")
    members = materialised(grouped.join(centres, "key").filter("node <> centre").select("key", "centre", "n", "node", "weight"))
    pairs = members.select("centre", "node", "weight")
    several = grouped.select("node")
    read = nodes.join(several, "node").select(F.col("of.doc_id").alias("doc_id"), F.col("of._row").alias("_row"), "node")
    sets = materialised(texts.join(read, ["doc_id", "_row"]).dropDuplicates(["doc_id", "_row"]).select("node", "text").mapInArrow(set_batches, "node long, hashes binary"))
    trees = components(links(centre_units(pairs), sets))
    others = members.filter("n > 2").join(trees, F.col("node") == F.col("id"), "left").select("key", "node", "weight", F.coalesce("component", "node").alias("tree"))
    found = components(trees.select(F.col("id").alias("src"), F.col("component").alias("dst")).unionByName(links(tile_units(others), sets)))
    return rows.join(found, F.col("node") == F.col("id"), "left").select("doc_id", "_row", F.coalesce("component", "node").alias("component_id")).distinct()


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, with their own columns, of which each component keeps the row with the smallest id.

    Rows are told apart by id and text: of texts under one id only the near-copies go, and of rows equal in both one stays.
    """
    own = [quoted(c) for c in docs.columns]
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("_row"), F.struct(*own).alias("_doc"))
    found = materialised(near_copies(marked))
    kept = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("kept")).select("kept.*")
    known = marked.filter("doc_id is not null").join(kept, ["doc_id", "_row"], "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", "_row").orderBy(F.xxhash64("_doc")))
    known = known.withColumn("_first", first).filter("_first = 1")
    return known.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns]).union(docs.filter("doc_id is null"))
