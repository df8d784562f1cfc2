"""Operator 10: embedding near-duplicates by PCA-ordered tiled comparison, exact.

Equal vectors are one node that stands for its copies. Vectors are scaled to length 1 and turned into the basis of their
principal components, largest first (second moments summed over all vectors; only a matrix of dimensions squared comes
to the driver). The angles to the leading GRID_AXES components of two linked vectors differ by at most the threshold's
angle, so a grid of that width over those angles leaves only neighbouring cells to compare; there are a few hundred cells
at most, whatever the data. A cell of more rows than TILE is dealt into tiles; a task compares two tiles in blocks.

Within a block the leading dimensions are multiplied first. The product of the suffixes' norms bounds the rest of each
pair; pairs that cannot reach the threshold stop there, and the others go on with the next dimensions. A cosine
within 1e-9 of the threshold is computed again from the vectors as given. Tasks return the sums of links of each node and
the edges of a forest, not the pairs; components are found in the shared folder.

Vectors that are null, empty, zero or that hold null or non-finite components link with nothing: n_links 0 and a
component of their own. Vectors of different lengths never link. A null vec_id links with nothing and has a null
component. Rows that repeat an id count each as a vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, materialised, table
from .components import components

THRESHOLD, GRID_AXES, TILE, BLOCK, STEP, CLOSE = 0.9, 3, 8192, 1024, 16, 1e-9
MOMENTS = pa.schema([("at", pa.int32()), ("v", pa.float64())])
TILES = pa.schema([("pair", pa.string()), ("side", pa.int32()), ("node", pa.int64()), ("copies", pa.int64()), ("vector", pa.binary())])
FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first by the largest part, lest squares overflow or vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def moments(dim: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            x = unit(matrix(b.column(0), dim))
            total += x.T @ x
        yield batch(MOMENTS, at=np.arange(dim * dim, dtype=np.int32), v=total.ravel())

    return run


def basis_of(nodes: DataFrame, dim: int) -> np.ndarray:
    """Columns: principal axes, by descending second moment."""
    sums = nodes.select("embedding").mapInArrow(moments(dim), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    m = np.zeros(dim * dim)
    for r in sums:
        m[r["at"]] = r["v"]
    values, axes = np.linalg.eigh(m.reshape(dim, dim))
    return axes[:, np.argsort(-values, kind="stable")]


def cells_of(x: np.ndarray, threshold: float) -> np.ndarray:
    """Grid cells of rotated unit vectors: rows of small integers."""
    width = math.acos(threshold) + 1e-6
    return np.floor(np.arccos(np.clip(x[:, :GRID_AXES], -1, 1)) / width).astype(np.int64)


def cell_name(cell) -> str:
    return ".".join(map(str, cell))


def count_cells(basis: np.ndarray, threshold: float):
    def run(batches):
        for b in batches:
            cells, n = np.unique(cells_of(unit(matrix(b.column(0), len(basis))) @ basis, threshold), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([cell_name(c) for c in cells], pa.string()), pa.array(n)], names=["cell", "n"])

    return run


def deal_tiles(basis: np.ndarray, threshold: float, tiles: dict[str, int]):
    """A row for each pair of tiles that a vector's tile belongs to; tiles: how many a cell has."""
    around: dict[str, list[tuple[str, bool]]] = {}
    known = {name: tuple(map(int, name.split("."))) for name in tiles}
    for name, cell in known.items():
        around[name] = [(other, cell <= c) for other, c in known.items() if max(abs(p - q) for p, q in zip(cell, c)) <= 1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = matrix(b.column(2), len(basis))
            names = [cell_name(c) for c in cells_of(unit(vectors) @ basis, threshold)]
            rows = []
            for node, copies, name, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), names, vectors.astype("<f8")):
                own = (node * 0x9E3779B97F4A7C15 >> 20) % tiles[name]
                for other, first in around[name]:
                    for tile in range(tiles[other]):
                        if other == name:
                            pair, side = f"{name}/{min(own, tile)}|{name}/{max(own, tile)}", int(own > tile)
                        else:
                            pair, side = (f"{name}/{own}|{other}/{tile}", 0) if first else (f"{other}/{tile}|{name}/{own}", 1)
                        rows.append((pair, side, node, copies, v.tobytes()))
                if len(rows) >= 8192:
                    yield batch(TILES, **dict(zip(TILES.names, map(list, zip(*rows)))))
                    rows = []
            if rows:
                yield batch(TILES, **dict(zip(TILES.names, map(list, zip(*rows)))))

    return run


class Side:
    def __init__(self, t: pa.Table, basis: np.ndarray):
        self.node, self.copies = np.asarray(t.column("node")), np.asarray(t.column("copies"))
        self.given = np.frombuffer(b"".join(t.column("vector").to_pylist()), "<f8").reshape(-1, len(basis))
        self.x = unit(self.given) @ basis
        squares = (self.x * self.x)[:, ::-1].cumsum(axis=1)[:, ::-1]
        self.suffix = np.sqrt(np.concatenate((squares, np.zeros((len(self.x), 1))), axis=1))


def near_mask(a: Side, b: Side, rows: slice, columns: slice, threshold: float) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """The linked pairs of a block: a mask if they are many, else two arrays of indexes."""
    x, y, dim, low = a.x[rows], b.x[columns], a.x.shape[1], threshold - CLOSE
    done = min(STEP, dim)
    part = x[:, :done] @ y[:, :done].T
    i, j = np.nonzero(part + np.outer(a.suffix[rows, done], b.suffix[columns, done]) >= low)
    if not len(i):
        return i, j
    if len(i) * 4 > part.size:  # the bound spares little here
        part += x[:, done:] @ y[:, done:].T
        mask = part >= low
        i, j = np.nonzero(mask & (part < threshold + CLOSE))
        mask[i, j] = exact(a.given[rows][i], b.given[columns][j]) >= threshold
        return mask
    s = part[i, j]
    while done < dim:
        to = min(done + STEP, dim)
        s = s + np.einsum("ij,ij->i", x[i, done:to], y[j, done:to])
        done = to
        stay = s + a.suffix[rows, done][i] * b.suffix[columns, done][j] >= low
        i, j, s = i[stay], j[stay], s[stay]
    sure = s >= threshold + CLOSE
    sure[~sure] = exact(a.given[rows][i[~sure]], b.given[columns][j[~sure]]) >= threshold
    return i[sure], j[sure]


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))) if len(x) else np.zeros(0)


def settle(label: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Lowers labels (of local indexes) until linked ones agree."""
    while True:
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        np.minimum.at(label, before[i], least)
        np.minimum.at(label, before[j], least)
        label[:] = label[label]
        if (before == label).all():
            return


def compare(basis: np.ndarray, threshold: float):
    def run(key, t: pa.Table) -> pa.Table:
        left, right = str(key[0].as_py()).split("|")
        sides = [t.filter(pc.equal(t.column("side"), s)).sort_by("node") for s in (0, 1)] if left != right else [t.sort_by("node")] * 2
        a = Side(sides[0], basis)
        b = a if left == right else Side(sides[1], basis)
        shift = 0 if a is b else len(a.node)
        nodes = a.node if a is b else np.concatenate((a.node, b.node))
        order = np.argsort(nodes, kind="stable")  # labels follow the order of nodes
        place = np.empty(len(nodes), np.int64)
        place[order] = np.arange(len(nodes))
        label, links = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
        for r in range(0, len(a.node), BLOCK):
            for c in range(r if a is b else 0, len(b.node), BLOCK):
                rows, columns = slice(r, r + BLOCK), slice(c, c + BLOCK)
                found = near_mask(a, b, rows, columns, threshold)
                if isinstance(found, tuple):
                    i, j = found
                    if a is b and r == c:
                        i, j = i[i < j], j[i < j]
                    np.add.at(links, i + r, b.copies[columns][j])
                    np.add.at(links, shift + j + c, a.copies[rows][i])
                    settle(label, place, place[i + r], place[shift + j + c])
                    continue
                if a is b and r == c:
                    found = np.triu(found, 1)
                links[r : r + len(found)] += found @ b.copies[columns]
                links[shift + c : shift + c + found.shape[1]] += found.T @ a.copies[rows]
                row, column = np.flatnonzero(found.any(axis=1)), found.argmax(axis=1)
                pairs_i, pairs_j = [row], [column[row]]  # each row with its first column, then what that leaves apart
                col, first = np.flatnonzero(found.any(axis=0)), found.argmax(axis=0)
                pairs_i, pairs_j = [*pairs_i, first[col]], [*pairs_j, col]
                settle(label, place, place[np.concatenate(pairs_i) + r], place[shift + np.concatenate(pairs_j) + c])
                for k in row:
                    hit = np.flatnonzero(found[k])
                    own, others = label[place[k + r]], label[place[shift + c + hit]]
                    apart = hit[others != own]
                    if len(apart):
                        settle(label, place, np.full(len(apart), place[k + r]), place[shift + c + apart])
        named = nodes[order]
        moved, some = np.flatnonzero(label != np.arange(len(nodes))), np.flatnonzero(links)
        return pa.table([pa.array(np.concatenate((named[moved], nodes[some]))), pa.array(np.concatenate((named[label[moved]], nodes[some]))), pa.array(np.concatenate((np.zeros(len(moved), np.int64), links[some])))], schema=FOUND)

    return run


def links_of(nodes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """nodes: node, copies, embedding of dim parts. Rows a, b, links: an edge if links is 0, else a node (a = b) and its links."""
    basis = basis_of(nodes, dim)
    cells = nodes.select("embedding").mapInArrow(count_cells(basis, threshold), "cell string, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # ceil(pi / width) ** GRID_AXES at most
    tiles = {r["cell"]: -(-r["n"] // TILE) for r in cells}
    dealt = nodes.select("node", "copies", "embedding").mapInArrow(deal_tiles(basis, threshold, tiles), "pair string, side int, node long, copies long, vector binary")
    return dealt.groupBy("pair").applyInArrow((lambda f: lambda key, t: f(key, t))(compare(basis, threshold)), "a long, b long, links long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors: vec_id, embedding. Per vector: vec_id, n_links, component_id, kept."""
    part = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)
    sound = F.col("vec_id").isNotNull() & F.coalesce(F.forall("embedding", part) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", F.when(sound, F.col("embedding")).alias("embedding"))
    nodes = materialised(rows.filter("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")))
    found = None
    for r in nodes.select(F.size("embedding").alias("dim")).distinct().orderBy("dim").collect():  # lengths of vectors: one, as a rule
        own = links_of(nodes.filter(F.size("embedding") == r["dim"]), r["dim"], threshold)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = materialised(found)
    degrees = found.filter("links > 0").groupBy(F.col("a").alias("d_node")).agg(F.sum("links").alias("links"))
    labels = components(found.filter("links = 0").select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("id", "c_node")
    known = nodes.join(degrees, nodes["node"] == degrees["d_node"], "left").join(labels, nodes["node"] == labels["c_node"], "left")
    known = materialised(known.select(F.col("embedding").alias("n_embedding"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    joined = rows.join(known, rows["embedding"] == known["n_embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op10(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP10_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9
), reach AS (
  SELECT x AS node, x AS root FROM links UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.node
), least AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
), degree AS (
  SELECT x, count(*) AS n FROM links GROUP BY x
)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, coalesce(l.root, e.vec_id) AS component_id, e.vec_id = coalesce(l.root, e.vec_id) AS kept
FROM embeddings e LEFT JOIN degree d ON e.vec_id = d.x LEFT JOIN least l ON e.vec_id = l.node
"""
