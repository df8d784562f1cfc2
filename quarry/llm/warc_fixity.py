"""Operator 3: Merkle fixity audit of WARC replicas.

Records lie in files in order, each at an offset. A leaf is the digest of a record's offset, length and bytes; FANOUT
neighbouring nodes, an ordered range of offsets, make their parent's digest, up to one root for an archive. Two replicas
whose roots agree are equal. Otherwise the audit descends from the root: at each level only children of nodes that
differ are compared, so what it reads grows with the damage and the height of the tree, not with the archive.

The inventory (an archive's own records, their files and offsets) places records; a replica's record takes the place
of its key there and is missing where it has none; records of the replica that the inventory lacks are extra. Bytes are
hashed where they are read; only digests are shuffled. A file holds a range of FILE_RECORDS ids. Places are numbered without
gaps, so a tree has a FANOUTth of a level's nodes in the next, however ids are spread.

Ids may be any long or null (those share a file); null urls and pages are empty. Rows that repeat id and url are told apart by their
order of digests, so n copies against n-1 give one missing record. Empty archives agree.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialised, table

FANOUT, FILE_RECORDS = 64, 1000
RECORD = "path string, offset long, length long, type string, uri string, record_id string, payload binary"


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """A response record as text."""
    html, url = F.coalesce(html, F.lit("")), F.coalesce(url, F.lit(""))
    name = F.md5(F.concat_ws(" ", F.coalesce(page_id.cast("string"), F.lit("-")), url).cast("binary"))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:md5:"), name, F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame) -> DataFrame:
    """page_id, url, file_no, length, digest: narrow rows."""
    body = record_bytes(F.col("page_id"), F.col("url"), F.col("html"))
    file_no = F.when(F.col("page_id").isNull(), 0).otherwise(F.expr(f"page_id div {FILE_RECORDS} + if(page_id % {FILE_RECORDS} < 0, 0, 1)"))  # whole numbers: no id is too large
    return pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), file_no.cast("long").alias("file_no"), F.octet_length(body).cast("long").alias("length"), F.sha2(body.cast("binary"), 256).alias("digest"))


def inventory(own: DataFrame) -> DataFrame:
    """Places records(): adds slot (their number in the archive, from 0), record_offset (in their file) and copy (number of one id and url, from 1).

    The rows are range-partitioned and numbered within partitions; a file or name that goes on in the next partition takes
    along what it has so far, from one row for each partition. So neither a large file nor many copies are one task.
    """
    order = ("file_no", "page_id", "url", "digest", "salt")
    ranged = materialised(own.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    in_part, in_file, in_name = (Window.partitionBy("part", *order[:k]).orderBy(*order[k:]) for k in (0, 1, 3))
    local = ranged.withColumn("no", F.row_number().over(in_part)).withColumn("through", F.sum("length").over(in_file.rowsBetween(Window.unboundedPreceding, 0))).withColumn("copy", F.row_number().over(in_name))
    ends = local.groupBy("part").agg(F.max("no").alias("n"), F.min_by(F.struct("file_no", "page_id", "url"), "no").alias("first"), F.max_by(F.struct("file_no", "page_id", "url", "through", "copy"), "no").alias("last"))
    carried, rows, file, name, through, copies = [], 0, None, None, 0, 0
    for e in sorted(ends.collect(), key=lambda e: e["part"]):  # a row for each partition
        first, last = tuple(e["first"]), tuple(e["last"])
        through, copies = through if file == first[0] else 0, copies if name == first else 0
        carried.append((e["part"], rows, *first, through, copies))
        rows, file, name = rows + e["n"], last[0], last[:3]
        through, copies = last[3] + (through if first[0] == file else 0), last[4] + (copies if first == name else 0)
    before = own.sparkSession.createDataFrame(carried, "b_part int, b_rows long, b_file long, b_id long, b_url string, b_through long, b_copies int")
    same_file = F.col("file_no") == F.col("b_file")
    same_name = same_file & F.col("page_id").eqNullSafe(F.col("b_id")) & (F.col("url") == F.col("b_url"))
    return local.join(before, F.col("part") == F.col("b_part")).select(
        "page_id", "url", "file_no", "length", "digest", (F.col("b_rows") + F.col("no") - 1).alias("slot"),
        (F.col("through") - F.col("length") + F.when(same_file, F.col("b_through")).otherwise(0)).alias("record_offset"), (F.col("copy") + F.when(same_name, F.col("b_copies")).otherwise(0)).alias("copy"),
    )


def leaves(places: DataFrame, replica: DataFrame) -> DataFrame:
    """slot, digest of a replica's records at the inventory's places."""
    mine, theirs = places.select("file_no", F.col("page_id").alias("p_id"), F.col("url").alias("p_url"), F.col("copy").alias("p_copy"), "slot", "record_offset"), replica.drop("slot", "record_offset").withColumnRenamed("file_no", "r_file")
    on = (F.col("file_no") == F.col("r_file")) & F.col("p_id").eqNullSafe(F.col("page_id")) & (F.col("p_url") == F.col("url")) & (F.col("p_copy") == F.col("copy"))
    return mine.join(theirs, on).select("slot", node_digest(F.concat_ws(":", F.col("record_offset").cast("string"), F.col("length").cast("string"), "digest"), "leaf"))


def node_digest(content: Column, kind: str) -> Column:
    """Leaves and inner nodes are hashed apart, so one can't pass for the other."""
    return F.sha2(F.concat(F.lit(f"{kind}:"), content).cast("binary"), 256).alias("digest")


def height(places: DataFrame) -> int:
    """Levels above the leaves until one node holds all places."""
    most, n = places.count(), 1
    while FANOUT**n < most:
        n += 1
    return n


def tree(leaf_rows: DataFrame, levels: int) -> DataFrame:
    """All nodes: level (0: leaves), node, digest. Each level has at most a FANOUTth of the rows below where files are full.

    A level's shuffle is reused by those above it in one job.
    """
    level = leaf_rows.select(F.lit(0).alias("level"), F.col("slot").alias("node"), "digest")
    every = level
    for n in range(1, levels + 1):
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda c: F.concat_ws("=", c["node"].cast("string"), c["digest"])), ",")
        level = level.groupBy(F.floor(F.col("node") / FANOUT).alias("parent")).agg(node_digest(children, "node")).select(F.lit(n).alias("level"), F.col("parent").alias("node"), "digest")
        every = every.unionByName(level)
    return every


def descend(left: DataFrame, right: DataFrame, levels: int) -> DataFrame:
    """Leaves that differ: slot, in_left, in_right. left, right: trees of the same places. Nothing below equal nodes is compared."""
    # settled as one table: through a union in the plan, Spark would push each level's semi join twice, doubling all that is below
    sides = materialised(left.withColumn("left", F.lit(True)).unionByName(right.withColumn("left", F.lit(False))))
    wrong = None
    for n in range(levels, -1, -1):
        own = sides.filter(F.col("level") == n)
        if wrong is not None:
            own = own.withColumn("parent", F.floor(F.col("node") / FANOUT)).join(wrong, "parent", "left_semi")
        both = own.groupBy("node").agg(F.max(F.when(F.col("left"), F.col("digest"))).alias("l"), F.max(F.when(~F.col("left"), F.col("digest"))).alias("r")).filter(~F.col("l").eqNullSafe(F.col("r")))
        wrong = both.select(F.col("node").alias("parent"))
    return both.select(F.col("node").alias("slot"), F.col("l").isNotNull().alias("in_left"), F.col("r").isNotNull().alias("in_right"))


def roots(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.filter(F.col("level") == levels).select("node", "digest")


def audit(archive: DataFrame, replica: DataFrame) -> DataFrame:
    """Where a replica differs from an archive: page_id, url, file_no, record_offset, length, state (changed, missing, extra).

    archive, replica: page_id, url, html. Offsets and lengths are the archive's, null for extra records.
    """
    places = materialised(inventory(records(archive)))
    theirs = materialised(inventory(records(replica)))
    levels = height(places)
    mine = places.select("slot", node_digest(F.concat_ws(":", F.col("record_offset").cast("string"), F.col("length").cast("string"), "digest"), "leaf"))
    found = descend(tree(mine, levels), tree(leaves(places, theirs), levels), levels)
    damaged = places.join(found, "slot").select("page_id", "url", "file_no", "record_offset", "length", F.when(F.col("in_right"), "changed").otherwise("missing").alias("state"))
    known = places.select(F.col("file_no").alias("k_file"), F.col("page_id").alias("k_id"), F.col("url").alias("k_url"), F.col("copy").alias("k_copy"))
    extra = theirs.join(known, (F.col("file_no") == F.col("k_file")) & F.col("page_id").eqNullSafe(F.col("k_id")) & (F.col("url") == F.col("k_url")) & (F.col("copy") == F.col("k_copy")), "left_anti")
    none = F.lit(None).cast("long")
    return damaged.unionByName(extra.select("page_id", "url", "file_no", none.alias("record_offset"), none.alias("length"), F.lit("extra").alias("state")))


# Files


def parse_warc(content: bytes) -> Iterator[tuple]:
    """(offset, length, type, uri, record_id, payload) of the records of a file, plain or with a gzip member for each record.

    Offsets are those of the uncompressed stream. A record that breaks off ends the file.
    """
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    at = 0
    while True:
        line = stream.readline()
        if not line:
            return
        start, at = at, at + len(line)
        if not line.strip():
            continue
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            at += len(line)
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        at += len(line)
        n = int(fields.get("content-length", "0"))
        payload = stream.read(n)
        at += len(payload)
        if len(payload) < n:
            return
        end = stream.read(4)
        at += len(end)
        yield start, at - start, fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-record-id"), payload


def read_warc(files: DataFrame) -> DataFrame:
    """Records of WARC files. files: path, content (binaryFile)."""
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("uri", pa.string()), ("record_id", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = [(path, *r) for r in parse_warc(content.as_py() or b"")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return files.select("path", "content").mapInArrow(run, RECORD)


def damaged_replica(pages: DataFrame) -> DataFrame:
    """A replica with known damage: records with a changed character, lost ones, and extra ones, by id."""
    k = F.coalesce("page_id", F.lit(0))
    changed = F.when(k % 97 == 5, F.overlay(F.coalesce("html", F.lit("")), F.lit("#"), F.lit(10))).otherwise(F.col("html"))
    kept = pages.filter(k % 211 != 7).select("page_id", "url", changed.alias("html"))
    return kept.unionByName(pages.filter(k % 307 == 11).select("page_id", F.concat(F.coalesce("url", F.lit("")), F.lit("#copy")).alias("url"), "html"))


def op3(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return audit(pages, damaged_replica(pages))


OP3_SQL = """
WITH r AS (
  SELECT page_id, coalesce(url, '') AS url, CASE WHEN page_id IS NULL THEN 0 ELSE CAST(floor(page_id / 1000) AS BIGINT) + 1 END AS file_no,
         CAST(159 + strlen(coalesce(url, '')) + length(CAST(strlen(coalesce(html, '')) AS VARCHAR)) + strlen(coalesce(html, '')) AS BIGINT) AS length -- 159: the header's fixed part
  FROM pages
), placed AS (
  SELECT *, CAST(sum(length) OVER (PARTITION BY file_no ORDER BY page_id, url ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS record_offset FROM r
)
SELECT page_id, url, file_no, record_offset, length, CASE WHEN page_id % 211 = 7 THEN 'missing' ELSE 'changed' END AS state FROM placed WHERE page_id % 211 = 7 OR page_id % 97 = 5
UNION ALL SELECT page_id, url || '#copy', file_no, NULL, NULL, 'extra' FROM placed WHERE page_id % 307 = 11
"""
