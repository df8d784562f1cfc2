"""Operator 2: mixing sources to target weights by weighted fair queueing.

Each source gets a share of the budget (all words) by its weight; no target exceeds `most` times its source's size, and
what a target can't hold is shared among the others by weight. Within a source, documents come in the order of a
seeded hash. A document's virtual finish is the words of its source through it, divided by the source's target;
repeated passes over a source go on counting. All sources' documents, ordered by virtual finish, are the queue, and the
mix is what comes before the budget's end in it: the last document there is cut. A document in which its source's target
is reached is queued as two packets, so a target is missed by a few words (one for each source) and not by a document.

Equal intervals of virtual time range-partition the queue without sampling: each holds about the same number of words
up to the budget's end, and fewer after it. Cumulative sums go over hash-range buckets and over intervals: a sum for each,
offsets from those sums, and then sums within, so a source with a third of all rows is no single task.

Null texts have size 0 and are taken with 0 words; a null source is a source of its own, the last. A source without
words has target 0. Repeated rows count each for itself; rows that differ only in columns besides id, source and text
may change places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialised, quoted, table, word_count

WEIGHTS, MOST = (5, 2, 1), 3
#: Rows in a bucket, about.
BUCKET_ROWS = 20_000
SEED = "mix"
#: Between a word and the white space after it.
WORD_ENDS = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: source, source_size. Adds weight, budget (all words) and target.

    Sources fill up in the order of capacity over weight: the first k are held at their capacity, and the others
    share what is left by weight; k is the first for which none of the others is above. One row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy((F.col("room") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rest = Window.partitionBy()
    held = (
        sizes.withColumn("weight", w).withColumn("room", F.col("source_size") * most).withColumn("budget", F.sum("source_size").over(rest))
        .withColumn("held_before", F.coalesce(F.sum("room").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_from", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("held", F.col("weight") * (F.col("budget") - F.col("held_before")) > F.col("room") * F.col("weight_from"))
    )
    total = held.withColumn("held_sum", F.coalesce(F.sum(F.when(F.col("held"), F.col("room"))).over(rest), F.lit(0))).withColumn("open_weight", F.sum(F.when(~F.col("held"), F.col("weight"))).over(rest))
    shared = F.col("weight").cast("double") * (F.col("budget") - F.col("held_sum")).cast("double") / F.col("open_weight").cast("double")
    return total.select("source", "source_size", "weight", "budget", F.when(F.col("held"), F.col("room").cast("double")).otherwise(shared).alias("target"))


def mix_stream(rows: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, buckets: int = 16) -> DataFrame:
    """The queue of all packets in the order of virtual finish, and what the mix takes of each.

    rows: numbered() rows. A packet is a pass over a document; one in which its source's target is reached ends there,
    and its rest is a packet of its own. Columns: the rows' own, source_size, target, pass, size_from and size_to (words
    of the source through the packet's ends, all passes counted), virtual_finish, mix_offset (words of the queue before
    it), range_no (interval of virtual time) and words (taken: those before the budget's end).
    """
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    per_source = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, most)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    offsets = offsets.join(per_source, offsets["source"].eqNullSafe(per_source["source"])).select(offsets["source"].alias("o_source"), F.col("bucket").alias("o_bucket"), "bucket_start", "source_size", "target", "budget")
    in_bucket = Window.partitionBy("source", "bucket").orderBy("shuffle_key", "doc_id", "size", "text_hash")
    placed = (
        rows.withColumn("through", F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
        .withColumn("first_start", F.col("bucket_start") + F.col("through") - F.col("size"))
    )
    served, start = F.floor("target").cast("long"), F.col("pass") * F.col("source_size") + F.col("first_start")
    passes = F.filter(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: (p == 0) | ((F.col("size") > 0) & (p * F.col("source_size") + F.col("first_start") < F.col("target"))))
    part = lambda x, y: F.struct(x.alias("size_from"), y.alias("size_to"))
    end = F.col("start") + F.col("size")
    queued = (
        placed.withColumn("pass", F.explode(passes)).withColumn("start", start)
        .withColumn("part", F.explode(F.when((F.col("start") < served) & (served < end), F.array(part(F.col("start"), served), part(served, end))).otherwise(F.array(part(F.col("start"), end)))))
        .select(*rows.columns, "source_size", "target", "budget", "pass", "part.size_from", "part.size_to")
        .withColumn("virtual_finish", F.when(F.col("target") > 0, F.col("size_to") / F.col("target")).otherwise(F.lit(0.0)))
        .withColumn("range_no", F.floor(F.col("virtual_finish") * buckets).cast("long"))
    )
    packet = F.col("size_to") - F.col("size_from")
    ranges = queued.groupBy("range_no").agg(F.sum(packet).alias("range_words"))
    ranges = ranges.select(F.col("range_no").alias("r_no"), F.coalesce(F.sum("range_words").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("range_start"))
    alone = F.when(packet == 0, F.xxhash64("source", "bucket", "shuffle_key"))  # what has no word needs no sum of its range
    in_range = Window.partitionBy("range_no", "alone").orderBy("virtual_finish", F.col("source").asc_nulls_last(), "size_from")
    stream = queued.withColumn("alone", alone).withColumn("in_range", F.sum(packet).over(in_range.rowsBetween(Window.unboundedPreceding, 0))).join(ranges, F.col("range_no") == F.col("r_no"))
    offset = F.col("range_start") + F.col("in_range") - packet
    return stream.withColumn("mix_offset", offset).withColumn("words", F.greatest(F.lit(0), F.least(packet, F.col("budget") - F.col("mix_offset"))).cast("long")).drop("budget", "alone", "in_range", "r_no", "range_start", "bucket", "shuffle_key", "text_hash")


def numbered(docs: DataFrame, seed: str = SEED, *own: str) -> tuple[DataFrame, int]:
    """Narrow rows of the documents, settled, and the number of intervals: _row (unique), source, size, bucket, shuffle_key, text_hash, and columns of their own."""
    bucket_of = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select("_row", "doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("shuffle_key"), F.xxhash64("text").alias("text_hash"), *own)
    buckets = max(16, docs.select(F.lit(1)).count() // BUCKET_ROWS)
    return materialised(rows.withColumn("bucket", F.floor(bucket_of / -(-(1 << 32) // buckets)))), buckets


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, passes, virtual_finish (of its first pass), mix_offset (of its first word in the mix, or null)."""
    rows, buckets = numbered(docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("_row")), seed)
    stream, some = mix_stream(rows, weights, most, buckets), F.col("words") > 0
    per = stream.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")], F.sum("words").alias("taken"), F.count_distinct(F.when(some, F.col("pass"))).alias("passes"),
        F.max(F.when(F.col("pass") == 0, F.col("virtual_finish"))).alias("virtual_finish"), F.min(F.when(some, F.col("mix_offset"))).alias("mix_offset"),
    )
    return per.drop("_row")


def mixed_documents(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The documents of the mix with their own columns: one row for each pass, the text cut to the words taken.

    The mix is computed on narrow rows; the texts are shuffled once, to meet the words taken.
    """
    names = docs.columns
    whole = materialised(docs.select(F.struct(*[F.col(quoted(c)) for c in names]).alias("_doc"), F.monotonically_increasing_id().alias("_row")))
    rows, buckets = numbered(whole.select("_row", "_doc.doc_id", "_doc.source", "_doc.text"), seed)
    taken = mix_stream(rows, weights, most, buckets).filter("words > 0").groupBy("_row", "pass").agg(F.sum("words").alias("words"), F.first("size").alias("size"))
    pieces = F.split(F.col("_doc.text"), WORD_ENDS)
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), "")
    text = F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("_doc.text"))
    return whole.join(taken, "_row").select(*[text.alias("text") if c == "text" else F.col("_doc").getField(c).alias(c) for c in names])


def op2(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "virtual_finish", "mix_offset")


OP2_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(concat('mix:', doc_id)) AS shuffle_key FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source
), weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         3 * source_size AS room, CAST(sum(source_size) OVER () AS BIGINT) AS budget FROM sizes
), filled AS (
  SELECT *, weight * (budget - coalesce(sum(room) OVER (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         > room * sum(weight) OVER (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS held FROM weighted
), targets AS (
  SELECT source, source_size, CASE WHEN held THEN CAST(room AS DOUBLE) ELSE CAST(weight AS DOUBLE)
         * CAST(budget - coalesce(sum(room) FILTER (held) OVER (), 0) AS DOUBLE) / CAST(sum(weight) FILTER (NOT held) OVER () AS DOUBLE) END AS target FROM filled
), placed AS (
  SELECT r.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS served, CAST(sum(size) OVER (PARTITION BY r.source ORDER BY shuffle_key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS first_start
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
), passes AS (
  SELECT *, pass * source_size + first_start AS start, pass * source_size + first_start + size AS finish FROM placed, (VALUES (0), (1), (2)) AS p(pass)
  WHERE pass = 0 OR size > 0 AND pass * source_size + first_start < target
), packets AS (
  SELECT *, start AS size_from, CASE WHEN start < served AND served < finish THEN served ELSE finish END AS size_to FROM passes
  UNION ALL SELECT *, served, finish FROM passes WHERE start < served AND served < finish
), queue AS (
  SELECT *, CASE WHEN target > 0 THEN CAST(size_to AS DOUBLE) / target ELSE 0.0 END AS virtual_finish FROM packets
), stream AS (
  SELECT *, CAST(sum(size_to - size_from) OVER (ORDER BY virtual_finish, source NULLS LAST, size_from ROWS UNBOUNDED PRECEDING) - (size_to - size_from) AS BIGINT) AS mix_offset, (SELECT sum(size) FROM rows) AS budget FROM queue
), mixed AS (
  SELECT *, greatest(0, least(size_to - size_from, budget - mix_offset)) AS words FROM stream
)
SELECT doc_id, CAST(any_value(size) AS BIGINT) AS size, any_value(source_size) AS source_size, any_value(target) AS target, CAST(sum(words) AS BIGINT) AS taken,
       max(virtual_finish) FILTER (pass = 0) AS virtual_finish, min(mix_offset) FILTER (words > 0) AS mix_offset
FROM mixed GROUP BY doc_id
"""
