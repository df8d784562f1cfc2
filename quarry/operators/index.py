"""The index: chunks, postings, vectors and settings as tables, kept current by snapshot differences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import retrieval


@dataclass(frozen=True)
class Index:
    """What searches read. size: one row (n, avgdl); words: the vocabulary; vectors: chunk_id, embedding, or None."""

    chunks: DataFrame
    postings: DataFrame
    size: DataFrame
    words: DataFrame
    vectors: DataFrame | None = None

    @classmethod
    def of(cls, chunks: DataFrame, vectors: DataFrame | None = None, keep: bool = True) -> Index:
        """Built from chunks; keep: held in the executors' memory and disks until released, since each search reads it several times."""
        chunks = chunks.persist() if keep else chunks
        postings = retrieval.postings(chunks).persist() if keep else retrieval.postings(chunks)
        size, words = retrieval.corpus_size(postings), retrieval.vocabulary(postings)
        return cls(chunks, postings, size.persist() if keep else size, words.persist() if keep else words, vectors)

    def release(self) -> None:
        for df in (self.chunks, self.postings, self.size, self.words):
            df.unpersist()

    def write(self, path: str) -> None:
        for name in ("chunks", "postings", "size", "words"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark, path: str) -> Index:
        return cls(*[spark.read.parquet(f"{path}/{name}") for name in ("chunks", "postings", "size", "words")])


def classify(old: DataFrame, new: DataFrame, profile_changed: bool = False) -> DataFrame:
    """Snapshots (path, hash) compared: path, change (added, updated, unchanged, deleted). A changed profile updates all that stay."""
    o, n = old.select("path", F.col("hash").alias("old_hash")), new.select("path", F.col("hash").alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when((F.col("old_hash") != F.col("new_hash")) | F.lit(profile_changed), "updated").otherwise("unchanged")
    return o.join(n, "path", "full_outer").select("path", change.alias("change"))


def without_paths(table: DataFrame, paths: DataFrame) -> DataFrame:
    return table.join(paths.select("path").distinct(), "path", "left_anti")


def replaced(table: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """The table after a change set: rows of changed and deleted paths give way to fresh ones."""
    gone = changes.filter("change in ('updated', 'deleted')")
    wanted = changes.filter("change in ('added', 'updated')").select("path")
    return without_paths(table, gone).unionByName(fresh.join(wanted, "path", "left_semi"))


def cascade(deleted: DataFrame, chunks: DataFrame, *by_chunk: DataFrame) -> tuple[DataFrame, ...]:
    """Chunks without the deleted paths, and each table keyed by chunk_id without their chunks."""
    gone = chunks.join(deleted.select("path").distinct(), "path", "left_semi").select("chunk_id")
    return without_paths(chunks, deleted), *[t.join(gone, "chunk_id", "left_anti") for t in by_chunk]


def upsert(table: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Latest wins: a fresh row replaces the one with its keys."""
    every = table.withColumn("_turn", F.lit(0)).unionByName(fresh.withColumn("_turn", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_turn")))
    return every.withColumn("_place", last).filter("_place = 1").drop("_place", "_turn")


def reuse_vectors(chunks: DataFrame, vectors: DataFrame, model: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Chunks that keep a vector of the same model and size (chunk_id, embedding), and those to embed."""
    fit = vectors.filter((F.col("model") == model) & (F.col("dim") == dim)).select("chunk_id", "embedding")
    return chunks.select("chunk_id").join(fit, "chunk_id"), chunks.join(fit, "chunk_id", "left_anti")


def with_columns_added(table: DataFrame, derived: dict[str, Column]) -> DataFrame:
    """Additive migration: columns that the table lacks are derived, those it has stay."""
    return table.withColumns({k: c for k, c in derived.items() if k not in table.columns})


def space_fingerprint(provider: str, model: str, dim: int, backend: str) -> Column:
    return F.sha2(F.concat_ws("\u0000", F.lit(provider), F.lit(model), F.lit(str(dim)), F.lit(backend)).cast("binary"), 256)


def profile_mismatch(settings: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Stored settings that differ from the expected ones: key, stored, expected. settings: key, value."""
    wanted = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    return settings.filter(F.col("key").isin(*expected)).select("key", F.col("value").alias("stored"), F.element_at(wanted, F.col("key")).alias("expected")).filter("stored <> expected")
