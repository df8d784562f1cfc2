"""Embedding and reranking providers as column transformations.

A provider has a name, a model and, for embeddings, a dimension; it works on batches in the executors. The mock providers are
deterministic and need no model. Remote ones take a client that the caller injects: a function from a list of texts to vectors (or
scores); batching, retries and checks are here.
"""

from __future__ import annotations

import math
import re
import time
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH, ATTEMPTS, FIRST_WAIT = 64, 3, 0.25
WORDS = re.compile(r"[^\W_]+")


class ProviderError(RuntimeError):
    pass


class Retryable(RuntimeError):
    """What a client raises for an answer that may succeed later (too many requests, a server's error)."""


def with_vectors(df: DataFrame, text: str, out: str, embed: Callable[[list[str]], list]) -> DataFrame:
    """Adds a column of vectors that `embed` gives for each Arrow batch's texts."""
    at, schema = df.columns.index(text), df.select("*", F.lit(None).cast("array<float>").alias(out)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(embed([t or "" for t in b.column(at).to_pylist()]), pa.list_(pa.float32()))], names=schema.names)

    return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class MockEmbedding:
    """Hashed words with signs, scaled to length 1: equal texts have equal vectors, shared words draw texts together."""

    dim: int = 64
    name: str = "mock"
    model: str = "mock-hash"

    def vectors(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            codes = np.array([zlib.crc32(w.encode()) for w in WORDS.findall(text.lower())], dtype=np.int64)
            v = np.bincount(codes // 2 % self.dim, weights=np.where(codes % 2, 1.0, -1.0), minlength=self.dim)
            norm = np.sqrt((v * v).sum())
            out.append((v / norm if norm else v).astype(np.float32))
        return out

    def apply(self, df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        return with_vectors(df, text, out, self.vectors)


def called(client: Callable[[list], list], items: list, attempts: int = ATTEMPTS, wait: float = FIRST_WAIT) -> list:
    """The client's answer, after at most `attempts` tries with doubling waits; one answer for each item."""
    for k in range(attempts):
        try:
            found = client(items)
            break
        except Retryable as e:
            if k + 1 == attempts:
                raise ProviderError(f"embedding request failed after {attempts} attempts: {e}") from e
            time.sleep(wait * 2**k)
    if len(found) != len(items):
        raise ProviderError(f"count mismatch: {len(found)} answers to {len(items)} texts")
    return found


@dataclass(frozen=True)
class RemoteEmbedding:
    """Vectors from an injected client, in batches; each must have `dim` finite parts."""

    client: Callable[[list[str]], list[list[float]]] = field(repr=False)
    dim: int
    model: str
    name: str = "remote"
    batch: int = BATCH

    def vectors(self, texts: list[str]) -> list[list[float]]:
        found: list[list[float]] = []
        for k in range(0, len(texts), self.batch):
            found += called(self.client, texts[k : k + self.batch])
        for v in found:
            if len(v) != self.dim or not all(map(math.isfinite, v)):
                raise ProviderError(f"dimension mismatch: {len(v)} parts, {self.dim} expected")
        return found

    def apply(self, df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        return with_vectors(df, text, out, self.vectors)


@dataclass(frozen=True)
class MockReranker:
    """The share of a query's words that a text holds."""

    name: str = "mock"

    def score(self, query: Column, text: Column) -> Column:
        words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != "")
        return F.coalesce(F.size(F.filter(words, lambda w: F.contains(F.lower(text), w))) / F.nullif(F.size(words), F.lit(0)), F.lit(0.0))


@dataclass(frozen=True)
class RemoteReranker:
    """Scores from an injected client (query, texts) for the candidates of each query; it fails closed."""

    client: Callable[[str, list[str]], list[float]] = field(repr=False)
    name: str = "remote"

    def apply(self, results: DataFrame, query: str = "raw", text: str = "document") -> DataFrame:
        client = self.client
        schema = results.select("*", F.lit(0.0).alias("model_score")).schema

        def run(key, t):  # without hints, by which Spark would look for another kind of function
            asked, texts = t.column(query)[0].as_py(), t.column(text).to_pylist()
            return t.append_column("model_score", pa.array([float(s) for s in called(lambda x: client(asked, x), texts)], pa.float64()))

        return results.groupBy("query_id").applyInArrow(run, schema)


def resolve(name: str, **options):
    """A provider by name: mock, or remote with a client."""
    kinds = {"mock": MockEmbedding, "remote": RemoteEmbedding}
    if name not in kinds:
        raise ProviderError(f"unknown embedding provider {name}")
    return kinds[name](**options)
