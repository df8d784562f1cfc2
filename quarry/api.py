"""The library's face: a vault's index on disk, kept current and searched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.markdown import link_set, parse_notes
from .functions.providers import MockEmbedding
from .operators import chunking, evaluation, retrieval
from .operators import index as ix
from .operators.index import Index
from .plans.search import SearchOptions, check_space, search
from .sources.files import append_events
from .sources.shared import settled
from .sources.vault import scan_vault

TABLES = ("files", "chunks", "vectors")


class Engine:
    """An index under a folder: files, chunks, vectors, settings and events as Parquet, in generations.

    A write makes a new generation and then points to it, so readers see a whole one, and a write that dies leaves none.
    """

    def __init__(self, spark: SparkSession, root: str, provider: MockEmbedding | None = None, max_bytes: int = chunking.MAX_BYTES, overlap: int = 0):
        self.spark, self.root, self.provider, self.max_bytes, self.overlap = spark, root.rstrip("/"), provider or MockEmbedding(), max_bytes, overlap

    def _generation(self) -> int | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        done = [int(n[11:]) for n in names if n.startswith("generation-") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}/settings/_SUCCESS"))]
        return max(done, default=None)

    def table(self, name: str) -> DataFrame:
        at = self._generation()
        if at is None:
            raise FileNotFoundError(f"no index under {self.root}")
        return self.spark.read.parquet(f"{self.root}/generation-{at}/{name}")

    def settings(self) -> dict[str, str]:
        return {r["key"]: r["value"] for r in self.table("settings").collect()}

    def profile(self) -> dict[str, str]:
        return {"provider": self.provider.name, "model": self.provider.model, "dim": str(self.provider.dim), "max_bytes": str(self.max_bytes), "overlap": str(self.overlap)}

    def chunks_of(self, notes: DataFrame) -> DataFrame:
        return chunking.chunk(parse_notes(notes), self.max_bytes, self.overlap).withColumn("links", link_set(F.col("text")))

    def index(self, notes: DataFrame, paths: DataFrame | None = None) -> dict[str, int]:
        """Brings the index up to date with notes (path, source, mtime); paths: only these. Returns counts of changes.

        Unchanged notes are neither parsed nor embedded again; chunks whose id was embedded by the same model keep their vectors. New
        tables are computed before the generation is named, so a failed embedding leaves the old index as it is.
        """
        fresh = notes.withColumns({"hash": F.sha2(F.col("source").cast("binary"), 256), "size": F.octet_length("source").cast("long")})
        at, profile = self._generation(), self.profile()
        if at is not None:
            held = self.settings()
            if any(held.get(k) != profile[k] for k in ("provider", "model", "dim")) and self.table("vectors").limit(1).count():
                raise ValueError("profile mismatch: the index holds vectors of another space")
            resized = any(held.get(k) != profile[k] for k in ("max_bytes", "overlap"))
            if resized and paths is not None:
                raise ValueError("a path-scoped update can't change the size of chunks")
            old = {t: self.table(t) for t in TABLES}
        else:
            resized, old = False, None
        if paths is not None:
            fresh = fresh.join(paths.select("path").distinct(), "path", "left_semi")
        before = old["files"].select("path", "hash") if old else fresh.select("path", "hash").limit(0)
        scope = before if paths is None else before.join(paths.select("path").distinct(), "path", "left_semi")
        changes = settled(ix.classify(scope, fresh.select("path", "hash"), resized))
        wanted = fresh.join(changes.filter("change in ('added', 'updated')"), "path", "left_semi")
        made = settled(self.chunks_of(wanted.select("path", "source", "mtime")))
        files = fresh.select("path", "mtime", "size", "hash")
        if old:
            files, chunks = ix.replaced(old["files"], files, changes), ix.replaced(old["chunks"], made.select(*old["chunks"].columns), changes)
            kept, todo = ix.reuse_vectors(made, old["vectors"], self.provider.model, self.provider.dim)
            others = old["vectors"].join(ix.without_paths(old["chunks"], changes.filter("change in ('updated', 'deleted')")), "chunk_id", "left_semi").select("chunk_id", "embedding")
            vectors = others.unionByName(kept).unionByName(self.embedded(todo))
        else:
            chunks, vectors = made, self.embedded(made)
        target = f"{self.root}/generation-{0 if at is None else at + 1}"
        for name, df in {"files": files, "chunks": chunks, "vectors": vectors.withColumns({"model": F.lit(self.provider.model), "dim": F.lit(self.provider.dim)})}.items():
            df.write.mode("overwrite").parquet(f"{target}/{name}")
        self.spark.createDataFrame(list(profile.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{target}/settings")
        return {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}

    def index_vault(self, path: str) -> dict[str, int]:
        return self.index(scan_vault(self.spark, path).select("path", "source", "mtime"))

    def embedded(self, chunks: DataFrame) -> DataFrame:
        text = chunking.embedding_text(F.col("title"), F.col("heading"), F.col("tags"), F.col("text"))
        return self.provider.apply(chunks.select("chunk_id", text.alias("input")), "input").select("chunk_id", "embedding")

    def open(self) -> Index:
        held = self.settings()
        check_space((held["model"], held["dim"]), (self.provider.model, str(self.provider.dim)))
        return Index.of(self.table("chunks"), self.table("vectors").select("chunk_id", "embedding"))

    def query(self, texts: list[str], now: str, options: SearchOptions = SearchOptions(), index: Index | None = None) -> DataFrame:
        """Results of a batch of searches; query_id is the text's place."""
        queries = self.spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "query_id string, raw string")
        vectors = self.provider.apply(queries, "raw").select("query_id", "embedding")
        return search(index or self.open(), queries, now, options, vectors)

    def get(self, ids: list[str], radius: int = 0) -> DataFrame:
        found = retrieval.get_by_ids(self.table("chunks"), ids)
        return retrieval.context(self.table("chunks"), found.select("chunk_id"), min(radius, 3)) if radius else found

    def status(self) -> DataFrame:
        return evaluation.status_counts(self.table("chunks"), self.table("vectors"))

    def feedback(self, events: DataFrame) -> None:
        """events: event, query_id, chunk_id, query, payload."""
        append_events(events, f"{self.root}/events")

    def manifest(self) -> DataFrame:
        return evaluation.manifest(self.table("files"))
