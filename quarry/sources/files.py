"""JSON inputs with fixed schemas, run folders, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVAL_SCHEMA = "schema_version string, frozen boolean, description string, queries array<struct<id:string,query:string,expected_paths:array<string>,expected_phrases:array<string>,scope_tags:array<string>>>"
PROPOSAL_SCHEMA = "id string, proposal_type string, relation string, source_path string, target_path string, confidence double, risk string, auto_apply boolean, human_review_required boolean, evidence array<struct<path:string,kind:string,value:string>>, rationale string"
AUDIT_SCHEMA = "proposal_id string, run_id string, event string, status string, dry_run boolean, apply boolean, reason string, created_at string"
SNAPSHOT_SCHEMA = "schema_version string, files map<string,struct<hash:string,mtime:bigint,size:bigint>>"


class SourceError(ValueError):
    pass


def read_eval(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """Evaluation cases of a JSON file: case_id, query, expected_paths, expected_phrases, scope_tags. Another version, or no case, is refused."""
    spec = spark.read.schema(EVAL_SCHEMA).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    head = spec.select("schema_version", F.coalesce(F.size("queries"), F.lit(0)).alias("n")).first()
    if head is None or head["n"] < 1:
        raise SourceError(f"{path} has no queries")
    if version and head["schema_version"] != version:
        raise SourceError(f"{path} has version {head['schema_version']}, not {version}")
    none = F.array().cast("array<string>")
    q = spec.select(F.explode("queries").alias("q"))
    return q.select(F.col("q.id").alias("case_id"), "q.query", *[F.coalesce(f"q.{c}", none).alias(c) for c in ("expected_paths", "expected_phrases", "scope_tags")])


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with their numbers; blank lines are skipped; a broken line is an error that names it."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("k", "line")).filter(F.trim("line") != "")
    parsed = lines.select((F.col("k") + 1).alias("line_no"), "line", F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r"))
    broken = F.raise_error(F.concat(F.lit(f"{path}, line "), F.col("line_no").cast("string"), F.lit(": not a JSON object")))
    sound = F.try_parse_json("line").isNotNull() & F.ltrim("line").startswith("{")
    return parsed.select("line_no", F.when(sound, F.col("r")).otherwise(broken).alias("r")).select("line_no", "r.*")


def read_proposals(spark: SparkSession, path: str) -> DataFrame:
    """Proposals of a JSON-lines file, with evidence_paths."""
    return read_jsonl(spark, path, PROPOSAL_SCHEMA).withColumn("evidence_paths", F.coalesce(F.transform("evidence", lambda e: e["path"]), F.array().cast("array<string>")))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, AUDIT_SCHEMA)


def run_folders(spark: SparkSession, root: str, file: str = "proposals.jsonl") -> DataFrame:
    """run_id, complete of the folders under a root: complete if they hold the file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    parts = F.split("path", "/")
    return found.select(F.element_at(parts, -2).alias("run_id"), F.element_at(parts, -1).alias("file")).groupBy("run_id").agg(F.bool_or(F.col("file") == file).alias("complete"))


def latest_proposals(spark: SparkSession, root: str) -> DataFrame | None:
    """Proposals of the greatest run that is complete, or None."""
    from ..operators.evaluation import last_run

    latest = last_run(run_folders(spark, root)).first()["latest"]
    return read_proposals(spark, f"{root}/{latest}/proposals.jsonl").withColumn("run_id", F.lit(latest)) if latest else None


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """path, hash, mtime, size of a snapshot file."""
    return spark.read.schema(SNAPSHOT_SCHEMA).option("multiLine", "true").json(path).select(F.explode("files").alias("path", "f")).select("path", "f.hash", "f.mtime", "f.size")


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet, partitioned by columns of few values if given."""
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def append_events(df: DataFrame, path: str) -> None:
    """Appends feedback, audit or query-log events with the time of writing."""
    df.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def report(sections: list[tuple[str, DataFrame]], title: str, most: int = 50) -> str:
    """A Markdown report: a heading and a table for each section, its first rows."""
    out = [f"# {title}", ""]
    for name, df in sections:
        rows = df.limit(most).collect()
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows] + [""]
    return "\n".join(out)
