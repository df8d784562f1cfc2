"""Streaming queries: run over what the events table holds, and compared with the batch results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from ..streaming import ledger as st
from .rollups import _OBS


def events(spark, sf):
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a stream's source is a folder; its filter leaves the other tables out
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", "4").parquet(path if len(spark.read.parquet(path).inputFiles()) > 1 else f"{sf}/event*.parquet")


def folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def ledger(spark, sf):
    e = events(spark, sf)
    topic = F.concat(F.col("event_type"), F.lit("-"), (F.col("user_id") % 9).cast("string"))
    mode = F.when(F.col("event_id") % 11 == 0, "weekly").when(F.col("event_id") % 3 == 0, "manual").otherwise("daily")
    o = e.select(topic.alias("topic_key"), F.concat(F.lit("Title "), topic).alias("title"), mode.alias("mode"), F.to_date("ts").alias("day"), F.when(F.col("value") > 50, "medium").otherwise("low").alias("confidence"), F.array(F.concat(F.lit("raw/"), F.col("event_type"))).alias("source_paths"), F.array(F.col("event_type")).alias("source_hashes"))
    return st.latest(st.run_available(st.streaming_ledger(o), folder(spark), "ledger"), "topic_key")


def counts(spark, sf):
    found = st.run_available(st.windowed_counts(events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))), folder(spark), "counts")
    return found.groupBy("start", "event_type").agg(F.max("n").alias("n")).select(F.to_date("start").alias("day"), "event_type", "n")


QUERIES = {"l10_streaming_ledger": ledger, "l01_streaming_windows": counts}

SQL = {
    "l10_streaming_ledger": f"WITH {_OBS} SELECT topic_key, 'Title ' || topic_key AS title, CAST(first_seen AS VARCHAR) AS first_seen, CAST(last_seen AS VARCHAR) AS last_seen, CAST(repeat_count AS INTEGER) AS repeat_count, CAST(days AS INTEGER) AS days, CASE r WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence FROM led",
    "l01_streaming_windows": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
