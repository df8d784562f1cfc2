"""The topic ledger and document counts as streams: keyed state, watermarks and late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "title string, first_seen string, last_seen string, dates array<string>, occurrences array<string>, own int"
ENTRY = "topic_key string, title string, first_seen string, last_seen string, repeat_count int, days int, confidence string"
NAMES = {0: "low", 1: "low", 2: "medium", 3: "high"}


def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One topic's observations of a micro-batch into its state; gives the entry as it then is.

    The state has a topic's days and occurrence digests, which grow with its days, not with its observations.
    """
    title, first, last, dates, seen, own = state.get if state.exists else ("", "", "", [], [], 0)
    dates, seen = set(dates), set(seen)
    for rows in batches:
        for r in rows.sort_values("day").itertuples(index=False):
            if not last or r.day >= last:
                title, last = r.title, r.day
            first = min(first, r.day) if first else r.day
            dates.add(r.day)
            seen.add(r.occurrence)
            own = max(own, int(r.own))
    state.update((title, first, last, sorted(dates), sorted(seen), own))
    yield pd.DataFrame([(key[0], title, first, last, len(seen), len(dates), NAMES[max(own, min(len(dates), 3))])], columns=["topic_key", "title", "first_seen", "last_seen", "repeat_count", "days", "confidence"])


def streaming_ledger(observations: DataFrame) -> DataFrame:
    """The ledger's entries as they change. observations: topic_key, title, mode, day, confidence, source_paths, source_hashes (streaming)."""
    from ..operators.rollups import confidence_rank, occurrence_id

    daily = observations.filter(F.col("mode").isin("daily", "manual") & (F.size("source_paths") > 0))
    narrow = daily.select("topic_key", "title", F.col("day").cast("string").alias("day"), occurrence_id(F.col("topic_key"), F.col("mode"), F.col("day"), F.col("source_paths"), F.col("source_hashes")).alias("occurrence"), confidence_rank(F.col("confidence")).alias("own"))
    return narrow.groupBy("topic_key").applyInPandasWithState(update, ENTRY, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 day", late: str = "2 days", by: str = "event_type") -> DataFrame:
    """Counts in event-time windows; rows later than the watermark are dropped, as a stream must."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def deduplicated(events: DataFrame, key: str, time: str = "ts", late: str = "2 days") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, folder: str, name: str, mode: str = "update") -> DataFrame:
    """Runs a stream over what is there now, with its checkpoint in the folder, and returns the sink's rows, each batch's updates in order.

    The sink is Parquet written by foreachBatch under the batch's number, so a batch that is run again after a failure replaces itself.
    """
    out = f"{folder}/{name}/rows"

    def put(df: DataFrame, epoch: int) -> None:
        df.withColumn("batch_no", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/{name}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{out}/batch=*")


def latest(updates: DataFrame, key: str) -> DataFrame:
    """The last entry of each key."""
    columns = [c for c in updates.columns if c not in (key, "batch_no", "batch")]
    return updates.groupBy(key).agg(F.max_by(F.struct(*columns), "batch_no").alias("r")).select(key, "r.*")
