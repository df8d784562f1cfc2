"""A total order's numbers and running sums without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled


def numbered(df: DataFrame, order: list[Column], name: str = "position", running: dict[str, Column] | None = None) -> DataFrame:
    """Adds each row's number from 1 in the order, and running sums of columns through it.

    Rows are range-partitioned by the order and numbered within a partition; partitions add what lies before them, from
    sums of which there is one row for each partition. Rows equal in the order may change places.
    """
    running = running or {}
    own = settled(df.repartitionByRange(*order).withColumns({"_part": F.spark_partition_id(), **{f"_v_{c}": v for c, v in running.items()}}))
    within = Window.partitionBy("_part").orderBy(*order)
    through = within.rowsBetween(Window.unboundedPreceding, 0)
    parts = own.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v_{c}").alias(f"_s_{c}") for c in running])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    parts = parts.select(F.col("_part").alias("_p"), earlier("_n").alias("_b"), *[earlier(f"_s_{c}").alias(f"_b_{c}") for c in running])
    placed = own.withColumns({"_k": F.row_number().over(within), **{f"_r_{c}": F.sum(f"_v_{c}").over(through) for c in running}}).join(parts, F.col("_part") == F.col("_p"))
    return placed.select(*df.columns, (F.col("_b") + F.col("_k")).alias(name), *[(F.col(f"_b_{c}") + F.coalesce(F.col(f"_r_{c}"), F.lit(0))).alias(c) for c in running])
