"""Positions and running sums over a whole order, without putting the order into one task.

The rows are dealt by ranges of the order itself, sampled by Spark, so that equal scores, however many, spread over tasks
as the later keys of the order tell them apart. Totals of the ranges are small; their prefix sums are added to
positions and sums inside each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import held


def with_running(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: Sequence[str] = (), position: str = "pos") -> DataFrame:
    """df with `position` (from 1) and cum_<c> for c in sums, in each group of `by`.

    order should tell all rows of a group apart. The ranges are written to the shared folder first, since a range's bounds
    may differ when they are sampled again; only one row for each range and group meets in the window over ranges.
    """
    by = list(by)
    ranges = held(df.repartitionByRange(*by, *order).withColumn("_bucket", F.spark_partition_id()))
    totals = ranges.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *by,
        F.col("_bucket"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_s0_{c}") for c in sums],
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = ranges.withColumn("_rank", F.row_number().over(inside))
    for c in sums:
        out = out.withColumn(f"_run_{c}", F.sum(c).over(running))
    out = out.join(starts, [*by, "_bucket"])
    return out.select(*df.columns, (F.col("_n0") + F.col("_rank")).alias(position), *[(F.col(f"_s0_{c}") + F.col(f"_run_{c}")).alias(f"cum_{c}") for c in sums])
