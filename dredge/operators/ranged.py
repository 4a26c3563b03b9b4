"""Running values over a total order without a task that sees all rows.

Rows are dealt into ranges of the order. A range's total is one number, so the totals of the ranges before it
are a window over as many rows as there are ranges; within a range the running value is a window of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dredge.storage import checkpointed

RANGE = "_range"


def in_ranges(rows: DataFrame, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """The rows with the number of their range; written once, so the ranges stay as they are."""
    dealt = rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order)
    return checkpointed(dealt.withColumn(RANGE, F.spark_partition_id()))


def carried(ranged: DataFrame, total: Column, onward: Column) -> DataFrame:
    """(_range, before): what the ranges before each range come to, by an aggregate of a range's rows and one of the totals."""
    totals = ranged.groupBy(RANGE).agg(total.alias("total"))
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(RANGE, onward.over(before).alias("before"))


def running(ranged: DataFrame, order: Sequence[str | Column], name: str, of: Column, total: Column, onward: Column, both: Column) -> DataFrame:
    """Adds the running value ``name``: ``of`` over a range's rows up to each row, put together with what came before.

    total and onward as in ``carried``; both: a column made of ``before`` (null in the first range) and ``inside``.
    """
    inside = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.withColumn("inside", of.over(inside)).join(carried(ranged, total, onward), RANGE)
    return rows.withColumn(name, both).drop("inside", "before")
