"""Consecutive ids for new rows, without passing the rows through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drillsight.session import stage

#: Bits of Spark's row numbers that count inside a partition.
_INSIDE = 33


def number_rows(df: DataFrame, order: str, first: Column, name: str = "id") -> DataFrame:
    """Add ``name`` = ``first``, ``first`` + 1, ... in the order of ``order``.

    ``order`` is a unique column of any sortable kind, with any gaps.  Rows are divided by
    ranges of it, sorted and counted inside their partition, and each partition starts where
    the ones before it end.  Only the partition sizes are summed up in one place, so a task
    has its share of rows whether the values are dense or far apart.  The rows are computed
    once: they are written with their place before the sizes are counted.
    """
    ranged = df.repartitionByRange(order).sortWithinPartitions(order)
    return number_sorted(ranged, first, name)


def number_sorted(ordered: DataFrame, first: Column, name: str = "id") -> DataFrame:
    """:func:`number_rows` for rows whose partitions are in order already."""
    placed = stage(ordered.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", _INSIDE)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = F.col("_place") - F.shiftleft("_part", _INSIDE)
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")  # a row for each partition
        .withColumn(name, (first + F.col("_start") + inside).cast("long"))
        .drop("_place", "_part", "_start")
    )


def next_id(df: DataFrame, column: str = "id") -> Column:
    """One more than the largest id of ``df`` (1 for an empty table), as a scalar subquery."""
    return df.agg(F.coalesce(F.max(column), F.lit(0)).alias("m")).scalar() + 1
