"""Distinct visitors from mergeable sketches: one small column per link and day.

A sketch (HyperLogLog of the DataSketches kind, as Spark's ``hll_*`` functions make them) has a
fixed size whatever it has seen, and sketches of parts merge into that of the whole: days into
months, batches into days, both stores into one.  So a span of days is counted without the
clicks, and a stream keeps no state for each visitor.

The estimate's standard error is :func:`standard_error`: 1.04 divided by the root of the number of
registers, 1.6 % at ``LG_K`` = 12.  Sketches of few visitors list them and are all but exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drillsight.functions.network import day_of

#: Registers of a sketch as a power of two: 4,096 registers, at most some 4 KB.
LG_K = 12
#: Standard errors an estimate may be off in :func:`within`: a normal error is beyond it three times
#: in ten thousand links.  Smaller counts may always be off by one.
SIGMAS = 3.6


def standard_error(lg_k: int = LG_K) -> float:
    """Relative standard error of a merged sketch."""
    return 1.04 / math.sqrt(1 << lg_k)


def sketch_visitors(clicks: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """``link_key, day, clicks, visitors`` of ``link_key, clicked_at, ip_hash``.

    Sketches are combined before the shuffle, so a crowded link costs its reducer one sketch
    a task.  Null visitors are not counted, as by a distinct count; a link and day with no
    other keeps an empty sketch.
    """
    return clicks.groupBy("link_key", day_of(F.col("clicked_at")).alias("day")).agg(
        F.count("*").alias("clicks"), F.hll_sketch_agg("ip_hash", lg_k).alias("visitors")
    )


def merge_sketches(sketches: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """One row for each group of ``by``: its clicks, and its sketches merged."""
    return sketches.groupBy(*by).agg(F.sum("clicks").alias("clicks"), F.hll_union_agg("visitors").alias("visitors"))


def estimates(merged: DataFrame) -> DataFrame:
    """``merged`` with the estimated number of ``unique_users`` in place of the sketch."""
    return merged.withColumn("unique_users", F.hll_sketch_estimate("visitors")).drop("visitors")


def visitors_by_span(sketches: DataFrame, span: Column, name: str = "span") -> DataFrame:
    """Estimates per link and ``span``, an expression of ``day`` such as its month."""
    return estimates(merge_sketches(sketches, ["link_key", span.alias(name)]))


def within(estimate: Column, exact: Column, lg_k: int = LG_K, sigmas: float = SIGMAS) -> Column:
    """Whether an estimate lies within ``sigmas`` standard errors of the exact count."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), exact * (sigmas * standard_error(lg_k)))
