"""Stored tables laid out for look-ups of one link or one tracking id.

Events are split by period (a day, or what a date pattern says) and, within it, by spans of link
ids of one width; inside a file they are sorted by link, and Parquet keeps a Bloom filter (or a
dictionary) of ``link_id`` for each row group.  A look-up of one link reads the folder of its span of
each period, or of some.  Width and pattern are part of the path, so that a store may change
them and is still read as one.

Links are split by the first letters of their tracking id, sorted by it, with Bloom filters of
``tracking_id`` and ``id``.  Tracking ids are hashes, so the parts are of one size.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drillsight.session import child_names

#: Links in a span.  New links get consecutive ids, so a span is about one campaign.
WIDTH = 1_000_000
#: Letters of a tracking id that name its part: 256 parts.
PREFIX = 2


def _bloom(*columns: str) -> dict[str, str]:
    """Write options for Bloom filters that fit themselves to the number of values."""
    return {"parquet.bloom.filter.adaptive.enabled": "true"} | {f"parquet.bloom.filter.enabled#{c}": "true" for c in columns}


def _span(link: Column, width: int) -> Column:
    return F.floor(link / width).cast("long")


def store_events(events: DataFrame, path: str, width: int = WIDTH, period: str = "yyyy-MM-dd") -> None:
    """Append click events to the store at ``path``.  ``period`` is a pattern whose texts sort by time.

    Rows of a period and span are brought together first; a crowded one is divided among tasks.
    """
    rows = events.withColumns(
        {"period": F.concat(F.lit("p"), F.date_format("created_at", period)), "span": _span(F.col("link_id"), width)}
    )
    (
        rows.hint("rebalance", "period", "span")
        .sortWithinPartitions("period", "span", "link_id", "created_at", "id")
        .write.mode("append")
        .options(**_bloom("link_id"))
        .partitionBy("period", "span")
        .parquet(f"{path}/pattern={period}/width={width}")
    )


def clicks_of_links(
    spark: SparkSession, path: str, link_ids: list[int], since: dt.date | None = None, until: dt.date | None = None
) -> DataFrame:
    """The events of a few links, of some days if told so; no other span or period is read."""
    out = None
    for pattern, width in _layouts(spark, path):
        rows = spark.read.parquet(f"{path}/pattern={pattern}/width={width}")
        rows = rows.filter(F.col("span").isin(sorted({i // width for i in link_ids})) & F.col("link_id").isin(link_ids))
        day = F.to_date("created_at")
        if since is not None:
            first = F.concat(F.lit("p"), F.date_format(F.lit(since), pattern))
            rows = rows.filter((F.col("period") >= first) & (day >= F.lit(since)))
        if until is not None:
            last = F.concat(F.lit("p"), F.date_format(F.lit(until), pattern))
            rows = rows.filter((F.col("period") <= last) & (day <= F.lit(until)))
        rows = rows.drop("period", "span")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"no events are stored at {path}")
    return out


def _layouts(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Pattern and width of each part of a store."""
    return [
        (outer.removeprefix("pattern="), int(inner.removeprefix("width=")))
        for outer in child_names(spark, path)
        if outer.startswith("pattern=")
        for inner in child_names(spark, f"{path}/{outer}")
        if inner.startswith("width=")
    ]


def store_links(links: DataFrame, path: str) -> None:
    """Append links to the store at ``path``, by the first letters of their tracking id."""
    rows = links.withColumn("prefix", F.concat(F.lit("p"), F.lower(F.substring("tracking_id", 1, PREFIX))))
    (
        rows.hint("rebalance", "prefix")
        .sortWithinPartitions("prefix", "tracking_id")
        .write.mode("append")
        .options(**_bloom("tracking_id", "id"))
        .partitionBy("prefix")
        .parquet(path)
    )


def links_of_tracking(spark: SparkSession, path: str, tracking_ids: list[str]) -> DataFrame:
    """The links of a few tracking ids; only their parts are read."""
    parts = sorted({f"p{x[:PREFIX].lower()}" for x in tracking_ids})
    rows = spark.read.parquet(path).filter(F.col("prefix").isin(parts) & F.col("tracking_id").isin(tracking_ids))
    return rows.drop("prefix")
