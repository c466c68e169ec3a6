"""The aggregate under nearly all reports: one row per clicked link.

Click events are by far the largest table.  Each event belongs to one link, each link to
one campaign and one recipient, so every report may start from clicks per link.  The
count is combined before the shuffle, so a link with a third of all clicks costs its
reducer one row per map task; behind it, all joins are between tables of links or smaller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Columns of rolled-up clicks: what they count, and what they know of the last of them.
ROLLED = ("link_id", "clicks", "first_click", "last_click", "last_id", "last_user_agent")


def is_rolled(clicks: DataFrame) -> bool:
    """Whether rows stand for several clicks each."""
    return set(ROLLED) <= set(clicks.columns)


def weighted(events: DataFrame) -> DataFrame:
    """Events as rolled-up rows of one click each."""
    return events.select(
        "link_id",
        F.lit(1).cast("long").alias("clicks"),
        F.col("created_at").alias("first_click"),
        F.col("created_at").alias("last_click"),
        F.col("id").alias("last_id"),
        F.col("user_agent").alias("last_user_agent"),
    )


def combined(rows: DataFrame, *by: str | Column) -> DataFrame:
    """Rolled-up rows, one for each group of ``by``."""
    last = F.max(F.struct("last_click", "last_id", "last_user_agent"))
    grouped = rows.groupBy(*by).agg(
        F.sum("clicks").alias("clicks"), F.min("first_click").alias("first_click"), last.alias("_last")
    )
    return grouped.select(*[c for c in grouped.columns if c != "_last"], "_last.*")


def clicks_per_link(events: DataFrame) -> DataFrame:
    """``link_id, clicks, first_click, last_click`` of every link that was clicked.

    ``events`` may be rolled up (``operators/rollup.py``).
    """
    if is_rolled(events):
        count = F.sum("clicks")
        first, last = "first_click", "last_click"
    else:
        count = F.count("*")
        first = last = "created_at"
    return events.groupBy("link_id").agg(
        count.alias("clicks"), F.min(first).alias("first_click"), F.max(last).alias("last_click")
    )


def last_click_per_link(events: DataFrame) -> DataFrame:
    """``link_id, click_count, last_clicked_at, last_user_agent`` of every clicked link, events or
    rolled up: the agent of the newest event, the larger id at ties."""
    rows = events if is_rolled(events) else weighted(events)
    return rows.groupBy("link_id").agg(
        F.sum("clicks").alias("click_count"),
        F.max("last_click").alias("last_clicked_at"),
        F.max_by("last_user_agent", F.struct("last_click", "last_id")).alias("last_user_agent"),
    )


def last_agent_per_link(events: DataFrame) -> DataFrame:
    """``link_id, last_user_agent``: the agent of the newest event, the larger id at ties."""
    return events.groupBy("link_id").agg(
        F.max_by("user_agent", F.struct("created_at", "id")).alias("last_user_agent")
    )


def links_with_clicks(links: DataFrame, events: DataFrame) -> DataFrame:
    """Every link with its clicks (0 if none), first and last click."""
    per_link = clicks_per_link(events).withColumnRenamed("link_id", "id")
    return links.join(per_link, "id", "left").withColumn("clicks", F.coalesce("clicks", F.lit(0)))
