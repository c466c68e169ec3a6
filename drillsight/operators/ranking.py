"""Newest campaigns, the trend between them, and ranks.

These look at a handful of campaigns.  The handful is fetched first (so it is computed once),
only its links are read, and the events are cut down to those links before they are counted
or moved; the rest of the history costs a scan of one column.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drillsight.functions.people import department_or_unknown, display_name
from drillsight.functions.rates import percent, percent_whole, trend_label, trend_points
from drillsight.functions.text import or_else, short_label
from drillsight.operators.aggregates import at_risk, campaign_summary
from drillsight.operators.ordering import newest_first
from drillsight.plans.clicks import clicks_per_link
from drillsight.plans.skew import dimension_join, lookup_join
from drillsight.session import stage

# Campaigns shown in the chart, and campaigns compared for the trend.
CHART_LENGTH = 6
TREND_LENGTH = 3
# Fixed value: shown for a recipient without a department.
NO_DEPARTMENT = "No dept"


def _newest_with_counts(campaigns: DataFrame, links: DataFrame, events: DataFrame, n: int) -> DataFrame:
    """:func:`campaign_summary` of the ``n`` newest campaigns only."""
    ids = [r["id"] for r in newest_first(campaigns).limit(n).select("id").collect()]  # n at most
    wanted = links.filter(F.col("campaign_id").isin(ids))
    clicked = dimension_join(events, wanted.select(F.col("id").alias("link_id")), "link_id", "left_semi")
    return campaign_summary(campaigns.filter(F.col("id").isin(ids)), wanted, clicked)


def last_campaigns(
    campaigns: DataFrame, links: DataFrame, events: DataFrame, n: int = CHART_LENGTH, width: int = 20
) -> DataFrame:
    """The ``n`` newest campaigns, oldest of them first, with short name and rate."""
    recent = _newest_with_counts(campaigns, links, events, n)
    return recent.orderBy("created_at", "id").select(
        "id",
        short_label(F.col("name"), width).alias("label"),
        "emails_sent",
        "total_clicks",
        percent_whole(F.col("total_clicks"), F.col("emails_sent")).alias("click_rate"),
    )


def first_of_each(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in ``order``.

    Spark cuts every group to ``n`` rows in each task before it moves any (a group limit below the
    exchange), so a group with a third of all rows costs its reducer ``n`` rows a task.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def last_campaigns_by_department(
    recipients: DataFrame, campaigns: DataFrame, links: DataFrame, events: DataFrame, n: int = CHART_LENGTH
) -> DataFrame:
    """Per department its ``n`` newest campaigns with links sent, clicks and rate in whole percent.

    The campaigns are chosen first, from the pairs of department and campaign; only events of
    links of those pairs are counted.
    """
    people = recipients.select(F.col("id").alias("recipient_id"), department_or_unknown(F.col("department")).alias("department"))
    sent = lookup_join(links.select("id", "campaign_id", "recipient_id"), people, "recipient_id", "inner", ["id"])
    pairs = sent.groupBy("department", "campaign_id").agg(F.count("*").alias("emails_sent"))
    dated = campaigns.select(F.col("id").alias("campaign_id"), "name", "created_at")
    named = dimension_join(pairs, dated, "campaign_id")
    newest = [F.desc("created_at"), F.desc("campaign_id")]
    chosen = stage(first_of_each(named, ["department"], newest, n), "newest")
    # Departments and the few campaigns of each: a small table, broadcast if it is that.
    key = F.struct("department", "campaign_id")
    wanted = dimension_join(
        sent.select(F.col("id").alias("link_id"), key.alias("pair")), chosen.select(key.alias("pair")), "pair", "left_semi"
    )
    per_link = clicks_per_link(dimension_join(events, wanted.select("link_id"), "link_id", "left_semi"))
    clicked = wanted.join(per_link, "link_id").groupBy("pair").agg(F.sum("clicks").alias("total_clicks"))
    counted = chosen.join(clicked.select("pair.*", "total_clicks"), ["department", "campaign_id"], "left")
    clicks = F.coalesce("total_clicks", F.lit(0)).cast("long")
    return counted.select(
        "department", "campaign_id", "name", "created_at", "emails_sent", clicks.alias("total_clicks"),
        percent_whole(clicks, F.col("emails_sent")).alias("click_rate"),
    )


def click_rate_trend(campaigns: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    """Newest rate against the third newest (the oldest, if there are two); no row for fewer."""
    recent = _newest_with_counts(campaigns, links, events, TREND_LENGTH)
    rate = percent(F.col("total_clicks"), F.col("emails_sent"))
    age = F.struct("created_at", "id")
    ends = recent.agg(
        F.count("*").alias("n"), F.max_by(rate, age).alias("newest"), F.min_by(rate, age).alias("oldest")
    )
    diff = F.col("newest") - F.col("oldest")
    return ends.filter(F.col("n") >= 2).select(
        trend_label(diff).alias("trend"), trend_points(diff).alias("points")
    )


def most_recent_campaign(campaigns: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    recent = _newest_with_counts(campaigns, links, events, 1)
    return recent.withColumn("click_rate", percent_whole(F.col("total_clicks"), F.col("emails_sent")))


def days_since_last(campaigns: DataFrame, as_of: dt.date) -> DataFrame:
    """One row: whole days from the last campaign's day to ``as_of``; null without campaigns."""
    last = F.max(F.col("created_at").cast("date"))
    return campaigns.agg(F.datediff(F.lit(as_of), last).cast("long").alias("days"))


def ranked_at_risk(recipients: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    """The at-risk list with ranks and names; the window runs over that short list only."""
    rank = F.row_number().over(Window.orderBy(F.desc("total_clicks"), "id"))
    return at_risk(recipients, links, events).select(
        rank.cast("long").alias("rank"),
        "id",
        display_name(F.col("first_name"), F.col("last_name"), F.col("email")).alias("name"),
        or_else(F.col("department"), F.lit(NO_DEPARTMENT)).alias("department"),
        "campaigns_targeted",
        "total_clicks",
    )
