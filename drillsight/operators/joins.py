"""Joins of the star: campaigns and recipients, their links, and the click events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drillsight.plans.buckets import bucketed_fanout, bucketed_lookup
from drillsight.plans.skew import dimension_join, fanout_join, hot_keys, lookup_join

# Fixed value: where a campaign without a setting sends its visitors.
DEFAULT_REDIRECT = "google"


def _links(links: DataFrame) -> DataFrame:
    return links.select(
        F.col("id").alias("link_id"),
        "campaign_id",
        "recipient_id",
        "tracking_id",
        F.col("created_at").alias("linked_at"),
    )


def _events(events: DataFrame) -> DataFrame:
    return events.select(
        "link_id",
        F.col("id").alias("event_id"),
        "ip_address",
        "user_agent",
        F.col("created_at").alias("clicked_at"),
    )


def _recipients(recipients: DataFrame) -> DataFrame:
    return recipients.select(
        F.col("id").alias("recipient_id"), "first_name", "last_name", "email", "department", "job_title"
    )


def _campaigns(campaigns: DataFrame) -> DataFrame:
    return campaigns.select(
        F.col("id").alias("campaign_id"), F.col("name").alias("campaign_name"), "difficulty", "redirect_to"
    )


def links_with_recipients(links: DataFrame, recipients: DataFrame) -> DataFrame:
    """Links with the columns of their recipient; links of unknown recipients are left out."""
    return lookup_join(_links(links), _recipients(recipients), "recipient_id", "inner", ["link_id"])


def links_with_events(links: DataFrame, events: DataFrame) -> DataFrame:
    """One row per click of a link, and one with nulls for a link without clicks."""
    return fanout_join(_links(links), _events(events), "link_id", ["event_id"])


def events_with_links(events: DataFrame, links: DataFrame) -> DataFrame:
    """Clicks with the columns of their link; clicks of unknown links are left out."""
    return lookup_join(_events(events), _links(links), "link_id", "inner", ["event_id"])


def recipients_to_events(
    recipients: DataFrame, links: DataFrame, campaigns: DataFrame, events: DataFrame, bucketed: bool = False
) -> DataFrame:
    """Recipients, left joined to links, campaigns and events in turn.

    Campaigns are attached to the links, which are far fewer than the events, then the links
    to their recipients, and only then do they meet the events.  ``bucketed`` tables of recipients
    by ``id`` and links by ``recipient_id``, in as many buckets, are joined where they are.
    """
    named = dimension_join(_links(links), _campaigns(campaigns), "campaign_id", "left")
    # The crowded recipients are looked for in the table of links, not in a join.
    crowded = hot_keys(links, "recipient_id")
    if bucketed:
        owned = bucketed_fanout(_recipients(recipients), named, "recipient_id", crowded)
    else:
        owned = fanout_join(_recipients(recipients), named, "recipient_id", ["link_id"], crowded)
    return fanout_join(owned, _events(events), "link_id", ["event_id"])


def campaigns_to_events(campaigns: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    """Campaigns, left joined to links and events in turn."""
    crowded = hot_keys(links, "campaign_id")
    sent = fanout_join(_campaigns(campaigns), _links(links), "campaign_id", ["link_id"], crowded)
    return fanout_join(sent, _events(events), "link_id", ["event_id"])


def resolve_tracking(
    requests: DataFrame, links: DataFrame, campaigns: DataFrame, bucketed: bool = False
) -> DataFrame:
    """Requests by ``tracking_id`` to link, campaign and redirect target; unknown ids are left out.

    A ``bucketed`` table of links, by ``tracking_id``, stays where it is; only requests move.
    """
    targets = campaigns.select(
        F.col("id").alias("campaign_id"),
        F.coalesce("redirect_to", F.lit(DEFAULT_REDIRECT)).alias("redirect_to"),
    )
    found = links.select("tracking_id", F.col("id").alias("link_id"), "campaign_id")
    named = dimension_join(found, targets, "campaign_id")
    return bucketed_lookup(requests, named, "tracking_id") if bucketed else lookup_join(requests, named, "tracking_id")


def by_source_priority(
    clicks: DataFrame, link_map: DataFrame, db_links: DataFrame, hot: Sequence | None = None
) -> DataFrame:
    """Attach the link of each click: from the link file, or else from the database.

    ``link_map`` has ``link_key, url, name``, ``db_links`` has ``link_key, link_id``.
    Adds ``url``, ``name``, ``link_id`` and ``source`` (``file``, ``db``, or null if unknown).
    ``hot`` names the crowded keys of the clicks, if they are known; the clicks are searched
    for them otherwise.
    """
    # Both tables have unique keys, so they are put together first and the clicks move once.
    both = link_map.select("link_key", "url", "name", F.lit(True).alias("_file")).join(
        db_links.select("link_key", "link_id"), "link_key", "full"
    )
    chosen = both.select(
        "link_key",
        "url",
        "name",
        F.when(F.col("_file").isNull(), F.col("link_id")).alias("link_id"),
        F.when(F.col("_file"), "file").otherwise("db").alias("source"),
    )
    return lookup_join(clicks, chosen, "link_key", "left", hot=hot)


def link_detail(links: DataFrame, campaigns: DataFrame, recipients: DataFrame) -> DataFrame:
    """Links with the campaign's name and the employee's full name."""
    people = recipients.select(
        F.col("id").alias("recipient_id"),
        F.concat_ws(" ", "first_name", "last_name").alias("employee"),
    )
    names = campaigns.select(F.col("id").alias("campaign_id"), F.col("name").alias("campaign_name"))
    owned = lookup_join(_links(links), people, "recipient_id", "inner", ["link_id"])
    return dimension_join(owned, names, "campaign_id").select(
        "link_id", "tracking_id", "campaign_name", "employee"
    )


def unclicked_links(links: DataFrame, events: DataFrame) -> DataFrame:
    clicked = events.select(F.col("link_id").alias("id")).distinct()
    return links.join(clicked, "id", "left_anti")


def never_clicked(recipients: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    """Recipients without any click, those without links among them."""
    clicked = links.select("id", F.col("recipient_id")).join(
        events.select(F.col("link_id").alias("id")).distinct(), "id", "left_semi"
    )
    clickers = clicked.select(F.col("recipient_id").alias("id")).distinct()
    return recipients.join(clickers, "id", "left_anti")
