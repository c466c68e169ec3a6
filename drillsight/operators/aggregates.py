"""Reports by recipient, campaign, department and link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drillsight.functions.agents import agent_or_unknown, parse_user_agent
from drillsight.functions.network import day_of
from drillsight.functions.people import department_or_unknown, display_name, full_name
from drillsight.functions.rates import clicked_flag, percent_tenth, percent_whole
from drillsight.functions.text import collated, nonblank, or_else
from drillsight.plans.clicks import is_rolled, last_click_per_link, links_with_clicks
from drillsight.plans.shares import SHARE, dealt, evenly
from drillsight.plans.skew import dimension_join, lookup_join

# How an empty list, a missing date and other gaps are shown.
NO_NAMES = "None"
NO_DATE = "N/A"
DASH = "—"
NAME_SEPARATOR = "; "
#: Fixed value: length of the at-risk list.
AT_RISK = 5


def joined_names(name: Column) -> Column:
    """Aggregate: distinct names in order, as one text.  Null where there are none.

    The set holds each name once, already in the map-side combine, so it grows with the
    number of campaign names and not with the rows of a group.
    """
    names = F.array_sort(F.collect_set(name))
    return F.when(F.size(names) > 0, F.array_join(names, NAME_SEPARATOR))


def _named_links(links: DataFrame, events: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Links with clicks and the name of their campaign (null if there is none)."""
    names = campaigns.select(F.col("id").alias("campaign_id"), F.col("name").alias("campaign_name"))
    return links_with_clicks(dimension_join(links, names, "campaign_id", "left"), events)


def recipient_totals(
    recipients: DataFrame, links: DataFrame, campaigns: DataFrame, events: DataFrame
) -> DataFrame:
    """Per recipient: names of campaigns targeted and clicked, clicks, first and last click."""
    per_recipient = (
        _named_links(links, events, campaigns)
        .groupBy(F.col("recipient_id").alias("id"))
        .agg(
            joined_names(F.col("campaign_name")).alias("campaigns_targeted"),
            joined_names(F.when(F.col("clicks") > 0, F.col("campaign_name"))).alias("campaigns_clicked"),
            F.sum("clicks").alias("total_clicks"),
            F.min("first_click").alias("first_click"),
            F.max("last_click").alias("last_click"),
        )
    )
    return recipients.select("id", "first_name", "last_name", "email", "department", "job_title").join(
        per_recipient, "id", "left"
    )


def recipient_engagement(
    recipients: DataFrame, links: DataFrame, campaigns: DataFrame, events: DataFrame
) -> DataFrame:
    """The export report: :func:`recipient_totals` with its gaps filled, all recipients."""
    totals = recipient_totals(recipients, links, campaigns, events)
    empty = F.lit("")

    def date(c: str) -> Column:
        return F.coalesce(day_of(F.col(c)), F.lit(NO_DATE))

    return totals.select(
        "id",
        F.coalesce("first_name", empty).alias("firstName"),
        F.coalesce("last_name", empty).alias("lastName"),
        F.coalesce("email", empty).alias("email"),
        F.coalesce("department", empty).alias("department"),
        F.coalesce("job_title", empty).alias("jobTitle"),
        or_else(F.col("campaigns_targeted"), F.lit(NO_NAMES)).alias("campaigns_targeted"),
        or_else(F.col("campaigns_clicked"), F.lit(NO_NAMES)).alias("campaigns_clicked"),
        F.coalesce("total_clicks", F.lit(0)).cast("long").alias("total_clicks"),
        date("first_click").alias("first_click_date"),
        date("last_click").alias("last_click_date"),
    )


def names_by_recipient(links: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Per recipient the distinct names of its campaigns as one text."""
    names = campaigns.select(F.col("id").alias("campaign_id"), F.col("name").alias("campaign_name"))
    return (
        dimension_join(links.select("campaign_id", "recipient_id"), names, "campaign_id")
        .groupBy("recipient_id")
        .agg(joined_names(F.col("campaign_name")).alias("campaigns"))
    )


def clicked_names_by_recipient(links: DataFrame, campaigns: DataFrame, events: DataFrame) -> DataFrame:
    """Per recipient the distinct names of campaigns with a click, null if there is none."""
    return (
        _named_links(links, events, campaigns)
        .groupBy("recipient_id")
        .agg(joined_names(F.when(F.col("clicks") > 0, F.col("campaign_name"))).alias("campaigns_clicked"))
    )


def campaign_summary(campaigns: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    """Per campaign: links sent and clicks; campaigns without links show zeros."""
    per_campaign = (
        links_with_clicks(links, events)
        .groupBy(F.col("campaign_id").alias("id"))
        .agg(F.count("*").alias("emails_sent"), F.sum("clicks").alias("total_clicks"))
    )
    zero = F.lit(0)
    return campaigns.join(per_campaign, "id", "left").select(
        "id",
        "name",
        "difficulty",
        "created_at",
        F.coalesce("emails_sent", zero).cast("long").alias("emails_sent"),
        F.coalesce("total_clicks", zero).cast("long").alias("total_clicks"),
    )


def campaign_rates(campaigns: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    """:func:`campaign_summary` with the click rate in whole percent."""
    return campaign_summary(campaigns, links, events).withColumn(
        "click_rate", percent_whole(F.col("total_clicks"), F.col("emails_sent"))
    )


def campaign_recipients(
    links: DataFrame, recipients: DataFrame, events: DataFrame, campaign_id: int | None = None
) -> DataFrame:
    """Per link of a campaign (of every campaign by default): recipient, clicks, last click and agent."""
    if campaign_id is not None:
        links = links.filter(F.col("campaign_id") == campaign_id)
        wanted = links.select(F.col("id").alias("link_id"))
        events = lookup_join(events, wanted, "link_id", "left_semi", ["last_id" if is_rolled(events) else "id"])
    per_link = last_click_per_link(events)
    sent = links.select(F.col("id").alias("link_id"), "campaign_id", "recipient_id")
    people = recipients.select(
        F.col("id").alias("recipient_id"), "first_name", "last_name", "email", "department", "job_title", "high_risk"
    )
    owned = lookup_join(sent, people, "recipient_id", "inner", ["link_id"])
    return owned.join(per_link, "link_id", "left").select(
        "campaign_id",
        "link_id",
        F.col("recipient_id").alias("id"),
        F.col("first_name").alias("firstName"),
        F.col("last_name").alias("lastName"),
        "email",
        "department",
        F.col("job_title").alias("jobTitle"),
        F.col("high_risk").alias("highRisk"),
        F.coalesce("click_count", F.lit(0)).cast("long").alias("click_count"),
        "last_clicked_at",
        "last_user_agent",
    )


def campaign_detail(
    links: DataFrame, recipients: DataFrame, events: DataFrame, campaign_id: int | None = None
) -> DataFrame:
    """:func:`campaign_recipients` as it is shown: names, dashes for gaps, readable agents."""
    rows = campaign_recipients(links, recipients, events, campaign_id)
    dash = F.lit(DASH)
    return rows.select(
        "campaign_id",
        "link_id",
        "id",
        display_name(F.col("firstName"), F.col("lastName"), dash).alias("name"),
        "highRisk",
        "email",
        or_else(F.col("department"), dash).alias("department"),
        or_else(F.col("jobTitle"), dash).alias("job_title"),
        clicked_flag(F.col("click_count")).alias("clicked"),
        "click_count",
        "last_clicked_at",
        parse_user_agent(F.col("last_user_agent")).alias("agent"),
    )


def recipient_clicks(links: DataFrame, events: DataFrame) -> DataFrame:
    """Per recipient: distinct campaigns targeted, links sent, clicks."""
    return (
        links_with_clicks(links, events)
        .groupBy(F.col("recipient_id").alias("id"))
        .agg(
            F.count_distinct("campaign_id").alias("campaigns_targeted"),
            F.sum("clicks").cast("long").alias("total_clicks"),
        )
    )


def at_risk(recipients: DataFrame, links: DataFrame, events: DataFrame, top: int = AT_RISK) -> DataFrame:
    """The ``top`` recipients by clicks, ties by id; recipients without clicks do not appear.

    Only known recipients may take a place, so they are joined before the cut.
    """
    people = recipients.select("id", "first_name", "last_name", "email", "department")
    clicked = recipient_clicks(links, events).filter(F.col("total_clicks") > 0)
    return people.join(clicked, "id").orderBy(F.desc("total_clicks"), "id").limit(top)


def _merge_spellings(by_department: DataFrame, collation: str) -> DataFrame:
    return (
        by_department.groupBy(collated(F.col("department"), collation).alias("_key"))
        .agg(
            F.min("department").alias("department"),
            F.sum("emails_sent").alias("emails_sent"),
            F.sum("total_clicks").alias("total_clicks"),
        )
        .drop("_key")
    )


def department_risk(
    recipients: DataFrame, links: DataFrame, events: DataFrame, collation: str | None = None
) -> DataFrame:
    """Per department: links sent, clicks, and the click rate with one decimal.

    With a ``collation``, spellings it holds equal are one department, shown by the
    first of them in binary order.
    """
    per_recipient = (
        links_with_clicks(links, events)
        .groupBy(F.col("recipient_id").alias("id"))
        .agg(F.count("*").alias("sent"), F.sum("clicks").alias("clicks"))
    )
    return (
        recipients.select("id", department_or_unknown(F.col("department")).alias("department"))
        .join(per_recipient, "id")
        .groupBy("department")
        .agg(F.sum("sent").alias("emails_sent"), F.sum("clicks").alias("total_clicks"))
        .transform(lambda df: df if collation is None else _merge_spellings(df, collation))
        .withColumn("click_rate", percent_tenth(F.col("total_clicks"), F.col("emails_sent")))
        .filter(F.col("emails_sent") > 0)
        .orderBy(F.desc("click_rate"), "department")
    )


def link_daily_clicks(clicks: DataFrame) -> DataFrame:
    """Clicks per link and UTC day."""
    return clicks.groupBy("link_key", day_of(F.col("clicked_at")).alias("day")).agg(
        F.count("*").alias("clicks")
    )


def link_agent_counts(clicks: DataFrame) -> DataFrame:
    """Clicks per link and user agent."""
    return clicks.groupBy("link_key", agent_or_unknown(F.col("ua")).alias("agent")).agg(
        F.count("*").alias("clicks")
    )


def link_unique_visitors(clicks: DataFrame) -> DataFrame:
    """Distinct visitors per link; visitors of a crowded link are counted in many tasks."""
    return clicks.groupBy("link_key").agg(F.count_distinct("ip_hash").alias("unique_users"))


def link_unique_visitors_approx(clicks: DataFrame, rsd: float = 0.02) -> DataFrame:
    """Estimate of :func:`link_unique_visitors` with a fixed-size sketch per link."""
    return clicks.groupBy("link_key").agg(F.approx_count_distinct("ip_hash", rsd).alias("unique_users"))


def known_links(link_map: DataFrame, db_links: DataFrame) -> DataFrame:
    """Links of both stores, those of the link file first: ``link_key, source, id, name, employee``.

    ``link_map`` has ``link_key, name``; ``db_links`` has ``link_key, link_id, campaign_name,
    employee``.  A key that the file has is not looked up in the database.
    """
    file = link_map.select(
        "link_key",
        F.lit("file").alias("source"),
        F.col("link_key").alias("id"),
        "name",
        F.lit(None).cast("string").alias("employee"),
    )
    db = db_links.join(link_map.select("link_key"), "link_key", "left_anti").select(
        "link_key",
        F.lit("db").alias("source"),
        F.col("link_id").cast("string").alias("id"),
        F.col("campaign_name").alias("name"),
        "employee",
    )
    return file.unionByName(db)


def clicks_of_both(
    log: DataFrame, events: DataFrame, link_map: DataFrame | None = None, db_links: DataFrame | None = None
) -> DataFrame:
    """Clicks of the log and of the database: ``source, id, day, visitor, agent, spread``.

    ``spread`` is a hash of the time, which tells clicks of one visitor apart.

    With the tables of links (``link_key`` of the file, ``link_key, link_id`` of the database), clicks of
    other links are cut off first, by the keys each store has, before anything is counted.
    """
    if link_map is not None:
        log = dimension_join(log, link_map.select("link_key").distinct(), "link_key", "left_semi")
    if db_links is not None:
        if link_map is not None:  # the file comes first
            db_links = db_links.join(link_map.select("link_key"), "link_key", "left_anti")
        events = dimension_join(events, db_links.select("link_id").distinct(), "link_id", "left_semi")
    file = log.select(
        F.lit("file").alias("source"),
        F.col("link_key").alias("id"),
        F.to_date("clicked_at").alias("day"),
        F.col("ip_hash").alias("visitor"),
        agent_or_unknown(F.col("ua")).alias("agent"),
        F.xxhash64("clicked_at").alias("spread"),
    )
    db = events.select(
        F.lit("db").alias("source"),
        F.col("link_id").cast("string").alias("id"),
        F.to_date("created_at").alias("day"),
        F.col("ip_address").alias("visitor"),
        agent_or_unknown(F.col("user_agent")).alias("agent"),
        F.xxhash64("created_at").alias("spread"),
    )
    return file.unionByName(db)


def _counted(clicks: DataFrame, items: Column, *fields: str) -> DataFrame:
    """``source, id, *fields, clicks``: clicks of each link by the structs in ``items``.

    Clicks are dealt out in even shares and combined inside these, then the sums of all shares meet;
    a crowded link has one row for each share and item, and no task more than its share of rows.
    """
    by = ["source", "id", *fields]
    shares = dealt(clicks, "source", "id", "day", "visitor", "agent", "spread")
    each = shares.select(SHARE, "source", "id", F.explode(items).alias("one"))
    rows = each.select(SHARE, "source", "id", *[F.col(f"one.{c}") for c in fields])
    sums = rows.groupBy(SHARE, *by).agg(F.count("*").alias("n")).drop(SHARE)
    return evenly(sums, *by).groupBy(*by).agg(F.sum("n").alias("clicks"))


def link_summary(links: DataFrame, clicks: DataFrame) -> DataFrame:
    """Analytics of every known link: clicks, distinct visitors, days with clicks, first and last.

    ``links`` as of :func:`known_links`, ``clicks`` as of :func:`clicks_of_both`.  A link without
    clicks shows zeros; clicks of unknown links do not appear.  The clicks are read once.  Each
    counts for its day and for its visitor, and a crowded link is combined by these first.
    """

    def one(by_day: bool, day: Column, visitor: Column) -> Column:
        return F.struct(F.lit(by_day).alias("by_day"), day.alias("day"), visitor.alias("visitor"))

    by_day = one(True, F.col("day"), F.lit(None).cast("string"))
    by_visitor = one(False, F.lit(None).cast("date"), F.col("visitor"))
    counts = _counted(clicks, F.array(by_day, by_visitor), "by_day", "day", "visitor")
    totals = evenly(counts, "source", "id").groupBy("source", "id").agg(
        F.sum(F.when(F.col("by_day"), F.col("clicks"))).alias("total_clicks"),
        F.count("visitor").alias("unique_users"),
        F.count("day").alias("days"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
    )

    def number(c: str) -> Column:
        return F.coalesce(c, F.lit(0)).cast("long").alias(c)

    return links.join(totals, ["source", "id"], "left").select(
        "link_key", "source", "name", "employee",
        number("total_clicks"), number("unique_users"), number("days"),
        F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"),
    )


def link_breakdown(links: DataFrame, clicks: DataFrame) -> DataFrame:
    """Clicks of known links by day and by agent, as rows ``(link_key, source, kind, item, clicks)``.

    The clicks are read once; each counts for its day and for its agent.
    """

    def item(kind: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(kind).cast("string").alias("item"))

    counts = _counted(clicks, F.array(item("day"), item("agent")), "kind", "item")
    return evenly(counts, "source", "id").join(links.select("link_key", "source", "id"), ["source", "id"]).select(
        "link_key", "source", "kind", "item", "clicks"
    )


def overall_totals(campaigns: DataFrame, links: DataFrame, events: DataFrame) -> DataFrame:
    """One row: number of campaigns, links sent, clicks, and the overall rate in whole percent."""
    sums = campaign_summary(campaigns, links, events).agg(
        F.count("*").alias("total_campaigns"),
        F.coalesce(F.sum("emails_sent"), F.lit(0)).alias("total_sent"),
        F.coalesce(F.sum("total_clicks"), F.lit(0)).alias("total_clicks"),
    )
    return sums.withColumn("overall_rate", percent_whole(F.col("total_clicks"), F.col("total_sent")))


def recipient_count(recipients: DataFrame) -> DataFrame:
    return recipients.agg(F.count("*").alias("recipients"))


def delivery_outcome(deliveries: DataFrame) -> DataFrame:
    """Per run: attempts, successes and failures."""
    return deliveries.groupBy("run_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("success")).alias("success"),
        F.count_if(~F.col("success")).alias("failed"),
    )


def delivery_failures(deliveries: DataFrame) -> DataFrame:
    """The failed list of every run, one row per failure, with the person's full name."""
    return deliveries.filter(~F.col("success")).select(
        "run_id", "link_id", full_name(F.col("first_name"), F.col("last_name")).alias("name"), "email", "error"
    )


def distinct_names(names: DataFrame, collation: str | None = None) -> DataFrame:
    """Each ``name`` once; of spellings a collation holds equal, the first in binary order."""
    once = names.select("name").distinct()
    if collation is None:
        return once
    return once.groupBy(collated(F.col("name"), collation).alias("_key")).agg(F.min("name").alias("name")).drop("_key")


def distinct_departments(recipients: DataFrame, collation: str | None = None) -> DataFrame:
    """Departments in use as they are written; blank ones are left out."""
    used = recipients.filter(nonblank(F.col("department"))).select(F.col("department").alias("name"))
    return distinct_names(used, collation)
