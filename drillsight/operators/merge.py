"""Changes to whole tables: inserts, updates, deletes and checks as joins.

Each function takes the table as it is and a table of requests, and returns the table
as it should be.  Requests carry a unique ``seq``; what one request after the other
would do is done for all of them at once.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drillsight.functions.network import tracking_key
from drillsight.functions.people import as_flag
from drillsight.functions.text import empty_to_null, normalize_email, or_else, web_trim
from drillsight.plans.ids import next_id, number_rows
from drillsight.plans.skew import dimension_join, lookup_join
from drillsight.schemas import CAMPAIGNS, RECIPIENTS
from drillsight.session import stage

# Levels and redirect targets a campaign may have, and the defaults.
DIFFICULTIES = ("low", "medium", "high")
DEFAULT_DIFFICULTY = "medium"
REDIRECTS = ("training", "google")
UNTITLED = "Untitled Campaign"
#: Columns added to tables of older installations, with their defaults.
ADDED_COLUMNS = {
    "recipients": {"high_risk": False, "profile_json": None},
    "campaigns": {"redirect_to": "google"},
}


def first_per_key(requests: DataFrame, key: Column, seq: str = "seq") -> DataFrame:
    """The earliest request of each key, with the key as ``_key``.

    Combined before the shuffle, so many requests for one key meet as few.
    """
    row = F.struct(*requests.columns)
    firsts = requests.groupBy(key.alias("_key")).agg(F.min_by(row, seq).alias("_row"))
    return firsts.select("_key", "_row.*")


def last_per_key(requests: DataFrame, key: Column, seq: str = "seq") -> DataFrame:
    row = F.struct(*requests.columns)
    lasts = requests.groupBy(key.alias("_key")).agg(F.max_by(row, seq).alias("_row"))
    return lasts.select("_key", "_row.*")


def get_or_create_recipients(recipients: DataFrame, requests: DataFrame) -> DataFrame:
    """Recipients, and a new one for each requested email that is not there yet.

    Emails are compared trimmed and in lower case, and kept as they were first asked for; blank
    ones are refused.  ``is_new`` tells the rows apart.
    """
    asked = requests.filter(normalize_email(F.col("email")) != "")
    wanted = first_per_key(asked, normalize_email(F.col("email")))
    present = recipients.select(normalize_email(F.col("email")).alias("_key")).distinct()
    new = number_rows(wanted.join(present, "_key", "left_anti"), "seq", next_id(recipients))
    rows = new.select(
        "id",
        F.coalesce("first_name", F.lit("")).alias("first_name"),
        F.coalesce("last_name", F.lit("")).alias("last_name"),
        "email",
        F.lit(False).alias("high_risk"),
        F.lit(True).alias("is_new"),
    )
    return recipients.withColumn("is_new", F.lit(False)).unionByName(rows, allowMissingColumns=True)


def update_recipients(recipients: DataFrame, changes: DataFrame) -> DataFrame:
    """Full-row updates by id, the last one wins; changes without an email are refused."""
    valid = changes.filter(empty_to_null(F.col("email")).isNotNull())
    last = last_per_key(valid, F.col("id"))
    change = last.select(
        "id",
        F.struct(
            F.coalesce("first_name", F.lit("")).alias("first_name"),
            F.coalesce("last_name", F.lit("")).alias("last_name"),
            "email",
            empty_to_null(F.col("department")).alias("department"),
            empty_to_null(F.col("job_title")).alias("job_title"),
            as_flag(F.col("high_risk")).alias("high_risk"),
            "profile_json",
        ).alias("_new"),
    )
    joined = recipients.join(change, "id", "left")
    new = F.col("_new")
    return joined.select(
        *[
            F.when(new.isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c != "id" and c in RECIPIENTS.names else F.col(c)
            for c in recipients.columns
        ]
    )


def toggle_flag(recipients: DataFrame, ids: DataFrame) -> DataFrame:
    """Flip ``high_risk`` once for each time an id is listed."""
    odd = (
        ids.groupBy("id")
        .agg((F.count("*") % 2 == 1).alias("_flip"))
        .filter("_flip")
    )
    flag = as_flag(F.col("high_risk"))
    return recipients.join(odd, "id", "left").select(
        *[
            F.when(F.col("_flip"), ~flag).otherwise(flag).alias(c) if c == "high_risk" else F.col(c)
            for c in recipients.columns
        ]
    )


@dataclass(frozen=True)
class Tables:
    """The three tables a deletion runs through."""

    recipients: DataFrame
    links: DataFrame
    events: DataFrame


def delete_recipients(tables: Tables, ids: DataFrame) -> Tables:
    """Remove recipients, then their links, then the events of those links."""
    gone = ids.select("id").distinct()
    owner = gone.select(F.col("id").alias("recipient_id"))
    links = lookup_join(tables.links, owner, "recipient_id", "left_anti", ["id"])
    removed = lookup_join(tables.links, owner, "recipient_id", "left_semi", ["id"])
    removed_ids = removed.select(F.col("id").alias("link_id"))
    events = lookup_join(tables.events, removed_ids, "link_id", "left_anti", ["id"])
    return Tables(
        tables.recipients.join(gone, "id", "left_anti"),
        links.select(*tables.links.columns),
        events.select(*tables.events.columns),
    )


def insert_departments(departments: DataFrame, names: DataFrame) -> DataFrame:
    """Add trimmed names that are neither blank nor present."""
    asked = names.select(web_trim(F.col("name")).alias("name")).filter(F.col("name") != "").distinct()
    return departments.unionByName(
        asked.join(departments.select("name"), "name", "left_anti"), allowMissingColumns=True
    )


def upsert(table: DataFrame, changes: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Insert or overwrite rows by ``key``, the last change wins.

    A change overwrites every column it has, also with null; columns it lacks keep
    their value.
    """
    values = [c for c in changes.columns if c not in (key, seq)]
    last = last_per_key(changes, F.col(key), seq).select(key, F.struct(F.lit(True).alias("_in"), *values).alias("_new"))
    joined = table.join(last, key, "full")
    new = F.col("_new")
    return joined.select(
        *[F.when(new["_in"], new[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns]
    )


def assign_links(
    links: DataFrame, requests: DataFrame, salt: str, created_at: dt.datetime
) -> DataFrame:
    """A link for each requested (campaign, recipient) pair that has none; ``is_new`` marks them."""
    pair = F.struct("campaign_id", "recipient_id")
    firsts = first_per_key(requests, pair).drop("_key")
    missing = firsts.join(
        links.select("campaign_id", "recipient_id"), ["campaign_id", "recipient_id"], "left_anti"
    )
    new = number_rows(missing, "seq", next_id(links)).select(
        "id",
        "campaign_id",
        "recipient_id",
        tracking_key(F.col("campaign_id"), F.col("recipient_id"), salt).alias("tracking_id"),
        F.lit(created_at.isoformat()).cast("timestamp_ntz").alias("created_at"),
        F.lit(True).alias("is_new"),
    )
    return links.withColumn("is_new", F.lit(False)).unionByName(new)


def add_to_campaign(
    recipients: DataFrame, links: DataFrame, requests: DataFrame, salt: str, created_at: dt.datetime
) -> tuple[DataFrame, DataFrame]:
    """People added to campaigns by email: ``requests`` has ``seq, campaign_id, email`` and names.

    A recipient of that email is used, or else created, and gets a link of the campaign unless
    it has one.  Gives the recipients and the links as they should be, both with ``is_new``.
    """
    known = stage(get_or_create_recipients(recipients, requests), "recipients")
    ids = known.groupBy(normalize_email(F.col("email")).alias("_key")).agg(F.min("id").alias("recipient_id"))
    keyed = requests.select("seq", "campaign_id", normalize_email(F.col("email")).alias("_key"))
    pairs = lookup_join(keyed, ids.filter("_key <> ''"), "_key", "inner", ["seq"])
    return known, assign_links(links, pairs.select("seq", "campaign_id", "recipient_id"), salt, created_at)


def orphans(events: DataFrame, links: DataFrame, campaigns: DataFrame, recipients: DataFrame) -> DataFrame:
    """Rows whose parent is missing, as ``(table_name, row_id, missing)``."""

    def keys(parent: DataFrame, column: str) -> DataFrame:
        return parent.select(F.col("id").alias(column))

    def report(rows: DataFrame, table: str, column: str) -> DataFrame:
        return rows.select(
            F.lit(table).alias("table_name"),
            F.col("id").cast("string").alias("row_id"),
            F.lit(column).alias("missing"),
        )

    linkless = lookup_join(events.select("id", "link_id"), keys(links, "link_id"), "link_id", "left_anti", ["id"])
    headless = dimension_join(links.select("id", "campaign_id"), keys(campaigns, "campaign_id"), "campaign_id", "left_anti")
    ownerless = lookup_join(
        links.select("id", "recipient_id"), keys(recipients, "recipient_id"), "recipient_id", "left_anti", ["id"]
    )
    return (
        report(linkless, "link_events", "link_id")
        .unionByName(report(headless, "links", "campaign_id"))
        .unionByName(report(ownerless, "links", "recipient_id"))
    )


def drop_links(link_map: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The link map without ``keys``, and the keys that were not in it."""
    asked = keys.select("link_key").distinct()
    left = link_map.join(asked, "link_key", "left_anti")
    unknown = asked.join(link_map.select("link_key"), "link_key", "left_anti")
    return left, unknown


def check_campaigns(drafts: DataFrame, untitled: str | None = None) -> DataFrame:
    """Drafts with defaults filled in and the reason for refusal, null if there is none.

    Without a name a draft is refused, or named ``untitled`` if that is given.
    """
    name = F.col("name") if untitled is None else or_else(F.col("name"), F.lit(untitled))
    level = F.coalesce("difficulty", F.lit(DEFAULT_DIFFICULTY))
    target = F.when(F.col("redirect_to") == REDIRECTS[0], REDIRECTS[0]).otherwise(REDIRECTS[1])
    return drafts.select(
        *[c for c in drafts.columns if c not in ("name", "difficulty", "redirect_to")],
        name.alias("name"),
        level.alias("difficulty"),
        target.alias("redirect_to"),
        F.when(empty_to_null(name).isNull(), "Campaign name required")
        .when(~level.isin(*DIFFICULTIES), "unknown difficulty")
        .alias("refused"),
    )


def conform(df: DataFrame, table: str) -> DataFrame:
    """Add the columns an older ``recipients`` or ``campaigns`` table lacks, with defaults.

    Nulls in a flag that must not be null become its default as well.
    """
    schema = {"recipients": RECIPIENTS, "campaigns": CAMPAIGNS}[table]
    defaults = ADDED_COLUMNS[table]

    def column(field) -> Column:
        default = F.lit(defaults.get(field.name))
        if field.name not in df.columns:
            return default.cast(field.dataType).alias(field.name)
        value = F.col(field.name)
        if defaults.get(field.name) is not None:
            value = F.coalesce(value, default)
        return value.cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in schema.fields])
