"""The click log: one JSON object per line, and the keyed link file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drillsight.functions.network import client_ip, hash_ip
from drillsight.functions.text import or_else
from drillsight.schemas import CLICK_LINE, LINK_MAP

_AT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def read_click_log(spark: SparkSession, path: str, link_key: str | None = None) -> DataFrame:
    """Clicks of a log; blank and unreadable lines are dropped.

    ``clicked_at`` is the time in UTC.  ``link_key`` keeps the clicks of one link.
    """
    lines = spark.read.schema(CLICK_LINE).option("mode", "DROPMALFORMED").json(path)
    # A line that names no link belongs to none.  The filter also makes sure that a bare
    # count still parses the lines, so that unreadable ones are seen and dropped.
    lines = lines.filter(F.col("linkId").isNotNull())
    clicks = lines.select(
        F.col("linkId").alias("link_key"),
        F.rtrim(F.col("at"), F.lit("Z")).try_cast("timestamp_ntz").alias("clicked_at"),
        "ua",
        "ref",
        F.col("ipHash").alias("ip_hash"),
    )
    return clicks if link_key is None else clicks.filter(F.col("link_key") == link_key)


def log_lines(clicks: DataFrame) -> DataFrame:
    """Clicks (``link_key, clicked_at, ua, ref, ip_hash``) in the form of the log."""
    return clicks.select(
        F.col("link_key").alias("linkId"),
        F.date_format("clicked_at", _AT).alias("at"),
        F.coalesce("ua", F.lit("")).alias("ua"),
        "ref",
        F.col("ip_hash").alias("ipHash"),
    )


def append_click_log(clicks: DataFrame, path: str) -> None:
    """Add clicks to a log; fields without a value are left out of the line."""
    log_lines(clicks).write.mode("append").json(path)


def event_rows(resolved: DataFrame) -> DataFrame:
    """Rows of the event table for requests whose link is in the database.

    ``resolved`` are raw requests with the link attached (see ``by_source_priority``).
    The forwarding header is kept as it came.
    """
    return resolved.filter(F.col("source") == "db").select(
        F.col("event_id").cast("string").alias("id"),
        "link_id",
        F.lit("click").alias("event_type"),
        or_else(F.col("forwarded"), F.coalesce("remote", F.lit(""))).alias("ip_address"),
        F.coalesce("ua", F.lit("")).alias("user_agent"),
        F.col("clicked_at").alias("created_at"),
    )


def log_rows(resolved: DataFrame) -> DataFrame:
    """Rows of the click log for requests whose link is in the link file."""
    clicks = clicks_from_requests(resolved.filter(F.col("source") == "file"))
    return clicks.select("link_key", "clicked_at", F.coalesce("ua", F.lit("")).alias("ua"), "ref", "ip_hash")


def clicks_from_requests(requests: DataFrame) -> DataFrame:
    """Click rows of raw requests: address from header or socket, stored as a hash; the
    referrer is null where there is none."""
    ip = client_ip(F.col("forwarded"), F.col("remote"))
    return requests.withColumn("ip_hash", hash_ip(ip)).drop("forwarded", "remote")


def read_link_map(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Entries ``link_key, url, name`` of link files; a file that cannot be read is empty.

    A link file is one JSON object, so it is parsed in one task; many files are parsed
    in parallel.  With ``whole_files=False`` every line is an object of its own, and
    large files are split.
    """
    texts = spark.read.text(path, wholetext=whole_files)
    entries = texts.select(F.explode(F.from_json("value", LINK_MAP)).alias("link_key", "link"))
    return entries.select("link_key", "link.url", "link.name")
