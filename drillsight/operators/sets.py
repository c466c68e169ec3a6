"""Unions of department lists and of click sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drillsight.functions.text import empty_to_null
from drillsight.operators.aggregates import distinct_departments, distinct_names


def department_union(departments: DataFrame, recipients: DataFrame, collation: str | None = None) -> DataFrame:
    """Managed departments and those in use, each once, in order."""
    both = departments.select("name").union(distinct_departments(recipients))
    return distinct_names(both, collation).orderBy("name")


def department_options(departments: DataFrame, recipients: DataFrame) -> DataFrame:
    """The choices of a department filter: nulls and empty names dropped, spaces kept."""
    used = recipients.select(F.col("department").alias("name"))
    named = used.filter(empty_to_null(F.col("name")).isNotNull())
    return department_union(departments, recipients).union(named).distinct().orderBy("name")


def union_sources(file_clicks: DataFrame, db_clicks: DataFrame) -> DataFrame:
    """Clicks of both stores under one schema, with their ``source``.

    ``file_clicks`` has ``link_key, clicked_at, ua, ip_hash``; ``db_clicks`` has
    ``link_key, clicked_at, user_agent, ip_address``.
    """
    from_file = file_clicks.select(
        "link_key", "clicked_at", F.col("ua").alias("user_agent"), "ip_hash", F.lit("file").alias("source")
    )
    from_db = db_clicks.select("link_key", "clicked_at", "user_agent", "ip_address", F.lit("db").alias("source"))
    return from_file.unionByName(from_db, allowMissingColumns=True)
