"""Choice of recipients, campaigns and articles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drillsight.functions.people import as_flag
from drillsight.functions.text import collated, empty_to_null
from drillsight.plans.skew import dimension_join

#: Columns a roster search looks into.
SEARCH_FIELDS = ("first_name", "last_name", "email", "department", "job_title")


def _has_email(df: DataFrame) -> DataFrame:
    return df.filter(empty_to_null(F.col("email")).isNotNull())


def in_departments(
    recipients: DataFrame, departments: Sequence[str] | DataFrame | None, collation: str | None = None
) -> DataFrame:
    """Recipients of the given departments (all for an empty list or table) that have an email.

    A long list may be passed as a table with a ``name`` column, which is compared exactly.
    """
    if isinstance(departments, DataFrame):
        wanted = departments.select(F.col("name").alias("department")).distinct()
        # One value of one row, so an empty table lets everybody pass without a look from the driver.
        unrestricted = departments.agg((F.count("*") == 0).alias("none")).scalar()
        marked = dimension_join(recipients, wanted.withColumn("_wanted", F.lit(True)), "department", "left")
        recipients = marked.filter(F.col("_wanted") | unrestricted).select(recipients.columns)
    elif departments:
        recipients = recipients.filter(collated(F.col("department"), collation).isin(list(departments)))
    return _has_email(recipients)


def high_risk_of(recipients: DataFrame, ids: DataFrame) -> DataFrame:
    """High-risk recipients among ``ids`` that have an email."""
    flagged = recipients.filter(as_flag(F.col("high_risk")))
    return _has_email(flagged).join(ids.select("id").distinct(), "id", "left_semi")


def search(recipients: DataFrame, term: str = "", department: str = "") -> DataFrame:
    """Case-blind substring search over :data:`SEARCH_FIELDS`, and an exact department.

    An empty term or department does not restrict.
    """
    found = recipients
    if term:
        wanted = F.lower(F.lit(term))
        hits = [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(wanted) for c in SEARCH_FIELDS]
        found = found.filter(reduce(or_, hits))
    if department:
        found = found.filter(F.coalesce("department", F.lit("")) == department)
    return found


def of_campaign(links: DataFrame, campaign_id: int) -> DataFrame:
    return links.filter(F.col("campaign_id") == campaign_id)


def with_image(articles: DataFrame, top: int = 3) -> DataFrame:
    """The newest ``top`` articles that have an image, ties by link."""
    pictured = articles.filter(empty_to_null(F.col("image")).isNotNull())
    return pictured.orderBy(F.desc("published"), "link").limit(top)
