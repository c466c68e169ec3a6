"""The engagement report as CSV text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drillsight.functions.text import csv_quote

# The header of the report.  Texts are quoted, the number is not.
HEADER = (
    "firstName",
    "lastName",
    "email",
    "department",
    "jobTitle",
    "campaigns_targeted",
    "campaigns_clicked",
    "total_clicks",
    "first_click_date",
    "last_click_date",
)
NUMBERS = ("total_clicks",)


def engagement_lines(engagement: DataFrame) -> DataFrame:
    """One CSV line per recipient, as ``value``, in the order of ``engagement``."""
    fields = [F.col(c).cast("string") if c in NUMBERS else csv_quote(F.col(c)) for c in HEADER]
    return engagement.select(F.concat_ws(",", *fields).alias("value"))


def write_engagement_csv(engagement: DataFrame, path: str) -> None:
    """Write the report by last and first name: a folder of part files that follow each other.

    The header is the first line of the first file only, so the files put one after the
    other are the report.  The sort is over all rows but by ranges, in many tasks.
    """
    spark = engagement.sparkSession
    head = spark.range(0, 1, 1, 1).select(F.lit(",".join(HEADER)).alias("value"))
    lines = engagement_lines(engagement.orderBy("lastName", "firstName", "id"))
    # A union keeps the order of its parts, so the header is in the first file.
    head.unionByName(lines).write.text(path)
