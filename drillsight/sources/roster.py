"""The roster: table scan, CSV import with refusals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drillsight.functions.people import as_flag, parse_profile
from drillsight.functions.text import normalize_email, or_else, web_trim
from drillsight.plans.ids import next_id, number_rows
from drillsight.plans.skew import dimension_join, lookup_join
from drillsight.plans.splits import pieces, quoted_records

# Spellings of each roster column, and the reasons for refusing a row.
HEADERS = {
    "first_name": ("firstName", "first_name"),
    "last_name": ("lastName", "last_name"),
    "email": ("email",),
    "department": ("department",),
    "job_title": ("jobTitle", "job_title"),
}
MISSING_EMAIL = "Missing email"
EMAIL_EXISTS = "Email already exists"


def with_web_names(recipients: DataFrame) -> DataFrame:
    """Columns under the names web clients use."""
    return recipients.select(
        "id",
        F.col("first_name").alias("firstName"),
        F.col("last_name").alias("lastName"),
        "email",
        "department",
        F.col("job_title").alias("jobTitle"),
        F.col("high_risk").alias("highRisk"),
        F.col("profile_json").alias("profile"),
    )


def scan_roster(recipients: DataFrame) -> DataFrame:
    """The roster list: web names, plain flag, parsed profile, by last and first name."""
    return (
        with_web_names(recipients)
        .withColumn("highRisk", as_flag(F.col("highRisk")))
        .withColumn("profile", parse_profile(F.col("profile")))
        .orderBy("lastName", "firstName", "id")
    )


def read_roster_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Rows of roster files as normalised texts, with their place in the files.

    Empty lines are skipped.  ``seq`` numbers rows in reading order and is unique;
    ``place`` sorts rows by file and position.  Quoted fields may hold line breaks, for
    which Spark must read a file in one task; pass ``multi_line=False`` for huge files
    without such fields, and each is split over many tasks, or use :func:`read_large_roster_csv`.

    All files of one call share one header.
    """
    raw = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("enforceSchema", False)
        .csv(path)
    )
    texts = [F.col(f"`{c}`") for c in raw.columns]
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return _normalised(raw.select(*texts, place.alias("place")), raw.columns)


def read_large_roster_csv(spark: SparkSession, path: str) -> DataFrame:
    """:func:`read_roster_csv` for files of any size whose quoted fields may hold line breaks.

    Files are read by lines in many tasks, records put together from lines, and each is parsed
    by itself.  Quotes stand around fields and are doubled inside them; a field with a bare quote
    in its middle needs the other form.
    """
    names = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).columns
    # A record that ends in CR and LF is of a file of such lines, whose breaks are read as LF.
    ending = F.col("text").endswith("\r")
    plain = F.replace(F.substring("text", F.lit(1), F.char_length("text") - 1), F.lit("\r\n"), F.lit("\n"))
    texts = F.when(ending, plain).otherwise(F.col("text"))
    records = quoted_records(pieces(spark, path, "\n")).withColumn("text", texts).filter(F.col("text") != "")
    at = F.struct("file", "first").alias("at")
    heads = records.filter(F.col("first.block") == 0).groupBy("file").agg(F.min("first").alias("first")).select(at)
    rows = dimension_join(records.select(at, "text"), heads, "at", "left_anti")
    fields = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
    parsed = rows.select(F.from_csv("text", fields, {"escape": '"', "multiLine": "true"}).alias("fields"), "at")
    place = F.struct(F.col("at.file").alias("file"), F.col("at.first.block").alias("block"), F.col("at.first.row").alias("row"))
    return _normalised(parsed.select("fields.*", place.alias("place")), names)


def _normalised(numbered: DataFrame, names: list[str]) -> DataFrame:
    """The roster's columns of rows with a ``place``, whatever spelling the header has."""

    def column(name: str) -> Column:
        present = [F.col(f"`{h}`") for h in HEADERS[name] if h in names]
        text = or_else(*present, F.lit("")) if present else F.lit("")
        return (normalize_email(text) if name == "email" else web_trim(text)).alias(name)

    return numbered.select(*[column(n) for n in HEADERS], "place", F.col("place.row").alias("seq"))


@dataclass(frozen=True)
class RosterImport:
    """Outcome of an import: new recipients, and refused rows with the reason."""

    created: DataFrame
    refused: DataFrame

    def summary(self) -> DataFrame:
        """One row ``success, failed``."""
        rows = self.created.select(F.lit(1).alias("ok")).unionByName(self.refused.select(F.lit(0).alias("ok")))
        return rows.agg(
            F.coalesce(F.sum("ok"), F.lit(0)).alias("success"),
            F.coalesce(F.sum(1 - F.col("ok")), F.lit(0)).alias("failed"),
        )


def import_roster(rows: DataFrame, recipients: DataFrame) -> RosterImport:
    """Split rows of :func:`read_roster_csv` into new recipients and refusals.

    A row needs an email that neither the table nor an earlier row has; new ids follow the
    order of files and rows.  One address on
    a third of all rows is combined before the shuffle, and its refusals stay spread out.
    """
    with_email = rows.filter(F.col("email") != "")
    fields = [c for c in HEADERS if c != "email"]
    firsts = with_email.groupBy("email").agg(
        F.min_by(F.struct("seq", "place", *fields), "place").alias("_first")
    )
    present = recipients.select(normalize_email(F.col("email")).alias("email")).distinct()
    winners = firsts.join(present, "email", "left_anti").select("email", "_first.*")
    created = number_rows(winners, "place", next_id(recipients)).select("id", *HEADERS)
    first_rows = winners.select("email", F.col("seq").alias("_first_seq"))
    repeated = (
        lookup_join(with_email, first_rows, "email", "left", ["seq"])
        .filter(F.coalesce(F.col("seq") != F.col("_first_seq"), F.lit(True)))
        .select(*HEADERS, F.lit(EMAIL_EXISTS).alias("error"))
    )
    missing = rows.filter(F.col("email") == "").select(*HEADERS, F.lit(MISSING_EMAIL).alias("error"))
    return RosterImport(created, missing.unionByName(repeated))


def append_created(recipients: DataFrame, created: DataFrame) -> DataFrame:
    """The roster with the rows of an import."""
    new = created.withColumn("high_risk", F.lit(False))
    return recipients.unionByName(new, allowMissingColumns=True)
