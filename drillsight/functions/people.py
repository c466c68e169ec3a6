"""Names and profiles of recipients."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from drillsight.functions.text import empty_to_null, nonempty_join, or_else, strict_object, web_trim
from drillsight.schemas import PROFILE_FIELDS

# Fixed value: the name shown for a nameless recipient.
NAMELESS = "Employee"


def display_name(first: Column, last: Column, fallback: Column) -> Column:
    """First and last name as far as known, else ``fallback`` (the email in reports)."""
    return or_else(nonempty_join(" ", first, last), fallback)


def short_name(first: Column, last: Column) -> Column:
    """First name, else last name, else a neutral word."""
    return or_else(first, last, F.lit(NAMELESS))


def full_name(first: Column, last: Column) -> Column:
    both = F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit("")))
    return or_else(web_trim(both), F.lit(NAMELESS))


def parse_profile(text: Column) -> Column:
    """Profile text to a struct of seven strings; null for missing or broken text."""
    return strict_object(empty_to_null(text), ", ".join(f"{f}: string" for f in PROFILE_FIELDS))


def fill_profile(profile: Column) -> Column:
    """The same struct with every missing field as an empty text."""
    return F.struct(*[F.coalesce(profile[f], F.lit("")).alias(f) for f in PROFILE_FIELDS])


def profile_text(profile: Column, high_risk: Column) -> Column:
    """Text form for storage; only high-risk recipients keep a profile."""
    return F.when(F.coalesce(high_risk, F.lit(False)), F.to_json(fill_profile(profile)))


def as_flag(c: Column) -> Column:
    """A tinyint or nullable boolean as a plain boolean."""
    return F.coalesce(c.cast("boolean"), F.lit(False))


def department_or_unknown(c: Column) -> Column:
    return F.coalesce(empty_to_null(F.trim(c)), F.lit("Unknown"))
