"""Sort orders and top-k cuts.  Every order ends in a unique column, so ties are settled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drillsight.plans.ids import number_sorted

# The columns a roster may be sorted by.
SORTABLE = ("first_name", "last_name", "email", "department", "job_title")


def by_name(recipients: DataFrame, last: str = "last_name", first: str = "first_name", tie: str = "id") -> DataFrame:
    """By last and first name; nulls come first.  Reports name these columns otherwise."""
    return recipients.orderBy(last, first, tie)


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("created_at"), F.desc("id"))


def top_by(df: DataFrame, measure: str, top: int = 5, tie: str = "id") -> DataFrame:
    return df.orderBy(F.desc(measure), tie).limit(top)


def sorted_by(recipients: DataFrame, field: str, descending: bool = False) -> DataFrame:
    """Case-blind order by one of :data:`SORTABLE`, nulls as empty text.

    Rows that are equal in it keep the order of the roster: by last, then first name.
    """
    if field not in SORTABLE:
        raise ValueError(f"cannot sort by {field!r}; choose one of {', '.join(SORTABLE)}")
    key = F.lower(F.coalesce(F.col(field), F.lit("")))
    return recipients.orderBy(key.desc() if descending else key.asc(), "last_name", "first_name", "id")


def by_clicks(detail: DataFrame) -> DataFrame:
    """Detail rows of campaigns, most clicks first, and by last and first name among equals."""
    return detail.orderBy(F.desc("click_count"), "lastName", "firstName", "link_id")


def with_position(ordered: DataFrame, name: str = "position") -> DataFrame:
    """Rows of a sorted table with their place in it, from 1.

    The order itself is a range sort over many tasks; only the tasks' row counts are summed
    up in one place.
    """
    return number_sorted(ordered, F.lit(1), name)


def take_first(recipients: DataFrame) -> DataFrame:
    """The recipient with the smallest id, for a trial run."""
    return recipients.orderBy("id").limit(1)
