"""Click rates, their rounding, and the bands shown for them.

Clicks are events, not clickers, so a rate may pass 100 % and is not clamped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Where the bands of a rate and of days since the last campaign end, and the
# change in points that counts as one.
RATE_GREEN, RATE_AMBER = 20, 40
DAYS_LOW, DAYS_MID = 30, 160
STABLE_BELOW = 1


def percent(clicks: Column, sent: Column) -> Column:
    """Unrounded rate in percent, 0 where nothing was sent."""
    return F.when(sent > 0, clicks.cast("double") / sent.cast("double") * 100.0).otherwise(F.lit(0.0))


def percent_whole(clicks: Column, sent: Column) -> Column:
    """Rate rounded to a whole number, halves up, from the same double as :func:`percent`."""
    return F.floor(percent(clicks, sent) + 0.5).cast("long")


def percent_tenth(clicks: Column, sent: Column) -> Column:
    """Rate rounded to one decimal, halves up; counted in integers, so ties are exact."""
    c, s = clicks.cast("long"), sent.cast("long")
    tenths = F.call_function("div", 2000 * c + s, 2 * s)
    return F.when(s > 0, tenths / 10.0).otherwise(F.lit(0.0))


def rate_band(rate: Column) -> Column:
    return F.when(rate <= RATE_GREEN, "green").when(rate <= RATE_AMBER, "amber").otherwise("red")


def days_band(days: Column) -> Column:
    return F.when(days.isNull(), "none").when(days <= DAYS_LOW, "low").when(days <= DAYS_MID, "mid").otherwise("high")


def clicked_flag(clicks: Column) -> Column:
    return F.when(clicks > 0, "Yes").otherwise("No")


def one_decimal(x: Column) -> Column:
    """Text of a non-negative double with one decimal, as web clients print it.

    The exact value of the double decides and ties go up: 0.25 gives 0.3, but 0.15,
    which is stored a little below its name, gives 0.1.  Ten times ``x`` may round up to
    a tie, so the part lost in that product is looked at: with ``x`` split in a short
    and a small part, both products are exact.
    """
    ten = x * 10.0
    short = x.cast("float").cast("double")
    lost = (short * 10.0 - ten) + (x - short) * 10.0
    up = F.floor(ten + 0.5)
    tenths = F.when((ten + 0.5 == up) & (lost < 0), up - 1).otherwise(up)
    return F.format_string("%.1f", tenths / 10.0)


def trend_label(diff: Column) -> Column:
    """Name of a change in click rate: less than one point either way is stable."""
    return F.when(F.abs(diff) < STABLE_BELOW, "Stable").when(diff < 0, "Improving").otherwise("Worsening")


def trend_points(diff: Column) -> Column:
    """Size of the change as text; a stable trend shows 0."""
    return F.when(F.abs(diff) < STABLE_BELOW, "0").otherwise(one_decimal(F.abs(diff)))
