"""Reports from a kept roll-up: clicks by link and day, with new batches merged in.

Events come in batches, each a folder ``batch=<n>`` of the event table.  The roll-up is a folder of
parts, ``since=<a>/upto=<b>``, each the clicks of the batches after a and up to b by link and day.
A part is written once and counts when it is complete, so a merge that is lost or repeated
changes nothing.  :func:`merge_batches` adds the part of the batches since the last; :func:`fold_parts`
puts all parts together in one, without the events.  :func:`clicks` gives the roll-up's rows and
those of the batches that are not in it yet, read from their folders alone; it may stand in
for the events in every report that goes by clicks per link (``plans/clicks.py``).

A row has the count, the first and last time, and of the last event its id and agent, all of which
merge: sums, extremes, and the agent of the larger (time, id).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drillsight.functions.network import day_of
from drillsight.plans.clicks import ROLLED, combined, weighted
from drillsight.session import child_names, exists, remove

BATCH = "batch"
_DAY = "day"


def append_batch(events: DataFrame, table: str, batch: int) -> None:
    """Write one batch of events; the same batch again replaces itself."""
    events.write.mode("overwrite").parquet(f"{table}/{BATCH}={batch}")


def batches(spark: SparkSession, table: str) -> list[int]:
    """The complete batches of an event table, by the names of their folders."""
    found = [int(x.split("=")[1]) for x in child_names(spark, table) if x.startswith(f"{BATCH}=")]
    return sorted(n for n in found if exists(spark, f"{table}/{BATCH}={n}/_SUCCESS"))


def _parts(spark: SparkSession, root: str) -> list[tuple[int, int]]:
    """The complete parts that together cover all merged batches, each batch once.

    Parts follow each other; where several begin alike (before and after a fold), the
    longest counts.
    """
    known: dict[int, int] = {}
    for outer in child_names(spark, root):
        if re.fullmatch(r"since=-?\d+", outer):
            for inner in child_names(spark, f"{root}/{outer}"):
                if exists(spark, f"{root}/{outer}/{inner}/_SUCCESS"):
                    since, upto = int(outer.split("=")[1]), int(inner.split("=")[1])
                    known[since] = max(upto, known.get(since, upto))
    out, at = [], -1
    while at in known:
        out.append((at, known[at]))
        at = known[at]
    return out


def _path(root: str, part: tuple[int, int]) -> str:
    return f"{root}/since={part[0]}/upto={part[1]}"


def merged_upto(spark: SparkSession, root: str) -> int:
    """The last batch in the roll-up, -1 if there is none."""
    parts = _parts(spark, root)
    return parts[-1][1] if parts else -1


def _events(spark: SparkSession, table: str, wanted: list[int]) -> DataFrame | None:
    """The events of some batches, from their folders alone."""
    return spark.read.parquet(*[f"{table}/{BATCH}={n}" for n in wanted]) if wanted else None


def merge_batches(spark: SparkSession, table: str, root: str, upto: int | None = None) -> int:
    """Add the batches since the last merge (up to ``upto``) as one part; gives the last merged one."""
    done = merged_upto(spark, root)
    new = [n for n in batches(spark, table) if n > done and (upto is None or n <= upto)]
    if not new:
        return done
    rows = weighted(_events(spark, table, new))
    daily = combined(rows, "link_id", day_of(F.col("first_click")).alias(_DAY))
    daily.write.mode("overwrite").parquet(_path(root, (done, new[-1])))
    return new[-1]


def fold_parts(spark: SparkSession, root: str) -> None:
    """Put all parts together in one, by link and day; the parts it replaces go afterwards."""
    parts = _parts(spark, root)
    if len(parts) < 2:
        return
    whole = (parts[0][0], parts[-1][1])
    daily = combined(spark.read.parquet(*[_path(root, p) for p in parts]), "link_id", _DAY)
    daily.write.mode("overwrite").parquet(_path(root, whole))
    for part in parts:
        if part != whole:
            remove(spark, _path(root, part))


def clicks(spark: SparkSession, table: str, root: str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """All clicks as rolled-up rows: the roll-up, and each event of batches after it.

    With ``first_day`` or ``last_day`` (``yyyy-MM-dd``) only clicks of those days count.
    """
    parts = _parts(spark, root)
    new = [n for n in batches(spark, table) if not parts or n > parts[-1][1]]
    rows = spark.read.parquet(*[_path(root, p) for p in parts]).select(_DAY, *ROLLED) if parts else None
    events = _events(spark, table, new)
    if events is not None:
        single = weighted(events).select(day_of(F.col("first_click")).alias(_DAY), *ROLLED)
        rows = single if rows is None else rows.unionByName(single)
    if rows is None:
        raise ValueError(f"no batch in {table}")
    if first_day is not None:
        rows = rows.filter(F.col(_DAY) >= first_day)
    if last_day is not None:
        rows = rows.filter(F.col(_DAY) <= last_day)
    return rows.drop(_DAY)
