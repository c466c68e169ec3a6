"""Deletions from an event table that rewrite only the files with removed rows.

The files that hold clicks of removed links are told by ``_metadata.file_path``; their other rows are
written anew beside the table, then the new files are moved in and the old ones deleted.  All
other files stay as they are, byte for byte.

The list of old files is the commit: written after the new rows are complete and before anything
is moved.  :func:`finish_deletion` completes what was committed, as often as it is called, and
drops what was not; call it before the table is read after a failure.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drillsight.operators.merge import Tables
from drillsight.plans.skew import dimension_join, lookup_join
from drillsight.session import child_names, exists, files_below, move, remove, stage, staging

#: Beside the table's own folders; names with an underscore are not read as rows.
_WORK = "_deletion"
#: Files that are rewritten at a time: their names pass through the driver.
FILES_AT_ONCE = 10_000
#: Ids of removed links up to this many are broadcast, so that no event moves to meet them.
MOST_BROADCAST = 1_000_000


def delete_events(spark: SparkSession, table: str, gone: DataFrame, parts: tuple[str, ...] = ("period",)) -> int:
    """Remove the events of the links in ``gone`` (``link_id``) from the table; gives the files rewritten.

    ``parts`` are the columns the table is split by.  The ids are staged once.  Up to
    :data:`MOST_BROADCAST` of them go to the events, which then move only to be written by ``parts``;
    more meet them in skew-safe joins.
    """
    finish_deletion(spark, table)
    done = 0
    with staging(spark):
        ids = stage(gone.select("link_id").distinct(), "gone")
        while True:
            events = spark.read.parquet(table)
            named = events.select("link_id", F.col("_metadata.file_path").alias("file"))
            held = dimension_join(named, ids, "link_id", "left_semi", MOST_BROADCAST)
            files = [unquote(r["file"]) for r in held.select("file").distinct().orderBy("file").limit(FILES_AT_ONCE).collect()]
            if not files:
                return done
            old = spark.read.schema(events.schema).option("basePath", table).parquet(*files)
            kept = dimension_join(old, ids, "link_id", "left_anti", MOST_BROADCAST).select(events.columns)
            kept.hint("rebalance", *parts).write.mode("overwrite").partitionBy(*parts).parquet(f"{table}/{_WORK}/rows")
            spark.createDataFrame([(f,) for f in files], "value string").write.mode("overwrite").text(f"{table}/{_WORK}/old")
            finish_deletion(spark, table)
            done += len(files)


def finish_deletion(spark: SparkSession, table: str) -> None:
    """Complete a committed rewrite; forget one that was not committed."""
    work = f"{table}/{_WORK}"
    if exists(spark, f"{work}/old/_SUCCESS"):
        for row in spark.read.text(f"{work}/old").collect():  # FILES_AT_ONCE at most
            remove(spark, row["value"])
        for name in files_below(spark, f"{work}/rows"):
            if not name.rsplit("/", 1)[-1].startswith(("_", ".")):
                move(spark, f"{work}/rows/{name}", f"{table}/{name}")
    if child_names(spark, work):
        remove(spark, work)


def delete_recipients_by_file(spark: SparkSession, tables: Tables, events_path: str, ids: DataFrame) -> Tables:
    """``merge.delete_recipients`` for events that are stored in files, which are changed in place."""
    owner = ids.select(F.col("id").alias("recipient_id")).distinct()
    removed = lookup_join(tables.links, owner, "recipient_id", "left_semi", ["id"])
    delete_events(spark, events_path, removed.select(F.col("id").alias("link_id")))
    return Tables(
        tables.recipients.join(ids.select("id").distinct(), "id", "left_anti"),
        lookup_join(tables.links, owner, "recipient_id", "left_anti", ["id"]).select(tables.links.columns),
        spark.read.parquet(events_path),
    )
