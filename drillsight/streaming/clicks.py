"""The click stream: resolve and store clicks, keep daily counts and visitors up to date.

Every job writes to a table in a folder all executors reach, with its checkpoint beside
it.  Tables are split by day, and within a day by batch: readers skip days by the folder's
name, and a batch that runs again after a failure writes its own parts again, so each click
counts once.  :func:`compact` puts the parts of many batches together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from drillsight.functions.network import day_of
from drillsight.operators.joins import by_source_priority
from drillsight.operators.sketches import LG_K, merge_sketches, sketch_visitors
from drillsight.schemas import STREAM_EVENTS

_BATCH = "batch"
_DAY = "day"


def read_event_stream(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """The event files at ``path``, which is a pattern, as a stream of ``per_batch`` files at a time."""
    return spark.readStream.schema(STREAM_EVENTS).option("maxFilesPerTrigger", per_batch).parquet(path)


def _write_batch(rows: DataFrame, out: str, batch_id: int) -> None:
    """Replace what this batch has written, day by day.

    The days of a batch follow from its rows alone, so a repeated batch meets all its parts.
    """
    (
        rows.withColumn(_BATCH, F.lit(batch_id).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(_DAY, _BATCH)
        .parquet(out)
    )


def compact(
    spark: SparkSession,
    table: str,
    compacted: str,
    upto: int,
    combine: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Rewrite the batches after the last compacted one, up to ``upto``, with few files a day.

    The result is a part of ``compacted`` of its own; :func:`read_table` reads it in place of
    the batches, whose folders may go then.  Running it again for the same ``upto`` replaces
    that part.  ``combine`` puts rows of several batches together; it keeps their day.
    """
    done = _compacted_upto(spark, compacted, below=upto)
    rows = spark.read.parquet(table).filter(F.col(_BATCH).between(done + 1, upto))
    if combine:
        rows = combine(rows.drop(_BATCH)).withColumn(_BATCH, F.lit(upto).cast("long"))
    days = rows.withColumn("upto", F.lit(upto).cast("long")).hint("rebalance", _DAY)
    (
        days.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("upto", _DAY)
        .parquet(compacted)
    )


def _compacted_upto(spark: SparkSession, compacted: str, below: int | None = None) -> int:
    """The last batch in ``compacted`` (before ``below``), -1 if there is none."""
    try:
        parts = spark.read.parquet(compacted).select("upto")
    except AnalysisException:  # nothing compacted yet
        return -1
    if below is not None:
        parts = parts.filter(F.col("upto") < below)
    last = parts.agg(F.max("upto")).first()[0]
    return -1 if last is None else last


def read_table(spark: SparkSession, table: str, compacted: str) -> DataFrame:
    """The rows of all batches: compacted ones, and the batches after them."""
    done = _compacted_upto(spark, compacted)
    recent = spark.read.parquet(table).filter(F.col(_BATCH) > done)
    if done < 0:
        return recent
    return recent.unionByName(spark.read.parquet(compacted).drop("upto").select(recent.columns))


def store_clicks(
    requests: DataFrame, link_map: DataFrame, db_links: DataFrame, out: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Resolve streamed requests and append them to ``out``, by day.

    The link tables are read again for every batch, so new links are found.  Requests of
    unknown links are kept too, with status ``unknown``.  A batch is too small for a search
    of crowded links beforehand; adaptive execution splits them.
    """

    def resolve(batch: DataFrame, batch_id: int) -> None:
        rows = by_source_priority(batch, link_map, db_links, hot=()).select(
            "*",
            F.when(F.col("source").isNull(), "unknown").otherwise("click").alias("status"),
            F.to_date("clicked_at").alias(_DAY),
        )
        _write_batch(rows.hint("rebalance", _DAY), out, batch_id)

    return (
        requests.writeStream.foreachBatch(resolve)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def store_daily_counts(clicks: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write each batch's own counts by link and day to ``out``; :func:`summed_counts` reads them.

    Every click counts, however late it comes and however files fall into batches, and the
    stream keeps no state.
    """

    def count(batch: DataFrame, batch_id: int) -> None:
        day = day_of(F.col("clicked_at")).alias(_DAY)
        _write_batch(batch.groupBy("link_key", day).agg(F.count("*").alias("clicks")), out, batch_id)

    return (
        clicks.writeStream.foreachBatch(count)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def summed_counts(counts: DataFrame) -> DataFrame:
    """Clicks per link and day of what :func:`store_daily_counts` has written."""
    day = F.col(_DAY).cast("string").alias(_DAY)
    return counts.groupBy("link_key", day).agg(F.sum("clicks").alias("clicks"))


def store_visitors(clicks: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each (link, visitor) pair the first time it is seen.

    The state is one small entry per pair, spread by link and visitor, so a crowded link
    does not gather in one task as a set per link would.
    """
    pairs = clicks.select("link_key", "ip_hash").dropDuplicates(["link_key", "ip_hash"])
    return (
        pairs.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def visitor_counts(visitors: DataFrame) -> DataFrame:
    return visitors.groupBy("link_key").agg(F.count("*").alias("unique_users"))


def store_visitor_sketches(
    clicks: DataFrame, out: str, checkpoint: str, lg_k: int = LG_K, **trigger
) -> StreamingQuery:
    """Write each batch's visitor sketches by link and day to ``out``.

    The stream keeps no state: where :func:`store_visitors` remembers every pair of link and
    visitor for ever, this leaves one sketch for each link and day of a batch.
    :func:`visitor_sketches` merges them; :func:`compact` may do so for good.
    """

    def sketch(batch: DataFrame, batch_id: int) -> None:
        _write_batch(sketch_visitors(batch, lg_k), out, batch_id)

    return (
        clicks.writeStream.foreachBatch(sketch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def visitor_sketches(rows: DataFrame) -> DataFrame:
    """One sketch per link and day of what :func:`store_visitor_sketches` has written."""
    return merge_sketches(rows, ["link_key", F.col(_DAY).cast("string").alias(_DAY)])


def append_events(events: DataFrame, out: str, period: str = "yyyy-MM-dd") -> None:
    """Append click events to a table split by ``period``: by day, or as the pattern says.

    Rows are brought together by period first, so that a task does not write a file for
    every period it meets; Spark divides a crowded period among several tasks.
    """
    rows = events.withColumn("period", F.date_format("created_at", period))
    rows.hint("rebalance", "period").write.mode("append").partitionBy("period").parquet(out)


def finish(query: StreamingQuery) -> None:
    """Wait for a query that stops by itself, and pass on its failure."""
    query.awaitTermination()
    failure = query.exception()
    if failure is not None:
        raise failure
