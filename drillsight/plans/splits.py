"""Texts whose records span lines, read in many tasks: pieces of files and what stands before them.

A file is read in pieces that end at a separator, in as many splits as its size asks for.  Whether
a piece begins inside a quoted value depends on all that stands before it.  That is summed up in two
levels: piece by piece inside a split, and split by split over a file, a row for each split.  Splits
are of the size Spark reads in one task, so no task gets more than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``value, file, block, row``: pieces in order of ``block`` and ``row`` within their file."""
    raw = spark.read.option("lineSep", separator).text(path)
    return raw.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def quotes(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit('"'), F.lit("")))


def quoted_records(lines: DataFrame) -> DataFrame:
    """``file, first, text``: records of lines, put together where a quoted value spans several.

    ``first`` (block and row) is the place of a record's first line.  Quotes stand around values or
    doubled inside them, so a line begins inside a value if an odd number stands before it in
    the file.  Only records of several lines are gathered; one whose quote is never closed is
    the rest of its file, as for any reader.
    """
    of_split, of_file = Window.partitionBy("file", "block").orderBy("row"), Window.partitionBy("file").orderBy("block")
    in_split, so_far = (of_split.rowsBetween(Window.unboundedPreceding, end) for end in (-1, 0))
    splits_before = of_file.rowsBetween(Window.unboundedPreceding, -1)
    odd = quotes(F.col("value")) % 2
    place = F.struct("block", "row")
    counted = lines.withColumn("odd", odd).withColumn(
        "inside", F.coalesce(F.sum("odd").over(in_split), F.lit(0)) % 2
    )
    splits = counted.groupBy("file", "block").agg(
        F.sum("odd").alias("total"),
        F.max(F.when(F.col("inside") == 0, place)).alias("last_0"),
        F.max(F.when(F.col("inside") == 1, place)).alias("last_1"),
    )
    opened = splits.withColumn("opened", F.coalesce(F.sum("total").over(splits_before), F.lit(0)) % 2)
    # The last line of a split that begins a record, and of the splits before it.
    last = F.when(F.col("opened") == 0, F.col("last_0")).otherwise(F.col("last_1"))
    carried = opened.withColumn("last", last).select(
        "file", "block", "opened", F.last("last", ignorenulls=True).over(splits_before).alias("carried")
    )
    known = counted.join(carried.hint("merge"), ["file", "block"])
    begins = (F.col("opened") + F.col("inside")) % 2 == 0
    found = known.withColumn("begins", begins).withColumn(
        "first", F.coalesce(F.max(F.when(F.col("begins"), place)).over(so_far), F.col("carried"))
    )
    alone = F.col("begins") & (F.col("odd") == 0)
    parts = F.sort_array(F.collect_list(F.struct("block", "row", "value")))
    gathered = found.filter(~alone).groupBy("file", "first").agg(parts.alias("parts"))
    whole = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    texts = found.filter(alone).select("file", "first", F.col("value").alias("text"))
    return texts.unionByName(gathered.select("file", "first", whole.alias("text")))
