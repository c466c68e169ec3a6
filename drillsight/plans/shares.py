"""Shuffles whose tasks hold a bounded number of rows.

A shuffle that Spark adds for an aggregate is merged by adaptive execution into tasks of 64 MB
as compressed in files, and a split of a compact table has millions of rows; where nearly every
row is a group of its own, the hash tables of such tasks take a gigabyte.  The shuffles of this
module keep the number of tasks that ``spark.sql.shuffle.partitions`` asks for, so a task has its
share of the rows, however well these compress.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names the share of a row that :func:`dealt` has dealt out.
SHARE = "_share"
#: Shares for each task: few enough to combine crowded keys in, and enough to make tasks even.
SHARES_PER_TASK = 16


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def evenly(df: DataFrame, *by: str) -> DataFrame:
    """Rows with the same ``by`` together, in as many tasks as there are shuffle partitions.

    For rows that are combined already: a task gets all rows of its keys.
    """
    return df.repartition(_tasks(df), *by)


def dealt(df: DataFrame, *spread_by: str) -> DataFrame:
    """Rows dealt out by a hash of ``spread_by``, with their share as :data:`SHARE`.

    An aggregate by :data:`SHARE` and other columns needs no more shuffle, so it combines the rows
    of crowded keys inside each share.
    """
    tasks = _tasks(df)
    share = F.pmod(F.xxhash64(*spread_by), F.lit(tasks * SHARES_PER_TASK))
    return df.withColumn(SHARE, share).repartition(tasks, SHARE)
