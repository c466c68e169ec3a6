"""Tables kept in buckets of a key, and joins that leave them where they are.

A bucketed table is written once by a hash of its key; a join on that key then moves the other side
alone, or neither if both are kept in as many buckets.  A bucket is read by one task, so rows of
crowded keys do not take that way: their few partners are broadcast to them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drillsight.plans.skew import hot_keys


def store_bucketed(rows: DataFrame, key: str, buckets: int, path: str) -> DataFrame:
    """Write ``rows`` to ``path`` in buckets of ``key``, sorted by it; gives the table.

    Rows of a bucket are brought together first; a crowded one is divided among tasks.
    """
    mark = F.pmod(F.hash(key), F.lit(buckets))
    dealt = rows.withColumn("_bucket", mark).hint("rebalance", "_bucket").drop("_bucket")
    name = f"bucketed_{uuid.uuid4().hex}"
    dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return rows.sparkSession.table(name)


def open_bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """A table that an earlier session has written."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    name = f"bucketed_{uuid.uuid4().hex}"
    spark.sql(f"create table {name} ({fields}) using parquet clustered by (`{key}`) sorted by (`{key}`) into {buckets} buckets location '{path}'")
    return spark.table(name)


def _crowded(key: str, hot: Sequence) -> Column:
    """Rows with a hot key, or with none."""
    return F.col(key).isNull() | F.coalesce(F.col(key).isin([k for k in hot if k is not None]), F.lit(False))


def bucketed_lookup(big: DataFrame, table: DataFrame, on: str, how: str = "inner", hot: Sequence | None = None) -> DataFrame:
    """Join ``big`` to a bucketed table that has ``on`` once; ``how`` is ``inner`` or ``left``.

    The table is not moved.  Its rows of crowded keys (at most as many as there are of those)
    are broadcast to the rows of ``big`` that have them.
    """
    hot = hot_keys(big, on) if hot is None else hot
    if not hot:
        return big.join(table.hint("merge"), on, how)
    crowded = _crowded(on, hot)
    few = F.broadcast(table.filter(F.col(on).isin([k for k in hot if k is not None])))
    return big.filter(~crowded).join(table.hint("merge"), on, how).unionByName(big.filter(crowded).join(few, on, how))


def bucketed_fanout(one: DataFrame, many: DataFrame, on: str, hot: Sequence | None = None) -> DataFrame:
    """``one`` left join ``many``, both in as many buckets of ``on``; ``one`` has each key once.

    Neither is moved.  Rows of ``many`` with a crowded key get their row of ``one`` broadcast.
    """
    hot = hot_keys(many, on) if hot is None else hot
    if not hot:
        return one.join(many.hint("merge"), on, "left")
    crowded = _crowded(on, hot)
    held = F.col(on).isNotNull() & crowded
    rest = one.filter(~held).join(many.filter(~crowded).hint("merge"), on, "left")
    return rest.unionByName(F.broadcast(one.filter(held)).join(many.filter(held), on))
