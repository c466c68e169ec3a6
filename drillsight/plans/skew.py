"""Equi-joins that hold up when one key has a third of all rows.

Clicks crowd: one link, campaign or address may be in most rows, and a plain shuffle
join sends all of those to one task.  :func:`lookup_join` and :func:`fanout_join` find
the crowded keys first, in one pass over the key column (:func:`hot_keys`, which runs a
job).  Where there are none, the join is a plain one.  Else rows with a hot key are spread
over ``SALTS`` sub-keys, and only the few matching rows of the other side are repeated.
What is found decides the route a row takes and nothing else: every row is joined.

:func:`dimension_join` is for the small tables: it broadcasts them after counting them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot if it has more rows than a task's fair share, so there are at most as many as
#: shuffle partitions.  The search looks for so many, within these bounds; keys it may miss
#: have little more than a fair share, and are left to adaptive execution.
LEAST_HOT, MAX_HOT = 256, 10_000
#: Counters of a sketch for each key that is looked for, and the most Spark allows.
COUNTERS_PER_KEY, MAX_COUNTERS = 16, 1_000_000
#: Sketches are merged in so many groups before all meet.
SLICES = 512
#: Keys with fewer rows than this are not worth splitting.
MIN_HOT_ROWS = 100_000
#: Sub-keys per hot key.
SALTS = 64
#: Tables up to this many rows and bytes of values are broadcast by :func:`dimension_join`.
MAX_BROADCAST_ROWS = 50_000
MAX_BROADCAST_BYTES = 64 << 20


def hot_keys(df: DataFrame, key: str, min_rows: int | None = None) -> list:
    """The most frequent keys of ``df``, null among them, each with ``min_rows`` rows or more.

    By default that is a shuffle partition's fair share of the rows, and :data:`MIN_HOT_ROWS`
    at least.  Counted with sketches whose size follows the number of shuffle partitions: one
    per task, merged by slices of the tasks, and the top of each slice added up.  Rows are
    not shuffled, and the driver gets no more than :data:`MAX_HOT` keys.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(max(LEAST_HOT, partitions), MAX_HOT)
    counters = min(COUNTERS_PER_KEY * most, MAX_COUNTERS)
    top = F.expr(f"approx_top_k(`{key}`, {most}, {counters})")
    slices = (
        df.select(key, (F.spark_partition_id() % SLICES).alias("_slice"))
        .groupBy("_slice")
        .agg(top.alias("top"), F.count("*").alias("_rows"))
    )
    # The first entry of a slice carries its number of rows, so that one pass gives both.
    counted = slices.select(F.posexplode("top").alias("_n", "top"), "_rows").groupBy(F.col("top.item").alias("item"))
    sums = counted.agg(F.sum("top.count").alias("n"), F.sum(F.when(F.col("_n") == 0, F.col("_rows"))).alias("_rows"))
    total = F.sum("_rows").over(Window.partitionBy())  # over the few keys that are left
    frequent = sums.withColumn("_total", total).orderBy(F.desc("n")).limit(most).collect()
    if not frequent:
        return []
    fair = max(MIN_HOT_ROWS, frequent[0]["_total"] // max(1, partitions))
    return [row["item"] for row in frequent if row["n"] >= (fair if min_rows is None else min_rows)]


def _is_hot(key: str, hot: Sequence) -> Column:
    return F.coalesce(F.col(key).isin([k for k in hot if k is not None]), F.lit(False))


def _salted(df: DataFrame, key: str, hot: Sequence, spread_by: Sequence[str] | None) -> DataFrame:
    """Rows with a hot key, or none, get one of the sub-keys; the others get 0."""
    # A hash and not a random number: a task that runs again salts its rows the same way.
    spread = F.xxhash64(*[F.col(c) for c in (spread_by or df.columns)])
    crowded = F.col(key).isNull() | _is_hot(key, hot)
    return df.withColumn("_salt", F.when(crowded, F.pmod(spread, F.lit(SALTS)).cast("int")).otherwise(0))


def _repeated(df: DataFrame, key: str, hot: Sequence) -> DataFrame:
    """Rows with a hot key once for each sub-key, the others once."""
    salts = F.when(_is_hot(key, hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("_salt", F.explode(salts))


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: str,
    how: str = "inner",
    spread_by: Sequence[str] | None = None,
    hot: Sequence | None = None,
) -> DataFrame:
    """Join ``big`` to ``small``, which has few rows per key.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``.  ``spread_by`` names columns of
    ``big`` that tell rows of one key apart (all columns by default).  ``big`` is read
    twice, the first time for its keys only, so it should be a table rather than the
    result of other joins; or ``hot`` names the crowded keys, if they are known.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join cannot do a {how} join")
    hot = hot_keys(big, on) if hot is None else hot
    if not hot:
        return big.join(small, on, how)
    return _salted(big, on, hot, spread_by).join(_repeated(small, on, hot), [on, "_salt"], how).drop("_salt")


def fanout_join(
    one: DataFrame,
    many: DataFrame,
    on: str,
    spread_by: Sequence[str] | None = None,
    hot: Sequence | None = None,
) -> DataFrame:
    """``one`` left join ``many``, where keys may crowd in ``many`` (``hot``, if they are known).

    A hot key has rows in ``many``, so a repeated row of ``one`` that met none of them
    is a repetition in vain and goes; rows of all other keys are kept with nulls.
    """
    hot = hot_keys(many, on) if hot is None else hot
    if not hot:
        return one.join(many, on, "left")
    right = _salted(many, on, hot, spread_by).withColumn("_met", F.lit(True))
    joined = _repeated(one, on, hot).join(right, [on, "_salt"], "left")
    return joined.filter(F.col("_met").isNotNull() | ~_is_hot(on, hot)).drop("_salt", "_met")


def dimension_join(
    big: DataFrame, dimension: DataFrame, on: str, how: str = "inner", max_rows: int | None = None
) -> DataFrame:
    """Join ``big`` to a table that is expected to be small.

    Its rows are counted up to ``max_rows``, and the bytes of their values added up (which
    runs a job); it is broadcast if neither passes its bound.  Beyond that this is a
    :func:`lookup_join`.
    """
    limit = MAX_BROADCAST_ROWS if max_rows is None else max_rows
    width = F.octet_length(F.to_json(F.struct(*dimension.columns)))
    rows, size = dimension.limit(limit + 1).agg(F.count("*"), F.sum(width)).first()
    if rows <= limit and (size or 0) <= MAX_BROADCAST_BYTES:
        return big.join(F.broadcast(dimension), on, how)
    return lookup_join(big, dimension, on, how)
