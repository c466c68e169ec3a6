"""Tables that take small changes without being rewritten: a base, and change sets beside it.

Rows are dealt to buckets by a hash of their key.  Below the table's folder,

* ``base/v=<n>/bucket=<b>`` holds the rows of a bucket in version n;
* ``held/v=<n>`` names the buckets version n was written for, and the last change set each holds;
* ``log/seq=<n>/bucket=<b>`` holds the rows that change set n has changed, as they are after it,
  or marked as deleted;
* ``schema`` holds the schema of the rows.

A change reads the current rows of its keys, in their buckets alone, and writes those that differ
as the next set: ten changed rows are ten written ones.  :func:`read` takes the newest version of each
bucket; rows of buckets without later sets come as they are, the others without the changed
keys, of which the last row counts.  :func:`compact` writes a new version of the buckets that have
later sets, and of no others.

Sets and versions count when their job is complete, so what is lost midway is as if it had not
begun, and may be done again.  One writer at a time; readers see the sets there were when they began.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drillsight.plans.skew import dimension_join
from drillsight.session import child_names, exists, remove

BUCKET, SEQ, DELETED, _VERSION = "bucket", "seq", "_deleted", "v"


@dataclass(frozen=True)
class KeyedTable:
    """A table below ``root`` whose rows have a unique ``key``; the number of buckets stays."""

    spark: SparkSession
    root: str
    key: str
    buckets: int


def _bucketed(table: KeyedTable, rows: DataFrame) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(table.key), F.lit(table.buckets)).cast("int"))


def _write(rows: DataFrame, path: str) -> None:
    """By bucket; a crowded bucket (large rows) is divided among several tasks."""
    rows.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def create(spark: SparkSession, root: str, rows: DataFrame, key: str, buckets: int = 64) -> KeyedTable:
    """Store ``rows`` as the first version of a table."""
    if taken := {BUCKET, SEQ, DELETED, _VERSION} & set(rows.columns):
        raise ValueError(f"columns of these names are not possible: {', '.join(sorted(taken))}")
    table = KeyedTable(spark, root, key, buckets)
    text = spark.createDataFrame([(rows.schema.json(),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{root}/schema")
    _write_version(table, rows, 0, {b: 0 for b in range(buckets)})
    return table


def _write_version(table: KeyedTable, rows: DataFrame, version: int, upto: dict[int, int]) -> None:
    """The names of its buckets come first: a version counts when its rows are complete."""
    held = table.spark.createDataFrame(list(upto.items()), f"{BUCKET} int, {SEQ} long")
    held.coalesce(1).write.mode("overwrite").json(f"{table.root}/held/{_VERSION}={version}")
    _write(_bucketed(table, rows), f"{table.root}/base/{_VERSION}={version}")


def _schema(table: KeyedTable) -> T.StructType:
    return T.StructType.fromJson(json.loads(table.spark.read.text(f"{table.root}/schema").first()[0]))


def _numbers(table: KeyedTable, folder: str, name: str) -> dict[int, list[int]]:
    """The buckets with rows of each complete version or set, by its number."""
    at, out = f"{table.root}/{folder}", {}
    for child in child_names(table.spark, at):
        if child.startswith(f"{name}=") and exists(table.spark, f"{at}/{child}/_SUCCESS"):
            inside = child_names(table.spark, f"{at}/{child}")
            out[int(child.split("=")[1])] = [int(x.split("=")[1]) for x in inside if x.startswith(f"{BUCKET}=")]
    return out


@dataclass(frozen=True)
class _State:
    """What a reader goes by: of each bucket its version, whether that has rows, and the sets
    after the one it holds."""

    version: dict[int, int]
    filled: set[int]
    later: dict[int, list[int]]


def _state(table: KeyedTable) -> _State:
    version: dict[int, int] = {}
    upto: dict[int, int] = {}
    filled: set[int] = set()
    bases = _numbers(table, "base", _VERSION)
    schema = f"{BUCKET} int, {SEQ} long, {_VERSION} int"
    held = table.spark.read.schema(schema).json(f"{table.root}/held").collect()  # a row a bucket and version
    for row in sorted(held, key=lambda r: r[_VERSION]):
        if row[_VERSION] in bases:
            bucket = row[BUCKET]
            version[bucket], upto[bucket] = row[_VERSION], row[SEQ]
            (filled.add if bucket in bases[row[_VERSION]] else filled.discard)(bucket)
    later: dict[int, list[int]] = {}
    for seq, found in _numbers(table, "log", SEQ).items():
        for bucket in found:
            if seq > upto[bucket]:
                later.setdefault(bucket, []).append(seq)
    return _State(version, filled, later)


def _read_paths(table: KeyedTable, folder: str, paths: list[str], *more: T.StructField) -> DataFrame:
    """The rows of some bucket folders, with ``more`` columns."""
    schema = T.StructType([*_schema(table).fields, *more])
    if not paths:
        return table.spark.createDataFrame([], schema)
    base = f"{table.root}/{folder}"
    return table.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{p}" for p in paths]).select(schema.names)


def read(table: KeyedTable, buckets: set[int] | None = None) -> DataFrame:
    """The rows as they are now (of some buckets), merged on the way."""
    state = _state(table)
    wanted = set(range(table.buckets)) if buckets is None else buckets

    def of(chosen: set[int]) -> DataFrame:
        return _read_paths(table, "base", [f"{_VERSION}={state.version[b]}/{BUCKET}={b}" for b in sorted(chosen)])

    changed = wanted & set(state.later)
    plain = of((wanted & state.filled) - changed)
    if not changed:
        return plain
    paths = [f"{SEQ}={s}/{BUCKET}={b}" for b in sorted(changed) for s in state.later[b]]
    log = _read_paths(table, "log", paths, T.StructField(DELETED, T.BooleanType()), T.StructField(SEQ, T.LongType()))
    row = F.struct(DELETED, *[c for c in plain.columns if c != table.key])
    last = log.groupBy(table.key).agg(F.max_by(row, SEQ).alias("_row"))
    old = dimension_join(of(changed & state.filled), log.select(table.key).distinct(), table.key, "left_anti")
    new = last.select(table.key, "_row.*").filter(~F.col(DELETED))
    return plain.unionByName(old).unionByName(new.select(plain.columns))


def rows_of(table: KeyedTable, keys: DataFrame) -> DataFrame:
    """The current rows of some keys, from their buckets alone."""
    asked = keys.select(table.key).distinct()
    held = {r[BUCKET] for r in _bucketed(table, asked).select(BUCKET).distinct().collect()}  # a number a bucket
    return dimension_join(read(table, held), asked, table.key, "left_semi")


def _append(table: KeyedTable, rows: DataFrame, deleted: bool) -> int:
    """Write rows as the next change set; gives its number."""
    seq = 1 + max(_numbers(table, "log", SEQ), default=0)
    _write(_bucketed(table, rows.withColumn(DELETED, F.lit(deleted))), f"{table.root}/log/{SEQ}={seq}")
    return seq


def change(table: KeyedTable, keys: DataFrame, f: Callable[[DataFrame], DataFrame]) -> int:
    """Write what ``f`` makes of the current rows of ``keys``, new rows included; gives the set's number.

    ``f`` is any function from rows to rows that keeps keys, such as those of ``merge.py``.  Rows it
    leaves as they are are not written.
    """
    now = rows_of(table, keys)
    columns = now.columns
    return _append(table, f(now).select(columns).exceptAll(now), deleted=False)


def delete(table: KeyedTable, keys: DataFrame) -> int:
    """Mark the rows of ``keys`` as deleted; keys that are not there leave no trace."""
    return _append(table, rows_of(table, keys), deleted=True)


def compact(table: KeyedTable, least_sets: int = 1) -> list[int]:
    """Write a new version of the buckets with ``least_sets`` later change sets or more; gives them."""
    later = _state(table).later
    chosen = {b: max(sets) for b, sets in later.items() if len(sets) >= least_sets}
    if chosen:
        version = 1 + max(_numbers(table, "base", _VERSION))
        _write_version(table, read(table, set(chosen)), version, chosen)
    return sorted(chosen)


def clean(table: KeyedTable) -> None:
    """Delete the versions and sets of buckets that are not read any more."""
    state = _state(table)
    for version, found in _numbers(table, "base", _VERSION).items():
        for bucket in found:
            if state.version[bucket] != version:
                remove(table.spark, f"{table.root}/base/{_VERSION}={version}/{BUCKET}={bucket}")
    for seq, found in _numbers(table, "log", SEQ).items():
        for bucket in found:
            if seq not in state.later.get(bucket, ()):
                remove(table.spark, f"{table.root}/log/{SEQ}={seq}/{BUCKET}={bucket}")
