"""Small helpers the operators of this folder share."""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one step inside a task works on; a longer text is a step of its own.
STEP_BYTES = 2 << 20


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Enough where executors see the driver's code at the same path, as in a local session; on
    other clusters the package is installed, or shipped with ``--py-files``.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *known]))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the sample tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(key: Column, folds: int) -> Column:
    """``crc32`` of the key as text, modulo ``folds``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def give_back() -> None:
    """Return memory that earlier tasks of this worker process have freed.

    Workers live through many tasks, and their allocators keep what was freed once.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # there is such a call in the GNU library alone
        ctypes.CDLL(None).malloc_trim(0)


def steps(
    batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = STEP_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of the text column."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(column)
        ends = np.cumsum(pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def whole_texts(column: pa.Array) -> list[str]:
    """The texts of a column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def with_fields(schema: T.StructType, *added: tuple[str, str]) -> T.StructType:
    """The schema with more fields, given by name and type; names may hold any sign."""
    more = [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in added]
    return T.StructType([*schema.fields, *more])


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores before it as it takes to be none of ``taken``."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[0] .. starts[0] + lengths[0] - 1, starts[1] ..`` as one array."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
