"""Session settings the library expects, and the shared folder for tables it writes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings that results or plans depend on.  The session zone fixes the day of a click;
#: the rest lets Spark re-plan joins by measured size and keep stream state on disk.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(app: str = "drillsight", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or fetch) a session with :data:`CONF`, then ``conf`` on top."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without the setting uses a folder of its warehouse, since its executors
    are this machine.  A cluster without it is an error: a folder on the driver's disk
    would not be there for the executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    spark.sparkContext.setCheckpointDir(root)
    return root


#: Open scopes: the paths handed out in each.
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below :func:`shared_root`; nothing is created yet.

    It belongs to the innermost open :func:`staging` scope, or to the caller if none is open.
    """
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def _at(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as it takes it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder."""
    system, at = _at(spark, path)
    return system.exists(at)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if there is no such folder."""
    system, at = _at(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(at)) if system.exists(at) else []


def files_below(spark: SparkSession, path: str) -> list[str]:
    """The files below a folder, as paths from there."""
    system, at = _at(spark, path)
    out, found = [], system.listFiles(at, True)
    top = system.makeQualified(at).toUri().getPath().rstrip("/") + "/"
    while found.hasNext():
        out.append(found.next().getPath().toUri().getPath().removeprefix(top))
    return sorted(out)


def move(spark: SparkSession, path: str, target: str) -> None:
    """Give a file another name; folders on the way are made."""
    system, at = _at(spark, path)
    _, to = _at(spark, target)
    system.mkdirs(to.getParent())
    if not system.rename(at, to):
        raise OSError(f"cannot move {path} to {target}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder wherever it is, if it is there."""
    system, at = _at(spark, path)
    system.delete(at, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Owns the tables staged inside: they are removed at the end, when results are stored."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


def settle(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write what ``build`` returns to ``path`` and remove what was staged on the way to it."""
    with staging(spark):
        df = build()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back.

    For results that are used several times: the table outlives lost executors, and the
    plans that use it start from it.  It stays until its :func:`staging` scope ends; without
    one, until the owner of the shared folder removes it.
    """
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
