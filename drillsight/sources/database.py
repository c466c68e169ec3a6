"""Tables of a relational database as a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    user: str,
    password: str,
    partitions: int = 64,
    key: str = "id",
    **options: str,
) -> DataFrame:
    """Read ``table`` in ``partitions`` ranges of its numeric ``key``.

    The range limits are asked from the database first, so that the reads are even.
    Filters and column choices on the result go into the queries sent.
    """

    def reader() -> DataFrameReader:
        return spark.read.format("jdbc").options(url=url, user=user, password=password, **options)

    limits = reader().option("query", f"select min({key}) as lo, max({key}) as hi from {table}").load().first()
    if limits["lo"] is None:
        return reader().option("dbtable", table).load()
    return (
        reader()
        .option("dbtable", table)
        .option("partitionColumn", key)
        .option("lowerBound", int(limits["lo"]))
        .option("upperBound", int(limits["hi"]) + 1)
        .option("numPartitions", partitions)
        .option("fetchsize", 10_000)
        .load()
    )
