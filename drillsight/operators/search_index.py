"""Substring search over the roster through an index of trigrams.

The index holds, for each three letters in a row (in lower case) of the searched columns, the rows and
columns that have them, in folders by a hash of the letters and sorted inside.  A term is looked up by
its rarest trigrams; rows that have all of them in one column are candidates, which the plain search
(``filters.search``) verifies.  Terms under three letters go through the plain search alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drillsight.operators.filters import SEARCH_FIELDS, search
from drillsight.plans.skew import dimension_join

LENGTH = 3
#: Folders of the index.
BUCKETS = 256
#: Trigrams of a term that are looked up: the rarest ones.
LOOKED_UP = 3


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def build_index(recipients: DataFrame, path: str, key: str = "id") -> None:
    """Write the postings of a roster, and how many each trigram has.

    A trigram that all rows have is a crowded folder, which is divided among tasks.
    """
    columns = F.array(*[F.struct(F.lit(n).alias("field"), F.lower(F.coalesce(c, F.lit(""))).alias("text")) for n, c in enumerate(SEARCH_FIELDS)])
    texts = recipients.select(F.col(key).alias("id"), F.inline(columns)).filter(F.char_length("text") >= LENGTH)
    places = F.sequence(F.lit(1), F.char_length("text") - (LENGTH - 1))
    grams = F.array_distinct(F.transform(places, lambda k: F.substring("text", k, F.lit(LENGTH))))
    postings = texts.select("id", "field", F.explode(grams).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
    dealt = postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram", "id")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    counts = recipients.sparkSession.read.parquet(f"{path}/postings").groupBy("bucket", "gram").agg(F.count("*").alias("n"))
    counts.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/counts")


def candidates(spark: SparkSession, path: str, term: str) -> DataFrame | None:
    """``id`` of the rows that have the term's rarest trigrams in one column; None for a short term."""
    lowered = spark.range(1).select(F.lower(F.lit(term)).alias("term")).first()["term"]
    grams = sorted({lowered[k : k + LENGTH] for k in range(len(lowered) - LENGTH + 1)})
    if not grams:
        return None
    asked = spark.createDataFrame([(g,) for g in grams], "gram string").select("gram", _bucket(F.col("gram")).alias("bucket"))
    folders = {r["gram"]: r["bucket"] for r in asked.collect()}

    def of(table: str, wanted: list[str]) -> DataFrame:
        rows = spark.read.parquet(f"{path}/{table}")
        return rows.filter(F.col("bucket").isin(sorted({folders[g] for g in wanted})) & F.col("gram").isin(wanted))

    counts = {r["gram"]: r["n"] for r in of("counts", grams).collect()}  # one for each trigram of the term
    chosen = sorted(grams, key=lambda g: (counts.get(g, 0), g))[:LOOKED_UP]
    found = of("postings", chosen).groupBy("id", "field").agg(F.count("*").alias("n"))
    return found.filter(F.col("n") == len(chosen)).select("id").distinct()


def search_indexed(recipients: DataFrame, path: str, term: str = "", department: str = "", key: str = "id") -> DataFrame:
    """:func:`filters.search` by way of the index; ``recipients`` are the rows it was built of."""
    found = candidates(recipients.sparkSession, path, term)
    if found is not None:
        recipients = dimension_join(recipients, found.withColumnRenamed("id", key), key, "left_semi")
    return search(recipients, term, department)
