"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drillsight.session import stage


def _least_of(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least_of(both).select("a", F.least("a", "least").alias("least"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    least = _least_of(links)
    tied = links.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return tied.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``a, b`` of links (``b < a``) to ``a, b`` with ``b`` the smallest node of ``a``'s component.

    Nodes that are the smallest of their component have no row.  Every round goes through the
    shared folder, so its lineage is one table; the driver sees a count and a checksum.
    """
    now = stage(links.select("a", "b").distinct(), label)
    seen = None
    while True:
        check = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if check == seen or not check[0]:
            return now
        seen = check
        now = stage(_small_star(_large_star(now)), label)
