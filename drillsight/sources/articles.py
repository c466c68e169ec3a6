"""News articles from stored responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drillsight.schemas import ARTICLES


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """One row per article of the responses at ``path`` (one JSON object per line)."""
    responses = spark.read.schema(ARTICLES).json(path)
    return flatten_articles(responses)


def flatten_articles(responses: DataFrame) -> DataFrame:
    article = F.col("article")
    return responses.select(F.explode("articles").alias("article")).select(
        article["title"].alias("title"),
        article["url"].alias("link"),
        article["publishedAt"].alias("published"),
        article["source"]["name"].alias("source"),
        article["urlToImage"].alias("image"),
        article["description"].alias("description"),
    )
