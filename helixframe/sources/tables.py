"""Reading the tables that queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shipping import ship


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A Parquet table of a directory; any path Spark can open."""
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")
