"""Table sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; filters and columns are pushed into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
