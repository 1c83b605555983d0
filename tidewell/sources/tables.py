"""Readers of the project's tables; each reads only the columns that are used later."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a test-data folder, one Parquet file or folder per table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
