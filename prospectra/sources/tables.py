"""Readers of the columnar tables that queries work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table `name` below `root`; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{root}/{name}.parquet")
