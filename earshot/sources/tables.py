"""Scans of the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder: a Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
