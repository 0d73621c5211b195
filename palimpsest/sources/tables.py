"""Readers for the store's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root``; columns are pruned by the plan that follows."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
