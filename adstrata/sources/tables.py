"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``directory``; columns and filters are pruned by the plan above it."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
