"""Table scans (S9).  Projection and filters are left to Catalyst, which
prunes columns and pushes predicates into the parquet reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan."""
    return spark.read.parquet(path)
