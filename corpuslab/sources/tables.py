"""Reading the engine's tables: one Parquet file or folder per table name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table `name` under `root`; Parquet carries the schema, so nothing is inferred from data."""
    return spark.read.parquet(f"{root}/{name}.parquet")
