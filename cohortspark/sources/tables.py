"""Named tables of one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """``directory/name.parquet``; with columns, only those are read."""
    df = spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def register_views(spark: SparkSession, directory: str, names: list[str]) -> None:
    """Make the tables of a directory available to ``spark.sql``."""
    for name in names:
        table(spark, directory, name).createOrReplaceTempView(name)
