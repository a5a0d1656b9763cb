"""Readers of the Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of ``directory``; only the columns a plan uses are read."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
