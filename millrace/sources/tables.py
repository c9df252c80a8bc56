"""Parquet tables addressed by name under one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Lazily read ``<folder>/<name>.parquet`` through Spark, whatever store the folder is in."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
