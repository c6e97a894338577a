"""Readers for the parquet tables that queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` (a file or a folder of files) below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
