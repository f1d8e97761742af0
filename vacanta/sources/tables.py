"""Parquet scans of the input tables.

Every scan names its columns, so Catalyst prunes the Parquet read to them
(``ReadSchema`` in the plan) and pushes filters into the reader.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def scan(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Column-pruned Parquet scan of one input table (S-03)."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df
