"""SRC-1: scan the ten shop tables with their declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import SCHEMAS


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One shop table from Parquet with its declared schema (no inference);
    filters and projections on the result reach the Parquet scan."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def load_tables(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """All ten tables below ``base`` (one folder per table)."""
    return {name: read_table(spark, f"{base.rstrip('/')}/{name}", name) for name in SCHEMAS}
