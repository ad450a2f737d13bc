"""Intermediate tables that every executor can read again."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyhouse.session import scratch_path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so that lineage ends there and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
