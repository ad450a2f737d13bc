"""Outputs: capture batches, published series, headline numbers and annotation sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, by: str = "batch_time", fmt: str = "parquet", mode: str = "append") -> None:
    """One directory per batch. Rebalancing splits a hot batch over writers and joins small ones."""
    writer = df.hint("rebalance", F.col(by)).write.mode(mode).partitionBy(by)
    (writer.option("header", True).option("escape", '"') if fmt == "csv" else writer).format(fmt).save(path)


def export_series(series: DataFrame, when: str, hate: str, total: str, daily: bool = True) -> DataFrame:
    """Published table: counts rounded half-even, percentage of the rounded counts."""
    label = F.date_format(when, "yyyy-MM-dd" if daily else "yyyy-MM-dd HH:mm:ss")
    rounded = series.select(
        label.alias("day"),
        F.bround(F.col(total)).cast("bigint").alias("total"),
        F.bround(F.col(hate)).cast("bigint").alias("violent"),
    )
    share = F.try_divide(F.col("violent").cast("double"), F.col("total").cast("double")) * 100
    return rounded.withColumn("percent", F.bround(share, 2))


def write_series(series: DataFrame, path: str) -> None:
    """One CSV file: a series has one row per slot or day, whatever the data size."""
    series.coalesce(1).sortWithinPartitions("day").write.mode("overwrite").option("header", True).csv(path)


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("bigint")


def headline_numbers(series: DataFrame, day: str, hate: str, today: str) -> DataFrame:
    """Total since the start and of the day before ``today`` (0 when that day is missing)."""
    before = F.date_sub(F.lit(today).cast("date"), 1)
    return series.agg(
        half_up(F.coalesce(F.sum(hate), F.lit(0.0))).alias("total_counts"),
        half_up(F.coalesce(F.sum(F.when(F.to_date(day) == before, F.col(hate))), F.lit(0.0))).alias("yesterday_counts"),
    )


def write_headline(numbers: DataFrame, path: str) -> None:
    """One JSON object: the table of headline numbers has one row."""
    numbers.coalesce(1).write.mode("overwrite").json(path)


def export_for_annotation(df: DataFrame, keep: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Sheet for annotators: chosen columns plus empty label columns."""
    return df.select(*keep, *[F.lit(None).cast("int").alias(c) for c in labels])
