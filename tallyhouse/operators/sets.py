"""Set operations, duplicates and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.windows import keep_first, with_group_count


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Concatenation by name; columns absent on one side are null."""
    return a.unionByName(b, allowMissingColumns=True)


def append_new(newest: DataFrame, older: DataFrame, key: str) -> DataFrame:
    """The newest list plus the entries found only in the older one."""
    only_old = older.join(newest.select(key), key, "left_anti")
    return union_all(newest, only_old)


def symmetric_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Distinct values found on one side only, with that side's name.

    Both sides are reduced to one row per value before they meet.
    """
    side = lambda df, bit: df.select(column, F.lit(bit).alias("_s"))
    seen = side(a, 1).unionByName(side(b, 2)).groupBy(column).agg(F.min("_s").alias("_lo"), F.max("_s").alias("_hi"))
    return seen.where(F.col("_lo") == F.col("_hi")).select(
        column, F.when(F.col("_lo") == 1, "left").otherwise("right").alias("side")
    )


def drop_duplicates(df: DataFrame, subset: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in an explicit order (nulls count as equal)."""
    return keep_first(df, subset, order)


def drop_duplicates_but(df: DataFrame, ignored: str) -> DataFrame:
    """One row per combination of all other columns; the smallest ``ignored`` value is kept."""
    rest = [c for c in df.columns if c != ignored]
    return df.groupBy(*rest).agg(F.min(ignored).alias(ignored)).select(*df.columns)


def find_double_entries(df: DataFrame, key: str, n: int = 1, dropna: bool = False) -> DataFrame:
    """All rows whose key occurs more than ``n`` times, keys in descending order.

    A hash of the row breaks ties, which lets the sort split a hot key over tasks.
    """
    rows = df.where(F.col(key).isNotNull()) if dropna else df
    counted = with_group_count(rows, [key], "n_rows")
    return counted.where(F.col("n_rows") > n).orderBy(F.col(key).desc(), F.xxhash64(*df.columns))


def is_key(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whether the columns identify a row, with both counts."""
    per = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"))
    return out.withColumn("is_key", (F.col("n_rows") == F.col("n_distinct")).cast("int"))


def overlap_between_batches(df: DataFrame, slot: str, user: str, step: str) -> DataFrame:
    """Share of the accounts of a capture that were also in the previous one."""
    seen = df.select(slot, user).distinct()
    before = seen.select((F.col(slot) + F.expr(f"INTERVAL {step}")).alias(slot), user, F.lit(1).alias("_again"))
    joined = seen.join(before, [slot, user], "left")
    g = joined.groupBy(slot).agg(F.count(F.lit(1)).alias("n_accounts"), F.count("_again").alias("n_common"))
    return g.withColumn("overlap", F.col("n_common") / F.col("n_accounts"))
