"""Joins with the integrity rules the measurements rely on."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def single_row_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` reduced to one row per key; a second row with the same key stops the job."""
    rest = [c for c in df.columns if c not in keys]
    one = F.assert_true(F.col("_n") == 1, F.lit(f"more than one row per {list(keys)}"))
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in rest])
    return grouped.where(one.isNull()).select(*df.columns)


def attach(facts: DataFrame, attributes: DataFrame, keys: Sequence[str], fill: dict | None = None) -> DataFrame:
    """Left join that cannot grow: ``attributes`` must hold one row per key."""
    joined = facts.join(single_row_per_key(attributes, keys), list(keys), "left")
    return joined.fillna(fill) if fill else joined


def keep_facts(attributes: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Right join: every fact row stays once, with its attributes when known (one row per key, or the job stops)."""
    return single_row_per_key(attributes, keys).join(facts, list(keys), "right")


def pairs_of_same_owner(a: DataFrame, b: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Inner join on the owner with a flag telling equal names."""
    return a.join(b, key).withColumn("same", F.coalesce(F.col(left) == F.col(right), F.lit(False)).cast("int"))


def full_outer(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full outer join with the side each row came from."""
    left = a.withColumn("_in_a", F.lit(1))
    right = b.withColumn("_in_b", F.lit(1))
    side = (
        F.when(F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull(), "both")
        .when(F.col("_in_a").isNotNull(), "left")
        .otherwise("right")
    )
    return left.join(right, key, "full_outer").withColumn("side", side).drop("_in_a", "_in_b")


def unmatched(joined: DataFrame) -> DataFrame:
    """Rows per side of ``full_outer``; only ``both`` may remain for a clean join."""
    return joined.groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def matched_only(joined: DataFrame) -> DataFrame:
    """Rows of ``full_outer`` without the side; a row found on one side only stops the job."""
    both = F.assert_true(F.col("side") == "both", F.lit("an id is missing on one side"))
    return joined.where(both.isNull()).drop("side")


def keep_ids(df: DataFrame, ids: DataFrame, column: str, id_column: str = "id") -> DataFrame:
    return df.join(ids.select(F.col(id_column).alias(column)), column, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, column: str, id_column: str = "id") -> DataFrame:
    """Rows whose id is not listed; rows without id stay."""
    return df.join(ids.select(F.col(id_column).alias(column)), column, "left_anti")


def all_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every row of ``a`` with every row of ``b``: the product is what is asked for. Spark broadcasts a side it knows to be small."""
    return a.crossJoin(b)


def all_value_combinations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All combinations of the distinct values (null included) of each column."""
    parts = [df.select(c).distinct() for c in columns]
    return reduce(all_pairs, parts)


def dense_labels(df: DataFrame, groups: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Observed group tuples (without nulls) times all values of the counted columns."""
    seen = df.select(*groups).dropna().distinct()
    return all_pairs(seen, all_value_combinations(df, values))


def interval_join(df: DataFrame, sources: DataFrame, at: str, first: str, last: str) -> DataFrame:
    """Row with the intervals active at ``at`` (both ends included); no interval drops the row.

    Intervals are listed by day, so that rows meet only intervals of their own day in an equi-join. Days
    outside the range of a table at rest are not listed; a stream has no range and needs intervals that end.
    """
    day = F.to_date(at)
    begin, end = F.to_date(first), F.to_date(last)
    listed = sources.where(F.col(first) <= F.col(last))
    if not df.isStreaming:
        ends = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
        begin, end = F.greatest(begin, ends.select("lo").scalar()), F.least(end, ends.select("hi").scalar())
    days = F.when(begin <= end, F.sequence(begin, end)).otherwise(F.array().cast("array<date>"))
    listed = listed.withColumn("__th_day", F.explode(days))
    joined = df.withColumn("__th_day", day).join(listed, "__th_day").drop("__th_day")
    return joined.where(F.col(at).between(F.col(first), F.col(last)))


def rater_pairs(votes: DataFrame, raters: Sequence[str]) -> DataFrame:
    """Common items and share of equal votes of every ordered pair of raters.

    Votes are laid out as one column per rater (the list of raters is fixed), so all
    pairs come from a single pass without pairing rows.
    """
    wide = votes.groupBy("id").agg(
        *[F.max(F.when(F.col("annotator") == r, F.col("value"))).alias(f"v{i}") for i, r in enumerate(raters)]
    )
    aggs, cells = [], []
    for i, a in enumerate(raters):
        for j, b in enumerate(raters):
            if i == j:
                continue
            both = F.col(f"v{i}").isNotNull() & F.col(f"v{j}").isNotNull()
            aggs += [
                F.count(F.when(both, 1)).alias(f"c_{i}_{j}"),
                F.count(F.when(F.col(f"v{i}") == F.col(f"v{j}"), 1)).alias(f"e_{i}_{j}"),
            ]
            cells.append(
                F.struct(
                    F.lit(a).alias("rater_a"), F.lit(b).alias("rater_b"),
                    F.col(f"c_{i}_{j}").alias("n_common"), F.col(f"e_{i}_{j}").alias("n_equal"),
                )
            )
    flat = wide.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return flat.withColumn("agreement", F.try_divide(F.col("n_equal").cast("double"), F.col("n_common").cast("double")))


def slot_grid(bounds: DataFrame, first: Column, last: Column, step: str, name: str = "slot") -> DataFrame:
    """Regular grid from a one-row table of bounds."""
    return bounds.select(F.explode(F.sequence(first, last, F.expr(f"INTERVAL {step}"))).alias(name))


def on_grid(grid: DataFrame, observed: DataFrame, slot: str) -> DataFrame:
    """Grid left joined with the observed slots, so that gaps show as nulls."""
    return grid.join(observed, slot, "left")
