"""Exact order statistics of groups of any size by distributed selection.

Values are counted in cells, the cell that holds each wanted rank is kept, and cells that still hold many rows are cut
again between their least and greatest value, until each holds few. Only then are values of a cell put in order. Each round
reads the rows once and keeps a small table of cells, so no task ever sorts more than ``most`` rows of a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.session import kept_table

PER_DOUBLING = 512  # cells of the first round
PARTS = 4096  # of a cell that is cut again
MOST_ROWS = 4096
_FAR = 1 << 21  # beyond the first-round cell of any double


def _first_cell(v: Column) -> Column:
    """Number of a cell of equal ratio; falls with the value below zero, and missing numbers come last as in Spark's order."""
    size = F.floor(F.least(F.log2(F.abs(v)), F.lit(1025.0)) * PER_DOUBLING).cast("bigint") + _FAR
    return F.when(F.isnan(v), F.lit(2 * _FAR)).when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0).cast("bigint"))


def order_statistics(df: DataFrame, group: Sequence[str], value: str, ranks: Sequence[Column], most: int = MOST_ROWS) -> DataFrame:
    """Group, ``_n`` (rows with a value) and ``_at``: the values at the 0-based ``ranks``, which are expressions of ``_n``.

    Rows without a value or with a missing key are left out. A rank outside the group has no value.
    """
    group, v = list(group), F.col(value).cast("double")
    present = reduce(lambda a, b: a & b, [F.col(g).isNotNull() for g in group], F.col(value).isNotNull())
    rows = df.where(present).select(*group, v.alias("_v"), F.lit(0.0).alias("_in"), _first_cell(v).alias("_cell"))
    at = [*group, "_in", "_cell"]
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), r.cast("bigint").alias("k")) for i, r in enumerate(ranks)])
    hit = lambda rank: (rank["k"] >= F.col("_before")) & (rank["k"] < F.col("_before") + F.col("_size"))

    def cells(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*at).agg(F.count(F.lit(1)).alias("_size"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))

    def before(*part: str) -> Column:
        return F.coalesce(F.sum("_size").over(Window.partitionBy(*part).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def opened(placed: DataFrame) -> DataFrame:
        return kept_table(placed.withColumn("_hits", F.filter("_hits", hit)).where(F.size("_hits") > 0).withColumn(
            "_hits", F.transform("_hits", lambda r: F.struct(r["i"].alias("i"), (r["k"] - F.col("_before")).alias("k")))), "cells")

    totals = F.sum("_size").over(Window.partitionBy(*group))
    now = opened(cells(rows).withColumn("_before", before(*group)).withColumn("_n", totals).withColumn("_hits", wanted))
    found = [now.where("_lo = _hi").select(*group, "_n", F.explode("_hits").alias("_h"), F.col("_lo").alias("_v"))]
    while True:
        wide = now.where("_lo < _hi")
        largest = wide.agg(F.max("_size").alias("n")).first()["n"]
        if largest is None:
            break
        inside = rows.join(wide.select(*at, "_lo", "_hi"), at)
        if largest <= most:
            counted = inside.groupBy(*at, "_v").agg(F.count(F.lit(1)).alias("_size"))
            upto = F.sum("_size").over(Window.partitionBy(*at).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
            placed = counted.withColumn("_before", upto - F.col("_size")).join(wide.select(*at, "_n", "_hits"), at)
            found.append(placed.select(*group, "_n", F.explode(F.filter("_hits", hit)).alias("_h"), "_v"))
            break
        step = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PARTS).cast("bigint")
        rows = inside.select(*group, "_v", F.col("_lo").alias("_in"), F.least(step, F.lit(PARTS - 1)).alias("_cell"))
        parents = wide.select(*group, F.col("_lo").alias("_in"), "_n", "_hits")
        now = opened(cells(rows).withColumn("_before", before(*group, "_in")).join(parents, [*group, "_in"]))
        found.append(now.where("_lo = _hi").select(*group, "_n", F.explode("_hits").alias("_h"), F.col("_lo").alias("_v")))
    each = reduce(DataFrame.unionByName, found)
    values = F.array(*[F.max(F.when(F.col("_h.i") == i, F.col("_v"))) for i in range(len(ranks))])
    return each.groupBy(*group).agg(F.max("_n").alias("_n"), values.alias("_at"))


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str, probs: dict[str, float], most: int = MOST_ROWS) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one row per group with ``n`` and one column per quantile."""
    group = list(group)
    spot = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs.values()]
    ranks = [r for s in spot for r in (F.floor(s), F.least(F.floor(s) + 1, F.col("_n") - 1))]
    found = order_statistics(df, group, value, ranks, most)
    out = []
    for i, (name, s) in enumerate(zip(probs, spot)):
        a, z = F.col("_at")[2 * i], F.col("_at")[2 * i + 1]
        part = s - F.floor(s)
        out.append(F.when((a == z) | (part == 0), a).otherwise(a + (z - a) * part).alias(name))
    return found.select(*group, F.col("_n").alias("n"), *out)
