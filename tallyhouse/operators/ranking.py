"""Ranks, running sums and order statistics that never put a whole table in one task.

All of them work in two levels: rows are cut into ordered buckets, each bucket is sorted
by its own task, and the bucket totals (at most ``buckets`` rows per group) give offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.operators.selection import exact_quantiles as exact_quantiles  # order statistics have their own module

def bucket_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def rank_by_uniform(
    df: DataFrame,
    draw: Column,
    ties: Sequence[str],
    group: Sequence[str] = (),
    name: str = "rank",
    buckets: int | None = None,
) -> DataFrame:
    """1-based rank of every row by ``draw`` (uniform in [0, 1)) inside ``group``.

    Buckets are equal slices of the unit interval, so they are balanced whatever the
    group sizes are; the offsets are a table of groups x buckets counts.
    """
    buckets = buckets or bucket_count(df)
    group = list(group)
    keyed = df.withColumn("_draw", draw).withColumn("_bucket", F.floor(F.col("_draw") * buckets).cast("int"))
    counts = keyed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(*group, "_bucket").orderBy("_draw", *ties)
    ranked = keyed.withColumn("_place", F.row_number().over(local))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "_bucket"]]
    cond = same[0]
    for extra in same[1:]:
        cond = cond & extra
    joined = ranked.alias("l").join(offsets.alias("r"), cond)
    keep = [F.col(f"l.{c}") for c in df.columns]
    return joined.select(*keep, (F.col("_place") + F.col("_offset")).alias(name))


def split_points(df: DataFrame, column: str, buckets: int) -> list[float]:
    """At most ``buckets`` - 1 approximate quantiles, the only data sent to the driver."""
    probs = [i / buckets for i in range(1, buckets)]
    found = df.stat.approxQuantile(column, probs, 0.25 / buckets)
    return sorted(set(found))


def running_sums(
    df: DataFrame,
    order: str,
    sums: dict[str, str],
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Running totals ``{output: input}`` in the order of a numeric column with unique values."""
    buckets = buckets or bucket_count(df)
    cuts = split_points(df, order, buckets)
    inner = [-float("inf"), *cuts, float("inf")]
    cut = Bucketizer(splits=inner, inputCol="_order", outputCol="_bucket").transform(
        df.withColumn("_order", F.col(order).cast("double"))
    )
    key = F.col(order).desc() if descending else F.col(order).asc()
    bkey = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    totals = cut.groupBy("_bucket").agg(*[F.sum(src).alias(f"_t_{out}") for out, src in sums.items()])
    before = Window.orderBy(bkey).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_bucket", *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_o_{out}") for out in sums]
    )
    local = Window.partitionBy("_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    stepped = cut.select(
        *df.columns, "_bucket", *[F.sum(src).over(local).alias(f"_s_{out}") for out, src in sums.items()]
    )
    return stepped.join(F.broadcast(offsets), "_bucket").select(
        *df.columns, *[(F.col(f"_s_{out}") + F.col(f"_o_{out}")).alias(out) for out in sums]
    )


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, salts: int | None = None
) -> DataFrame:
    """First ``k`` rows of each group, in two steps.

    A group is cut by a salt over as many tasks as there are shuffle partitions; each part keeps its
    best ``k``, and the parts of a group meet afterwards. For small ``k`` Spark limits the parts before the shuffle.
    """
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts or bucket_count(df)))
    salted = Window.partitionBy(*group, "_salt").orderBy(*order)
    best = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= k).drop("_r", "_salt")
    final = Window.partitionBy(*group).orderBy(*order)
    return best.withColumn("_r", F.row_number().over(final)).where(F.col("_r") <= k).drop("_r")


def first_rows(df: DataFrame, value: Column, ties: Sequence[str], n: int, parts: int = 4096) -> DataFrame:
    """The ``n`` rows with the smallest ``value`` (not negative), for any ``n``.

    Values are counted in cells of equal ratio (``parts`` per doubling, a table that does not grow with the rows). Cells that
    lie wholly among the first ``n`` rows are taken as they are, and only the one cell in which row ``n`` lies is sorted.
    """
    cell = F.when(F.col("_v") > 0, F.floor(F.log2("_v") * parts).cast("bigint")).otherwise(F.lit(-(2**62)))
    keyed = df.withColumn("_v", value).where(F.col("_v").isNotNull()).withColumn("_cell", cell)
    sizes = keyed.groupBy("_cell").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = sizes.withColumn("_before", before).where(F.col("_before") < n)
    whole = keyed.join(places.where(F.col("_before") + F.col("_size") <= n).select("_cell"), "_cell").select(*df.columns)
    edge = keyed.join(places.where(F.col("_before") + F.col("_size") > n).select("_cell", "_before"), "_cell")
    place = F.row_number().over(Window.partitionBy("_cell").orderBy("_v", *ties))
    rest = edge.withColumn("_place", place).where(F.col("_place") + F.col("_before") <= n).select(*df.columns)
    return whole.unionByName(rest)
