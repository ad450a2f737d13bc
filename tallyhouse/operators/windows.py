"""Time series on slot grids, ranking and weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.operators.ranking import top_per_group


def batch_day(ts: Column | str, hours: float = 3) -> Column:
    """Day in which most of the slot ending at ``ts`` lies."""
    minutes = int(hours * 30)
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.to_date(col - F.expr(f"INTERVAL {minutes} MINUTES"))


def agg_by_day(df: DataFrame, ts: str, stats: Sequence[str], hours: float = 3) -> DataFrame:
    day = batch_day(ts, hours)
    return df.where(day.isNotNull()).groupBy(day.alias("day")).agg(*[F.sum(s).alias(s) for s in stats])


def interpolate_linear(df: DataFrame, order: str, value: str, out: str, back_fill: bool = True) -> DataFrame:
    """Equal-step linear filling of a series; trailing nulls repeat the last value.

    The series holds one row per slot, so one window over all of it is small by nature.
    """
    rows = Window.orderBy(order)
    past = rows.rowsBetween(Window.unboundedPreceding, 0)
    coming = rows.rowsBetween(0, Window.unboundedFollowing)
    known = F.col(value).isNotNull()
    step = (
        df.withColumn("_i", F.row_number().over(rows))
        .withColumn("_pv", F.last(value, ignorenulls=True).over(past))
        .withColumn("_pi", F.last(F.when(known, F.col("_i")), ignorenulls=True).over(past))
        .withColumn("_nv", F.first(value, ignorenulls=True).over(coming))
        .withColumn("_ni", F.first(F.when(known, F.col("_i")), ignorenulls=True).over(coming))
    )
    slope = (F.col("_nv") - F.col("_pv")) / (F.col("_ni") - F.col("_pi"))
    filled = (
        F.when(known, F.col(value))
        .when(F.col("_pv").isNotNull() & F.col("_nv").isNotNull(), F.col("_pv") + slope * (F.col("_i") - F.col("_pi")))
        .otherwise(F.coalesce("_pv", "_nv") if back_fill else F.col("_pv"))
    )
    return step.withColumn(out, filled).drop("_i", "_pv", "_pi", "_nv", "_ni")


def seasonal_impute(df: DataFrame, order: str, value: str, season: str, hours: float, out: str) -> DataFrame:
    """Fill null slots: deseasonalise, centred mean, linear interpolation, back-fill, reseason.

    With w = int(24/h) - 1 and o = (w - 1) // 2 the mean covers rows -(w - o) to +o and
    needs w known values. Slots that were monitored but hold no mention are null as well
    and are filled like missing ones.
    """
    w = int(24 / hours) - 1
    o = (w - 1) // 2
    frame = Window.orderBy(order).rowsBetween(-(w - o), o)
    flat = df.withColumn("_flat", F.try_divide(F.col(value), F.col(season)))
    mean = F.when(F.count("_flat").over(frame) >= w, F.avg("_flat").over(frame))
    smooth = interpolate_linear(flat.withColumn("_mean", mean), order, "_mean", "_smooth")
    filled = F.coalesce(F.col(value), F.col("_smooth") * F.col(season))
    return smooth.withColumn(out, filled).drop("_flat", "_mean", "_smooth")


def rolling_mean(df: DataFrame, order: str, value: str, n: int, out: str) -> DataFrame:
    """Trailing mean of ``n`` slots, nulls counted as 0; the first n - 1 slots stay null."""
    frame = Window.orderBy(order).rowsBetween(-(n - 1), 0)
    mean = F.avg(F.coalesce(F.col(value), F.lit(0.0))).over(frame)
    return df.withColumn(out, F.when(F.count(F.lit(1)).over(frame) == n, mean))


def agg_period(series: DataFrame, ts: str, value: str, hours: float) -> DataFrame:
    """Sums in bins closed and labelled on the right, starting at midnight of the first day.

    Bins without rows give 0.
    """
    minutes = int(hours * 60)
    first = series.agg(F.date_trunc("day", F.min(ts)).alias("o"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    origin = first.select("o").scalar()
    gap = F.timestamp_diff("MICROSECOND", origin, F.col(ts))
    width = minutes * 60_000_000
    k = F.ceil(gap / F.lit(width)).cast("bigint")
    sums = series.select(k.alias("_k"), F.col(value)).groupBy("_k").agg(F.sum(value).alias("_v"))
    gap_of = lambda c: F.ceil(F.timestamp_diff("MICROSECOND", F.col("o"), F.col(c)) / F.lit(width)).cast("bigint")
    grid = first.where(F.col("lo").isNotNull()).select("o", F.explode(F.sequence(gap_of("lo"), gap_of("hi"))).alias("_k"))
    label = F.timestamp_add("MINUTE", (F.col("_k") * minutes).cast("int"), F.col("o"))
    return grid.join(sums, "_k", "left").select(label.alias(ts), F.coalesce("_v", F.lit(0.0)).alias(value))


def top_k(df: DataFrame, by: Sequence[Column], k: int) -> DataFrame:
    """The k first rows in the given order; add an id to the order to settle ties."""
    return df.orderBy(*by).limit(k)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key in the given order."""
    return top_per_group(df, keys, order, 1)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row of each key; reduced before the shuffle, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, "_b.*").select(*df.columns)


def reverse_cumulative(df: DataFrame, threshold: str, density: str, fraction: str) -> DataFrame:
    """Sums of density and of density x fraction from each threshold of a score grid upward."""
    asc = Window.orderBy(threshold)
    step = F.lead(threshold).over(asc) - F.col(threshold)
    with_step = df.withColumn("_dt", step)
    with_step = with_step.withColumn("_dt", F.coalesce("_dt", F.lag("_dt").over(asc)))
    down = Window.orderBy(F.col(threshold).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return with_step.select(
        *df.columns,
        F.sum(F.col(density) * F.col(fraction) * F.col("_dt")).over(down).alias("true_positives"),
        F.sum(F.col(density) * F.col("_dt")).over(down).alias("predicted_positives"),
    )


def reverse_cumsum_precision(df: DataFrame, threshold: str, density: str, fraction: str) -> DataFrame:
    cum = reverse_cumulative(df, threshold, density, fraction)
    return cum.select(threshold, F.try_divide("true_positives", "predicted_positives").alias("precision"))


def reverse_cumsum_recall(df: DataFrame, threshold: str, density: str, fraction: str) -> DataFrame:
    cum = reverse_cumulative(df, threshold, density, fraction)
    every = F.max("true_positives").over(Window.partitionBy())
    return cum.select(threshold, F.try_divide(F.col("true_positives"), every).alias("recall"))


# Savitzky-Golay window 7, cubic. Interior weights, then the least-squares
# cubic through the first seven points evaluated at points 0, 1 and 2.
SG_INTERIOR = (-2, 3, 6, 7, 6, 3, -2)
SG_INTERIOR_DIV = 21
SG_EDGE = ((39, 8, -4, -4, 1, 4, -2), (8, 19, 16, 6, -4, -7, 4), (-4, 16, 19, 12, 2, -4, 1))
SG_EDGE_DIV = 42


def savgol_density(df: DataFrame, score: str, bins: int = 199) -> DataFrame:
    """Smoothed density of a score in [0, 1] on ``bins`` equal bins (last bin closed)."""
    k = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(score).between(0, 1)).groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = grid.join(counts, "bin", "left").select("bin", F.coalesce("_n", F.lit(0)).alias("n"))
    w = Window.orderBy("bin")
    near = {d: F.coalesce(F.lag("n", -d).over(w), F.lit(0)) if d else F.col("n") for d in range(-6, 7)}
    interior = sum((near[d] * c for d, c in zip(range(-3, 4), SG_INTERIOR)), F.lit(0)) / F.lit(float(SG_INTERIOR_DIV))
    smooth = interior
    for pos, weights in enumerate(SG_EDGE):
        head = sum((near[i - pos] * c for i, c in enumerate(weights)), F.lit(0)) / F.lit(float(SG_EDGE_DIV))
        tail = sum((near[pos - i] * c for i, c in enumerate(weights)), F.lit(0)) / F.lit(float(SG_EDGE_DIV))
        smooth = F.when(F.col("bin") == pos, head).when(F.col("bin") == bins - 1 - pos, tail).otherwise(smooth)
    shaped = full.withColumn("smooth", smooth)
    mass = F.sum("n").over(Window.partitionBy())
    return shaped.select(
        "bin", (F.col("bin") / F.lit(float(bins))).alias("score"), "n",
        F.try_divide(F.col("smooth"), mass / F.lit(float(bins))).alias("density"),
    )


def value_weights(df: DataFrame, column: str) -> DataFrame:
    """Frequency and inverse frequency of each value of a column."""
    n = F.count(F.lit(1))
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(n.alias(f"n_{column}"), (1.0 / n).alias(f"w_{column}"))


def with_group_count(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Rows with the size of their group: counted first, then joined back.

    Counting pre-aggregates in every task, and the join may split a hot key, which a
    window over the key could not.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    cond = None
    for k in keys:
        eq = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        cond = eq if cond is None else cond & eq
    return df.alias("l").join(counts.alias("r"), cond).select("l.*", f"r.{out}")


def clipped_target_weight(df: DataFrame, target: str, floor: int = 20) -> DataFrame:
    """Weight 1 / max(floor, mentions of the target)."""
    counted = with_group_count(df, [target], "n_target")
    return counted.withColumn("target_weight", 1.0 / F.greatest(F.col("n_target"), F.lit(floor)))


def owner_weight(df: DataFrame, owner: str) -> DataFrame:
    """Weight 1 / rows of the same owner, so that owners are equally likely."""
    return with_group_count(df, [owner], "n_owned").withColumn("sample_weight", 1.0 / F.col("n_owned"))


def sequence_check(df: DataFrame, key: str, number: str) -> DataFrame:
    """Per key: highest number, count, and whether numbering has no holes."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(number).cast("bigint").alias("highest"), F.count(number).alias("n"))
    return g.withColumn("complete", (F.col("highest") == F.col("n")).cast("int"))


def date_range(bounds: DataFrame, first: str, last: str, freq: str = "day") -> DataFrame:
    """Days, or first days of months, inside the closed interval of a one-row table."""
    if freq == "day":
        return bounds.select(F.explode(F.sequence(F.col(first), F.col(last), F.expr("INTERVAL 1 DAY"))).alias("day"))
    start = F.when(F.col(first) == F.trunc(first, "month"), F.col(first)).otherwise(
        F.add_months(F.trunc(first, "month"), 1)
    )
    inside = bounds.select(start.alias("_s"), F.col(last).alias("_l")).where(F.col("_s") <= F.col("_l"))
    return inside.select(F.explode(F.sequence("_s", "_l", F.expr("INTERVAL 1 MONTH"))).alias("day"))


def days_from(bounds: DataFrame, first: str, n: int) -> DataFrame:
    """``n`` days starting at ``first``."""
    return bounds.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_i"), first).select(
        F.date_add(F.col(first), F.col("_i")).alias("day")
    )


def batch_slot(ts: Column, ref: str, hours: float) -> Column:
    """Smallest ``ref + k * hours`` (k >= 0) that is not before ``ts``."""
    seconds = int(hours * 3600)
    origin = F.lit(ref).cast("timestamp_ntz")
    k = F.greatest(F.ceil(F.timestamp_diff("MICROSECOND", origin, ts) / F.lit(seconds * 1_000_000)), F.lit(0))
    return F.timestamp_add("SECOND", (k * seconds).cast("int"), origin)
