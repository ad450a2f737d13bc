"""Binomial posteriors on grids, calibration of scores and their summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.operators.bins import bin_prob
from tallyhouse.operators.ranking import running_sums


def triangular_pdf(x: Column, mode: Column) -> Column:
    """Density on [0, 1] of the triangular distribution with the given mode."""
    return (
        F.when(mode == 0, 2 - 2 * x)
        .when(x < mode, F.try_divide(2 * x, mode))
        .when(mode != 1, F.try_divide(2 * (1 - x), 1 - mode))
        .otherwise(2 * x)
    )


def binomial_log_kernel(p: Column, n: Column, k: Column) -> Column:
    """Logarithm of p^k (1-p)^(n-k), null where it is zero or p is no probability.

    The binomial coefficient does not depend on p and cancels on normalising.
    """
    yes = F.when(k == 0, 0.0).otherwise(k * F.ln(F.when(p > 0, p)))
    no = F.when(n == k, 0.0).otherwise((n - k) * F.ln(F.when(p < 1, 1 - p)))
    return F.when((p >= 0) & (p <= 1), yes + no)


def binomial_posterior(groups: DataFrame, keys: Sequence[str], mode: str, n: str, k: str, dp: float = 0.005) -> DataFrame:
    """Posterior density of a success rate on the grid [0, 1), one grid per row of ``groups``.

    A grid has 1/dp points, whatever the number of trials, so it fits one task.
    """
    points = math.ceil(1 / dp - 1e-9)
    grid = groups.select(*keys, mode, n, k, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_i"))
    p = F.col("_i") * F.lit(float(dp))
    w = Window.partitionBy(*keys)
    logs = grid.withColumn("p", p).withColumn("_l", binomial_log_kernel(F.col("p"), F.col(n), F.col(k)))
    raw = F.coalesce(F.exp(F.col("_l") - F.max("_l").over(w)), F.lit(0.0)) * triangular_pdf(F.col("p"), F.col(mode))
    shaped = logs.withColumn("_r", raw)
    return shaped.select(*keys, "p", (F.col("_r") / (F.sum("_r").over(w) * dp)).alias("density"))


def posterior_moments(posterior: DataFrame, keys: Sequence[str], dp: float) -> DataFrame:
    """Mean and standard deviation of each posterior."""
    g = posterior.groupBy(*keys).agg(
        (F.sum(F.col("p") * F.col("density")) * dp).alias("mean"),
        (F.sum(F.col("p") * F.col("p") * F.col("density")) * dp).alias("_sq"),
    )
    return g.select(*keys, "mean", F.sqrt(F.greatest(F.col("_sq") - F.col("mean") ** 2, F.lit(0.0))).alias("deviation"))


def credible_interval(posterior: DataFrame, keys: Sequence[str], dp: float, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Grid points whose cumulative mass is nearest to each limit, the first one on ties."""
    run = Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    cum = posterior.withColumn("_c", F.sum("density").over(run) * dp)
    near = lambda q: F.min(F.struct(F.pow(F.col("_c") - q, F.lit(2.0)), "p"))["p"]
    return cum.groupBy(*keys).agg(near(low).alias("low"), near(high).alias("high"))


def binomial_stats(
    df: DataFrame, by: str, columns: Sequence[str], low: float = 0.05, high: float = 0.95, dp: float = 1e-4
) -> DataFrame:
    """Per group and 0/1 column: trials, successes, frequency and credible interval.

    The prior of a column has its mode at the column's mean over all groups.
    """
    g = df.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("trials"), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"k_{c}") for c in columns]
    )
    means = df.agg(*[F.avg(c).alias(c) for c in columns])
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"k_{c}").alias("successes"), means.select(c).scalar().alias("mode"))
        for c in columns
    ]
    long = g.select(by, "trials", F.explode(F.array(*cells)).alias("c")).select(by, "trials", "c.*")
    post = binomial_posterior(long, [by, "column"], "mode", "trials", "successes", dp)
    limits = credible_interval(post, [by, "column"], dp, low, high)
    return long.drop("mode").withColumn("freq", F.col("successes") / F.col("trials")).join(limits, [by, "column"])


def interval_errors(stats: DataFrame) -> DataFrame:
    """Distances from the frequency to the ends of its interval."""
    return stats.withColumns({"err_low": F.col("freq") - F.col("low"), "err_high": F.col("high") - F.col("freq")})


def score_calibration(df: DataFrame, score: str, label: str, votes: str, width: float = 0.1, dp: float = 1e-4) -> DataFrame:
    """Per score bin: mean score next to the share of items people called positive."""
    rated = df.where(F.col(votes) > 0).withColumn("bin", bin_prob(F.col(score), width))
    means = rated.groupBy("bin").agg(F.avg(score).alias("mean_score"))
    return binomial_stats(rated, "bin", [label], dp=dp).drop("column").join(means, "bin")


# Fixed values of the prior on (intercept, slope).
PRIOR = {"spread": 1.0, "floor": 0.02, "reach": 1.2, "mu": -0.7, "sigma": 0.9, "shift": -1.0}


def calibration_prior(a: Column, b: Column) -> Column:
    """Prior of human share = a + b * score: a near (1 - b)/2, b lognormal below 1."""
    s = PRIOR["spread"] * (PRIOR["reach"] - F.abs(b)) / 2
    centre = F.exp(-F.pow(a - (1 - b) / 2, F.lit(2.0)) / 2 / F.pow(s, F.lit(2.0)))
    near = F.when(s >= PRIOR["floor"], centre).otherwise(0.0)
    m, sd = PRIOR["mu"], PRIOR["sigma"]
    x = -b - PRIOR["shift"] + math.exp(m - sd**2)
    tail = F.exp(-F.pow(F.ln(F.when(x > 0, x)) - m, F.lit(2.0)) / (2 * sd**2)) / (x * sd * math.sqrt(2 * math.pi))
    return near * F.when(x > 0, tail).otherwise(0.0)


def calibration_posterior(
    bins: DataFrame, a: tuple[float, float, float], b: tuple[float, float, float],
    n: str = "trials", k: str = "successes", x: str = "mean_score",
) -> DataFrame:
    """Posterior of (a, b) on a grid of (start, stop, step) each; share of a bin is a + b * x.

    ``bins`` has a row per score bin, a few dozen at most, and travels with the query as
    one array; the grid points are spread over the tasks.
    """
    count = lambda t: math.ceil((t[1] - t[0]) / t[2] - 1e-9)
    na, nb = count(a), count(b)
    rows = bins.agg(F.array_sort(F.collect_list(F.struct(
        F.col(x).cast("double").alias("x"), F.col(n).cast("double").alias("n"), F.col(k).cast("double").alias("k")
    )))).scalar()
    grid = bins.sparkSession.range(na * nb).select(
        (F.lit(a[0]) + F.floor(F.col("id") / nb) * F.lit(a[2])).alias("a"), (F.lit(b[0]) + (F.col("id") % nb) * F.lit(b[2])).alias("b")
    ).withColumn("_bins", rows)
    like = F.aggregate("_bins", F.lit(0.0), lambda acc, r: acc + binomial_log_kernel(F.col("a") + F.col("b") * r["x"], r["n"], r["k"]))
    logs = grid.select("a", "b", like.alias("_l"))
    top = logs.agg(F.max("_l")).scalar()
    raw = logs.select("a", "b", (F.coalesce(F.exp(F.col("_l") - top), F.lit(0.0)) * calibration_prior(F.col("a"), F.col("b"))).alias("_r"))
    mass = raw.agg(F.sum("_r")).scalar()
    return raw.select("a", "b", (F.col("_r") / (mass * a[2] * b[2])).alias("density"))


def posterior_mode(posterior: DataFrame) -> DataFrame:
    """Grid point of highest density, the first in grid order on ties."""
    best = posterior.agg(F.max(F.struct("density", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))).alias("m"))
    return best.select((-F.col("m.na")).alias("a"), (-F.col("m.nb")).alias("b"), F.col("m.density").alias("density"))


def hpd_levels(posterior: DataFrame, cell: float, masses: Sequence[float] = (0.95, 0.68)) -> DataFrame:
    """Density levels whose enclosed mass is closest to each wanted mass; equal densities go together."""
    levels = posterior.groupBy("density").agg((F.sum("density") * cell).alias("_m"))
    cum = running_sums(levels, "density", {"enclosed": "_m"}, descending=True)
    pick = lambda q: F.min(F.struct(F.pow(F.col("enclosed") - q, F.lit(2.0)), (-F.col("density")).alias("d")))["d"]
    row = cum.agg(*[(-pick(q)).alias(f"l{i}") for i, q in enumerate(masses)])
    cells = [F.struct(F.lit(float(q)).alias("mass"), F.col(f"l{i}").alias("level")) for i, q in enumerate(masses)]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
