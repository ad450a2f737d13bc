"""Permutation tests, two-sample comparison and count estimators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.hashing import uniform
from tallyhouse.operators.metrics import binary_metrics
from tallyhouse.operators.ranking import rank_by_uniform, running_sums
from tallyhouse.operators.sampling import sample_fixed_proportion, shuffle_columns


def frac_by_categories(df: DataFrame, dims: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of rows in each cell, within each group ``by``; cells with a null are left out."""
    counts = df.groupBy(*by, *dims).agg(F.count(F.lit(1)).alias("_n"))
    known = counts.dropna(subset=list(dims))
    if by:
        totals = counts.groupBy(*by).agg(F.sum("_n").alias("_t"))
        return known.join(totals, list(by)).select(*by, *dims, (F.col("_n") / F.col("_t")).alias("share"))
    total = counts.agg(F.sum("_n")).scalar()
    return known.select(*dims, (F.col("_n") / total).alias("share"))


Statistic = Callable[[DataFrame, Sequence[str]], DataFrame]


def permutation_distribution(
    df: DataFrame, dims: Sequence[str], key: str, replicas: int, seed: int | str, stat: Statistic | None = None
) -> DataFrame:
    """A statistic on ``replicas`` tables whose columns were shuffled independently.

    ``stat(table, by)`` returns rows per group ``by``; cell shares by default. Only the
    permuted columns are copied per replica.
    """
    shuffled = shuffle_columns(df, dims, key, seed, replicas).drop("position")
    if stat is None:
        return frac_by_categories(shuffled, dims, ["replica"])
    return stat(shuffled, ["replica"])


def permutation_correlation(df: DataFrame, a: str, b: str, key: str, replicas: int, seed: int | str) -> DataFrame:
    """Correlation of two columns after shuffling one against the other (without replacement)."""
    corr = lambda t, by: t.groupBy(*by).agg(F.corr(a, b).alias("corr"))
    return permutation_distribution(df, [a, b], key, replicas, seed, corr)


def p_value(trials: DataFrame, column: str, observed: Column | float) -> DataFrame:
    """Share of trials strictly above the observed value."""
    t = F.lit(observed) if isinstance(observed, (int, float)) else observed
    return trials.agg(F.avg((F.col(column) > t).cast("double")).alias("p_value"), F.count(column).alias("n_trials"))


def ks_two_sample(df: DataFrame, value: str, side: str, first, second) -> DataFrame:
    """Largest gap between the distributions of two samples, with its asymptotic p-value.

    Samples are reduced to counts per distinct value before being put in order.
    """
    both = df.where(F.col(side).isin(first, second) & F.col(value).isNotNull())
    counts = both.groupBy(value).agg(
        F.count(F.when(F.col(side) == first, 1)).alias("_a"), F.count(F.when(F.col(side) == second, 1)).alias("_b")
    )
    run = running_sums(counts, value, {"_ca": "_a", "_cb": "_b"})
    g = run.agg(F.sum("_a").cast("double").alias("n1"), F.sum("_b").cast("double").alias("n2"))
    n1, n2 = g.select("n1").scalar(), g.select("n2").scalar()
    d = run.agg(F.max(F.abs(F.col("_ca") / n1 - F.col("_cb") / n2)).alias("statistic"), F.max(n1).alias("n1"), F.max(n2).alias("n2"))
    t2 = F.col("statistic") ** 2 * F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2"))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * t2),
    )
    return d.select("statistic", F.least(F.greatest(F.when(t2 > 0.04, series).otherwise(1.0), F.lit(0.0)), F.lit(1.0)).alias("p_value"))


def count_estimators(df: DataFrame, truth: str, prob: str, key: str, batches: int, seed: int | str) -> DataFrame:
    """Bias and deviation of two counts of positives: sum of probabilities and number above 0.5.

    Rows are cut into equal random batches; the remainder of the division is left out.
    """
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = rank_by_uniform(df.select(key, truth, prob), uniform(seed, key), [key], name="_r")
    ranked = ranked.withColumn("_size", F.floor(n / batches)).withColumn("_batch", F.floor((F.col("_r") - 1) / F.col("_size")))
    g = ranked.where(F.col("_batch") < batches).groupBy("_batch").agg(
        F.sum(truth).alias("_t"), F.sum(prob).alias("_p"), F.count(F.when(F.col(prob) > 0.5, 1)).alias("_c")
    )
    row = g.select((F.col("_p") - F.col("_t")).alias("p"), (F.col("_c") - F.col("_t")).cast("double").alias("c"))
    row = row.agg(F.avg("p").alias("bp"), F.stddev_pop("p").alias("dp"), F.avg("c").alias("bc"), F.stddev_pop("c").alias("dc"))
    return row.select(F.explode(F.array(
        F.struct(F.lit("probabilities").alias("estimator"), F.col("bp").alias("bias"), F.col("dp").alias("deviation")),
        F.struct(F.lit("predictions").alias("estimator"), F.col("bc").alias("bias"), F.col("dc").alias("deviation")),
    )).alias("c")).select("c.*")


def resampled_scores(
    df: DataFrame, truth: str, prob: str, key: str, fraction: float, replicas: int, seed: int | str, threshold: float = 0.5,
    scorer: Callable[[DataFrame, str, str, Sequence[str]], DataFrame] = binary_metrics,
) -> DataFrame:
    """A metric on ``replicas`` samples in which positives make up ``fraction``."""
    sample = sample_fixed_proportion(df.select(key, truth, prob), truth, key, fraction, seed, replicas)
    judged = sample.withColumn("_pred", (F.col(prob) > threshold).cast("int"))
    return scorer(judged, truth, "_pred", ["replica"])
