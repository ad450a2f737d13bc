"""Quality of binary predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.hashing import uniform
from tallyhouse.operators.ranking import running_sums


def _cells(truth: str, pred: str) -> list[Column]:
    n = lambda t, p: F.count(F.when((F.col(truth) == t) & (F.col(pred) == p), 1)).cast("double")
    return [n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn")]


def binary_metrics(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1; a ratio over nothing is 0."""
    g = df.groupBy(*by).agg(*_cells(truth, pred))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return g.select(
        *by, safe(tp + tn, tp + fp + fn + tn).alias("accuracy"), safe(tp, tp + fp).alias("precision"),
        safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def geomean_hit_rate(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Square root of the hit rates of both classes multiplied; values other than 0 and 1 fail."""
    ok = F.coalesce(F.col(truth).isin(0, 1) & F.col(pred).isin(0, 1), F.lit(False))
    rows = df.where(F.assert_true(ok, F.lit("classes must be 0 or 1")).isNull())
    g = rows.agg(*_cells(truth, pred))
    rate = lambda a, b: F.try_divide(F.col(a), F.col(a) + F.col(b))
    return g.select(F.sqrt(rate("tp", "fn") * rate("tn", "fp")).alias("hit_rate"))


def pr_roc_curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Precision, recall and false positive rate when everything from each score up is called positive."""
    counts = df.groupBy(score).agg(F.count(F.when(F.col(truth) == 1, 1)).alias("_p"), F.count(F.when(F.col(truth) == 0, 1)).alias("_n"))
    run = running_sums(counts, score, {"tp": "_p", "fp": "_n"}, descending=True)
    sums = counts.agg(F.sum("_p").cast("double").alias("p"), F.sum("_n").cast("double").alias("n"))
    return run.select(
        F.col(score).alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide(F.col("tp").cast("double"), sums.select("p").scalar()).alias("recall"),
        F.try_divide(F.col("fp").cast("double"), sums.select("n").scalar()).alias("fpr"),
    )


def mean_pr_curve(df: DataFrame, truth: str, score: str, points: int = 100, by: str = "replica") -> DataFrame:
    """Precision and recall at ``points`` thresholds in [0, 1], interpolated per replica, then averaged.

    Scores fall into cells between the thresholds (and onto them). Sums per cell, with
    its lowest and highest score, are enough for the interpolation, so no replica is
    ever sorted as a whole.
    """
    last = points - 1
    j = F.floor(F.col(score) * last)
    spot = j / F.lit(float(last))
    cell = F.when(F.col(score) == spot, 2 * j).when(F.col(score) < spot, 2 * j - 1).otherwise(2 * j + 1).cast("int")
    pos, neg = F.count(F.when(F.col(truth) == 1, 1)), F.count(F.when(F.col(truth) == 0, 1))
    values = df.groupBy(by, cell.alias("_c"), score).agg(pos.alias("_p"), neg.alias("_n"))
    cells = values.groupBy(by, "_c").agg(
        F.sum("_p").alias("_p"), F.sum("_n").alias("_n"), F.min(score).alias("_lo"), F.max(score).alias("_hi"),
        F.max_by(F.struct(F.col("_p").alias("p"), F.col("_n").alias("n")), F.col(score)).alias("_top"),
    )
    above = Window.partitionBy(by).orderBy(F.col("_c").desc()).rowsBetween(Window.unboundedPreceding, -1)
    up = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    cells = cells.withColumns({"_ap": up("_p"), "_an": up("_n"), "_tot": F.sum("_p").over(Window.partitionBy(by))})

    def at(tp: Column, fp: Column, t: Column) -> Column:
        share = tp / F.col("_tot")
        return F.struct(t.alias("t"), F.try_divide(tp.cast("double"), (tp + fp).cast("double")).alias("p"), share.alias("r"))

    cells = cells.select(
        by, "_c",
        at(F.col("_ap") + F.col("_p"), F.col("_an") + F.col("_n"), F.col("_lo")).alias("_low"),
        at(F.col("_ap") + F.col("_top.p"), F.col("_an") + F.col("_top.n"), F.col("_hi")).alias("_high"),
    )
    grid = cells.select(by).distinct().select(by, F.explode(F.sequence(F.lit(0), F.lit(last))).alias("_x"))
    grid = grid.select(by, (2 * F.col("_x")).alias("_c"), F.col("_x"))
    marks = grid.join(cells, [by, "_c"], "full_outer")
    order = Window.partitionBy(by).orderBy("_c")
    below = F.last("_high", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    over = F.first("_low", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    marks = marks.withColumns({"_a": below, "_b": over}).where("_x IS NOT NULL").withColumn("x", F.col("_x") / F.lit(float(last)))

    def mixed(f: str) -> Column:
        a, b = F.col("_a"), F.col("_b")
        slope = F.try_divide(b[f] - a[f], b["t"] - a["t"])
        return F.when(a.isNull(), b[f]).when(b.isNull(), a[f]).when(a["t"] == b["t"], a[f]).otherwise(a[f] + slope * (F.col("x") - a["t"]))

    per = marks.select("x", mixed("p").alias("_p"), mixed("r").alias("_r"))
    return per.groupBy("x").agg(F.avg("_p").alias("precision"), F.avg("_r").alias("recall"))


def baselines(df: DataFrame, label: str, key: str, folds: int, seed: int | str) -> DataFrame:
    """Accuracy in folds of three blind guesses: the commonest class, any class, classes by frequency.

    Frequencies of a fold come from the other folds. Only class counts per fold are
    looked up, a table of folds x classes.
    """
    rows = df.select(key, F.col(label).alias("_y"), F.floor(uniform(f"{seed}-fold", key) * folds).cast("int").alias("_f"))
    counts = rows.groupBy("_f", "_y").agg(F.count(F.lit(1)).alias("_n"))
    classes = counts.groupBy("_y").agg(F.sum("_n").alias("_t"))
    mode = classes.agg(F.max(F.struct("_t", (-F.col("_y")).alias("_y")))["_y"] * -1).scalar()
    every = classes.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    held = every.join(counts, ["_f", "_y"], "left").select("_f", "_y", (F.col("_t") - F.coalesce("_n", F.lit(0))).alias("_w"))
    run = Window.partitionBy("_f").orderBy("_y")
    table = held.withColumn("_cum", F.sum("_w").over(run) / F.sum("_w").over(Window.partitionBy("_f")))
    table = table.groupBy("_f").agg(F.array_sort(F.collect_list(F.struct("_cum", "_y"))).alias("_cums"), F.array_sort(F.collect_list("_y")).alias("_all"))
    u, v = uniform(f"{seed}-any", key), uniform(f"{seed}-freq", key)
    judged = rows.withColumns({"_u": u, "_v": v}).join(table, "_f").select(
        "_f", (F.col("_y") == mode).cast("double").alias("constant"),
        (F.col("_y") == F.get("_all", F.floor(F.col("_u") * F.size("_all")).cast("int"))).cast("double").alias("uniform"),
        (F.col("_y") == F.get(F.filter("_cums", lambda c: c["_cum"] > F.col("_v")), F.lit(0))["_y"]).cast("double").alias("frequency"),
    )
    kinds = ("constant", "uniform", "frequency")
    per = judged.groupBy("_f").agg(*[F.avg(k).alias(k) for k in kinds])
    row = per.agg(*[F.avg(k).alias(f"m_{k}") for k in kinds], *[F.stddev_pop(k).alias(f"d_{k}") for k in kinds])
    cells = [F.struct(F.lit(k).alias("guess"), F.col(f"m_{k}").alias("mean"), F.col(f"d_{k}").alias("deviation")) for k in kinds]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
