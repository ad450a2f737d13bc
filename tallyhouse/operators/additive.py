"""Models whose training data enters only through sums, so that all folds, sizes and parameters share one pass.

Linear regression needs products of columns, a word model the counts of words by class, and a Newton step of a logistic model two
sums. Spark adds these up per fold or step; the training set of a fold is the total less the fold, that of a step all steps up to it. What
reaches the driver has the size of the model, never that of the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.hashing import uniform
from tallyhouse.operators.ranking import rank_by_uniform
from tallyhouse.session import kept_table

SCORES = ("accuracy", "precision", "recall", "f1", "hit_rate")


# ---- linear regression ------------------------------------------------------------------
def _fit(m: np.ndarray, reg: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept from the moments of (1, features, target); the penalty is on standardised columns, as in MLlib."""
    n, means = m[0, 0], m[0, 1:] / m[0, 0]
    centred = m[1:, 1:] / n - np.outer(means, means)
    a, b = centred[:-1, :-1], centred[:-1, -1]
    spread = np.sqrt(centred[-1, -1])
    w = np.linalg.lstsq(a + np.diag(reg * np.diag(a) / spread if spread else np.zeros(len(a))), b, rcond=None)[0]
    return w, means[-1] - w @ means[:-1]


def _squares(m: np.ndarray, w: np.ndarray, c: float) -> float:
    """Sum of squared errors of a model over rows with these moments."""
    v = np.r_[c, w, -1.0]
    return max(float(v @ m @ v), 0.0)


def regression_scores(df: DataFrame, features: Sequence[str], target: str, key: str, folds: int, seed: int | str, reg: float = 0.0) -> DataFrame:
    """RMSE in cross-validation, on the training folds, and with a shuffled target; adjusted R2.

    One aggregate holds the moments of every fold, for the target and for the shuffled one. Rows with a missing feature or target are left out.
    """
    complete = [F.col(c).isNotNull() for c in (*features, target)]
    rows = df
    for c in complete:
        rows = rows.where(c)
    names = [f"_x{i}" for i in range(len(features))]
    plain = rows.select(F.col(key).alias("_k"), F.floor(uniform(seed, key) * folds).cast("int").alias("_f"),
                        *[F.col(c).cast("double").alias(n) for c, n in zip(features, names)], F.col(target).cast("double").alias("_y"))
    ranked = rank_by_uniform(plain, uniform(f"{seed}-a", "_k"), ["_k"], name="_p")
    other = rank_by_uniform(plain.select("_k", F.col("_y").alias("_z")), uniform(f"{seed}-b", "_k"), ["_k"], name="_p")
    both = ranked.join(other.select("_p", "_z"), "_p")
    # Taken around the means, so that products lose no digits.
    means = plain.agg(*[F.avg(c).alias(c) for c in (*names, "_y")]).first().asDict()
    if means["_y"] is None:
        return df.sparkSession.createDataFrame([], "score STRING, mean DOUBLE, deviation DOUBLE")
    at = lambda c: F.col(c) - F.lit(means["_y" if c == "_z" else c])
    columns = ["1", *names, "_y", "_z"]
    value = {"1": F.lit(1.0), **{c: at(c) for c in columns[1:]}}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = both.groupBy("_f").agg(*[F.sum(value[a] * value[b]).alias(f"{a}*{b}") for a, b in pairs]).orderBy("_f").collect()
    cube = np.zeros((len(sums), len(columns), len(columns)))
    for f, row in enumerate(sums):
        for a, b in pairs:
            i, j = columns.index(a), columns.index(b)
            cube[f, i, j] = cube[f, j, i] = row[f"{a}*{b}"]
    p, out = len(features), []
    for kind, last in (("real", p + 1), ("shuffled", p + 2)):
        keep = [*range(p + 1), last]
        m = cube[:, keep][:, :, keep]
        total, test, train = m.sum(axis=0), [], []
        for part in m:
            rest = total - part
            if rest[0, 0] <= 0:
                continue
            model = _fit(rest, reg)
            test.append((_squares(part, *model) / part[0, 0]) ** 0.5)
            train.append((_squares(rest, *model) / rest[0, 0]) ** 0.5)
        if kind == "real":
            n, free = total[0, 0], total[0, 0] - p - 1
            spread = total[-1, -1] - total[0, -1] ** 2 / n
            if free > 0 and spread > 0:
                out.append(("adjusted_r2", float(1 - _squares(total, *_fit(total, reg)) / spread * (n - 1) / free), 0.0))
            out.append(("train", *_mean_dev(train)))
        out.append(("cross_validation" if kind == "real" else "shuffled_target", *_mean_dev(test)))
    return df.sparkSession.createDataFrame(out, "score STRING, mean DOUBLE, deviation DOUBLE")


def _mean_dev(values: Sequence[float]) -> tuple[float, float]:
    return float(np.mean(values)) if len(values) else float("nan"), float(np.std(values)) if len(values) else float("nan")


# ---- multinomial Bayes on words ---------------------------------------------------------
def bayes_weights(counts: DataFrame, docs: DataFrame, key: str, label: str, trained: Sequence[Column], alphas: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """Log-odds of class 1 per word for many training sets and smoothings at once.

    ``counts`` is (key, token, n). ``trained`` are conditions on rows of ``docs``, one per training set. The first result is (token, ``w``) with the
    log-odds of training set v and smoothing a at v * len(alphas) + a, 0 where the set does not hold the word; the second is one row with the
    log-odds ``prior`` of the classes in the same order.
    """
    y = F.col(label).cast("int")
    marks = [F.when(c, y).alias(f"_t{v}") for v, c in enumerate(trained)]
    given = docs.select(key, *marks)
    sums = [F.coalesce(F.sum(F.when(F.col(f"_t{v}") == c, F.col("n"))), F.lit(0)).alias(f"_c{v}_{c}") for v in range(len(trained)) for c in (0, 1)]
    words = counts.join(given, key).groupBy("token").agg(*sums)
    per_set = []
    for v in range(len(trained)):
        a, b = F.col(f"_c{v}_0"), F.col(f"_c{v}_1")
        per_set += [F.sum(a).cast("double").alias(f"_s{v}_0"), F.sum(b).cast("double").alias(f"_s{v}_1"), F.count(F.when(a + b > 0, 1)).alias(f"_v{v}")]
    totals = words.agg(*per_set)
    one = words.withColumn("_s", totals.select(F.struct(*totals.columns)).scalar())
    odds = []
    for v in range(len(trained)):
        a, b, s = F.col(f"_c{v}_0"), F.col(f"_c{v}_1"), F.col("_s")
        for alpha in alphas:
            smooth = F.lit(float(alpha))
            share = lambda n, total: F.ln((n + smooth) / (total + smooth * s[f"_v{v}"]))  # noqa: B023, E731
            odds.append(F.when(a + b > 0, share(b, s[f"_s{v}_1"]) - share(a, s[f"_s{v}_0"])).otherwise(0.0))
    sizes = [F.count(F.when(F.col(f"_t{v}") == c, 1)).alias(f"_d{v}_{c}") for v in range(len(trained)) for c in (0, 1)]
    prior = [F.ln((F.col(f"_d{v}_1") + F.lit(float(alpha))) / (F.col(f"_d{v}_0") + F.lit(float(alpha)))) for v in range(len(trained)) for alpha in alphas]
    return one.select("token", F.array(*odds).alias("w")), given.agg(*sizes).select(F.array(*prior).alias("prior"))


def _odds(counts: DataFrame, docs: DataFrame, key: str, weights: DataFrame, prior: DataFrame, places: Sequence[Column]) -> DataFrame:
    """Rows of ``docs`` with ``_o``: log-odds of class 1 under the models at the given (0-based) places, which may differ by row."""
    wanted = docs.withColumn("_at", F.array(*[p.cast("int") for p in places]))
    hits = counts.join(wanted.select(key, "_at"), key).join(weights, "token")
    sums = hits.groupBy(key).agg(*[F.sum(F.col("n") * F.get(F.col("w"), F.col("_at")[i])).alias(f"_g{i}") for i in range(len(places))])
    start = prior.select("prior").scalar()
    joined = wanted.join(sums, key, "left").withColumn("_prior", start)
    gaps = [F.coalesce(F.col(f"_g{i}"), F.lit(0.0)) + F.get(F.col("_prior"), F.col("_at")[i]) for i in range(len(places))]
    return joined.select(*docs.columns, F.array(*gaps).alias("_o"))


def bayes_predictions(counts: DataFrame, docs: DataFrame, key: str, label: str, trained: Column, alpha: float = 1.0) -> DataFrame:
    """Class of every row of ``docs`` under a word model of its rows that meet ``trained``; ``odds`` are the log-odds of class 1."""
    weights, prior = bayes_weights(counts, docs, key, label, [trained], [alpha])
    odds = _odds(counts, docs, key, weights, prior, [F.lit(0)])
    return odds.select(*docs.columns, F.col("_o")[0].alias("odds"), (F.col("_o")[0] > 0).cast("int").alias("prediction"))


def bayes_learning_curve(counts: DataFrame, docs: DataFrame, key: str, label: str, validation: Column, steps: int, seed: int | str, alpha: float = 1.0) -> DataFrame:
    """Accuracy on training and validation rows for growing nested training sets: step, n_train, train, validation.

    A row belongs to the sets from its own step on, so one aggregate of words by step and class gives every model.
    """
    marked = docs.select(key, label, validation.alias("_late"), F.greatest(F.ceil(uniform(seed, key) * steps), F.lit(1)).cast("int").alias("_step"))
    inside = [~F.col("_late") & (F.col("_step") <= i) for i in range(1, steps + 1)]
    weights, prior = bayes_weights(counts, marked, key, label, inside, [alpha])
    judged = _odds(counts, marked, key, weights, prior, [F.lit(i) for i in range(steps)])
    right = [((F.col("_o")[i] > 0).cast("int") == F.col(label)).cast("double") for i in range(steps)]
    found = judged.agg(*[F.struct(F.lit(i + 1).alias("step"), F.count(F.when(inside[i], 1)).alias("n_train"), F.avg(F.when(inside[i], right[i])).alias("train"),
                                  F.avg(F.when(F.col("_late"), right[i])).alias("validation")).alias(f"s{i}") for i in range(steps)])
    return found.select(F.explode(F.array(*found.columns)).alias("s")).select("s.*")


def bayes_cv_scores(counts: DataFrame, docs: DataFrame, key: str, label: str, alphas: Sequence[float], folds: int, seed: int | str) -> DataFrame:
    """Several scores of each smoothing over the same folds: alpha, score, mean, deviation and deviation of the mean.

    Scores are accuracy, precision, recall, F1 and the geometric mean of both hit rates. A fold in which a score has no denominator does not count.
    """
    marked = docs.select(key, label, F.floor(uniform(seed, key) * folds).cast("int").alias("_fold"))
    weights, prior = bayes_weights(counts, marked, key, label, [F.col("_fold") != f for f in range(folds)], alphas)
    judged = _odds(counts, marked, key, weights, prior, [F.col("_fold") * len(alphas) + a for a in range(len(alphas))])
    each = judged.select("_fold", F.col(label).alias("_y"), F.posexplode("_o").alias("_a", "_odds")).withColumn("_p", (F.col("_odds") > 0).cast("int"))
    n = lambda y, p: F.count(F.when((F.col("_y") == y) & (F.col("_p") == p), 1)).cast("double")
    cells = each.groupBy("_a", "_fold").agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    score = {
        "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn), "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn),
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn), "hit_rate": F.sqrt(F.try_divide(tp, tp + fn) * F.try_divide(tn, tn + fp)),
    }
    long = cells.select("_a", F.explode(F.array(*[F.struct(F.lit(s).alias("score"), score[s].alias("v")) for s in SCORES])).alias("s")).select("_a", "s.*")
    alpha = F.element_at(F.array(*[F.lit(float(a)) for a in alphas]), F.col("_a") + 1)
    deviation = F.stddev_pop("v")
    found = long.groupBy("_a", "score").agg(F.avg("v").alias("mean"), deviation.alias("deviation"), (deviation / F.sqrt(F.count("v"))).alias("mean_deviation"))
    return found.select(alpha.alias("alpha"), "score", "mean", "deviation", "mean_deviation")


# ---- ridge logistic regression ----------------------------------------------------------
def _newton_sums(rows: DataFrame, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-loss, gradient and Hessian of a logistic model over all rows, from one aggregate of the sums of each task."""
    size = len(w)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 + size + size * size)
        for pdf in batches:
            x = np.c_[np.ones(len(pdf)), np.stack(pdf["_x"].to_numpy())] if len(pdf) else np.zeros((0, size))
            y, z = pdf["_y"].to_numpy(dtype=float), x @ w
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            total[0] += (np.logaddexp(0, z) - y * z).sum()
            total[1:1 + size] += x.T @ (p - y)
            total[1 + size:] += ((x * (p * (1 - p))[:, None]).T @ x).ravel()
        yield pd.DataFrame({"cell": np.arange(len(total)), "value": total})

    found = np.zeros(1 + size + size * size)
    for cell, value in rows.mapInPandas(part, "cell int, value double").groupBy("cell").agg(F.sum("value")).collect():  # size of the model
        found[cell] = value
    return float(found[0]), found[1:1 + size], found[1 + size:].reshape(size, size)


def ridge_logistic(df: DataFrame, features: Column, target: Column, c: float, tolerance: float = 1e-10, most: int = 100) -> np.ndarray:
    """Intercept and coefficients that minimise |w|^2 / 2 + C * log-loss (the intercept is free), by Newton steps.

    ``features`` is an array of doubles without missing values. Each step is one aggregate; a step that does not lower the loss is halved.
    """
    rows = kept_table(df.select(features.alias("_x"), target.cast("double").alias("_y")), "features")
    size = rows.agg(F.max(F.size("_x"))).first()[0]
    if size is None:
        raise ValueError("no rows to fit a model to")
    w, penalty = np.zeros(size + 1), np.r_[0.0, np.ones(size)]

    def at(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, gradient, hessian = _newton_sums(rows, v)
        return c * loss + (penalty * v * v).sum() / 2, c * gradient + penalty * v, c * hessian + np.diag(penalty)

    loss, gradient, hessian = at(w)
    for _ in range(most):
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        if np.abs(step).max() <= tolerance * max(1.0, np.abs(w).max()):
            return w - step
        for _ in range(40):
            new = at(w - step)
            if new[0] <= loss + 1e-12 * abs(loss):
                break
            step = step / 2
        w, (loss, gradient, hessian) = w - step, new
    raise ArithmeticError("the logistic model does not converge")


def platform_usage_model(df: DataFrame, target: str, categories: Sequence[str], ordered: Mapping[str, Sequence[str]], numbers: Sequence[str],
                         logs: Sequence[str], c: float = 0.1) -> DataFrame:
    """Logistic model of platform use with penalty C; coefficients from most negative to most positive.

    Categories are one-hot without their first level, ordered levels count from 0, numbers are standardised with the population deviation, and so
    are logarithms of 1 + value, after missing ones became the mean. A missing category, level, number or target is an error.
    """
    need = lambda col, name: F.when(col.isNull(), F.raise_error(F.lit(f"missing or unknown value in {name}"))).otherwise(col)
    levels = {g: sorted(r[0] for r in df.where(F.col(g).isNotNull()).select(F.col(g).cast("string")).distinct().collect()) for g in categories}
    columns, names = [], []
    for g in categories:
        for level in levels[g][1:]:
            columns.append((need(F.col(g).cast("string"), g) == level).cast("double"))
            names.append(f"{g}_{level}")
    for g, order in ordered.items():
        place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(g)) - 1
        columns.append(need(F.when(place >= 0, place), g).cast("double"))
        names.append(g)
    values = {n: need(F.col(n).cast("double"), n) for n in numbers} | {n: F.log10(F.col(n).cast("double") + 1) for n in logs}
    average = df.agg(*[F.avg(v).alias(n) for n, v in values.items()]).first().asDict()
    filled = {n: F.coalesce(v, F.lit(average[n])) if n in logs else v for n, v in values.items()}
    spread = df.agg(*[F.stddev_pop(v).alias(n) for n, v in filled.items()]).first().asDict()
    columns += [(v - F.lit(average[n])) / F.lit(spread[n] or 1.0) for n, v in filled.items()]
    names += list(filled)
    w = ridge_logistic(df, F.array(*columns), need(F.col(target).cast("double"), target), c)
    return df.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(names, w[1:])], "feature STRING, coefficient DOUBLE").orderBy("coefficient", "feature")
