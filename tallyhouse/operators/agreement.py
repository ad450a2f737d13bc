"""Votes of raters: counts, majority, agreement and bias."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.hashing import uniform
from tallyhouse.operators.ranking import rank_by_uniform


def count_class_votes(votes: DataFrame, item: str = "id", value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Votes per class of each item; missing votes do not count."""
    return votes.where(F.col(value).isNotNull()).groupBy(*by, item, value).agg(F.count(F.lit(1)).alias("n"))


def fleiss_kappa(counts: DataFrame, item: str = "id", value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Fleiss' kappa of class votes (item, class, n), per group ``by``.

    Every item must have the same number of votes.
    """
    keyed = counts.withColumn("_k", F.lit(0))
    by = [*by, "_k"]
    items = keyed.groupBy(*by, item).agg(F.sum("n").alias("_m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("_s"))
    m = F.col("_m").cast("double")
    agreed = items.groupBy(*by).agg(
        F.min("_m").alias("_lo"), F.max("_m").alias("_hi"), F.count(F.lit(1)).alias("n_items"),
        F.avg(F.try_divide(F.col("_s").cast("double"), m * (m - 1))).alias("_p"),
    )
    same = F.assert_true(F.col("_lo") == F.col("_hi"), F.lit("items differ in their number of votes"))
    classes = keyed.groupBy(*by, value).agg(F.sum("n").cast("double").alias("_t")).groupBy(*by).agg(
        (F.sum(F.col("_t") * F.col("_t")) / F.pow(F.sum("_t"), F.lit(2.0))).alias("_e")
    )
    joined = agreed.where(same.isNull()).join(classes, by)
    return joined.select(
        *by[:-1], "n_items", F.col("_hi").alias("n_votes"), F.try_divide(F.col("_p") - F.col("_e"), 1 - F.col("_e")).alias("kappa")
    )


def kappa_report(votes: DataFrame, least: int, replicas: int, seed: int | str) -> DataFrame:
    """Kappa of the raters with more than ``least`` votes, and of votes shuffled per rater.

    Only items rated by all those raters count. Row ``replica`` = -1 is the real kappa.
    Shuffling gives each rater's votes new item numbers, so replicas need no join.
    """
    given = votes.where("value IS NOT NULL")
    raters = given.groupBy("annotator").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > least)
    k = raters.agg(F.count(F.lit(1)).alias("k")).scalar()
    kept = given.join(raters.select("annotator"), "annotator", "left_semi")
    full = kept.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == k)
    complete = kept.join(full.select("id"), "id", "left_semi").select("id", "annotator", "value")
    real = complete.withColumn("replica", F.lit(-1))
    many = complete.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    moved = rank_by_uniform(many, uniform(seed, "replica", "annotator", "id"), ["id"], ["replica", "annotator"], "position")
    shuffled = moved.select(F.col("position").cast("bigint").alias("id"), "annotator", "value", "replica")
    everything = real.select("id", "annotator", "value", "replica").unionByName(shuffled)
    return fleiss_kappa(count_class_votes(everything, by=["replica"]), by=["replica"])


def confusion_matrix(df: DataFrame, a: str, b: str, normalize: str | None = None, classes: Sequence = (0, 1)) -> DataFrame:
    """Counts, or shares with ``normalize="all"``, of class pairs over complete rows."""
    cells = [(x, y) for x in classes for y in classes]
    row = df.agg(*[F.count(F.when((F.col(a) == x) & (F.col(b) == y), 1)).alias(f"c{i}") for i, (x, y) in enumerate(cells)])
    long = row.select(F.explode(F.array(*[
        F.struct(F.lit(x).alias("actual"), F.lit(y).alias("predicted"), F.col(f"c{i}").alias("n")) for i, (x, y) in enumerate(cells)
    ])).alias("c"), sum((F.col(f"c{i}") for i in range(len(cells))), F.lit(0)).cast("double").alias("_t"))
    n = F.try_divide(F.col("c.n").cast("double"), F.col("_t")) if normalize == "all" else F.col("c.n")
    return long.select("c.actual", "c.predicted", n.alias("n"))


def rater_bias_sigma(votes: DataFrame, control: str, raters: Sequence[str]) -> DataFrame:
    """How far each rater leans to yes (+) or no (-) against the control, in standard deviations.

    (n01 - n10) / sqrt(n01 + n10) on counts; shares in their place would not be in units
    of the deviation.
    """
    others = [x for x in raters if x != control]
    wide = votes.groupBy("id").agg(
        F.max(F.when(F.col("annotator") == control, F.col("value"))).alias("_c"),
        *[F.max(F.when(F.col("annotator") == x, F.col("value"))).alias(f"v{i}") for i, x in enumerate(others)],
    )
    aggs, cells = [], []
    for i, x in enumerate(others):
        aggs += [
            F.count(F.when((F.col("_c") == 0) & (F.col(f"v{i}") == 1), 1)).alias(f"u{i}"),
            F.count(F.when((F.col("_c") == 1) & (F.col(f"v{i}") == 0), 1)).alias(f"d{i}"),
        ]
        cells.append(F.struct(F.lit(x).alias("annotator"), F.col(f"u{i}").alias("n01"), F.col(f"d{i}").alias("n10")))
    flat = wide.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    sigma = F.try_divide((F.col("n01") - F.col("n10")).cast("double"), F.sqrt(F.col("n01") + F.col("n10")))
    return flat.withColumn("n_sigma", sigma).orderBy(F.abs("n_sigma").desc(), "annotator")


def majority_label(
    votes: DataFrame, default: int | Mapping[str, int] = 0, keys: Sequence[str] = ("id",), ignored: Sequence[str] = ()
) -> DataFrame:
    """Most frequent vote per item; a tie gives ``default``, no vote gives null.

    ``default`` may differ by label (the keys then include ``label``, and a label that is not listed gives null). Votes
    of the raters in ``ignored`` do not count.
    """
    if ignored:
        votes = votes.withColumn("value", F.when(~F.col("annotator").isin(*ignored), F.col("value")))
    if isinstance(default, Mapping):
        tie = F.create_map(*[F.lit(x) for pair in default.items() for x in pair])[F.col("label")] if default else F.lit(None).cast("int")
    else:
        tie = F.lit(default)
    bad = F.assert_true(F.coalesce(F.col("value").isin(0, 1), F.lit(True)), F.lit("votes must be 0, 1 or missing"))
    g = votes.where(bad.isNull()).groupBy(*keys).agg(
        F.count(F.when(F.col("value") == 1, 1)).alias("_yes"), F.count(F.when(F.col("value") == 0, 1)).alias("_no")
    )
    label = (
        F.when(F.col("_yes") > F.col("_no"), 1).when(F.col("_yes") < F.col("_no"), 0).when(F.col("_yes") > 0, tie)
    )
    return g.select(*keys, label.alias("final"))


def n_votes(votes: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    return votes.groupBy(*keys).agg(F.count("value").alias("n_votes"))


def votes_by_rater(votes: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Votes each rater gave, one column per label."""
    return votes.groupBy("annotator").pivot("label", list(labels)).agg(F.count("value")).fillna(0)


def join_rater_tables(tables: Mapping[str, DataFrame], check: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """One row per item with the labels of every rater as ``label_rater``.

    All raters must have the same items with identical ``check`` texts, else the job
    fails. The tables are stacked and grouped once instead of joined one by one. Texts are compared
    by 240 bits of their SHA-256, as four numbers each, so none is shuffled, sorted or kept in a group.
    """
    k = len(tables)

    def digest(c: str) -> list[Column]:
        hashed = F.sha2(F.col(c).cast("string"), 256)
        return [F.conv(F.substring(hashed, 15 * j + 1, 15), 16, 10).cast("bigint") for j in range(4)]

    stacked = reduce(DataFrame.unionByName, [
        df.select("id", *[part.alias(f"_c{i}_{j}") for i, c in enumerate(check) for j, part in enumerate(digest(c))], *labels, F.lit(who).alias("_who"))
        for who, df in tables.items()])
    aggs = [F.count(F.when(F.col("_who") == who, 1)).alias(f"_n{w}") for w, who in enumerate(tables)]
    for i in range(len(check)):
        aggs += [F.count(f"_c{i}_0").alias(f"_k{i}")]
        for j in range(4):
            aggs += [F.min(f"_c{i}_{j}").alias(f"_lo{i}_{j}"), F.max(f"_c{i}_{j}").alias(f"_hi{i}_{j}")]
    aggs += [F.max(F.when(F.col("_who") == who, F.col(x))).alias(f"{x}_{who}") for who in tables for x in labels]
    g = stacked.groupBy("id").agg(*aggs)
    once = reduce(Column.__and__, [F.col(f"_n{w}") == 1 for w in range(k)])
    g = g.where(F.assert_true(once, F.lit("raters differ in their items")).isNull())
    for i, c in enumerate(check):
        same = reduce(Column.__and__, [F.col(f"_lo{i}_{j}") == F.col(f"_hi{i}_{j}") for j in range(4)]) & (F.col(f"_k{i}") == k)
        g = g.where(F.assert_true(F.coalesce(same, F.lit(False)), F.lit(f"{c} differs between raters")).isNull())
    return g.select("id", *[f"{x}_{who}" for who in tables for x in labels])


def strict_corpus(df: DataFrame, combined: str, votes: Sequence[str], text: str = "text") -> DataFrame:
    """Texts all raters call positive (1) or the combined label calls negative (0); the rest is dropped."""
    total = sum((F.col(c) for c in votes), F.lit(0))
    label = F.when(total == len(votes), 1).when(F.col(combined) == 0, 0)
    return df.select(label.alias("label"), text).where("label IS NOT NULL")
