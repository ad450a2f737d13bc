"""Sampling, splitting and shuffling with draws that depend only on seed and key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.hashing import exponential_key, uniform
from tallyhouse.functions.permutation import permuted, replica_keys
from tallyhouse.operators.bins import bin_prob
from tallyhouse.operators.joins import drop_ids, keep_ids
from tallyhouse.operators.ranking import bucket_count, first_rows, rank_by_uniform, top_per_group
from tallyhouse.session import kept_table

MOST_KEYS = 100_000  # permutations whose keys (200 bytes each, 500 for small tables) are sent to all executors
PARTNER_ROWS = 500_000  # numbered rows that one task of a join holds


def weighted_sample(df: DataFrame, key: str, n: int, seed: int | str, weight: Column | None = None) -> DataFrame:
    """``n`` rows without replacement, likelier with larger ``weight``; rows of weight 0 or null never."""
    u = uniform(seed, key)
    if weight is None:
        return first_rows(df, u, [key], n)
    return first_rows(df.where(weight > 0), exponential_key(u, weight), [key], n)


def plan_batch(
    pool: DataFrame, n: int, batch_time: str, seed: int | str, previous: DataFrame | None = None,
    key: str = "id", weight: str = "sample_weight",
) -> DataFrame:
    """Queue of ``n`` accounts for a capture, leaving out those of the previous one.

    Asking for more accounts than there are is an error.
    """
    free = drop_ids(pool, previous, key) if previous is not None else pool
    chosen = weighted_sample(free, key, n, seed, F.col(weight)).select(key)
    enough = F.assert_true(chosen.agg(F.count(F.lit(1)).alias("n")).scalar() >= n, F.lit("the pool is smaller than the batch"))
    return chosen.where(enough.isNull()).select(
        key, F.lit(n).cast("bigint").alias("batch_size"), F.lit(batch_time).cast("timestamp_ntz").alias("batch_time"),
        F.lit("queue").alias("status"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("batch_start", "timestamp_ntz"), ("batch_end", "timestamp_ntz"),
                                                   ("batch_tweets", "double"), ("batch_errors", "double"))],
    )


def popular_targets(df: DataFrame, least: int, user: str = "batch_user", group: DataFrame | None = None) -> DataFrame:
    """Mentions of accounts with at least ``least`` mentions, inside a group of accounts if given."""
    rows = keep_ids(df, group, user) if group is not None else df
    popular = rows.groupBy(user).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return rows.join(popular.select(user), user, "left_semi")


def two_way_weights(df: DataFrame, dim1: str, dim2: str, exponent: float = 1.0) -> DataFrame:
    """Rows with the inverse frequencies of two columns and ``w1 * w2 ** exponent``.

    The exponent acts on the second column (the score bin). Both counts come from the
    counts of value pairs, so the rows are shuffled once for them.
    """
    pairs = df.groupBy(dim1, dim2).agg(F.count(F.lit(1)).alias("_n"))
    out = df
    for d in (dim1, dim2):
        per = pairs.groupBy(d).agg(F.sum("_n").alias(f"n_{d}"))
        out = out.join(per, d).withColumn(f"w_{d}", 1.0 / F.col(f"n_{d}"))
    return out.withColumn("w_eq_sampling", F.col(f"w_{dim1}") * F.pow(F.col(f"w_{dim2}"), F.lit(float(exponent))))


def sample_in_group(
    df: DataFrame, group: DataFrame, least: int, width: float, exponent: float, n: int, seed: int | str,
    key: str = "id", user: str = "batch_user", score: str = "hate_score",
) -> DataFrame:
    """Sample of the mentions of popular accounts of a group, evened out over accounts and score bins."""
    pool = popular_targets(df, least, user, group).withColumn("prob_bin", bin_prob(F.col(score), width))
    weighted = two_way_weights(pool, user, "prob_bin", exponent)
    return weighted_sample(weighted, key, n, seed, F.col("w_eq_sampling"))


def sample_per_group(df: DataFrame, group: Sequence[str], key: str, k: int, seed: int | str) -> DataFrame:
    """``k`` random rows of each group."""
    return top_per_group(df, group, [uniform(seed, key), F.col(key)], k)


def top_then_sample(
    df: DataFrame, key: str, score: str, n_top: int, n_uniform: int, seed: int | str, factor: int = 10
) -> DataFrame:
    """``n_top`` rows drawn from the best ``factor * n_top``, plus ``n_uniform`` from all, in random order."""
    best = df.orderBy(F.col(score).desc(), F.col(key)).limit(n_top * factor)
    top = weighted_sample(best, key, n_top, f"{seed}-top")
    rest = weighted_sample(df, key, n_uniform, f"{seed}-all")
    return rest.unionByName(top).dropDuplicates([key]).orderBy(uniform(f"{seed}-order", key), key)


def sample_fixed_proportion(
    df: DataFrame, label: str, key: str, fraction: float, seed: int | str, replicas: int | None = None
) -> DataFrame:
    """All negatives plus positives drawn with replacement until they make up ``fraction``.

    The number of draws is int(n0 * f / (1 - f) + 0.5); draw j of a replica takes the
    positive with number floor(u_j * n1). With ``replicas`` the result holds that many
    samples under ``replica``. Draws are split by positive number, which is uniform, so
    no positive or replica gathers in one task.
    """
    f = float(fraction)
    counts = df.agg(
        F.count(F.when(F.col(label) == 0, 1)).alias("n0"), F.count(F.when(F.col(label) == 1, 1)).alias("n1")
    )
    draws = F.floor(F.col("n0") * (f / (1 - f)) + 0.5)
    per_replica = counts.where((draws > 0) & (F.col("n1") > 0)).select(
        "n1", draws.alias("_d"), F.explode(F.sequence(F.lit(0), F.lit((replicas or 1) - 1))).alias("replica")
    )
    # Two nested sequences keep the exploded rows apart before they are generated.
    block = 65_536
    blocks = per_replica.select(
        "n1", "_d", "replica", F.explode(F.sequence(F.lit(0).cast("bigint"), ((F.col("_d") - 1) / block).cast("bigint"))).alias("_b")
    )
    spread = blocks.repartition(F.col("replica"), F.col("_b"))
    numbered = spread.select(
        "n1", "replica",
        F.explode(F.sequence(F.col("_b") * block, F.least((F.col("_b") + 1) * block, F.col("_d")) - 1)).alias("draw"),
    )
    picks = numbered.select(
        "replica", "draw", (F.floor(uniform(seed, "replica", "draw") * F.col("n1")) + 1).alias("_pos")
    )
    positives = rank_by_uniform(df.where(F.col(label) == 1), uniform(f"{seed}-number", key), [key], name="_pos")
    drawn = picks.join(positives, "_pos").select("replica", *df.columns)
    negatives = df.where(F.col(label) == 0).select(
        F.explode(F.sequence(F.lit(0), F.lit((replicas or 1) - 1))).alias("replica"), *df.columns
    )
    both = negatives.unionByName(drawn)
    return both if replicas else both.drop("replica")


def random_set_split(df: DataFrame, fractions: Sequence[float], key: str, seed: int | str) -> DataFrame:
    """Rows with the number of their set. Sizes are rounded half-even; the first takes the remainder."""
    if abs(sum(fractions) - 1) > 1e-8:
        raise ValueError("the fractions must add up to one")
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    ranked = rank_by_uniform(df, uniform(seed, key), [key], name="_rank").withColumn("_n", n)
    later = [F.bround(F.col("_n") * F.lit(float(f))).cast("bigint") for f in fractions[1:]]
    # Position of the first row of each later set.
    start = F.col("_n")
    starts = []
    for size in reversed(later):
        start = start - size
        starts.append(start)
    number = sum(((F.col("_rank") > s).cast("int") for s in starts), F.lit(0))
    return ranked.select(*df.columns, number.alias("set"))


def in_test_set(col: Column, fraction: float, prefix: str = "") -> Column:
    """Whether the crc32 of a text puts it in the test set; new data never moves old rows."""
    text = F.replace(col, F.lit(prefix), F.lit("")) if prefix else col
    return F.crc32(F.encode(text, "UTF-8")) < F.lit(int(fraction * 2**32))


def split_by_string(df: DataFrame, column: str, fraction: float, prefix: str = "") -> DataFrame:
    return df.withColumn("in_test", in_test_set(F.col(column), fraction, prefix).cast("int"))


def split_by_date(df: DataFrame, column: str, first_test_day: str) -> DataFrame:
    """Earlier rows train, rows from the day on test."""
    return df.withColumn("part", F.when(F.col(column) < F.lit(first_test_day).cast("timestamp_ntz"), "train").otherwise("test"))


def split_by_date_and_string(df: DataFrame, column: str, first_test_day: str, text: str, prefix: str = "") -> DataFrame:
    """Earlier rows train; later rows halved into validation and test by their text."""
    late = F.when(in_test_set(F.col(text), 0.5, prefix), "test").otherwise("validation")
    parts = split_by_date(df, column, first_test_day)
    return parts.withColumn("part", F.when(F.col("part") == "train", "train").otherwise(late))


def stratified_split(df: DataFrame, label: str, key: str, fraction: float, seed: int | str) -> DataFrame:
    """Train and test parts with the class shares of the whole: round(n_c * fraction) test rows per class."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    ranked = rank_by_uniform(df, uniform(seed, key), [key], group=[label], name="_rank")
    joined = ranked.join(sizes, label)
    test = F.col("_rank") <= F.bround(F.col("_n") * F.lit(float(fraction)))
    return joined.select(*df.columns, F.when(test, "test").otherwise("train").alias("part"))


def shuffle_columns(
    df: DataFrame, columns: Sequence[str], key: str, seed: int | str, replicas: int | None = None
) -> DataFrame:
    """Each column permuted on its own: margins stay, dependence goes.

    Rows are numbered once, in the order of a draw from the key, and stored. The first column keeps that order, as only
    the order relative to it matters; every other column takes, at position i, the value of the row that a keyed
    permutation names for i. With ``replicas`` the table is permuted that many times. A replica costs one
    equi-join on row numbers, which are spread evenly, and no sort: the copies stream past a hash table of at most about
    ``PARTNER_ROWS`` numbered rows. The join is the same for tables of any size, so that what it shuffles grows with the rows.
    """
    first, *others = columns
    ranked = rank_by_uniform(df.select(key, *columns), uniform(seed, key), [key], (), "_rank")
    numbered = kept_table(ranked.select((F.col("_rank") - 1).alias("_number"), *columns), "numbered")
    n = numbered.count()
    keys = replica_keys(df.sparkSession, {f"_k{i}": f"{seed}-{c}" for i, c in enumerate(others)}, replicas or 1, n)
    out = numbered.select("_number", first).crossJoin(F.broadcast(keys) if (replicas or 1) * len(others) <= MOST_KEYS else keys)
    for i in range(len(others)):
        out = permuted(out, "_number", f"_k{i}", n, f"_p{i}").drop(f"_k{i}")
    parts = math.ceil(n / PARTNER_ROWS)
    dealt = (lambda t, p: t.repartition(parts, p)) if parts > bucket_count(df) else (lambda t, p: t)
    for i, c in enumerate(others):
        partners = numbered.select(F.col("_number").alias(f"_p{i}"), c)
        out = dealt(out, f"_p{i}").join(dealt(partners, f"_p{i}").hint("shuffle_hash"), f"_p{i}")
    return out.select(*["replica"][: 1 if replicas else 0], (F.col("_number") + 1).alias("position"), *columns)
