"""Grouped totals, profiles and panel statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.operators.joins import keep_ids
from tallyhouse.operators.ranking import exact_quantiles, top_per_group
from tallyhouse.operators.sketches import distinct_estimates, surely_more


def count_rows(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def known(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are all known: as in the tables these totals come from, a missing key is no group."""
    return df.dropna(subset=list(keys))


def asset_features(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Number and total value of assets per owner."""
    return known(df, *keys).groupBy(*keys).agg(count_rows("n_assets"), F.sum(value).alias("asset_value"))


def voters_by_unit(df: DataFrame, unit: str, voters: str, whole: str = "BR") -> DataFrame:
    """Voters per unit plus one row for the whole country, added up from the units."""
    units = known(df, unit).groupBy(F.col(unit).cast("string").alias(unit)).agg(F.sum(voters).alias(voters))
    return units.unionByName(units.agg(F.lit(whole).alias(unit), F.sum(voters).alias(voters)))


def nominal_votes(df: DataFrame, key: str, votes: str, turn: str, wanted: int, kind: str) -> DataFrame:
    """Votes per candidate in one turn; the table must hold a single type of election."""
    same = F.assert_true(F.col("_lo").eqNullSafe(F.col("_hi")), F.lit("more than one type of election"))
    g = known(df, key).groupBy(key).agg(
        F.min(kind).alias("_lo"), F.max(kind).alias("_hi"),
        F.sum(F.when(F.col(turn) == wanted, F.col(votes))).alias("votes"),
        F.count(F.when(F.col(turn) == wanted, 1)).alias("_n"),
    )
    extremes = df.agg(F.min(kind).alias("_lo"), F.max(kind).alias("_hi")).select(same.isNull().alias("ok"))
    return g.where(extremes.select("ok").scalar() & (F.col("_n") > 0)).select(key, "votes")


def votes_by(df: DataFrame, by: str, votes: str, id_columns: Sequence[str], where: Column) -> DataFrame:
    """Votes per key of the rows in ``where`` with descriptive columns that are unique per key."""
    aggs = [F.sum(votes).alias("votes")]
    for c in id_columns:
        aggs += [F.min(c).alias(c), F.max(c).alias(f"_x_{c}")]
    g = known(df.where(where), by).groupBy(by).agg(*aggs)
    for c in id_columns:
        g = g.where(F.assert_true(F.col(c).eqNullSafe(F.col(f"_x_{c}")), F.lit(f"{c} differs inside a key")).isNull())
    return g.select(by, *id_columns, "votes")


def unique_traits(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per key with columns that must hold exactly one value per key."""
    aggs = []
    for c in columns:
        aggs += [F.min(c).alias(c), F.max(c).alias(f"_x_{c}"), F.count(F.when(F.col(c).isNull(), 1)).alias(f"_n_{c}")]
    g = known(df, *keys).groupBy(*keys).agg(*aggs)
    for c in columns:
        one = (F.col(c) == F.col(f"_x_{c}")) & (F.col(f"_n_{c}") == 0)
        g = g.where(F.assert_true(F.coalesce(one, F.lit(False)), F.lit(f"{c} is not unique in a group")).isNull())
    return g.select(*keys, *columns)


def avg_stat_per_user_day(
    df: DataFrame, stat: str, ids: DataFrame, per_day: int = 8, user: str = "batch_user", slot: str = "batch_time"
) -> DataFrame:
    """Sum of ``stat`` over the accounts in ``ids``, per account and per day.

    The number of slots counts all rows, not only those of the chosen accounts.
    """
    ids = ids.select("id").distinct()
    size = ids.agg(F.count(F.lit(1)).cast("double").alias("v")).scalar()
    slots = df.agg(F.count_distinct(slot).cast("double").alias("v")).scalar()
    total = keep_ids(df, ids, user).agg(F.coalesce(F.sum(stat), F.lit(0.0)).alias("s"))
    return total.select((F.try_divide(F.try_divide(F.col("s"), size), slots) * per_day).alias("avg_stat"))


def stat_change_factor(df: DataFrame, stat: str, ids: DataFrame, ref: DataFrame, **kw) -> DataFrame:
    """How much larger the average of the reference accounts is than that of ``ids``."""
    top = avg_stat_per_user_day(df, stat, ref, **kw).scalar()
    return avg_stat_per_user_day(df, stat, ids, **kw).select(F.try_divide(top, F.col("avg_stat")).alias("factor"))


def pool_factors(
    df: DataFrame, pools: DataFrame, ref: str, start: str,
    stats: Mapping[str, str] = {"t_win_weight": "n_tweets_list_factor", "w_final_prob": "n_hate_list_factor"},
    user: str = "batch_user", slot: str = "batch_time",
) -> DataFrame:
    """Factor of each account list against the list ``ref``, on batches from ``start`` on.

    Number of slots and of batches per day cancel in the ratio, so a list's average is
    its sum over its size. Rows are added up per account before meeting the lists.
    """
    recent = df.where(F.col(slot) >= F.lit(start).cast("timestamp_ntz"))
    per_user = recent.groupBy(F.col(user).alias("id")).agg(*[F.sum(s).alias(s) for s in stats])
    members = pools.select("file", "id").distinct()
    sizes = members.join(per_user, "id", "left").groupBy("file").agg(
        F.count(F.lit(1)).alias("_size"), *[F.coalesce(F.sum(s), F.lit(0.0)).alias(s) for s in stats]
    )
    means = sizes.select("file", *[(F.col(s) / F.col("_size")).alias(s) for s in stats])
    base = means.where(F.col("file") == ref)
    return means.select(
        F.col("file").alias("pool_filename"),
        *[F.try_divide(base.select(s).scalar(), F.col(s)).alias(name) for s, name in stats.items()],
    )


def hour_seasonal_factor(df: DataFrame, slot: str = "batch_time", weight: str = "t_win_weight") -> DataFrame:
    """Weight per hour of the slot relative to the busiest hour (at most 24 rows)."""
    hours = known(df, slot).groupBy(F.hour(slot).alias("hour")).agg(F.sum(weight).alias("_w"))
    return hours.select("hour", F.try_divide(F.col("_w"), F.max("_w").over(Window.partitionBy())).alias("season_index"))


def counts_table(df: DataFrame, column: str) -> DataFrame:
    """Values with count and percentage; null counts as a value."""
    counts = df.groupBy(column).agg(count_rows())
    total = counts.agg(F.sum("n").cast("double")).scalar()
    return counts.withColumn("percent", F.try_divide(F.col("n") * 100.0, total))


def map_counts(df: DataFrame, columns: Sequence[str], head: int) -> DataFrame:
    """Most frequent values of each column, in one pass over the table."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(cells.alias("c")).groupBy("c.column", "c.value").agg(count_rows())
    return top_per_group(counts, ["column"], [F.col("n").desc(), F.col("value").asc_nulls_first()], head)


def _unpivot_row(row: DataFrame, columns: Sequence[str], parts: Mapping[str, str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), *[F.col(f"{p}_{c}").alias(n) for p, n in parts.items()]) for c in columns]
    return row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def missing_profile(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """Null count and percentage (2 decimals) of each column."""
    row = df.agg(count_rows("_all"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"n_{c}") for c in df.columns])
    for c in df.columns:
        row = row.withColumn(f"p_{c}", F.bround(F.try_divide(F.col(f"n_{c}") * 100.0, F.col("_all").cast("double")), 2))
    out = _unpivot_row(row, df.columns, {"n": "n_missing", "p": "percent"})
    return out.where("n_missing > 0") if only_missing else out


def distinct_profile(df: DataFrame, most: int | None = None, approx: bool = False) -> DataFrame:
    """Distinct values of each column, nulls left out; ``approx`` takes them from sketches.

    With ``most`` only columns of at most so many values are reported. Sketches rule out the
    others without a shuffle. Each column left is grouped by itself, so that a row is never
    copied once per column; a stored table is read one column at a time.
    """
    if approx:
        row = df.agg(*[F.approx_count_distinct(c).alias(f"n_{c}") for c in df.columns])
        out = _unpivot_row(row, df.columns, {"n": "n_distinct"})
        return out.where(F.col("n_distinct") <= most) if most is not None else out
    columns = list(df.columns)
    if most is not None:
        sizes = distinct_estimates(df, {c: [c] for c in columns})
        columns = [c for c in columns if not surely_more(sizes[c], most + 1)]  # one more for null
    exact = [
        df.select(F.col(f"`{c}`").alias("v")).where("v IS NOT NULL").distinct().agg(count_rows("n_distinct")).select(
            F.lit(c).alias("column"), "n_distinct")
        for c in columns
    ]
    if not exact:
        return df.sparkSession.createDataFrame([], "column STRING, n_distinct LONG")
    out = reduce(DataFrame.unionByName, exact)
    return out.where(F.col("n_distinct") <= most) if most is not None else out


def non_unique_columns(df: DataFrame) -> DataFrame:
    """Columns with more than one value; null counts as a value. One pass of min and max."""
    aggs = []
    for c in df.columns:
        aggs += [(F.min(c) != F.max(c)).alias(f"d_{c}"), F.count(c).alias(f"k_{c}")]
    row = df.agg(count_rows("_all"), *aggs)
    for c in df.columns:
        mixed = (F.col(f"k_{c}") > 0) & (F.col(f"k_{c}") < F.col("_all"))
        row = row.withColumn(f"m_{c}", F.coalesce(F.col(f"d_{c}"), F.lit(False)) | mixed)
    return _unpivot_row(row, df.columns, {"m": "varies"}).where("varies").select("column")


def user_hate_totals(df: DataFrame, user: str = "batch_user") -> DataFrame:
    """Per target: mentions, attacks and violent responses, and their frequencies."""
    g = known(df, user).groupBy(user).agg(
        F.sum(F.col("t_win_weight")).alias("n_tweets"),
        F.sum(F.col("hate_score") * F.col("target_prob") * F.col("t_win_weight")).alias("n_hate"),
        F.sum(F.col("hate_score") * F.col("t_win_weight")).alias("_all"),
    )
    g = g.select(user, "n_tweets", "n_hate", (F.col("_all") - F.col("n_hate")).alias("n_response"))
    return g.withColumn("freq_hate", F.try_divide("n_hate", "n_tweets")).withColumn(
        "freq_response", F.try_divide("n_response", "n_tweets")
    )


def platform_use(owners: DataFrame, links: DataFrame, key: str, flags: Sequence[str], none: str = "nenhuma") -> DataFrame:
    """Per owner 1 for each platform found in any of the links; no link at all means ``none``."""
    used = links.groupBy(key).agg(*[F.max(f).alias(f) for f in flags])
    fill = [F.coalesce(F.col(f), F.lit(1 if f == none else 0)).cast("int").alias(f) for f in flags]
    return owners.join(used, key, "left").select(*owners.columns, *fill)


def group_means(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    return known(df, by).groupBy(by).agg(*[F.avg(c).alias(c) for c in columns])


def mean_difference(means: DataFrame, by: str, columns: Sequence[str], first: str, second: str) -> DataFrame:
    """Column means of one category minus those of another, one row per column."""
    at = lambda c, v: F.max(F.when(F.col(by) == v, F.col(c)))
    row = means.agg(*[(at(c, first) - at(c, second)).alias(f"d_{c}") for c in columns])
    return _unpivot_row(row, columns, {"d": "difference"})


def adjusted_platform_counts(use: DataFrame, flags: Sequence[str], none: str, undeclared: float) -> DataFrame:
    """Users per platform corrected for accounts that were not declared.

    With p the share of undeclared use: ``none`` is scaled by 1 - p, the others by
    1 + p * N0 / (N - N0), N0 being the owners without any platform.
    """
    row = use.agg(count_rows("_all"), *[F.sum(f).alias(f"n_{f}") for f in flags])
    n0, p = F.col(f"n_{none}"), F.lit(undeclared)
    for f in flags:
        up = 1 + p * F.try_divide(n0.cast("double"), (F.col("_all") - n0).cast("double"))
        row = row.withColumn(f"a_{f}", F.col(f"n_{f}") * ((1 - p) if f == none else up))
    return _unpivot_row(row, flags, {"n": "declared", "a": "adjusted"})


def presence_matrix(df: DataFrame, day: Column, user: str, users: Sequence) -> DataFrame:
    """Day x account matrix of 0/1 for a declared list of accounts."""
    seen = df.groupBy(day.alias("day"), user).agg(F.lit(1).alias("_one"))
    wide = seen.groupBy("day").pivot(user, list(users)).agg(F.max("_one"))
    return wide.fillna(0)


def coverage_per_day(df: DataFrame, day: Column, user: str) -> DataFrame:
    """Share of all accounts seen on each day."""
    pairs = df.groupBy(day.alias("day"), user).agg(F.lit(1).alias("_one"))
    users = pairs.agg(F.count_distinct(user).cast("double")).scalar()
    return pairs.groupBy("day").agg(count_rows("n_users")).withColumn("coverage", F.col("n_users") / users)


def group_membership(df: DataFrame, key: str, group: str, groups: Sequence) -> DataFrame:
    """Counts of each declared group per id, and the number of groups the id is in."""
    aggs = [F.count(F.when(F.col(group) == g, 1)).alias(f"in_{g}") for g in groups]
    wide = known(df, key).groupBy(key).agg(*aggs)
    inside = sum(((F.col(f"in_{g}") > 0).cast("int") for g in groups), F.lit(0))
    return wide.withColumn("n_groups", inside)


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Count, quartiles and whiskers (last values within 1.5 quartile ranges) per category."""
    q = exact_quantiles(df, [by], value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    ends = (
        df.where(v.isNotNull()).join(q, by)
        .groupBy(by)
        .agg(
            F.min(F.when(v >= F.col("q1") - reach, v)).alias("low"),
            F.max(F.when(v <= F.col("q3") + reach, v)).alias("high"),
        )
    )
    return q.join(ends, by)


def batch_totals(log: DataFrame) -> DataFrame:
    """Sum and mean (3 decimals) of captured mentions over the successful requests."""
    ok = F.when(F.col("status") == "ok", F.col("batch_tweets"))
    return log.agg(
        F.count(ok).alias("n_ok"), F.coalesce(F.sum(ok), F.lit(0)).alias("total"), F.bround(F.avg(ok), 3).alias("mean")
    )


def capture_stats(
    df: DataFrame, request: Sequence[str], created: str, start: str, end: str, cap: int = 800, error: Column | None = None
) -> DataFrame:
    """Per request: mentions, errors, expected and covered hours, and the window weight.

    A request that reached the cap only covers its most recent stretch, so its mentions
    weigh expected / covered hours.
    """
    hours = lambda a, b: F.timestamp_diff("MICROSECOND", a, b) / F.lit(3_600_000_000.0)
    errors = F.count(F.when(error, 1)) if error is not None else F.lit(0).cast("bigint")
    g = df.groupBy(*request).agg(
        count_rows("n_mentions"), errors.alias("n_errors"), F.min(start).alias("_s"), F.max(end).alias("_e"),
        F.min(created).alias("_lo"), F.max(created).alias("_hi"),
    )
    g = g.withColumn("expected_hours", hours(F.col("_s"), F.col("_e"))).withColumn(
        "covered_hours", hours(F.col("_lo"), F.col("_hi"))
    )
    weight = F.when(F.col("n_mentions") >= cap, F.try_divide("expected_hours", "covered_hours")).otherwise(1.0)
    return g.withColumn("t_win_weight", weight).drop("_s", "_e", "_lo", "_hi")


def error_profile(log: DataFrame) -> DataFrame:
    """Failed requests per account."""
    return known(log.where("status = 'error'"), "id").groupBy("id").agg(count_rows("n_errors"))


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlations over complete rows, one row per ordered pair."""
    full = df.dropna(subset=list(columns))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = full.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = []
    for a in columns:
        for b in columns:
            v = F.lit(1.0) if a == b else F.col(f"`{a}|{b}`" if (a, b) in pairs else f"`{b}|{a}`")
            cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), v.alias("corr")))
    return row.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def attribute_per_batch(df: DataFrame, attributes: DataFrame, user: str, slot: str, attribute: str, total: str) -> DataFrame:
    """Mean attribute of the accounts sampled in each slot next to the slot's total."""
    per = known(df, slot, user).groupBy(slot, user).agg(F.sum(total).alias("_t"))
    joined = per.join(attributes.select(F.col("id").alias(user), attribute), user, "left")
    return joined.groupBy(slot).agg(F.avg(attribute).alias(f"mean_{attribute}"), F.sum("_t").alias("total"))
