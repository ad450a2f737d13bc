"""The main product: violent and total mentions of a monitored population over time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators.filters import filter_expr, select_direct_text
from tallyhouse.operators.joins import interval_join, keep_ids, slot_grid
from tallyhouse.operators.totals import hour_seasonal_factor
from tallyhouse.operators.windows import agg_by_day, agg_period, seasonal_impute
from tallyhouse.session import kept_table
from tallyhouse.sources import tables
from tallyhouse.sources.sinks import export_series, headline_numbers, write_headline, write_series


def drop_accounts(df: DataFrame, column: str, bad: Sequence[int]) -> DataFrame:
    """Rows of the accounts listed in the configuration go; rows without account stay."""
    return df.where(~F.coalesce(F.col(column).isin(*bad), F.lit(False))) if bad else df


def final_probability(df: DataFrame) -> DataFrame:
    """Probability that the mentioned account was attacked, and its window-weighted form."""
    both = F.col("hate_score") * F.col("target_prob")
    return (
        df.withColumn("w_hate_score", F.col("hate_score") * F.col("t_win_weight"))
        .withColumn("final_prob", both)
        .withColumn("w_final_prob", both * F.col("t_win_weight"))
    )


def checked_log(log: DataFrame) -> DataFrame:
    """Capture log whose batches are whole: one size per batch time, and as many rows as that size."""
    sizes = log.groupBy("batch_time").agg(F.count(F.lit(1)).alias("_n"), F.min("batch_size").alias("_lo"), F.max("batch_size").alias("_hi"))
    one = F.coalesce((F.col("_lo") == F.col("_hi")) & (F.col("_n") == F.col("_lo")), F.lit(False))
    whole = sizes.where(F.assert_true(one, F.lit("a batch of the log is not whole")).isNull()).select("batch_time")
    return log.join(whole, "batch_time", "left_semi")


def load_log(log: DataFrame, sources: DataFrame) -> DataFrame:
    """Capture log with the account list in use at each batch; sizes of batches are checked where the log has them."""
    log = checked_log(log) if "batch_size" in log.columns else log
    return interval_join(log, sources, "batch_time", "first_batch", "last_batch")


def population_estimate(
    selection: DataFrame, log: DataFrame, ref: DataFrame, factors: DataFrame, start: str, hours: float = 3
) -> DataFrame:
    """Per slot of the grid: mentions and attacks scaled up to the whole population.

    Slots without a successful request have no scale factor, so their estimate is null.
    """
    good = keep_ids(log.where("status = 'ok'"), ref, "id")
    slots = good.groupBy(F.col("batch_time").alias("slot")).agg(
        F.count(F.lit(1)).alias("n_accounts"), F.min("file").alias("file"), F.max("file").alias("_last")
    )
    one_list = F.assert_true(F.col("file") == F.col("_last"), F.lit("a slot uses two account lists"))
    slots = slots.where(one_list.isNull()).drop("_last")
    bounds = good.agg(F.max("batch_time").alias("hi"))
    step = f"{int(hours * 60)} MINUTES"
    grid = slot_grid(bounds.where("hi IS NOT NULL"), F.lit(start).cast("timestamp_ntz"), F.col("hi"), step)
    sums = selection.groupBy(F.col("batch_time").alias("slot")).agg(
        F.sum("t_win_weight").alias("w_n_tweets"), F.sum("w_final_prob").alias("w_n_hate")
    )
    size = ref.select("id").distinct().agg(F.count(F.lit(1)).cast("double")).scalar()
    lists = factors.select(F.col("pool_filename").alias("file"), "n_tweets_list_factor", "n_hate_list_factor")
    joined = grid.join(slots, "slot", "left").join(sums, "slot", "left").join(lists, "file", "left")
    scale = F.try_divide(size, F.col("n_accounts").cast("double"))
    return joined.select(
        "slot",
        F.coalesce("n_accounts", F.lit(0)).alias("n_accounts"),
        (scale * F.col("w_n_tweets") * F.col("n_tweets_list_factor")).alias("pop_n_tweets"),
        (scale * F.col("w_n_hate") * F.col("n_hate_list_factor")).alias("pop_n_hate"),
    )


def impute_slots(estimate: DataFrame, season: DataFrame, hours: float = 3) -> DataFrame:
    """Null estimates filled from the deseasonalised neighbourhood."""
    df = estimate.withColumn("hour", F.hour("slot")).join(season, "hour", "left")
    df = seasonal_impute(df, "slot", "pop_n_tweets", "season_index", hours, "final_n_tweets")
    return seasonal_impute(df, "slot", "pop_n_hate", "season_index", hours, "final_n_hate")


def slot_series(
    mentions: DataFrame, log: DataFrame, sources: DataFrame, pools: DataFrame, factors: DataFrame,
    query: str, bad: Sequence[int], start: str, hours: float = 3,
) -> DataFrame:
    """Final series on the slot grid for the accounts chosen by ``query`` in the newest list."""
    scored = final_probability(drop_accounts(mentions, "batch_user", bad))
    newest = sources.agg(F.max_by("file", "first_batch")).scalar()
    ref = drop_accounts(filter_expr(pools, query).where(F.col("file") == newest), "id", bad).select("id").distinct()
    selection = keep_ids(select_direct_text(scored), ref, "batch_user")
    estimate = population_estimate(selection, load_log(log, sources), ref, factors, start, hours)
    return impute_slots(estimate, hour_seasonal_factor(scored), hours)


def daily_series(slots: DataFrame, hours: float = 3, until: str | None = None) -> DataFrame:
    """Published daily table, cut at ``until`` (included)."""
    days = agg_by_day(slots, "slot", ["final_n_hate", "final_n_tweets"], hours)
    if until:
        days = days.where(F.col("day") <= F.lit(until).cast("date"))
    return export_series(days, "day", "final_n_hate", "final_n_tweets")


def period_series(slots: DataFrame, hours: float) -> DataFrame:
    """Published table in bins of ``hours``, labelled by their end."""
    hate = agg_period(slots, "slot", "final_n_hate", hours)
    total = agg_period(slots, "slot", "final_n_tweets", hours)
    return export_series(hate.join(total, "slot"), "slot", "final_n_hate", "final_n_tweets", daily=False)


def publish(
    spark: SparkSession, stored: Mapping[str, str], schemas: Mapping[str, str], query: str, bad: Sequence[int], start: str,
    out: str, today: str, hours: float = 3, until: str | None = None,
) -> DataFrame:
    """From stored files to the published ones: ``daily`` as CSV and ``headline`` as JSON below ``out``.

    ``stored`` names the folders of scored ``mentions``, the capture ``log``, the account ``pools`` and the files of pool
    ``sources`` and ``factors``; ``schemas`` those of the first three and of the factors. Returns the daily table as it was written.
    """
    scored = tables.load_concat_csv(spark, stored["mentions"], schemas["mentions"]).drop("filename")
    log = tables.load_concat_csv(spark, stored["log"], schemas["log"]).drop("filename")
    slots = slot_series(
        scored, log, tables.load_pool_sources(spark, stored["sources"]), tables.load_pools(spark, stored["pools"], schemas["pools"]),
        tables.robust_load_csv(spark, stored["factors"], schemas["factors"]), query, bad, start, hours)
    slots = kept_table(slots, "slots")  # both outputs need it, and the files are to be read once
    write_series(daily_series(slots, hours, until), f"{out}/daily")
    days = agg_by_day(slots, "slot", ["final_n_hate", "final_n_tweets"], hours)
    write_headline(headline_numbers(days, "day", "final_n_hate", today), f"{out}/headline")
    return spark.read.option("header", True).schema("day STRING, total LONG, violent LONG, percent DOUBLE").csv(f"{out}/daily")
