"""Candidate table of the public registers with voters, assets and votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.urls import platform_flags
from tallyhouse.operators.joins import attach
from tallyhouse.operators.posterior import binomial_stats
from tallyhouse.operators.totals import asset_features, platform_use


def candidate_table(people: DataFrame, units: DataFrame, assets: DataFrame, votes: DataFrame) -> DataFrame:
    """One row per person: unit name, voters of the unit, assets (0 when none) and votes.

    A person without votes was not counted, so votes stay null.
    """
    voters = people.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("voters"))
    names = units.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("unit_name"))
    owned = asset_features(assets, ["o_custkey"], "o_totalprice").withColumnRenamed("o_custkey", "c_custkey")
    first_turn = votes.where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    polled = (
        first_turn.groupBy("o_orderkey").agg(F.sum("l_quantity").alias("q"))
        .join(assets.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey")
        .groupBy("c_custkey").agg(F.sum("q").cast("bigint").alias("votes"))
    )
    df = attach(people, names, ["c_nationkey"])
    df = attach(df, voters, ["c_nationkey"])
    df = attach(df, owned, ["c_custkey"], {"n_assets": 0, "asset_value": 0.0})
    return attach(df, polled, ["c_custkey"])


def platform_report(
    people: DataFrame, links: DataFrame, key: str, url: str, by: str, flags: Sequence[str], dp: float = 1e-4
) -> DataFrame:
    """Share of people using each platform per category, with credible intervals.

    ``links`` holds the declared links; equal links of a person count once.
    """
    flagged = links.dropDuplicates([key, url]).select(key, *platform_flags(F.col(url)))
    use = platform_use(people.select(key, by), flagged, key, flags)
    return binomial_stats(use, by, list(flags), dp=dp)
