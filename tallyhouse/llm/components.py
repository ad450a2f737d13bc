"""Connected components of a table of links, by alternating star contractions in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.saved import saved


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """Columns ``node`` and ``component`` (its smallest node) of every node of the links (a, b).

    Each round hangs the larger neighbours of a node on its smallest one, then the smaller ones; the
    table never has more rows than links, and every round is written to the shared folder. Rounds grow with
    the logarithm of the longest path.
    """
    now = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    state = _state(now)
    while state != before:
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small stars: all links point down now.
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(floor.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = saved(small, "links")
        state = _state(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
