"""Nested JSON pages of captured mentions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE_SCHEMA = """
data ARRAY<STRUCT<id: BIGINT, text: STRING, author_id: BIGINT, created_at: STRING, in_reply_to_user_id: STRING,
  entities: STRUCT<mentions: ARRAY<STRUCT<username: STRING, id: STRING>>>>>,
includes STRUCT<users: ARRAY<STRUCT<id: BIGINT, name: STRING, username: STRING>>>,
meta STRUCT<result_count: BIGINT, next_token: STRING>,
errors ARRAY<STRUCT<title: STRING, detail: STRING>>
"""


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE_SCHEMA).json(path)


def load_mentions_json(pages: DataFrame, account: str | None = None) -> DataFrame:
    """One row per mention with its author; authors are listed once per id, so rows never grow.

    ``account`` is the id of the monitored account: mentions replying to it get
    ``direct_reply`` = 1.
    """
    rows = pages.select(F.explode("data").alias("d")).select(
        "d.id", "d.text", "d.author_id", "d.created_at", "d.in_reply_to_user_id",
        F.coalesce(F.size(F.col("d.entities.mentions")), F.lit(0)).alias("n_mentions"),
    )
    authors = (
        pages.select(F.explode("includes.users").alias("u"))
        .groupBy(F.col("u.id").alias("author_id"))
        .agg(F.min(F.struct("u.username", "u.name")).alias("a"))
        .select("author_id", F.col("a.name").alias("author_name"), F.col("a.username").alias("author_username"))
    )
    joined = rows.join(authors, "author_id", "left")
    link = F.concat(
        F.lit("https://twitter.com/"), F.col("author_username"), F.lit("/status/"), F.col("id").cast("string")
    )
    direct = (
        F.coalesce(F.col("in_reply_to_user_id") == F.lit(account), F.lit(False)) if account
        else F.col("in_reply_to_user_id").isNotNull()
    )
    return joined.select(
        "id", F.translate("text", "\r", " ").alias("text"), "author_id", "author_name", "author_username",
        "created_at", "in_reply_to_user_id", link.alias("tweet_url"), F.when(F.col("n_mentions") < 0, 0)
        .otherwise(F.col("n_mentions")).alias("n_mentions"), direct.cast("int").alias("direct_reply"),
    )


def union_pages(pages: Sequence[DataFrame]) -> DataFrame:
    """Pages of one or several reads as one table; fields absent from a page become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pages)


def page_totals(pages: DataFrame) -> DataFrame:
    """Results and errors announced by all pages together."""
    return pages.agg(
        F.coalesce(F.sum("meta.result_count"), F.lit(0)).alias("result_count"),
        F.coalesce(F.sum(F.when(F.col("errors").isNotNull(), F.size("errors"))), F.lit(0)).alias("n_errors"),
        F.count(F.lit(1)).alias("n_pages"),
    )


def expand_struct(df: DataFrame) -> DataFrame:
    """Every struct column becomes one flat column per field; the struct itself is dropped."""
    out = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StructType):
            out += [F.col(f"`{field.name}`.`{n}`").alias(n) for n in field.dataType.names]
        else:
            out.append(F.col(f"`{field.name}`"))
    return df.select(*out)
