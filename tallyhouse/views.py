"""The synthetic tables seen as mentions, capture logs, account pools and raters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.hashing import uniform
from tallyhouse.functions.permutation import PRIME, ROUNDS, SMALL, SMALL_ROUNDS

SLOT = "3 hours"
OFFSET = "30 minutes"
BAD_ACCOUNTS = (3, 5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slot_end(ts: str = "ts"):
    """End of the 3 h slot (grid at 00:30) that holds ``ts``, closed on the right."""
    return F.window(F.col(ts) - F.expr("INTERVAL 1 MICROSECOND"), SLOT, SLOT, OFFSET)["end"]


def mentions_of(events: DataFrame) -> DataFrame:
    """``events`` as scored mentions."""
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        F.col("user_id").alias("batch_user"),
        "event_type",
        slot_end("ts").alias("batch_time"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("hate_score"),
        (F.lit(1.0) + (F.col("event_id") % 5) * F.lit(0.1)).alias("t_win_weight"),
        (F.lit(1.0) - (F.col("event_id") % 7) / F.lit(10.0)).alias("target_prob"),
        (F.col("event_id") % 2).cast("int").alias("direct_reply"),
        (1 + F.col("event_id") % 3).cast("int").alias("n_mentions"),
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions_of(table(spark, sf_dir, "events"))


def capture_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (slot, account); some accounts fail and some slots are missing."""
    bt = F.col("batch_time")
    return (
        mentions(spark, sf_dir)
        .where(~((F.hour(bt) == 6) & (F.dayofmonth(bt) % 2 == 1)))
        .groupBy("batch_time", F.col("batch_user").alias("id"))
        .agg(F.count(F.lit(1)).alias("batch_tweets"))
        .withColumn("status", F.when(F.col("id") % 17 == 0, "error").otherwise("ok"))
    )


def pool_sources(spark: SparkSession) -> DataFrame:
    """Validity intervals of the two account lists; the last one is open ended."""
    return spark.sql(
        "SELECT * FROM VALUES "
        "('pool_a', TIMESTAMP_NTZ'2024-01-01 00:30:00', TIMESTAMP_NTZ'2024-01-12 00:30:00'), "
        "('pool_b', TIMESTAMP_NTZ'2024-01-12 03:30:00', TIMESTAMP_NTZ'2050-01-01 00:00:00') "
        "AS t(file, first_batch, last_batch)"
    )


def pool_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts of each list: list a lacks the second half of the categories."""
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("category"), F.col("c_nationkey").alias("unit")
    )
    a = c.where("category < 'G'").select(F.lit("pool_a").alias("file"), "*")
    return a.unionByName(c.select(F.lit("pool_b").alias("file"), "*"))


RATERS = ("A00", "A01", "A02", "A03", "A04")


def ratings(spark: SparkSession, sf_dir: str, keep: Sequence[str] = ()) -> DataFrame:
    """Long annotation table over ``documents``, with the columns ``keep`` of them; one vote in ten is missing."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), *keep)
    long = docs.select("id", *keep, F.explode(F.array(*[F.lit(r) for r in RATERS])).alias("annotator"))
    base = uniform("base", "id")
    own = uniform("rate", "id", "annotator")
    gap = uniform("gap", "id", "annotator")
    return long.select(
        "id",
        *keep,
        "annotator",
        F.when(gap >= 0.1, ((base + own) / 2 < 0.4).cast("int")).alias("value"),
    )


# The same views for the SQL engine of the checks.
def sql_uniform(seed, *keys: str) -> str:
    joined = " || ':' || ".join([f"'{seed}'"] + [f"({k})::VARCHAR" for k in keys])
    return f"(('0x' || substr(md5({joined}), 1, 13))::BIGINT / 16.0::DOUBLE ** 13)"


def sql_permutation(source: str, columns: str, seed: int | str, replicas: int, name: str) -> str:
    """The same permutation for another engine: CTEs that end in ``name`` (columns, replica, place) from ``source`` (columns, number).

    Walks are a recursion there, and every round is a subquery.
    """
    key = lambda i: f"('0x' || substr(md5('{seed}:' || rep || ':{i // 4}'), {1 + i % 4 * 8}, 8))::BIGINT % {PRIME}"
    rounds = f"SELECT {columns}, replica, ks, n, a, b, x // b AS u, x % b AS v FROM w"
    for i in range(SMALL_ROUNDS):
        s, t, side = ("v", "u", "a") if i % 2 == 0 else ("u", "v", "b")
        k = [f"ks[{4 * i + j + 1}]" for j in range(4)]
        poly = f"((({k[0]} * {s} + {k[1]}) % {PRIME} * {s} + {k[2]}) % {PRIME} * {s} + {k[3]}) % {PRIME}"
        if i >= ROUNDS:
            poly = f"CASE WHEN n < {SMALL} THEN {poly} ELSE 0 END"
        rounds = f"SELECT {columns}, replica, ks, n, a, b, {s}, ({t} + {poly}) % {side} AS {t} FROM ({rounds})"
    first = rounds.replace("FROM w", "FROM start")
    again = rounds.replace("FROM w", f"FROM {name}_walk WHERE x >= n")
    return f"""size AS (SELECT count(*) AS n FROM {source}),
  grid AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, unnest(range(greatest(root // 4, least(n, 2), 1), root + 1)) AS a
    FROM (SELECT n, greatest(floor(sqrt(n))::BIGINT, least(n, 2), 1) AS root FROM size)) ORDER BY (a - n % a) % a, a DESC LIMIT 1),
  keys AS (SELECT rep::INT AS replica, [{', '.join(key(i) for i in range(4 * SMALL_ROUNDS))}] AS ks FROM range({replicas}) t(rep)),
  start AS (SELECT {columns}, replica, ks, n, a, b, number AS x FROM {source}, keys, grid),
  {name}_walk AS (SELECT {columns}, replica, ks, n, a, b, u * b + v AS x FROM ({first})
    UNION ALL SELECT {columns}, replica, ks, n, a, b, u * b + v FROM ({again})),
  {name} AS (SELECT {columns}, replica, x AS place FROM {name}_walk WHERE x < n)"""


SQL_M = """m AS (
  SELECT event_id AS id, ts AS created_at, user_id AS batch_user, event_type,
    time_bucket(INTERVAL '3 hours', ts - INTERVAL 1 MICROSECOND, TIMESTAMP '2024-01-01 00:30:00') + INTERVAL 3 HOUR AS batch_time,
    least(value / 500, 1.0::DOUBLE) AS hate_score,
    1.0::DOUBLE + (event_id % 5) * 0.1::DOUBLE AS t_win_weight,
    1.0::DOUBLE - (event_id % 7) / 10.0::DOUBLE AS target_prob,
    (event_id % 2)::INT AS direct_reply, (1 + event_id % 3)::INT AS n_mentions
  FROM events)"""

SQL_LOG = """lg AS (
  SELECT batch_time, batch_user AS id, count(*) AS batch_tweets,
    CASE WHEN batch_user % 17 = 0 THEN 'error' ELSE 'ok' END AS status
  FROM m WHERE NOT (hour(batch_time) = 6 AND day(batch_time) % 2 = 1)
  GROUP BY ALL)"""

SQL_SRC = """src AS (SELECT * FROM (VALUES
  ('pool_a', TIMESTAMP '2024-01-01 00:30:00', TIMESTAMP '2024-01-12 00:30:00'),
  ('pool_b', TIMESTAMP '2024-01-12 03:30:00', TIMESTAMP '2050-01-01 00:00:00')) t(file, first_batch, last_batch))"""

SQL_POOL = """pool AS (
  SELECT 'pool_a' AS file, c_custkey AS id, c_mktsegment AS category, c_nationkey AS unit FROM customer WHERE c_mktsegment < 'G'
  UNION ALL SELECT 'pool_b', c_custkey, c_mktsegment, c_nationkey FROM customer)"""

SQL_RATINGS = f"""ratings AS (
  SELECT id, annotator, CASE WHEN {sql_uniform('gap', 'id', 'annotator')} >= 0.1
    THEN (({sql_uniform('base', 'id')} + {sql_uniform('rate', 'id', 'annotator')}) / 2 < 0.4)::INT END AS value
  FROM (SELECT doc_id AS id, unnest(['A00','A01','A02','A03','A04']) AS annotator FROM documents))"""
