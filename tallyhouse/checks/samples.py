"""Sampling and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse import views
from tallyhouse.checks.base import M, T, r, stamp
from tallyhouse.functions.hashing import uniform
from tallyhouse.operators import sampling as sm
from tallyhouse.views import sql_permutation
from tallyhouse.views import sql_uniform as U


def _pool(spark, sf):
    return T(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (1.0 / (1 + F.col("c_nationkey") % 4)).alias("sample_weight"))


def plan_batch(spark, sf):
    pool = _pool(spark, sf)
    n = pool.count() // 4
    first = sm.plan_batch(pool, n, "2022-08-16 03:30:00", "a")
    second = sm.plan_batch(pool, n, "2022-08-16 06:30:00", "b", previous=first)
    return first.union(second).select("id", "batch_size", stamp("batch_time").alias("batch_time"), "status")


def popular_targets(spark, sf):
    ids = views.pool_members(spark, sf).where("file = 'pool_a'").select("id")
    return sm.popular_targets(views.mentions(spark, sf).select("id", "batch_user"), 65, group=ids)


def two_way_weights(spark, sf):
    m = views.mentions(spark, sf).select("id", "batch_user", F.floor(F.col("hate_score") * 10).alias("prob_bin"))
    df = sm.two_way_weights(m, "batch_user", "prob_bin", 0.7)
    return df.select("id", "n_batch_user", "n_prob_bin", r("w_eq_sampling", 12).alias("w_eq_sampling"))


def sample_in_group(spark, sf):
    ids = views.pool_members(spark, sf).where("category <> 'MACHINERY' AND file = 'pool_b'").select("id")
    m = views.mentions(spark, sf).select("id", "batch_user", "hate_score")
    return sm.sample_in_group(m, ids, 60, 0.1, 0.7, 300, "s4").select("id", "batch_user", "prob_bin")


def sample_per_group(spark, sf):
    return sm.sample_per_group(T(spark, sf, "events").select("event_id", "event_type"), ["event_type"], "event_id", 40, "s5")


def top_then_sample(spark, sf):
    df = sm.top_then_sample(T(spark, sf, "events").select("event_id", "value"), "event_id", "value", 50, 150, "s6")
    return df


def sample_fixed_proportion(spark, sf):
    lb = T(spark, sf, "labels").select("doc_id", "toxic")
    df = sm.sample_fixed_proportion(lb, "toxic", "doc_id", 0.4, "s7")
    return df.groupBy("doc_id", "toxic").agg(F.count(F.lit(1)).alias("n"))


def random_set_split(spark, sf):
    return sm.random_set_split(T(spark, sf, "documents").select("doc_id"), [0.625, 0.125, 0.25], "doc_id", "s8")


def split_by_string(spark, sf):
    return sm.split_by_string(T(spark, sf, "documents").select("doc_id", "text"), "text", 0.3, "The ").select("doc_id", "in_test")


def split_by_date(spark, sf):
    df = sm.split_by_date(T(spark, sf, "events"), "ts", "2024-01-20")
    return df.groupBy("part").agg(F.count(F.lit(1)).alias("n"), stamp(F.min("ts")).alias("first"))


def split_by_date_and_string(spark, sf):
    df = sm.split_by_date_and_string(T(spark, sf, "events"), "ts", "2024-01-20", "props")
    return df.select("event_id", "part")


def stratified_split(spark, sf):
    return sm.stratified_split(T(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id", 0.3, "s11")


def shuffle_columns(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return sm.shuffle_columns(o, ["o_orderstatus", "o_orderpriority"], "o_orderkey", "s12")


# CRC-32 in SQL: the table of its 256 remainders, and the sum over the bytes of a text.
CRC_TABLE = (
    "list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), "
    "lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i))"
)


def crc32(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce({octets}, lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


_W = "1.0::DOUBLE / (1 + c_nationkey % 4)"
_BATCH = f"""a AS (SELECT c_custkey AS id FROM customer ORDER BY -ln({U('a', 'c_custkey')}) / ({_W}), c_custkey LIMIT (SELECT count(*) // 4 FROM customer)),
  b AS (SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT id FROM a) ORDER BY -ln({U('b', 'c_custkey')}) / ({_W}), c_custkey LIMIT (SELECT count(*) // 4 FROM customer))"""

QUERIES = {
    "plan_batch": (plan_batch, f"""WITH {_BATCH}
        SELECT id, (SELECT count(*) // 4 FROM customer)::BIGINT AS batch_size, '2022-08-16 03:30:00' AS batch_time, 'queue' AS status FROM a
        UNION ALL SELECT id, (SELECT count(*) // 4 FROM customer), '2022-08-16 06:30:00', 'queue' FROM b"""),
    "popular_targets": (popular_targets, f"""WITH {M}
        SELECT id, batch_user FROM m WHERE batch_user IN (SELECT c_custkey FROM customer WHERE c_mktsegment < 'G')
        QUALIFY count(*) OVER (PARTITION BY batch_user) >= 65"""),
    "two_way_weights": (two_way_weights, f"""WITH {M}, p AS (SELECT id, count(*) OVER (PARTITION BY batch_user) AS a,
          count(*) OVER (PARTITION BY floor(hate_score * 10)) AS b FROM m)
        SELECT id, a AS n_batch_user, b AS n_prob_bin, round(1.0::DOUBLE / a * (1.0::DOUBLE / b) ** 0.7::DOUBLE, 12) AS w_eq_sampling FROM p"""),
    "sample_in_group": (sample_in_group, f"""WITH {M}, p AS (SELECT id, batch_user, trunc(hate_score / 0.1::DOUBLE)::INT AS prob_bin FROM m
          WHERE batch_user IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY') QUALIFY count(*) OVER (PARTITION BY batch_user) >= 60),
        w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY batch_user) * (1.0::DOUBLE / count(*) OVER (PARTITION BY prob_bin)) ** 0.7::DOUBLE AS w FROM p)
        SELECT id, batch_user, prob_bin FROM w ORDER BY -ln({U('s4', 'id')}) / w, id LIMIT 300"""),
    "sample_per_group": (sample_per_group, f"""
        SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {U('s5', 'event_id')}, event_id) <= 40"""),
    "top_then_sample": (top_then_sample, f"""
        WITH best AS (SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 500)
        (SELECT event_id, value FROM best ORDER BY {U('s6-top', 'event_id')}, event_id LIMIT 50)
        UNION (SELECT event_id, value FROM events ORDER BY {U('s6-all', 'event_id')}, event_id LIMIT 150)"""),
    "sample_fixed_proportion": (sample_fixed_proportion, f"""
        WITH c AS (SELECT count(*) FILTER (WHERE toxic = 0) AS n0, count(*) FILTER (WHERE toxic = 1) AS n1 FROM labels),
        d AS (SELECT unnest(range(floor(n0 * (0.4::DOUBLE / (1 - 0.4::DOUBLE)) + 0.5)::BIGINT)) AS draw, n1 FROM c),
        k AS (SELECT floor({U('s7', '0', 'draw')} * n1)::BIGINT + 1 AS pos FROM d),
        p AS (SELECT doc_id, row_number() OVER (ORDER BY {U('s7-number', 'doc_id')}, doc_id) AS pos FROM labels WHERE toxic = 1)
        SELECT doc_id, 1 AS toxic, count(*) AS n FROM k JOIN p USING (pos) GROUP BY 1 UNION ALL SELECT doc_id, 0, 1 FROM labels WHERE toxic = 0"""),
    "random_set_split": (random_set_split, f"""
        WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY {U('s8', 'doc_id')}, doc_id) AS r, count(*) OVER () AS n FROM documents)
        SELECT doc_id, (r > n - round_even(n * 0.25::DOUBLE, 0))::INT + (r > n - round_even(n * 0.25::DOUBLE, 0) - round_even(n * 0.125::DOUBLE, 0))::INT AS "set" FROM p"""),
    "split_by_string": (split_by_string, f"""
        WITH t AS (SELECT {CRC_TABLE} AS tab)
        SELECT doc_id, (crc < floor(0.3::DOUBLE * 4294967296))::INT AS in_test
        FROM (SELECT doc_id, {crc32("replace(text, 'The ', '')")} AS crc FROM documents, t)"""),
    "split_by_date": (split_by_date, """
        SELECT CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' ELSE 'test' END AS part, count(*) AS n,
          strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first FROM events GROUP BY 1"""),
    "split_by_date_and_string": (split_by_date_and_string, f"""
        WITH t AS (SELECT {CRC_TABLE} AS tab)
        SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'train' WHEN {crc32("props")} < 2147483648 THEN 'test' ELSE 'validation' END AS part
        FROM events, t"""),
    "stratified_split": (stratified_split, f"""
        SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY {U('s11', 'doc_id')}, doc_id)
          <= round_even(count(*) OVER (PARTITION BY quality) * 0.3::DOUBLE, 0) THEN 'test' ELSE 'train' END AS part FROM labels"""),
    "shuffle_columns": (shuffle_columns, f"""
        WITH RECURSIVE s AS (SELECT o_orderstatus, o_orderpriority,
          row_number() OVER (ORDER BY {U('s12', 'o_orderkey')}, o_orderkey) - 1 AS number, number AS own FROM orders),
        {sql_permutation('s', 'o_orderstatus, own', 's12-o_orderpriority', 1, 'a')}
        SELECT a.own + 1 AS position, a.o_orderstatus, s.o_orderpriority FROM a JOIN s ON place = number"""),
}
