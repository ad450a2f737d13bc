"""Filters, predicates and column alignment."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as TY

from tallyhouse import views
from tallyhouse.checks.base import M, T, r
from tallyhouse.operators import filters as fl


def _prefixed(spark, sf):
    """Conversation texts as mentions; every seventh conversation turn says nothing."""
    c = T(spark, sf, "conversations")
    empty = (F.col("conv_id") + F.col("turn")) % 7 == 0
    tail = F.when(F.col("turn") % 2 == 0, "https://t.co/Abcdef1234").otherwise("")
    body = F.concat(F.lit("@user_1 @other "), F.when(empty, tail).otherwise(F.col("text")))
    return c.select(
        "conv_id", "turn", body.alias("text"), (F.col("turn") % 2).cast("int").alias("direct_reply"),
        (1 + F.col("conv_id") % 2).cast("int").alias("n_mentions"),
    )


def select_direct_text(spark, sf):
    return fl.select_direct_text(_prefixed(spark, sf)).select("conv_id", "turn", F.md5("text").alias("digest"))


def filter_expr(spark, sf):
    return fl.filter_expr(T(spark, sf, "customer"), "c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 100")


def regex_flag(spark, sf):
    d = T(spark, sf, "documents")
    return d.select(
        "doc_id", fl.regex_flag(F.col("text"), r"the [a-z]+ing", case=False).cast("int").alias("has"),
        fl.regex_flag(F.col("text"), r"\d{3}", exists=False).cast("int").alias("lacks"),
    )


def standardize_columns(spark, sf):
    old = T(spark, sf, "customer").toDF("CODIGO_CLIENTE", "NOME_CLIENTE", "COD_NACAO", "VALOR_SALDO", "DESC_SEGMENTO")
    template = TY.StructType.fromDDL(
        "CD_CLIENTE BIGINT, NM_CLIENTE STRING, CD_NACAO INT, DS_SEGMENTO STRING, SG_UF STRING"
    )
    fixes = [("CODIGO_", "CD_"), ("COD_", "CD_"), ("NOME_", "NM_"), ("DESC_", "DS_"), ("VALOR_", "VR_")]
    return fl.standardize_columns(old, template, ["VR_SALDO"], fixes).withColumn("VR_SALDO", F.col("VR_SALDO").cast("double"))


def clear_null_tokens(spark, sf):
    o = T(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 5 == 0, "#NULO#").when(F.col("o_orderkey") % 5 == 1, "-1")
        .otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_custkey") % 3 == 0, F.lit(-3.0)).otherwise(F.col("o_totalprice")).cast("int").alias("price"),
    )
    return fl.clear_null_tokens(o).select("o_orderkey", "priority", F.col("price").cast("string").alias("price"))


_CODES = {"1-URGENT": "URGENTE", "2-HIGH": "ALTA", "5-LOW": "BAIXA"}


def map_values(spark, sf):
    p = F.col("o_orderpriority")
    return T(spark, sf, "orders").select(
        "o_orderkey", fl.map_values(p, _CODES).alias("kept"), fl.map_values(p, _CODES, "null").alias("strict")
    )


def legacy_to_full(spark, sf):
    short = T(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").toDF("ID", "SEGMENTO", "SALDO")
    template = TY.StructType.fromDDL("ID BIGINT, CD_SEGMENTO STRING, DS_SEGMENTO STRING, VR_SALDO DOUBLE, SG_UF STRING")
    codes = {"BUILDING": 1, "MACHINERY": 2, "HOUSEHOLD": 3}
    return fl.legacy_to_full(
        short, {"SEGMENTO": "DS_SEGMENTO", "SALDO": "VR_SALDO"}, template, {"CD_SEGMENTO": ("DS_SEGMENTO", codes)}
    )


def date_range_filter(spark, sf):
    df = fl.date_range_filter(T(spark, sf, "events"), "ts", "2024-01-05", "2024-01-09")
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 4).alias("total"))


def drop_bad_urls(spark, sf):
    """Page links where a third of the sites are given a post, invitation or video path."""
    p = T(spark, sf, "pages").select("page_id", F.concat(
        "url", F.when(F.col("page_id") % 6 == 0, "/p/Xy1").when(F.col("page_id") % 6 == 1, "/invites/z").otherwise("")
    ).alias("url"))
    return fl.drop_bad_urls(p)


def fill_from(spark, sf):
    c = T(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("n_nationkey"),
        F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("n_name"),
        F.when(F.col("c_custkey") % 3 != 0, F.lit("known")).alias("state"),
    )
    names = T(spark, sf, "nation").where("n_nationkey < 20").select("n_nationkey", "n_name")
    return fl.fill_from(c, names, "n_nationkey", ["n_name"], {"n_name": "OTHER", "state": "NONE"})


_PRE = r"""WITH p AS (SELECT conv_id, turn, '@user_1 @other ' || CASE WHEN (conv_id + turn) % 7 = 0 THEN
  CASE WHEN turn % 2 = 0 THEN 'https://t.co/Abcdef1234' ELSE '' END ELSE text END AS text,
  turn % 2 AS direct_reply, 1 + conv_id % 2 AS n_mentions FROM conversations)"""

QUERIES = {
    "select_direct_text": (select_direct_text, _PRE + r"""
        SELECT conv_id, turn, md5(text) AS digest FROM p
        WHERE NOT regexp_matches(text, '^(?:@[A-Za-z0-9_]{1,15} )+(?:https://t.co/[A-Za-z0-9]{10})?$')
          AND (direct_reply = 1 OR n_mentions = 1)"""),
    "filter_expr": (filter_expr, """
        SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 100"""),
    "regex_flag": (regex_flag, r"""
        SELECT doc_id, regexp_matches(text, 'the [a-z]+ing', 'i')::INT AS has,
          (NOT regexp_matches(text, '\d{3}'))::INT AS lacks FROM documents"""),
    "standardize_columns": (standardize_columns, """
        SELECT c_custkey AS "CD_CLIENTE", c_name AS "NM_CLIENTE", c_nationkey AS "CD_NACAO", c_mktsegment AS "DS_SEGMENTO",
          NULL::VARCHAR AS "SG_UF", c_acctbal AS "VR_SALDO" FROM customer"""),
    "clear_null_tokens": (clear_null_tokens, """
        SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 1 THEN o_orderpriority END AS priority,
          CASE WHEN o_custkey % 3 <> 0 THEN trunc(o_totalprice)::BIGINT::VARCHAR END AS price FROM orders"""),
    "map_values": (map_values, """
        SELECT o_orderkey, coalesce(s, o_orderpriority) AS kept, s AS strict FROM (SELECT *, CASE o_orderpriority
          WHEN '1-URGENT' THEN 'URGENTE' WHEN '2-HIGH' THEN 'ALTA' WHEN '5-LOW' THEN 'BAIXA' END AS s FROM orders)"""),
    "legacy_to_full": (legacy_to_full, """
        SELECT c_custkey AS "ID", CASE c_mktsegment WHEN 'BUILDING' THEN '1' WHEN 'MACHINERY' THEN '2'
          WHEN 'HOUSEHOLD' THEN '3' END AS "CD_SEGMENTO", c_mktsegment AS "DS_SEGMENTO", c_acctbal AS "VR_SALDO",
          NULL::VARCHAR AS "SG_UF" FROM customer"""),
    "date_range_filter": (date_range_filter, """
        SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
        WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' GROUP BY 1"""),
    "drop_bad_urls": (drop_bad_urls, """
        SELECT page_id, url FROM pages WHERE page_id % 6 > 1
          AND NOT (contains(url, '/p/') OR contains(url, '/invites/') OR contains(url, '/tv/'))"""),
    "fill_from": (fill_from, """
        SELECT c_custkey, c_nationkey AS n_nationkey, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment
          ELSE coalesce(n_name, 'OTHER') END AS n_name, CASE WHEN c_custkey % 3 <> 0 THEN 'known' ELSE 'NONE' END AS state
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20"""),
}
