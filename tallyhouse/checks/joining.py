"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse import views
from tallyhouse.checks.base import LOG, M, RATINGS, SRC, T, r, stamp
from tallyhouse.operators import joins as jn
from tallyhouse.plans.register import candidate_table


def attach(spark, sf):
    return candidate_table(
        T(spark, sf, "customer"), T(spark, sf, "nation"), T(spark, sf, "orders"), T(spark, sf, "lineitem")
    ).select("c_custkey", "unit_name", "voters", "n_assets", r("asset_value", 2).alias("asset_value"),
             F.col("votes").cast("string").alias("votes"))


def keep_facts(spark, sf):
    attrs = T(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    facts = T(spark, sf, "events").select("event_id", "user_id")
    return jn.keep_facts(attrs, facts, ["user_id"])


def pairs_of_same_owner(spark, sf):
    o = T(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.upper("o_orderpriority").alias("a"))
    c = T(spark, sf, "customer").select(
        F.col("c_custkey").alias("k"),
        F.when(F.col("c_custkey") % 2 == 0, "5-LOW").otherwise("1-URGENT").alias("b"),
    )
    return jn.pairs_of_same_owner(o, c, "k", "a", "b").select("o_orderkey", "k", "same")


def full_outer(spark, sf):
    joined = jn.full_outer(
        T(spark, sf, "labels").select("doc_id", "quality"), T(spark, sf, "documents").select("doc_id", "lang"), "doc_id"
    )
    return jn.unmatched(joined)


def keep_ids(spark, sf):
    m = views.mentions(spark, sf).select("id", "batch_user")
    ids = views.pool_members(spark, sf).where("file = 'pool_a'").select("id")
    bad = spark.createDataFrame([(i,) for i in views.BAD_ACCOUNTS], "id LONG")
    return jn.drop_ids(jn.keep_ids(m, ids, "batch_user"), bad, "batch_user")


def all_pairs(spark, sf):
    n = T(spark, sf, "nation").select("n_nationkey", "n_name")
    return jn.all_pairs(n, T(spark, sf, "region"))


def all_value_combinations(spark, sf):
    o = T(spark, sf, "orders").select(
        "o_orderstatus", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("o_orderpriority")
    )
    return jn.all_value_combinations(o, ["o_orderstatus", "o_orderpriority"])


def dense_labels(spark, sf):
    li = T(spark, sf, "lineitem").select(
        F.when(F.col("l_suppkey") != 7, F.col("l_suppkey")).alias("supplier"), "l_returnflag",
        F.when(F.col("l_linenumber") != 3, F.col("l_linestatus")).alias("l_linestatus"),
    )
    return jn.dense_labels(li, ["supplier"], ["l_returnflag", "l_linestatus"])


def interval_join(spark, sf):
    lg = views.capture_log(spark, sf)
    df = jn.interval_join(lg, views.pool_sources(spark), "batch_time", "first_batch", "last_batch")
    return df.groupBy("file", "status").agg(
        F.count(F.lit(1)).alias("n"), stamp(F.min("batch_time")).alias("first"), stamp(F.max("batch_time")).alias("last")
    )


def rater_pairs(spark, sf):
    df = jn.rater_pairs(views.ratings(spark, sf), views.RATERS)
    return df.select("rater_a", "rater_b", "n_common", "n_equal", r("agreement", 10).alias("agreement"))


def on_grid(spark, sf):
    lg = views.capture_log(spark, sf).where("status = 'ok'").groupBy(F.col("batch_time").alias("slot")).agg(
        F.count(F.lit(1)).alias("n")
    )
    bounds = lg.agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    grid = jn.slot_grid(bounds, F.col("lo"), F.col("hi"), "3 HOURS")
    return jn.on_grid(grid, lg, "slot").select(stamp("slot").alias("slot"), F.coalesce("n", F.lit(0)).alias("n"))


QUERIES = {
    "attach": (attach, """
        WITH v AS (SELECT c_nationkey, count(*) AS voters FROM customer GROUP BY 1),
        a AS (SELECT o_custkey, count(*) AS n_assets, sum(o_totalprice) AS val FROM orders GROUP BY 1),
        w AS (SELECT o_custkey, sum(l_quantity)::BIGINT AS votes FROM lineitem JOIN orders ON l_orderkey = o_orderkey
          WHERE l_linenumber = 1 GROUP BY 1)
        SELECT c_custkey, n_name AS unit_name, voters, coalesce(n_assets, 0) AS n_assets,
          round(coalesce(val, 0), 2) AS asset_value, votes::VARCHAR AS votes
        FROM customer c LEFT JOIN nation ON c.c_nationkey = n_nationkey LEFT JOIN v USING (c_nationkey)
          LEFT JOIN a ON c_custkey = a.o_custkey LEFT JOIN w ON c_custkey = w.o_custkey"""),
    "keep_facts": (keep_facts, """
        SELECT event_id, user_id, c_mktsegment FROM (SELECT * FROM customer WHERE c_acctbal > 0)
          RIGHT JOIN events ON c_custkey = user_id"""),
    "pairs_of_same_owner": (pairs_of_same_owner, """
        SELECT o_orderkey, o_custkey AS k, (o_orderpriority = CASE WHEN c_custkey % 2 = 0 THEN '5-LOW' ELSE '1-URGENT' END)::INT AS same
        FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "full_outer": (full_outer, """
        SELECT CASE WHEN l.doc_id IS NULL THEN 'right' WHEN d.doc_id IS NULL THEN 'left' ELSE 'both' END AS side, count(*) AS n
        FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1"""),
    "keep_ids": (keep_ids, """
        SELECT event_id AS id, user_id AS batch_user FROM events
        WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment < 'G') AND user_id NOT IN (3, 5)"""),
    "all_pairs": (all_pairs, "SELECT n_nationkey, n_name, r_regionkey, r_name FROM nation, region"),
    "all_value_combinations": (all_value_combinations, """
        SELECT * FROM (SELECT DISTINCT o_orderstatus FROM orders),
          (SELECT DISTINCT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS o_orderpriority FROM orders)"""),
    "dense_labels": (dense_labels, """
        SELECT * FROM (SELECT DISTINCT l_suppkey AS supplier FROM lineitem WHERE l_suppkey <> 7),
          (SELECT DISTINCT l_returnflag FROM lineitem),
          (SELECT DISTINCT CASE WHEN l_linenumber <> 3 THEN l_linestatus END AS l_linestatus FROM lineitem)"""),
    "interval_join": (interval_join, f"""WITH {M}, {LOG}, {SRC}
        SELECT file, status, count(*) AS n, strftime(min(batch_time), '%Y-%m-%d %H:%M:%S') AS first,
          strftime(max(batch_time), '%Y-%m-%d %H:%M:%S') AS last
        FROM lg JOIN src ON batch_time BETWEEN first_batch AND last_batch GROUP BY ALL"""),
    "rater_pairs": (rater_pairs, f"""WITH {RATINGS}
        SELECT a.annotator AS rater_a, b.annotator AS rater_b, count(*) AS n_common,
          count(*) FILTER (WHERE a.value = b.value) AS n_equal,
          round(count(*) FILTER (WHERE a.value = b.value) / count(*), 10) AS agreement
        FROM ratings a JOIN ratings b ON a.id = b.id AND a.annotator <> b.annotator
        WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL"""),
    "on_grid": (on_grid, f"""WITH {M}, {LOG}, n AS (SELECT batch_time, count(*) AS n FROM lg WHERE status = 'ok' GROUP BY 1),
        g AS (SELECT unnest(generate_series((SELECT min(batch_time) FROM n), (SELECT max(batch_time) FROM n), INTERVAL 3 HOUR)) AS slot)
        SELECT strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, coalesce(n, 0) AS n FROM g LEFT JOIN n ON slot = batch_time"""),
}
