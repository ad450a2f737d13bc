"""Set operations, keys and functional dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse import views
from tallyhouse.checks.base import M, RATINGS, T, r, stamp
from tallyhouse.operators import dependencies as fd
from tallyhouse.operators import sets as st


def union_all(spark, sf):
    c = T(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    s = T(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), "s_nationkey")
    df = st.union_all(c, s)
    return df.withColumn("s_nationkey", F.col("s_nationkey").cast("string"))


def append_new(spark, sf):
    c = T(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return st.append_new(c.where("c_mktsegment > 'C'").withColumn("origin", F.lit("new")),
                         c.where("c_custkey % 2 = 0").withColumn("origin", F.lit("old")), "c_custkey")


def symmetric_difference(spark, sf):
    d = T(spark, sf, "documents").select("text")
    b = T(spark, sf, "benchmark").select("text").union(d.where("length(text) > 900"))
    return st.symmetric_difference(d, b, "text").select(F.md5("text").alias("digest"), "side")


def drop_duplicates(spark, sf):
    o = T(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice")
    return st.drop_duplicates(o, ["o_custkey", "o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])


def drop_duplicates_but(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", "text")
    return st.drop_duplicates_but(d, "doc_id").select("doc_id", F.md5("text").alias("digest"))


def find_double_entries(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("owner"))
    return st.find_double_entries(o, "owner", 11, dropna=True)


def is_key(spark, sf):
    li = T(spark, sf, "lineitem")
    a = st.is_key(li, ["l_orderkey", "l_linenumber"]).withColumn("key", F.lit("order, line"))
    b = st.is_key(T(spark, sf, "orders"), ["o_orderkey"]).withColumn("key", F.lit("order"))
    return a.union(b)


def overlap_between_batches(spark, sf):
    df = st.overlap_between_batches(views.mentions(spark, sf), "batch_time", "batch_user", "3 HOURS")
    return df.select(stamp("batch_time").alias("batch_time"), "n_accounts", "n_common", r("overlap", 9).alias("overlap"))


def _places(spark, sf):
    return T(spark, sf, "nation").join(T(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


def is_one_to_one(spark, sf):
    a = fd.is_one_to_one(_places(spark, sf), "n_nationkey", "n_name").withColumn("pair", F.lit("nation key name"))
    odd = T(spark, sf, "customer").select("c_nationkey", F.when(F.col("c_nationkey") == 1, None).otherwise(
        F.when(F.col("c_nationkey") == 2, F.col("c_mktsegment")).otherwise(F.col("c_nationkey").cast("string"))).alias("label"))
    return a.union(fd.is_one_to_one(odd, "c_nationkey", "label").withColumn("pair", F.lit("nation label")))


def one_to_one_violations(spark, sf):
    return fd.one_to_one_violations(T(spark, sf, "customer"), "c_nationkey", "c_mktsegment")


def shared_children(spark, sf):
    o = T(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return fd.shared_children(o, ["o_custkey", "year"], "o_orderstatus")


def subcategory_pairs(spark, sf):
    return fd.subcategory_pairs(_places(spark, sf))


def drop_redundant(spark, sf):
    p = _places(spark, sf).withColumn("CD_nation", F.col("n_nationkey") + 100)
    return fd.drop_redundant(p.select("CD_nation", "n_nationkey", "n_name", "r_name", "n_regionkey"), "CD_")


def guess_data_types(spark, sf):
    li = T(spark, sf, "lineitem").withColumn("code", F.concat(F.lit("0"), F.col("l_linenumber").cast("string"))).withColumn(
        "gap", F.when(F.col("l_linenumber") != 2, F.col("l_quantity"))).withColumn("span", F.pow(F.lit(10.0), F.col("l_linenumber") / 2.0))
    return fd.guess_data_types(li)


def cross_source_mismatch(spark, sf):
    c = T(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    other = c.where("c_custkey % 50 <> 3").select(
        "c_custkey", F.when(F.col("c_custkey") % 20 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(F.col("c_custkey") % 30 != 0, F.col("c_nationkey")).alias("c_nationkey"))
    extra = c.where("c_custkey % 50 = 4").withColumn("c_custkey", F.col("c_custkey") + 10_000_000)
    return fd.cross_source_mismatch(c, other.union(extra), "c_custkey", ["c_mktsegment", "c_nationkey"])


def count_consistency(spark, sf):
    v = views.ratings(spark, sf)
    g = v.groupBy("id").agg(F.count("value").alias("n_violent"), F.count(F.when(F.col("annotator") < "A04", F.col("value"))).alias("n_target"))
    return fd.count_consistency(g, "id", ["n_violent", "n_target"])


_LI = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()

QUERIES = {
    "union_all": (union_all, """
        SELECT c_name AS name, c_acctbal AS balance, c_mktsegment, NULL::VARCHAR AS s_nationkey FROM customer
        UNION ALL SELECT s_name, s_acctbal, NULL, s_nationkey::VARCHAR FROM supplier"""),
    "append_new": (append_new, """
        SELECT c_custkey, c_mktsegment, 'new' AS origin FROM customer WHERE c_mktsegment > 'C'
        UNION ALL SELECT c_custkey, c_mktsegment, 'old' FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment <= 'C'"""),
    "symmetric_difference": (symmetric_difference, """
        WITH b AS (SELECT text FROM benchmark UNION SELECT text FROM documents WHERE length(text) > 900)
        SELECT md5(text) AS digest, 'left' AS side FROM (SELECT text FROM documents EXCEPT SELECT text FROM b)
        UNION ALL SELECT md5(text), 'right' FROM (SELECT text FROM b EXCEPT SELECT text FROM documents)"""),
    "drop_duplicates": (drop_duplicates, """
        SELECT o_custkey, o_orderpriority, o_orderkey, o_totalprice FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) = 1"""),
    "drop_duplicates_but": (drop_duplicates_but, "SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text"),
    "find_double_entries": (find_double_entries, """
        SELECT o_custkey AS owner, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n_rows FROM orders WHERE o_custkey % 7 <> 0
        QUALIFY count(*) OVER (PARTITION BY o_custkey) > 11"""),
    "is_key": (is_key, """
        SELECT n AS n_rows, d AS n_distinct, (n = d)::INT AS is_key, k AS key FROM (
          SELECT 'order, line' AS k, count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS d FROM lineitem
          UNION ALL SELECT 'order', count(*), count(DISTINCT o_orderkey) FROM orders)"""),
    "overlap_between_batches": (overlap_between_batches, f"""WITH {M}, s AS (SELECT DISTINCT batch_time, batch_user FROM m)
        SELECT strftime(a.batch_time, '%Y-%m-%d %H:%M:%S') AS batch_time, count(*) AS n_accounts, count(b.batch_user) AS n_common,
          round(count(b.batch_user) / count(*), 9) AS overlap
        FROM s a LEFT JOIN s b ON a.batch_time = b.batch_time + INTERVAL 3 HOUR AND a.batch_user = b.batch_user GROUP BY a.batch_time"""),
    "is_one_to_one": (is_one_to_one, """
        WITH o AS (SELECT c_nationkey AS a, CASE WHEN c_nationkey = 1 THEN NULL WHEN c_nationkey = 2 THEN c_mktsegment
            ELSE c_nationkey::VARCHAR END AS b FROM customer),
        p AS (SELECT 'nation key name' AS pair, n_nationkey AS a, n_name AS b FROM nation UNION ALL SELECT 'nation label', a, b FROM o),
        x AS (SELECT pair, min(n) AS lo, max(n) AS hi FROM (SELECT pair, a, count(DISTINCT b) AS n FROM p WHERE a IS NOT NULL GROUP BY ALL) GROUP BY 1),
        y AS (SELECT pair, min(n) AS lo, max(n) AS hi FROM (SELECT pair, b, count(DISTINCT a) AS n FROM p WHERE b IS NOT NULL GROUP BY ALL) GROUP BY 1)
        SELECT pair, x.lo AS min_right, x.hi AS max_right, y.lo AS min_left, y.hi AS max_left,
          (x.lo = 1 AND x.hi = 1 AND y.lo = 1 AND y.hi = 1)::INT AS one_to_one FROM x JOIN y USING (pair)"""),
    "one_to_one_violations": (one_to_one_violations, """
        SELECT DISTINCT c_nationkey, n AS n_partners, c_mktsegment FROM customer
          JOIN (SELECT c_nationkey, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1) USING (c_nationkey) WHERE n > 1"""),
    "shared_children": (shared_children, """
        WITH p AS (SELECT DISTINCT o_custkey, year(o_orderdate)::INT AS year, o_orderstatus FROM orders)
        SELECT o_custkey, year, count(*) OVER (PARTITION BY o_custkey, year) AS n_partners, o_orderstatus FROM p
        QUALIFY count(*) OVER (PARTITION BY o_custkey, year) > 1"""),
    "subcategory_pairs": (subcategory_pairs, """
        WITH j AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
        c AS (SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey', 'r_regionkey', 'r_name']) AS c),
        v AS (UNPIVOT (SELECT row_number() OVER () AS i, n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey,
          r_regionkey::VARCHAR AS r_regionkey, r_name FROM j) ON n_nationkey, n_name, n_regionkey, r_regionkey, r_name INTO NAME c VALUE v),
        p AS (SELECT a.c AS child, b.c AS parent, a.v, count(DISTINCT b.v) AS n FROM v a JOIN v b ON a.i = b.i AND a.c <> b.c GROUP BY ALL)
        SELECT child, parent FROM p GROUP BY ALL HAVING max(n) = 1"""),
    "drop_redundant": (drop_redundant, "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "guess_data_types": (guess_data_types, """
        WITH s AS (""" + " UNION ALL ".join(
        f"SELECT '{c}' AS c, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, count(DISTINCT {c}) AS d, bool_or({c} <> trunc({c})) AS frac, "
        f"bool_or({c}::VARCHAR LIKE '0%') AS zero FROM lineitem" for c in _LI) + """)
        SELECT c AS "column", CASE WHEN frac OR (NOT zero AND d > 30) THEN CASE WHEN lo > 0 AND log10(hi) - log10(lo) > 2 THEN 'log' ELSE 'num' END
          ELSE 'cat' END AS dtype FROM s
        UNION ALL SELECT * FROM (VALUES ('l_returnflag', 'cat'), ('l_linestatus', 'cat'), ('l_shipdate', 'num'), ('code', 'cat'), ('gap', 'cat'), ('span', 'log')) t(a, b)"""),
    "cross_source_mismatch": (cross_source_mismatch, """
        WITH o AS (SELECT c_custkey, CASE WHEN c_custkey % 20 = 0 THEN 'OTHER' ELSE c_mktsegment END AS s,
            CASE WHEN c_custkey % 30 <> 0 THEN c_nationkey END AS n FROM customer WHERE c_custkey % 50 <> 3)
        SELECT c_custkey, 'missing_right' AS problem, NULL AS "left", NULL AS "right" FROM customer WHERE c_custkey % 50 = 3
        UNION ALL SELECT c_custkey + 10000000, 'missing_left', NULL, NULL FROM customer WHERE c_custkey % 50 = 4
        UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment, s FROM customer JOIN o USING (c_custkey) WHERE c_mktsegment IS DISTINCT FROM s
        UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey::VARCHAR, n::VARCHAR FROM customer JOIN o USING (c_custkey) WHERE c_nationkey IS DISTINCT FROM n"""),
    "count_consistency": (count_consistency, f"""WITH {RATINGS}, g AS (SELECT id, count(value) AS n_violent,
          count(value) FILTER (WHERE annotator < 'A04') AS n_target FROM ratings GROUP BY 1)
        SELECT * FROM g WHERE n_violent <> n_target"""),
}
