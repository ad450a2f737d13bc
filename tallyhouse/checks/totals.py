"""Grouped totals, profiles and panel statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse import views
from tallyhouse.checks.base import LOG, M, POOL, T, day, r, stamp
from tallyhouse.functions import text as tx
from tallyhouse.functions.urls import platform_flags
from tallyhouse.operators import terms as tm
from tallyhouse.operators import totals as to
from tallyhouse.operators.windows import agg_by_day, agg_period, keep_last
from tallyhouse.plans.violence_series import final_probability


def asset_features(spark, sf):
    df = to.asset_features(T(spark, sf, "orders"), ["o_custkey"], "o_totalprice")
    return df.select("o_custkey", "n_assets", r("asset_value", 2).alias("asset_value"))


def voters_by_unit(spark, sf):
    c = T(spark, sf, "customer").join(T(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return to.voters_by_unit(c.select("n_name", (F.col("c_custkey") % 100 + 1).alias("voters")), "n_name", "voters")


def nominal_votes(spark, sf):
    li = T(spark, sf, "lineitem").withColumn("kind", F.lit(2)).withColumn("q", F.col("l_quantity").cast("bigint"))
    return to.nominal_votes(li, "l_suppkey", "q", "l_linenumber", 1, "kind")


def votes_by(spark, sf):
    li = T(spark, sf, "lineitem").join(T(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    li = li.withColumn("q", F.col("l_quantity").cast("bigint"))
    return to.votes_by(li, "o_orderkey", "q", ["o_custkey", "o_orderstatus"], F.col("l_returnflag") != "R")


def unique_traits(spark, sf):
    j = T(spark, sf, "orders").join(T(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return to.unique_traits(j, ["o_custkey"], ["c_name", "c_mktsegment"])


def _scored(spark, sf):
    return final_probability(views.mentions(spark, sf))


def _ids(spark, sf, file):
    return views.pool_members(spark, sf).where(F.col("file") == file).select("id")


def avg_stat_per_user_day(spark, sf):
    df = to.avg_stat_per_user_day(_scored(spark, sf), "w_final_prob", _ids(spark, sf, "pool_a"))
    return df.select(r("avg_stat", 10).alias("avg_stat"))


def stat_change_factor(spark, sf):
    df = to.stat_change_factor(_scored(spark, sf), "t_win_weight", _ids(spark, sf, "pool_a"), _ids(spark, sf, "pool_b"))
    return df.select(r("factor", 10).alias("factor"))


def pool_factors(spark, sf):
    df = to.pool_factors(_scored(spark, sf), views.pool_members(spark, sf), "pool_b", "2024-01-12 03:30:00")
    return df.select("pool_filename", r("n_tweets_list_factor", 10).alias("n_tweets_list_factor"),
                     r("n_hate_list_factor", 10).alias("n_hate_list_factor"))


def hour_seasonal_factor(spark, sf):
    df = to.hour_seasonal_factor(views.mentions(spark, sf))
    return df.select("hour", r("season_index", 10).alias("season_index"))


def sum_per_day(spark, sf):
    df = agg_by_day(_scored(spark, sf), "batch_time", ["w_final_prob", "t_win_weight"])
    return df.select(day("day").alias("day"), r("w_final_prob").alias("hate"), r("t_win_weight").alias("tweets"))


def _holed(spark, sf):
    """Orders with missing priorities, statuses and prices."""
    o = T(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(F.col("o_custkey") % 4 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_custkey") % 9 != 0, F.col("o_totalprice")).alias("o_totalprice"), "o_custkey",
    )


def counts_table(spark, sf):
    df = to.counts_table(_holed(spark, sf), "o_orderpriority")
    return df.select("o_orderpriority", "n", r("percent").alias("percent"))


def map_counts(spark, sf):
    return to.map_counts(T(spark, sf, "customer"), ["c_nationkey", "c_mktsegment", "c_name"], 4)


def missing_profile(spark, sf):
    return to.missing_profile(_holed(spark, sf), only_missing=True)


def distinct_profile(spark, sf):
    return to.distinct_profile(T(spark, sf, "lineitem"), most=1000)


def non_unique_columns(spark, sf):
    n = T(spark, sf, "nation").withColumn("country", F.lit("BR")).withColumn(
        "half", F.when(F.col("n_nationkey") > 3, F.lit(1))
    ).withColumn("nothing", F.lit(None).cast("string"))
    return to.non_unique_columns(n)


def user_hate_totals(spark, sf):
    df = to.user_hate_totals(views.mentions(spark, sf))
    return df.select("batch_user", *[r(c, 10).alias(c) for c in df.columns[1:]])


_FLAGS = ["facebook", "twitter", "instagram", "youtube", "website", "nenhuma"]


def _urls(spark, sf):
    """Page links moved to well-known hosts by page number."""
    k = F.col("page_id") % 6
    host = F.when(k == 0, "facebook").when(k == 1, "twitter").when(k == 2, "instagram").when(k == 3, "youtube").otherwise("example")
    p = T(spark, sf, "pages").select((F.col("page_id") % 97).alias("c_custkey"), F.regexp_replace("url", "example", "{h}").alias("u"), host.alias("h"))
    return p.select("c_custkey", F.expr("replace(u, '{h}', h)").alias("url"))


def _links(spark, sf):
    return _urls(spark, sf).select("c_custkey", *platform_flags(F.col("url")))


def platform_use(spark, sf):
    return to.platform_use(T(spark, sf, "customer").select("c_custkey"), _links(spark, sf), "c_custkey", _FLAGS)


def _typed(spark, sf):
    ev = T(spark, sf, "events").join(T(spark, sf, "customer"), F.col("user_id") == F.col("c_custkey"))
    return ev.select("c_mktsegment", *[(F.col("event_type") == t).cast("int").alias(t) for t in ("click", "view", "error")])


def group_means(spark, sf):
    m = to.group_means(_typed(spark, sf), "c_mktsegment", ["click", "view", "error"])
    return m.select("c_mktsegment", *[r(c).alias(c) for c in ("click", "view", "error")])


def mean_difference(spark, sf):
    m = to.group_means(_typed(spark, sf), "c_mktsegment", ["click", "view", "error"])
    d = to.mean_difference(m, "c_mktsegment", ["click", "view", "error"], "BUILDING", "MACHINERY")
    return d.select("column", r("difference").alias("difference"))


def adjusted_platform_counts(spark, sf):
    use = to.platform_use(T(spark, sf, "customer").select("c_custkey"), _links(spark, sf), "c_custkey", _FLAGS)
    df = to.adjusted_platform_counts(use, _FLAGS, "nenhuma", 0.29)
    return df.select("column", "declared", r("adjusted", 6).alias("adjusted"))


_TYPES = ["click", "error", "purchase", "signup", "view"]


def presence_matrix(spark, sf):
    df = to.presence_matrix(T(spark, sf, "events"), F.to_date("ts"), "event_type", _TYPES)
    return df.withColumn("day", day("day"))


def coverage_per_day(spark, sf):
    df = to.coverage_per_day(T(spark, sf, "events"), F.to_date("ts"), "user_id")
    return df.select(day("day").alias("day"), "n_users", r("coverage").alias("coverage"))


def group_membership(spark, sf):
    return to.group_membership(T(spark, sf, "events"), "user_id", "event_type", _TYPES)


def box_stats(spark, sf):
    df = to.box_stats(T(spark, sf, "orders"), "o_totalprice", "o_orderpriority")
    return df.select("o_orderpriority", "n", *[r(c, 4).alias(c) for c in ("q1", "median", "q3", "low", "high")])


def batch_totals(spark, sf):
    return to.batch_totals(views.capture_log(spark, sf))


def capture_stats(spark, sf):
    m = views.mentions(spark, sf).withColumn("start", F.col("batch_time") - F.expr("INTERVAL 3 HOURS"))
    df = to.capture_stats(m, ["batch_time", "batch_user"], "created_at", "start", "batch_time", 3, F.col("event_type") == "error")
    return df.select(stamp("batch_time").alias("batch_time"), "batch_user", "n_mentions", "n_errors",
                     *[r(c, 10).alias(c) for c in ("expected_hours", "covered_hours", "t_win_weight")])


def error_profile(spark, sf):
    lg = views.capture_log(spark, sf)
    last = keep_last(lg.select("id", "batch_time", "status", "batch_tweets"), ["id"], ["batch_time"])
    joined = last.join(to.error_profile(lg), "id", "left")
    return joined.select("id", stamp("batch_time").alias("last"), "status", F.coalesce("n_errors", F.lit(0)).alias("n_errors"))


def corr_matrix(spark, sf):
    df = to.corr_matrix(T(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return df.select("a", "b", r("corr").alias("corr"))


def attribute_per_batch(spark, sf):
    c = T(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("followers"))
    df = to.attribute_per_batch(views.mentions(spark, sf), c, "batch_user", "batch_time", "followers", "t_win_weight")
    return df.select(stamp("batch_time").alias("batch_time"), r("mean_followers", 9).alias("mean_followers"), r("total").alias("total"))


def ngram_counts(spark, sf):
    d = T(spark, sf, "documents")
    names = [r["token"] for r in tm.frequent_names(T(spark, sf, "part"), "p_name", 100).collect()]  # a few hundred at most
    return tm.ngram_counts(d, "doc_id", tm.link_words(F.col("text")), min_df=10, stopwords=[*tm.URL_STOPWORDS, *names])


def vocab_size(spark, sf):
    return tm.vocab_size(T(spark, sf, "documents"), "text")


def agg_period_query(spark, sf):
    ev = T(spark, sf, "events").select(F.col("ts"), F.col("value"))
    return agg_period(ev, "ts", "value", 1).select(stamp("ts").alias("ts"), r("value", 4).alias("value"))


_S = f"""WITH {M}, s AS (SELECT *, hate_score * target_prob * t_win_weight AS w_final_prob FROM m)"""
_HOLED = """WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS o_orderpriority,
  CASE WHEN o_custkey % 4 <> 0 THEN o_orderstatus END AS o_orderstatus,
  CASE WHEN o_custkey % 9 <> 0 THEN o_totalprice END AS o_totalprice, o_custkey FROM orders)"""
_A = "(SELECT c_custkey FROM customer WHERE c_mktsegment < 'G')"
_USE = """WITH f AS (SELECT page_id % 97 AS c_custkey, page_id % 6 AS k FROM pages),
  g AS (SELECT c_custkey, max((k = 0)::INT) AS facebook, max((k = 1)::INT) AS twitter, max((k = 2)::INT) AS instagram,
    max((k = 3)::INT) AS youtube, max((k > 3)::INT) AS website FROM f GROUP BY 1),
  u AS (SELECT c.c_custkey, coalesce(facebook, 0) AS facebook, coalesce(twitter, 0) AS twitter, coalesce(instagram, 0) AS instagram,
    coalesce(youtube, 0) AS youtube, coalesce(website, 0) AS website, (g.c_custkey IS NULL)::INT AS nenhuma
    FROM customer c LEFT JOIN g ON c.c_custkey = g.c_custkey)"""
_TYPED = """WITH t AS (SELECT c_mktsegment, avg((event_type = 'click')::INT) AS click, avg((event_type = 'view')::INT) AS view,
  avg((event_type = 'error')::INT) AS error FROM events JOIN customer ON user_id = c_custkey GROUP BY 1)"""

# Words as the SQL engine cuts them: its own Unicode classes, on accent-free text.
SQL_WORDS = r"list_filter(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+'), lambda t: length(t) > 1)"
_STOP = "[" + ", ".join(f"'{w}'" for w in tm.URL_STOPWORDS) + "]"
_PUNCT = tx.PUNCTUATION.replace("'", "''")

QUERIES = {
    "asset_features": (asset_features, """
        SELECT o_custkey, count(*) AS n_assets, round(sum(o_totalprice), 2) AS asset_value FROM orders GROUP BY 1"""),
    "voters_by_unit": (voters_by_unit, """
        WITH u AS (SELECT n_name, sum(c_custkey % 100 + 1)::BIGINT AS voters FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
        SELECT * FROM u UNION ALL SELECT 'BR', sum(voters)::BIGINT FROM u"""),
    "nominal_votes": (nominal_votes, """
        SELECT l_suppkey, sum(l_quantity)::BIGINT AS votes FROM lineitem WHERE l_linenumber = 1 GROUP BY 1"""),
    "votes_by": (votes_by, """
        SELECT o_orderkey, o_custkey, o_orderstatus, sum(l_quantity)::BIGINT AS votes
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' GROUP BY ALL"""),
    "unique_traits": (unique_traits, """
        SELECT DISTINCT o_custkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey"""),
    "avg_stat_per_user_day": (avg_stat_per_user_day, _S + f"""
        SELECT round(sum(w_final_prob) FILTER (WHERE batch_user IN {_A}) / (SELECT count(*) FROM {_A})
          / count(DISTINCT batch_time) * 8, 10) AS avg_stat FROM s"""),
    "stat_change_factor": (stat_change_factor, _S + f"""
        SELECT round((sum(t_win_weight) FILTER (WHERE batch_user IN (SELECT c_custkey FROM customer)) / (SELECT count(*) FROM customer)
            / count(DISTINCT batch_time) * 8)
          / (sum(t_win_weight) FILTER (WHERE batch_user IN {_A}) / (SELECT count(*) FROM {_A})
            / count(DISTINCT batch_time) * 8), 10) AS factor FROM s"""),
    "pool_factors": (pool_factors, _S + f""", {POOL},
        u AS (SELECT batch_user, sum(t_win_weight) AS w, sum(w_final_prob) AS h FROM s WHERE batch_time >= TIMESTAMP '2024-01-12 03:30:00' GROUP BY 1),
        p AS (SELECT file, coalesce(sum(w), 0) / count(*) AS w, coalesce(sum(h), 0) / count(*) AS h
          FROM pool LEFT JOIN u ON id = batch_user GROUP BY 1)
        SELECT file AS pool_filename, round((SELECT w FROM p WHERE file = 'pool_b') / w, 10) AS n_tweets_list_factor,
          round((SELECT h FROM p WHERE file = 'pool_b') / h, 10) AS n_hate_list_factor FROM p"""),
    "hour_seasonal_factor": (hour_seasonal_factor, _S + """, h AS (SELECT hour(batch_time)::INT AS hour, sum(t_win_weight) AS w FROM s GROUP BY 1)
        SELECT hour, round(w / (SELECT max(w) FROM h), 10) AS season_index FROM h"""),
    "sum_per_day": (sum_per_day, _S + """
        SELECT strftime(CAST(batch_time - INTERVAL 90 MINUTE AS DATE), '%Y-%m-%d') AS day, round(sum(w_final_prob), 8) AS hate,
          round(sum(t_win_weight), 8) AS tweets FROM s GROUP BY 1"""),
    "counts_table": (counts_table, _HOLED + """
        SELECT o_orderpriority, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM h), 8) AS percent FROM h GROUP BY 1"""),
    "map_counts": (map_counts, """
        WITH v AS (SELECT 'c_nationkey' AS "column", c_nationkey::VARCHAR AS value FROM customer
          UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer UNION ALL SELECT 'c_name', c_name FROM customer),
        c AS (SELECT "column", value, count(*) AS n FROM v GROUP BY ALL)
        SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) <= 4"""),
    "missing_profile": (missing_profile, _HOLED + """
        SELECT 'o_orderpriority' AS "column", count(*) FILTER (WHERE o_orderpriority IS NULL) AS n_missing,
          round_even(count(*) FILTER (WHERE o_orderpriority IS NULL) * 100.0::DOUBLE / count(*), 2) AS percent FROM h
        UNION ALL SELECT 'o_orderstatus', count(*) FILTER (WHERE o_orderstatus IS NULL),
          round_even(count(*) FILTER (WHERE o_orderstatus IS NULL) * 100.0::DOUBLE / count(*), 2) FROM h
        UNION ALL SELECT 'o_totalprice', count(*) FILTER (WHERE o_totalprice IS NULL),
          round_even(count(*) FILTER (WHERE o_totalprice IS NULL) * 100.0::DOUBLE / count(*), 2) FROM h"""),
    "distinct_profile": (distinct_profile, " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", n AS n_distinct FROM (SELECT count(DISTINCT {c}) AS n FROM lineitem) WHERE n <= 1000"
        for c in "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split())),
    "non_unique_columns": (non_unique_columns, """
        WITH n AS (SELECT *, 'BR' AS country, CASE WHEN n_nationkey > 3 THEN 1 END AS half FROM nation)
        SELECT c AS "column" FROM (SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey', 'country', 'half']) AS c,
          unnest([count(DISTINCT n_nationkey), count(DISTINCT n_name), count(DISTINCT n_regionkey), count(DISTINCT country),
            count(DISTINCT coalesce(half, -1))]) AS k FROM n) WHERE k > 1"""),
    "user_hate_totals": (user_hate_totals, f"""WITH {M}, g AS (SELECT batch_user, sum(t_win_weight) AS n_tweets,
          sum(hate_score * target_prob * t_win_weight) AS n_hate, sum(hate_score * t_win_weight) AS a FROM m GROUP BY 1)
        SELECT batch_user, round(n_tweets, 10) AS n_tweets, round(n_hate, 10) AS n_hate, round(a - n_hate, 10) AS n_response,
          round(n_hate / n_tweets, 10) AS freq_hate, round((a - n_hate) / n_tweets, 10) AS freq_response FROM g"""),
    "platform_use": (platform_use, _USE + " SELECT * FROM u"),
    "group_means": (group_means, _TYPED + """
        SELECT c_mktsegment, round(click, 8) AS click, round(view, 8) AS view, round(error, 8) AS error FROM t"""),
    "mean_difference": (mean_difference, _TYPED + """, u AS (UNPIVOT t ON click, view, error INTO NAME "column" VALUE v)
        SELECT "column", round(sum(v) FILTER (WHERE c_mktsegment = 'BUILDING') - sum(v) FILTER (WHERE c_mktsegment = 'MACHINERY'), 8) AS difference
        FROM u GROUP BY 1"""),
    "adjusted_platform_counts": (adjusted_platform_counts, _USE + """,
        l AS (UNPIVOT (SELECT facebook, twitter, instagram, youtube, website, nenhuma FROM u)
          ON facebook, twitter, instagram, youtube, website, nenhuma INTO NAME "column" VALUE v),
        t AS (SELECT count(*) AS n, sum(nenhuma) AS n0 FROM u)
        SELECT "column", sum(v)::BIGINT AS declared, round(sum(v) * CASE WHEN "column" = 'nenhuma' THEN 1 - 0.29::DOUBLE
          ELSE 1 + 0.29::DOUBLE * any_value(n0) / (any_value(n) - any_value(n0)) END, 6) AS adjusted FROM l, t GROUP BY 1"""),
    "presence_matrix": (presence_matrix, "SELECT strftime(ts, '%Y-%m-%d') AS day, " + ", ".join(
        f"max((event_type = '{t}')::INT) AS {t}" for t in _TYPES) + " FROM events GROUP BY 1"),
    "coverage_per_day": (coverage_per_day, """
        SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS n_users,
          round(count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM events), 8) AS coverage FROM events GROUP BY 1"""),
    "group_membership": (group_membership, "SELECT user_id, " + ", ".join(
        f"count(*) FILTER (WHERE event_type = '{t}') AS in_{t}" for t in _TYPES)
        + ", count(DISTINCT event_type)::INT AS n_groups FROM events GROUP BY 1"),
    "box_stats": (box_stats, """
        WITH q AS (SELECT o_orderpriority, count(*) AS n, quantile_cont(o_totalprice, 0.25) AS q1,
          quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
        SELECT o_orderpriority, any_value(n) AS n, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median,
          round(any_value(q3), 4) AS q3,
          round(min(o_totalprice) FILTER (WHERE o_totalprice >= q1 - 1.5::DOUBLE * (q3 - q1)), 4) AS low,
          round(max(o_totalprice) FILTER (WHERE o_totalprice <= q3 + 1.5::DOUBLE * (q3 - q1)), 4) AS high
        FROM orders JOIN q USING (o_orderpriority) GROUP BY 1"""),
    "batch_totals": (batch_totals, f"""WITH {M}, {LOG}
        SELECT count(*) AS n_ok, sum(batch_tweets)::BIGINT AS total, round_even(avg(batch_tweets), 3) AS mean FROM lg WHERE status = 'ok'"""),
    "capture_stats": (capture_stats, f"""WITH {M}, g AS (SELECT batch_time, batch_user, count(*) AS n,
          count(*) FILTER (WHERE event_type = 'error') AS e, (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 3600000000.0::DOUBLE AS c FROM m GROUP BY 1, 2)
        SELECT strftime(batch_time, '%Y-%m-%d %H:%M:%S') AS batch_time, batch_user, n AS n_mentions, e AS n_errors,
          3.0::DOUBLE AS expected_hours, round(c, 10) AS covered_hours,
          round(CASE WHEN n >= 3 THEN CASE WHEN c > 0 THEN 3.0::DOUBLE / c END ELSE 1.0::DOUBLE END, 10) AS t_win_weight FROM g"""),
    "error_profile": (error_profile, f"""WITH {M}, {LOG}
        SELECT id, strftime(max(batch_time), '%Y-%m-%d %H:%M:%S') AS last, arg_max(status, batch_time) AS status,
          count(*) FILTER (WHERE status = 'error') AS n_errors FROM lg GROUP BY 1"""),
    "corr_matrix": (corr_matrix, " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, " + ("1.0::DOUBLE" if a == b else f"round(corr({a}, {b}), 8)") + " AS corr FROM "
        + ("(SELECT 1)" if a == b else "lineitem")
        for a in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") for b in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))),
    "attribute_per_batch": (attribute_per_batch, f"""WITH {M}, p AS (SELECT batch_time, batch_user, sum(t_win_weight) AS t FROM m GROUP BY ALL)
        SELECT strftime(batch_time, '%Y-%m-%d %H:%M:%S') AS batch_time, round(avg(c_acctbal), 9) AS mean_followers, round(sum(t), 8) AS total
        FROM p LEFT JOIN customer ON batch_user = c_custkey GROUP BY 1"""),
    "ngram_counts": (ngram_counts, f"""
        WITH names AS (SELECT t FROM (SELECT unnest({SQL_WORDS.format("lower(regexp_replace(p_name, '[0-9]+', ' ', 'g'))")}) AS t FROM part)
          GROUP BY t HAVING count(*) > 100),
        stop AS (SELECT coalesce(list(t), []) || {_STOP} AS s FROM names),
        w AS (SELECT doc_id, list_filter({SQL_WORDS.format(f"regexp_replace(translate(lower(text), '{_PUNCT}', '{' ' * len(tx.PUNCTUATION)}'), '[0-9]+', '', 'g')")},
          lambda t: NOT list_contains(s, t)) AS w FROM documents, stop),
        t AS (SELECT doc_id, unnest(w) AS term FROM w UNION ALL
          SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w)
        SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10"""),
    "vocab_size": (vocab_size, f"""
        SELECT count(DISTINCT t) AS vocabulary FROM (SELECT unnest({SQL_WORDS.format("lower(strip_accents(text))")}) AS t FROM documents)"""),
    "agg_period": (agg_period_query, """
        WITH b AS (SELECT date_trunc('day', min(ts))::TIMESTAMP AS o, min(ts) AS lo, max(ts) AS hi FROM events),
        k AS (SELECT o, unnest(range(ceil((epoch_us(lo) - epoch_us(o)) / 3600000000.0)::BIGINT, ceil((epoch_us(hi) - epoch_us(o)) / 3600000000.0)::BIGINT + 1)) AS k FROM b),
        v AS (SELECT ceil((epoch_us(ts) - epoch_us(o)) / 3600000000.0)::BIGINT AS k, sum(value) AS v FROM events, b GROUP BY 1)
        SELECT strftime(o + to_hours(k.k), '%Y-%m-%d %H:%M:%S') AS ts, round(coalesce(v, 0), 4) AS value FROM k LEFT JOIN v ON k.k = v.k"""),
}
