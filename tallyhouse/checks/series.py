"""Time series, ranking and weights; the flagship series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse import views
from tallyhouse.checks.base import LOG, M, POOL, SRC, T, day, r, stamp
from tallyhouse.operators import windows as wn
from tallyhouse.operators.totals import hour_seasonal_factor
from tallyhouse.plans import violence_series as vs
from tallyhouse.session import scratch_path

QUERY = "category <> 'MACHINERY' AND unit <> 7"
START = "2024-01-01 00:30:00"


def _inputs(spark, sf):
    body = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    m = views.mentions(spark, sf).withColumn("text", F.concat(F.lit("@user"), F.col("batch_user").cast("string"), F.lit(" "), body))
    factors = spark.sql(
        "SELECT * FROM VALUES ('pool_a', 1.1D, 0.9D), ('pool_b', 1.0D, 1.0D) AS t(pool_filename, n_tweets_list_factor, n_hate_list_factor)"
    )
    return m, views.capture_log(spark, sf), views.pool_sources(spark), views.pool_members(spark, sf), factors


def _slots(spark, sf):
    return vs.slot_series(*_inputs(spark, sf), QUERY, views.BAD_ACCOUNTS, START)


def population_estimate(spark, sf):
    m, log, src, pools, factors = _inputs(spark, sf)
    scored = vs.final_probability(vs.drop_accounts(m, "batch_user", views.BAD_ACCOUNTS))
    ref = vs.drop_accounts(pools.where("file = 'pool_b'").where(QUERY), "id", views.BAD_ACCOUNTS)
    sel = vs.keep_ids(vs.select_direct_text(scored), ref, "batch_user")
    df = vs.population_estimate(sel, vs.load_log(log, src), ref, factors, START)
    return df.select(stamp("slot").alias("slot"), "n_accounts", r("pop_n_tweets", 9).alias("pop_n_tweets"), r("pop_n_hate", 9).alias("pop_n_hate"))


def seasonal_impute(spark, sf):
    df = _slots(spark, sf)
    return df.select(stamp("slot").alias("slot"), r("final_n_tweets", 9).alias("final_n_tweets"), r("final_n_hate", 9).alias("final_n_hate"))


def violence_series(spark, sf):
    return vs.daily_series(_slots(spark, sf), until="2024-01-29")


def publish(spark, sf):
    """The series from stored files, log sizes included, read back from the published CSV."""
    root = scratch_path(spark, "publish")
    m, log, sources, pools, factors = _inputs(spark, sf)
    sizes = log.groupBy("batch_time").agg(F.count(F.lit(1)).alias("batch_size"))
    whole = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    csv = lambda df, name: df.write.options(**whole).csv(f"{root}/{name}")
    csv(m.select("id", "text", "batch_user", "batch_time", "hate_score", "t_win_weight", "target_prob", "direct_reply", "n_mentions"), "mentions")
    csv(log.join(sizes, "batch_time").select("id", "batch_time", "batch_size", "status"), "log")
    csv(sources, "sources")
    csv(factors, "factors")
    for name in ("pool_a", "pool_b"):
        csv(pools.where(F.col("file") == name).drop("file"), f"pools/{name}.csv")
    schemas = {
        "mentions": "id LONG, text STRING, batch_user LONG, batch_time TIMESTAMP_NTZ, hate_score DOUBLE, t_win_weight DOUBLE, target_prob DOUBLE, "
                    "direct_reply INT, n_mentions INT",
        "log": "id LONG, batch_time TIMESTAMP_NTZ, batch_size LONG, status STRING", "pools": "id LONG, category STRING, unit INT",
        "factors": "pool_filename STRING, n_tweets_list_factor DOUBLE, n_hate_list_factor DOUBLE",
    }
    stored = {n: f"{root}/{n}" for n in ("mentions", "log", "sources", "pools", "factors")}
    return vs.publish(spark, stored, schemas, QUERY, views.BAD_ACCOUNTS, START, f"{root}/out", "2024-01-15", until="2024-01-29")


def period_series(spark, sf):
    return vs.period_series(_slots(spark, sf), 12)


def interpolate_linear(spark, sf):
    d = T(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    dom = F.dayofmonth("day")
    d = d.withColumn("v", F.when((dom > 2) & (dom % 4 != 0) & (dom < 30), F.col("v")))
    df = wn.interpolate_linear(d, "day", "v", "filled")
    return df.select(day("day").alias("day"), r("filled", 7).alias("filled"))


def rolling_mean(spark, sf):
    est = population_estimate(spark, sf)
    df = wn.rolling_mean(est, "slot", "pop_n_hate", 8, "mean_hate")
    return df.select("slot", r("mean_hate", 6).alias("mean_hate"))


def top_k(spark, sf):
    return wn.top_k(T(spark, sf, "events").select("event_id", "user_id", "value"), [F.col("value").desc(), F.col("event_id")], 25)


def keep_last(spark, sf):
    return wn.keep_last(T(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).drop("ts")


def _bins(spark, sf):
    """Share of direct replies and density in 50 score bins."""
    b = F.least(F.floor(F.col("hate_score") * 50), F.lit(49)).cast("int")
    g = views.mentions(spark, sf).groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.avg("direct_reply").alias("fraction"))
    return g.select((F.col("b") / F.lit(50.0)).alias("threshold"), F.col("n").cast("double").alias("density"), "fraction")


def reverse_cumsum_precision(spark, sf):
    df = wn.reverse_cumsum_precision(_bins(spark, sf), "threshold", "density", "fraction")
    return df.select(r("threshold", 4).alias("threshold"), r("precision", 9).alias("precision"))


def reverse_cumsum_recall(spark, sf):
    df = wn.reverse_cumsum_recall(_bins(spark, sf), "threshold", "density", "fraction")
    return df.select(r("threshold", 4).alias("threshold"), r("recall", 9).alias("recall"))


def savgol_density(spark, sf):
    df = wn.savgol_density(views.mentions(spark, sf), "hate_score")
    return df.select("bin", "n", r("density", 9).alias("density"))


def value_weights(spark, sf):
    df = wn.value_weights(T(spark, sf, "events"), "event_type")
    return df.select("event_type", "n_event_type", r("w_event_type", 12).alias("w_event_type"))


def clipped_target_weight(spark, sf):
    df = wn.clipped_target_weight(T(spark, sf, "events").select("event_id", "user_id"), "user_id", 60)
    return df.select("event_id", "n_target", r("target_weight", 12).alias("target_weight"))


def owner_weight(spark, sf):
    df = wn.owner_weight(T(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey")
    return df.select("o_orderkey", r("sample_weight", 12).alias("sample_weight"))


def sequence_check(spark, sf):
    return wn.sequence_check(T(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


def date_range(spark, sf):
    b = T(spark, sf, "orders").agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    days = wn.date_range(b, "lo", "hi").select(F.lit("day").alias("freq"), day("day").alias("day"))
    months = wn.date_range(b, "lo", "hi", "month").select(F.lit("month").alias("freq"), day("day").alias("day"))
    ten = wn.days_from(b, "lo", 10).select(F.lit("ten").alias("freq"), day("day").alias("day"))
    return days.union(months).union(ten)


_SERIES = f"""WITH {M}, {LOG}, {SRC}, {POOL},
  fac AS (SELECT * FROM (VALUES ('pool_a', 1.1::DOUBLE, 0.9::DOUBLE), ('pool_b', 1.0::DOUBLE, 1.0::DOUBLE)) t(file, ft, fh)),
  mm AS (SELECT *, hate_score * target_prob * t_win_weight AS wf FROM m WHERE batch_user NOT IN (3, 5)),
  ref AS (SELECT DISTINCT id FROM pool WHERE file = 'pool_b' AND category <> 'MACHINERY' AND unit <> 7 AND id NOT IN (3, 5)),
  good AS (SELECT batch_time, id, file FROM lg JOIN src ON batch_time BETWEEN first_batch AND last_batch
    WHERE status = 'ok' AND id IN (SELECT id FROM ref)),
  n AS (SELECT batch_time AS slot, count(*) AS n, min(file) AS file FROM good GROUP BY 1),
  s AS (SELECT batch_time AS slot, sum(t_win_weight) AS w, sum(wf) AS h FROM mm
    WHERE event_type <> 'error' AND (direct_reply = 1 OR n_mentions = 1) AND batch_user IN (SELECT id FROM ref) GROUP BY 1),
  g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:30:00', (SELECT max(batch_time) FROM good), INTERVAL 3 HOUR)) AS slot),
  e AS (SELECT g.slot, coalesce(n, 0) AS n_accounts, (SELECT count(*) FROM ref)::DOUBLE / n * w * ft AS pt,
      (SELECT count(*) FROM ref)::DOUBLE / n * h * fh AS ph
    FROM g LEFT JOIN n ON g.slot = n.slot LEFT JOIN s ON g.slot = s.slot LEFT JOIN fac ON n.file = fac.file)"""

_IMPUTE = _SERIES + """,
  hr AS (SELECT hour(batch_time) AS hour, sum(t_win_weight) AS w FROM mm GROUP BY 1),
  d AS (SELECT e.*, w / (SELECT max(w) FROM hr) AS si FROM e LEFT JOIN hr ON hour(slot) = hr.hour),
  a AS (SELECT *, row_number() OVER (ORDER BY slot) AS i,
      CASE WHEN count(pt / si) OVER f >= 7 THEN avg(pt / si) OVER f END AS mt,
      CASE WHEN count(ph / si) OVER f >= 7 THEN avg(ph / si) OVER f END AS mh
    FROM d WINDOW f AS (ORDER BY slot ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING)),
  b AS (SELECT *, last_value(mt IGNORE NULLS) OVER p AS pvt, last_value(CASE WHEN mt IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pit,
      first_value(mt IGNORE NULLS) OVER q AS nvt, first_value(CASE WHEN mt IS NOT NULL THEN i END IGNORE NULLS) OVER q AS nit,
      last_value(mh IGNORE NULLS) OVER p AS pvh, last_value(CASE WHEN mh IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pih,
      first_value(mh IGNORE NULLS) OVER q AS nvh, first_value(CASE WHEN mh IS NOT NULL THEN i END IGNORE NULLS) OVER q AS nih
    FROM a WINDOW p AS (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      q AS (ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  z AS (SELECT slot, coalesce(pt, si * CASE WHEN mt IS NOT NULL THEN mt WHEN pvt IS NULL THEN nvt WHEN nvt IS NULL THEN pvt
        ELSE pvt + (nvt - pvt) / (nit - pit) * (i - pit) END) AS ft,
      coalesce(ph, si * CASE WHEN mh IS NOT NULL THEN mh WHEN pvh IS NULL THEN nvh WHEN nvh IS NULL THEN pvh
        ELSE pvh + (nvh - pvh) / (nih - pih) * (i - pih) END) AS fh FROM b)"""

_BINS = f"""WITH {M}, b AS (SELECT least(floor(hate_score * 50), 49) / 50.0::DOUBLE AS t, count(*)::DOUBLE AS d, avg(direct_reply) AS f
    FROM m GROUP BY 1),
  s AS (SELECT *, coalesce(lead(t) OVER (ORDER BY t) - t, t - lag(t) OVER (ORDER BY t)) AS dt FROM b),
  c AS (SELECT t, sum(d * f * dt) OVER (ORDER BY t DESC) AS tp, sum(d * dt) OVER (ORDER BY t DESC) AS pp FROM s)"""

_SG = f"""WITH {M}, c AS (SELECT least(floor(hate_score * 199), 198)::INT AS bin, count(*) AS n FROM m GROUP BY 1),
  g AS (SELECT k::INT AS bin, coalesce(n, 0) AS n FROM range(199) t(k) LEFT JOIN c ON c.bin = k),
  x AS (SELECT g.*, list(n) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a FROM g),
  y AS (SELECT bin, n, CASE
      WHEN bin = 0 THEN (39*a[1]+8*a[2]-4*a[3]-4*a[4]+a[5]+4*a[6]-2*a[7]) / 42.0::DOUBLE
      WHEN bin = 1 THEN (8*a[1]+19*a[2]+16*a[3]+6*a[4]-4*a[5]-7*a[6]+4*a[7]) / 42.0::DOUBLE
      WHEN bin = 2 THEN (-4*a[1]+16*a[2]+19*a[3]+12*a[4]+2*a[5]-4*a[6]+a[7]) / 42.0::DOUBLE
      WHEN bin = 198 THEN (39*a[199]+8*a[198]-4*a[197]-4*a[196]+a[195]+4*a[194]-2*a[193]) / 42.0::DOUBLE
      WHEN bin = 197 THEN (8*a[199]+19*a[198]+16*a[197]+6*a[196]-4*a[195]-7*a[194]+4*a[193]) / 42.0::DOUBLE
      WHEN bin = 196 THEN (-4*a[199]+16*a[198]+19*a[197]+12*a[196]+2*a[195]-4*a[194]+a[193]) / 42.0::DOUBLE
      ELSE (-2*a[bin-2]+3*a[bin-1]+6*a[bin]+7*a[bin+1]+6*a[bin+2]+3*a[bin+3]-2*a[bin+4]) / 21.0::DOUBLE END AS s FROM x)"""

QUERIES = {
    "violence_series": (violence_series, _IMPUTE + """,
        y AS (SELECT CAST(slot - INTERVAL 90 MINUTE AS DATE) AS day, round_even(sum(ft), 0) AS t, round_even(sum(fh), 0) AS h FROM z GROUP BY 1)
        SELECT strftime(day, '%Y-%m-%d') AS day, t::BIGINT AS total, h::BIGINT AS violent, round_even(h / t * 100, 2) AS percent
        FROM y WHERE day <= DATE '2024-01-29'"""),
    "publish": (publish, _IMPUTE + """,
        y AS (SELECT CAST(slot - INTERVAL 90 MINUTE AS DATE) AS day, round_even(sum(ft), 0) AS t, round_even(sum(fh), 0) AS h FROM z GROUP BY 1)
        SELECT strftime(day, '%Y-%m-%d') AS day, t::BIGINT AS total, h::BIGINT AS violent, round_even(h / t * 100, 2) AS percent
        FROM y WHERE day <= DATE '2024-01-29'"""),
    "period_series": (period_series, _IMPUTE + """,
        y AS (SELECT ceil((epoch_us(slot) - epoch_us(TIMESTAMP '2024-01-01')) / 43200000000.0)::BIGINT AS k, round_even(sum(ft), 0) AS t,
          round_even(sum(fh), 0) AS h FROM z GROUP BY 1)
        SELECT strftime(TIMESTAMP '2024-01-01' + to_hours(k * 12), '%Y-%m-%d %H:%M:%S') AS day, t::BIGINT AS total, h::BIGINT AS violent,
          round_even(h / t * 100, 2) AS percent FROM y"""),
    "population_estimate": (population_estimate, _SERIES + """
        SELECT strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, n_accounts, round(pt, 9) AS pop_n_tweets, round(ph, 9) AS pop_n_hate FROM e"""),
    "seasonal_impute": (seasonal_impute, _IMPUTE + """
        SELECT strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, round(ft, 9) AS final_n_tweets, round(fh, 9) AS final_n_hate FROM z"""),
    "interpolate_linear": (interpolate_linear, """
        WITH d AS (SELECT ts::DATE AS day, sum(value) AS v FROM events GROUP BY 1),
        a AS (SELECT day, CASE WHEN day(day) > 2 AND day(day) % 4 <> 0 AND day(day) < 30 THEN v END AS v, row_number() OVER (ORDER BY day) AS i FROM d),
        b AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi,
          first_value(v IGNORE NULLS) OVER q AS nv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER q AS ni
          FROM a WINDOW p AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
            q AS (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT strftime(day, '%Y-%m-%d') AS day, round(CASE WHEN v IS NOT NULL THEN v WHEN pv IS NULL THEN nv WHEN nv IS NULL THEN pv
          ELSE pv + (nv - pv) / (ni - pi) * (i - pi) END, 7) AS filled FROM b"""),
    "rolling_mean": (rolling_mean, _SERIES + """
        SELECT strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, round(CASE WHEN count(*) OVER f = 8 THEN avg(coalesce(round(ph, 9), 0)) OVER f END, 6) AS mean_hate
        FROM e WINDOW f AS (ORDER BY slot ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"""),
    "top_k": (top_k, "SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 25"),
    "keep_last": (keep_last, """
        SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""),
    "reverse_cumsum_precision": (reverse_cumsum_precision, _BINS + " SELECT round(t, 4) AS threshold, round(tp / pp, 9) AS precision FROM c"),
    "reverse_cumsum_recall": (reverse_cumsum_recall, _BINS + """
        SELECT round(t, 4) AS threshold, round(tp / (SELECT max(tp) FROM c), 9) AS recall FROM c"""),
    "savgol_density": (savgol_density, _SG + """
        SELECT bin, n, round(s / (sum(n) OVER () / 199.0::DOUBLE), 9) AS density FROM y"""),
    "value_weights": (value_weights, """
        SELECT event_type, count(*) AS n_event_type, round(1.0::DOUBLE / count(*), 12) AS w_event_type FROM events GROUP BY 1"""),
    "clipped_target_weight": (clipped_target_weight, """
        SELECT event_id, n AS n_target, round(1.0::DOUBLE / greatest(n, 60), 12) AS target_weight
        FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""),
    "owner_weight": (owner_weight, """
        SELECT o_orderkey, round(1.0::DOUBLE / count(*) OVER (PARTITION BY o_custkey), 12) AS sample_weight FROM orders"""),
    "sequence_check": (sequence_check, """
        SELECT l_orderkey, max(l_linenumber)::BIGINT AS highest, count(*) AS n, (max(l_linenumber) = count(*))::INT AS complete
        FROM lineitem GROUP BY 1"""),
    "date_range": (date_range, """
        WITH b AS (SELECT min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders),
        d AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS d, lo FROM b)
        SELECT 'day' AS freq, strftime(d, '%Y-%m-%d') AS day FROM d UNION ALL SELECT 'month', strftime(d, '%Y-%m-%d') FROM d WHERE day(d) = 1
        UNION ALL SELECT 'ten', strftime(d, '%Y-%m-%d') FROM d WHERE d < lo + INTERVAL 10 DAY"""),
}
