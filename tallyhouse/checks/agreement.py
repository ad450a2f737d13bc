"""Rater agreement, posteriors, calibration and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyhouse import views
from tallyhouse.checks.base import M, RATINGS, T, r
from tallyhouse.functions.hashing import uniform
from tallyhouse.operators import agreement as ag
from tallyhouse.operators import posterior as po
from tallyhouse.operators import resampling as rs
from tallyhouse.checks.totals import _USE, _urls
from tallyhouse.plans.register import platform_report as report
from tallyhouse.views import sql_permutation
from tallyhouse.views import sql_uniform as U


def frac_by_categories(spark, sf):
    df = rs.frac_by_categories(T(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])
    return df.select("o_orderstatus", "o_orderpriority", r("share", 10).alias("share"))


def permutation_distribution(spark, sf):
    c = T(spark, sf, "customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") > 0).cast("int").alias("positive"))
    df = rs.permutation_distribution(c, ["c_mktsegment", "positive"], "c_custkey", 20, "p2")
    return df.select("replica", "c_mktsegment", "positive", r("share", 10).alias("share"))


def _corrs(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("owner"))
    return rs.permutation_correlation(o, "o_totalprice", "owner", "o_orderkey", 20, "p3")


def permutation_correlation(spark, sf):
    return _corrs(spark, sf).select("replica", r("corr", 9).alias("corr"))


def p_value(spark, sf):
    real = T(spark, sf, "orders").agg(F.corr("o_totalprice", "o_custkey").alias("c")).scalar()
    return rs.p_value(_corrs(spark, sf), "corr", real)


def count_class_votes(spark, sf):
    return ag.count_class_votes(views.ratings(spark, sf))


def fleiss_kappa(spark, sf):
    v = views.ratings(spark, sf).withColumn("value", F.coalesce("value", F.lit(2)))
    df = ag.fleiss_kappa(ag.count_class_votes(v))
    return df.select("n_items", "n_votes", r("kappa", 10).alias("kappa"))


def kappa_report(spark, sf):
    v = views.ratings(spark, sf).withColumn(
        "value", F.when((F.col("annotator") == "A04") & (uniform("few", "id") < 0.7), None).otherwise(F.col("value")))
    n = T(spark, sf, "documents").count()
    df = ag.kappa_report(v, n // 2, 20, "p7")
    return df.select("replica", "n_items", "n_votes", r("kappa", 10).alias("kappa"))


def confusion_matrix(spark, sf):
    df = ag.confusion_matrix(T(spark, sf, "labels"), "quality", "toxic", "all")
    return df.select("actual", "predicted", r("n", 10).alias("n"))


def rater_bias_sigma(spark, sf):
    df = ag.rater_bias_sigma(views.ratings(spark, sf), "A00", views.RATERS)
    return df.select("annotator", "n01", "n10", r("n_sigma", 9).alias("n_sigma"))


def majority_label(spark, sf):
    df = ag.majority_label(views.ratings(spark, sf), default=1)
    return df.select("id", F.col("final").cast("string").alias("final"))


def n_votes(spark, sf):
    return ag.n_votes(views.ratings(spark, sf))


def _two_labels(spark, sf):
    v = views.ratings(spark, sf)
    other = v.select("id", "annotator", F.when(uniform("target", "id", "annotator") > 0.2, F.col("value")).alias("value"))
    return v.withColumn("label", F.lit("violent")).unionByName(other.withColumn("label", F.lit("target")))


def votes_by_rater(spark, sf):
    return ag.votes_by_rater(_two_labels(spark, sf), ["violent", "target"])


def join_rater_tables(spark, sf):
    v = views.ratings(spark, sf, ["text"]).where("id IS NOT NULL")
    tables = {a: v.where(F.col("annotator") == a).select("id", "text", F.col("value").alias("violent")) for a in views.RATERS}
    df = ag.join_rater_tables(tables, ["text"], ["violent"])
    return df.select("id", *[F.col(c).cast("string").alias(c) for c in df.columns[1:]])


def strict_corpus(spark, sf):
    d = T(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    w = views.ratings(spark, sf).groupBy("id").agg(*[
        F.coalesce(F.max(F.when(F.col("annotator") == a, F.col("value"))), F.lit(0)).alias(a) for a in ("A00", "A01", "A02")])
    w = w.withColumn("combined", (F.col("A00") + F.col("A01") + F.col("A02") >= 2).cast("int")).join(d, "id")
    df = ag.strict_corpus(w, "combined", ["A00", "A01", "A02"]).unionByName(
        T(spark, sf, "benchmark").select(F.lit(0).alias("label"), "text"))
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def _by_lang(spark, sf):
    return T(spark, sf, "labels").join(T(spark, sf, "documents").select("doc_id", "lang"), "doc_id")


def _groups(spark, sf):
    g = _by_lang(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k"))
    return g.withColumn("mode", F.lit(0.15))


def binomial_posterior(spark, sf):
    post = po.binomial_posterior(_groups(spark, sf), ["lang"], "mode", "n", "k", 0.005)
    return post.select("lang", r("p", 6).alias("p"), r("density", 8).alias("density"))


def posterior_moments(spark, sf):
    post = po.binomial_posterior(_groups(spark, sf), ["lang"], "mode", "n", "k", 0.005)
    return po.posterior_moments(post, ["lang"], 0.005).select("lang", r("mean", 9).alias("mean"), r("deviation", 9).alias("deviation"))


def credible_interval(spark, sf):
    post = po.binomial_posterior(_groups(spark, sf), ["lang"], "mode", "n", "k", 0.0005)
    return po.credible_interval(post, ["lang"], 0.0005).select("lang", r("low", 6).alias("low"), r("high", 6).alias("high"))


def binomial_stats(spark, sf):
    df = po.binomial_stats(_by_lang(spark, sf), "lang", ["quality", "toxic"])
    return df.select("lang", "column", "trials", "successes", r("freq", 9).alias("freq"), r("low", 6).alias("low"), r("high", 6).alias("high"))


def interval_errors(spark, sf):
    df = po.interval_errors(po.binomial_stats(_by_lang(spark, sf), "lang", ["toxic"], dp=0.001))
    return df.select("lang", r("err_low", 8).alias("err_low"), r("err_high", 8).alias("err_high"))


def platform_report(spark, sf):
    df = report(T(spark, sf, "customer"), _urls(spark, sf), "c_custkey", "url", "c_mktsegment", ["facebook", "website", "nenhuma"], 0.001)
    return df.select("c_mktsegment", "column", "trials", "successes", r("low", 6).alias("low"), r("high", 6).alias("high"))


def _judged(spark, sf):
    """Mentions with a human label that is likelier for high scores; one in five has no vote."""
    m = views.mentions(spark, sf).select("id", "event_type", "hate_score")
    label = (uniform("human", "id") < 0.07 + 0.758 * F.col("hate_score")).cast("int")
    return m.withColumn("violent", label).withColumn("n_votes", (uniform("votes", "id") * 5).cast("int"))


def score_calibration(spark, sf):
    df = po.score_calibration(_judged(spark, sf), "hate_score", "violent", "n_votes")
    return df.select("bin", "trials", "successes", r("mean_score", 9).alias("mean_score"), r("low", 6).alias("low"), r("high", 6).alias("high"))


_A, _B = (-0.1, 0.3, 0.02), (0.2, 1.2, 0.05)


def _calibrated(spark, sf):
    return po.calibration_posterior(po.score_calibration(_judged(spark, sf), "hate_score", "violent", "n_votes", dp=0.01), _A, _B)


def calibration_posterior(spark, sf):
    return _calibrated(spark, sf).select(r("a", 6).alias("a"), r("b", 6).alias("b"), r("density", 6).alias("density"))


def posterior_mode(spark, sf):
    return po.posterior_mode(_calibrated(spark, sf)).select(r("a", 6).alias("a"), r("b", 6).alias("b"), r("density", 6).alias("density"))


def hpd_levels(spark, sf):
    return po.hpd_levels(_calibrated(spark, sf), _A[2] * _B[2]).select("mass", r("level", 6).alias("level"))


def ks_two_sample(spark, sf):
    df = rs.ks_two_sample(views.mentions(spark, sf), "hate_score", "event_type", "click", "error")
    return df.select(r("statistic", 10).alias("statistic"), r("p_value", 8).alias("p_value"))


def count_estimators(spark, sf):
    df = rs.count_estimators(_judged(spark, sf).withColumn("hate_score", F.col("hate_score") * 2), "violent", "hate_score", "id", 7, "p22")
    return df.select("estimator", r("bias", 7).alias("bias"), r("deviation", 7).alias("deviation"))


def resampled_scores(spark, sf):
    d = T(spark, sf, "labels").select("doc_id", "toxic", uniform("prob", "doc_id").alias("prob"))
    df = rs.resampled_scores(d, "toxic", "prob", "doc_id", 0.4, 10, "p23")
    return df.select("replica", *[r(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def _kappa(source, by=""):
    """Kappa of a table (by, id, value) of votes as SQL."""
    b = f"{by}, " if by else ""
    on = f"USING ({by})" if by else "ON true"
    g = f"GROUP BY {by}" if by else ""
    return f"""c AS (SELECT {b}id, value, count(*) AS n FROM {source} GROUP BY ALL),
      i AS (SELECT {b}id, sum(n) AS m, sum(n * (n - 1)) AS s FROM c GROUP BY ALL),
      pa AS (SELECT {b}count(*) AS n_items, max(m)::BIGINT AS n_votes, avg(s::DOUBLE / (m * (m - 1))) AS p FROM i {g}),
      t AS (SELECT {b}value, sum(n)::DOUBLE AS t FROM c GROUP BY ALL), pe AS (SELECT {b}sum(t * t) / sum(t) ** 2 AS e FROM t {g})
      SELECT {b}n_items, n_votes, round((p - e) / (1 - e), 10) AS kappa FROM pa JOIN pe {on}"""


_SHUFFLED = f"""RECURSIVE s AS (SELECT c_mktsegment, (c_acctbal > 0)::INT AS positive,
    row_number() OVER (ORDER BY {U('p2', 'c_custkey')}, c_custkey) - 1 AS number FROM customer),
  {sql_permutation('s', 'c_mktsegment', 'p2-positive', 20, 'a')}"""
_CORR = f"""RECURSIVE s AS (SELECT o_totalprice, o_custkey::DOUBLE AS owner,
    row_number() OVER (ORDER BY {U('p3', 'o_orderkey')}, o_orderkey) - 1 AS number FROM orders),
  {sql_permutation('s', 'o_totalprice', 'p3-owner', 20, 'a')},
  k AS (SELECT replica, corr(a.o_totalprice, s.owner) AS corr FROM a JOIN s ON place = number GROUP BY 1)"""
_LANG = "l AS (SELECT lang, quality, toxic FROM labels JOIN documents USING (doc_id))"


def _posterior(source, dp):
    """Posterior of a table (g, mode, n, k), mode strictly inside (0, 1)."""
    pts = round(1 / dp)
    return f"""gr AS (SELECT g, mode, n, k, i * {dp}::DOUBLE AS p FROM {source}, range({pts}) t(i)),
      lg AS (SELECT *, CASE WHEN k = 0 THEN 0 WHEN p > 0 THEN k * ln(p) END + CASE WHEN n = k THEN 0 ELSE (n - k) * ln(1 - p) END AS l FROM gr),
      rw AS (SELECT *, coalesce(exp(l - max(l) OVER (PARTITION BY g)), 0)
        * CASE WHEN p < mode THEN 2 * p / mode ELSE 2 * (1 - p) / (1 - mode) END AS r FROM lg),
      ps AS (SELECT g, p, r / (sum(r) OVER (PARTITION BY g) * {dp}::DOUBLE) AS d FROM rw),
      cu AS (SELECT *, sum(d) OVER (PARTITION BY g ORDER BY p) * {dp}::DOUBLE AS c FROM ps),
      ci AS (SELECT g, arg_min(p, (c - 0.05::DOUBLE) ** 2) AS low, arg_min(p, (c - 0.95::DOUBLE) ** 2) AS high FROM cu GROUP BY 1)"""


_LG = f"{_LANG}, gs AS (SELECT lang AS g, 0.15::DOUBLE AS mode, count(*) AS n, sum(toxic)::BIGINT AS k FROM l GROUP BY 1)"
_JUDGED = f"""{M}, j AS (SELECT id, event_type, hate_score, ({U('human', 'id')} < 0.07::DOUBLE + 0.758::DOUBLE * hate_score)::INT AS violent,
  trunc({U('votes', 'id')} * 5)::INT AS n_votes FROM m),
  jb AS (SELECT trunc(hate_score / 0.1::DOUBLE)::INT AS g, count(*) AS n, sum(violent)::BIGINT AS k, avg(hate_score) AS x,
    (SELECT avg(violent) FROM j WHERE n_votes > 0) AS mode FROM j WHERE n_votes > 0 GROUP BY 1)"""
_CAL = f"""WITH {_JUDGED}, ab AS (SELECT -0.1::DOUBLE + i * 0.02::DOUBLE AS a, 0.2::DOUBLE + q * 0.05::DOUBLE AS b FROM range(20) t(i), range(20) u(q)),
  pr AS (SELECT a, b, CASE WHEN (1.2::DOUBLE - abs(b)) / 2 < 0.02 THEN 0 ELSE exp(-1 * (a - (1 - b) / 2) ** 2 / 2 / ((1.2::DOUBLE - abs(b)) / 2) ** 2) END
    * CASE WHEN 1 - b + exp(-0.7::DOUBLE - 0.81::DOUBLE) <= 0 THEN 0 ELSE exp(-1 * (ln(CASE WHEN 1 - b + exp(-1.51::DOUBLE) > 0 THEN 1 - b + exp(-1.51::DOUBLE) END) + 0.7::DOUBLE) ** 2 / 2 / 0.81::DOUBLE)
      / (1 - b + exp(-1.51::DOUBLE)) / 0.9::DOUBLE / sqrt(2 * pi()) END AS w FROM ab),
  ll AS (SELECT a, b, sum(CASE WHEN p >= 0 AND p <= 1 THEN CASE WHEN k = 0 THEN 0 WHEN p > 0 THEN k * ln(p) ELSE '-inf'::DOUBLE END
      + CASE WHEN n = k THEN 0 WHEN p < 1 THEN (n - k) * ln(1 - p) ELSE '-inf'::DOUBLE END ELSE '-inf'::DOUBLE END) AS l
    FROM (SELECT a, b, n, k, a + b * x AS p FROM ab, jb) GROUP BY 1, 2),
  un AS (SELECT a, b, exp(l - (SELECT max(l) FROM ll)) * w AS u FROM ll JOIN pr USING (a, b)),
  po AS (SELECT a, b, u / ((SELECT sum(u) FROM un) * 0.02::DOUBLE * 0.05::DOUBLE) AS d FROM un)"""

QUERIES = {
    "frac_by_categories": (frac_by_categories, """
        SELECT o_orderstatus, o_orderpriority, round(count(*) / (SELECT count(*) FROM orders), 10) AS share FROM orders GROUP BY ALL"""),
    "permutation_distribution": (permutation_distribution, f"""WITH {_SHUFFLED}
        SELECT replica, a.c_mktsegment, positive, round(count(*) / (SELECT count(*) FROM customer), 10) AS share
        FROM a JOIN s ON place = number GROUP BY ALL"""),
    "permutation_correlation": (permutation_correlation, f"WITH {_CORR} SELECT replica, round(corr, 9) AS corr FROM k"),
    "p_value": (p_value, f"""WITH {_CORR} SELECT avg((corr > (SELECT corr(o_totalprice, o_custkey) FROM orders))::INT) AS p_value, count(*) AS n_trials FROM k"""),
    "count_class_votes": (count_class_votes, f"WITH {RATINGS} SELECT id, value, count(*) AS n FROM ratings WHERE value IS NOT NULL GROUP BY ALL"),
    "fleiss_kappa": (fleiss_kappa, f"WITH {RATINGS}, v AS (SELECT id, coalesce(value, 2) AS value FROM ratings), " + _kappa("v")),
    "kappa_report": (kappa_report, f"""WITH {RATINGS}, v AS (SELECT id, annotator, value FROM ratings
          WHERE value IS NOT NULL AND NOT (annotator = 'A04' AND {U('few', 'id')} < 0.7)),
        rt AS (SELECT annotator FROM v GROUP BY 1 HAVING count(*) > (SELECT count(*) // 2 FROM documents)),
        kp AS (SELECT * FROM v WHERE annotator IN (SELECT annotator FROM rt)),
        fl AS (SELECT * FROM kp WHERE id IN (SELECT id FROM kp GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM rt))),
        e AS (SELECT -1 AS replica, id, value FROM fl UNION ALL
          SELECT rep::INT, row_number() OVER (PARTITION BY rep, annotator ORDER BY {U('p7', 'rep', 'annotator', 'id')}, id), value FROM fl, range(20) t(rep)),
        """ + _kappa("e", "replica")),
    "confusion_matrix": (confusion_matrix, """
        SELECT a::INT AS actual, p::INT AS predicted, round((SELECT count(*) FROM labels WHERE quality = a AND toxic = p) / (SELECT count(*) FROM labels), 10) AS n
        FROM range(2) t(a), range(2) u(p)"""),
    "rater_bias_sigma": (rater_bias_sigma, f"""WITH {RATINGS}, p AS (SELECT b.annotator, count(*) FILTER (WHERE a.value = 0 AND b.value = 1) AS n01,
          count(*) FILTER (WHERE a.value = 1 AND b.value = 0) AS n10 FROM ratings a JOIN ratings b USING (id) WHERE a.annotator = 'A00' AND b.annotator <> 'A00' GROUP BY 1)
        SELECT annotator, n01, n10, round((n01 - n10) / sqrt(n01 + n10), 9) AS n_sigma FROM p"""),
    "majority_label": (majority_label, f"""WITH {RATINGS}, g AS (SELECT id, count(*) FILTER (WHERE value = 1) AS y, count(*) FILTER (WHERE value = 0) AS n FROM ratings GROUP BY 1)
        SELECT id, CASE WHEN y + n > 0 THEN (y >= n)::INT::VARCHAR END AS final FROM g"""),
    "n_votes": (n_votes, f"WITH {RATINGS} SELECT id, count(value) AS n_votes FROM ratings GROUP BY 1"),
    "votes_by_rater": (votes_by_rater, f"""WITH {RATINGS}
        SELECT annotator, count(value) AS violent, count(value) FILTER (WHERE {U('target', 'id', 'annotator')} > 0.2) AS target FROM ratings GROUP BY 1"""),
    "join_rater_tables": (join_rater_tables, f"WITH {RATINGS} SELECT id, " + ", ".join(
        f"max(value) FILTER (WHERE annotator = '{a}')::VARCHAR AS \"violent_{a}\"" for a in views.RATERS) + " FROM ratings GROUP BY 1"),
    "strict_corpus": (strict_corpus, f"""WITH {RATINGS}, w AS (SELECT id, coalesce(sum(value) FILTER (WHERE annotator < 'A03'), 0) AS s FROM ratings GROUP BY 1),
        c AS (SELECT CASE WHEN s = 3 THEN 1 ELSE 0 END AS label, text FROM w JOIN documents ON id = doc_id WHERE s = 3 OR s < 2
          UNION ALL SELECT 0, text FROM benchmark)
        SELECT label, count(*) AS n, sum(length(text))::BIGINT AS chars FROM c GROUP BY 1"""),
    "binomial_posterior": (binomial_posterior, f"WITH {_LG}, {_posterior('gs', 0.005)} SELECT g AS lang, round(p, 6) AS p, round(d, 8) AS density FROM ps"),
    "posterior_moments": (posterior_moments, f"""WITH {_LG}, {_posterior('gs', 0.005)}, mo AS (SELECT g, sum(p * d) * 0.005::DOUBLE AS m, sum(p * p * d) * 0.005::DOUBLE AS q FROM ps GROUP BY 1)
        SELECT g AS lang, round(m, 9) AS mean, round(sqrt(q - m * m), 9) AS deviation FROM mo"""),
    "credible_interval": (credible_interval, f"WITH {_LG}, {_posterior('gs', 0.0005)} SELECT g AS lang, round(low, 6) AS low, round(high, 6) AS high FROM ci"),
    "binomial_stats": (binomial_stats, f"""WITH {_LANG},
        gs AS (SELECT lang || '/quality' AS g, lang, 'quality' AS c, (SELECT avg(quality) FROM labels) AS mode, count(*) AS n, sum(quality)::BIGINT AS k FROM l GROUP BY lang
          UNION ALL SELECT lang || '/toxic', lang, 'toxic', (SELECT avg(toxic) FROM labels), count(*), sum(toxic)::BIGINT FROM l GROUP BY lang),
        {_posterior('gs', 0.0001)}
        SELECT lang, c AS "column", n AS trials, k AS successes, round(k / n, 9) AS freq, round(low, 6) AS low, round(high, 6) AS high FROM gs JOIN ci USING (g)"""),
    "interval_errors": (interval_errors, f"""WITH {_LANG}, gs AS (SELECT lang AS g, (SELECT avg(toxic) FROM labels) AS mode, count(*) AS n, sum(toxic)::BIGINT AS k FROM l GROUP BY 1),
        {_posterior('gs', 0.001)} SELECT g AS lang, round(k / n - low, 8) AS err_low, round(high - k / n, 8) AS err_high FROM gs JOIN ci USING (g)"""),
    "platform_report": (platform_report, _USE + f""", cu0 AS (SELECT c_mktsegment, u.* FROM u JOIN customer USING (c_custkey)),
        gs AS (""" + " UNION ALL ".join(f"SELECT c_mktsegment || '/{c}' AS g, c_mktsegment, '{c}' AS c, (SELECT avg({c}) FROM u) AS mode, count(*) AS n, sum({c})::BIGINT AS k FROM cu0 GROUP BY c_mktsegment"
          for c in ("facebook", "website", "nenhuma")) + f"""), {_posterior('gs', 0.001)}
        SELECT c_mktsegment, c AS "column", n AS trials, k AS successes, round(low, 6) AS low, round(high, 6) AS high FROM gs JOIN ci USING (g)"""),
    "score_calibration": (score_calibration, f"""WITH {_JUDGED}, {_posterior('jb', 0.0001)}
        SELECT g AS bin, n AS trials, k AS successes, round(x, 9) AS mean_score, round(low, 6) AS low, round(high, 6) AS high FROM jb JOIN ci USING (g)"""),
    "calibration_posterior": (calibration_posterior, _CAL + " SELECT round(a, 6) AS a, round(b, 6) AS b, round(d, 6) AS density FROM po"),
    "posterior_mode": (posterior_mode, _CAL + " SELECT round(a, 6) AS a, round(b, 6) AS b, round(d, 6) AS density FROM po ORDER BY d DESC LIMIT 1"),
    "hpd_levels": (hpd_levels, _CAL + """, z AS (SELECT d, sum(d) * 0.001::DOUBLE AS m FROM po GROUP BY 1),
        cu AS (SELECT d, sum(m) OVER (ORDER BY d DESC) AS c FROM z)
        SELECT q::DOUBLE AS mass, round(arg_min(d, (c - q) ** 2), 6) AS level FROM cu, (VALUES (0.95::DOUBLE), (0.68::DOUBLE)) t(q) GROUP BY 1"""),
    "ks_two_sample": (ks_two_sample, f"""WITH {M}, c AS (SELECT hate_score, count(*) FILTER (WHERE event_type = 'click') AS a, count(*) FILTER (WHERE event_type = 'error') AS b
          FROM m WHERE event_type IN ('click', 'error') GROUP BY 1),
        k AS (SELECT sum(a) OVER (ORDER BY hate_score) / (SELECT sum(a) FROM c) AS fa, sum(b) OVER (ORDER BY hate_score) / (SELECT sum(b) FROM c) AS fb FROM c),
        d AS (SELECT max(abs(fa - fb)) AS d FROM k), t AS (SELECT d, d * d * n1 * n2 / (n1 + n2) AS t2 FROM d, (SELECT sum(a)::DOUBLE AS n1, sum(b)::DOUBLE AS n2 FROM c))
        SELECT round(d, 10) AS statistic, round(least(greatest((SELECT sum(CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0::DOUBLE * k * k * t2)) FROM range(1, 101) u(k)), 0), 1), 8) AS p_value FROM t"""),
    "count_estimators": (count_estimators, f"""WITH {_JUDGED}, o AS (SELECT violent, hate_score * 2 AS p, row_number() OVER (ORDER BY {U('p22', 'id')}, id) - 1 AS i, count(*) OVER () // 7 AS s FROM j),
        g AS (SELECT sum(p) - sum(violent) AS p, (count(*) FILTER (WHERE p > 0.5) - sum(violent))::DOUBLE AS c FROM o WHERE i // s < 7 GROUP BY i // s)
        SELECT 'probabilities' AS estimator, round(avg(p), 7) AS bias, round(stddev_pop(p), 7) AS deviation FROM g
        UNION ALL SELECT 'predictions', round(avg(c), 7), round(stddev_pop(c), 7) FROM g"""),
    "resampled_scores": (resampled_scores, f"""
        WITH c AS (SELECT count(*) FILTER (WHERE toxic = 0) AS n0, count(*) FILTER (WHERE toxic = 1) AS n1 FROM labels),
        d AS (SELECT rep, unnest(range(floor(n0 * (0.4::DOUBLE / (1 - 0.4::DOUBLE)) + 0.5)::BIGINT)) AS draw, n1 FROM c, range(10) t(rep)),
        k AS (SELECT rep, floor({U('p23', 'rep', 'draw')} * n1)::BIGINT + 1 AS pos FROM d),
        p AS (SELECT doc_id, row_number() OVER (ORDER BY {U('p23-number', 'doc_id')}, doc_id) AS pos FROM labels WHERE toxic = 1),
        s AS (SELECT rep, doc_id, 1 AS y FROM k JOIN p USING (pos) UNION ALL SELECT rep, doc_id, 0 FROM labels, range(10) t(rep) WHERE toxic = 0),
        e AS (SELECT rep, y, ({U('prob', 'doc_id')} > 0.5)::INT AS h FROM s),
        m AS (SELECT rep, count(*) FILTER (WHERE y = 1 AND h = 1)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND h = 1) AS fp,
          count(*) FILTER (WHERE y = 1 AND h = 0) AS fn, count(*) FILTER (WHERE y = 0 AND h = 0) AS tn FROM e GROUP BY 1)
        SELECT rep::INT AS replica, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(tp / (tp + fp), 9) AS precision,
          round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM m"""),
}
