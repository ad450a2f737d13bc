"""Text models, evaluation and MLlib jobs."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from tallyhouse import views
from tallyhouse.checks.agreement import _JUDGED, _judged
from tallyhouse.checks.base import M, T, r
from tallyhouse.checks.totals import SQL_WORDS
from tallyhouse.functions.hashing import uniform
from tallyhouse.operators import additive as ad
from tallyhouse.operators import metrics as me
from tallyhouse.operators import models as mo
from tallyhouse.operators import terms as tm
from tallyhouse.operators.sampling import sample_fixed_proportion
from tallyhouse.plans.violence_series import final_probability
from tallyhouse.views import sql_uniform as U


def _labelled(spark, sf):
    return T(spark, sf, "labels").join(T(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id")


def score_texts(spark, sf):
    model = mo.default_scorer(_labelled(spark, sf), "quality")
    d = T(spark, sf, "documents").select("doc_id", "text")
    return mo.score_texts(d, model).select("doc_id", "hate_score", "hate_class")


def score_texts_custom(spark, sf):
    """A user scorer on Arrow batches: share of capital letters in the whole text."""
    def factory():
        return lambda texts: texts.str.count(r"[A-Z]") / texts.str.len().clip(lower=1)

    df = mo.score_texts(T(spark, sf, "documents").select("doc_id", "text"), factory, threshold=0.02)
    return df.select("doc_id", r("hate_score", 12).alias("hate_score"), "hate_class")


def final_prob(spark, sf):
    df = final_probability(views.mentions(spark, sf))
    return df.select("id", r("w_hate_score", 9).alias("w_hate_score"), r("final_prob", 9).alias("final_prob"), r("w_final_prob", 9).alias("w_final_prob"))


def term_counts(spark, sf):
    return tm.term_counts(T(spark, sf, "documents"), "doc_id", "text")


def _weights(spark, sf):
    counts = tm.term_counts(_labelled(spark, sf), "doc_id", "text")
    return tm.complement_weights(counts, T(spark, sf, "labels"), "doc_id", "toxic", 0.15)


def complement_weights(spark, sf):
    return _weights(spark, sf).select("token", r("w0", 9).alias("w0"), r("w1", 9).alias("w1"))


def complement_scores(spark, sf):
    d = T(spark, sf, "documents")
    df = tm.complement_scores(tm.term_counts(d, "doc_id", "text"), _weights(spark, sf), d, "doc_id")
    return df.select("doc_id", r("p0", 7).alias("p0"), r("p1", 7).alias("p1"))


def token_weights(spark, sf):
    return tm.token_weights(_weights(spark, sf).select("token", r("w0", 9).alias("w0"), r("w1", 9).alias("w1")), 40).select("token", r("weight", 7).alias("weight"))


def multi_column_counts(spark, sf):
    c = T(spark, sf, "conversations")
    parts = [(tm.term_counts(c.where(F.col("role") == role), "conv_id", "text"), w) for role, w in (("user", 1.0), ("assistant", 0.5), ("system", 0.25))]
    a = tm.multi_column_counts(parts, "conv_id", "max").withColumnRenamed("n", "n_max")
    b = tm.multi_column_counts(parts, "conv_id", "sum").withColumnRenamed("n", "n_sum")
    return a.join(b, ["conv_id", "token"])


def weighted_counts(spark, sf):
    counts = tm.term_counts(T(spark, sf, "documents"), "doc_id", "text")
    return tm.weighted_counts(counts, ["the of and", "une la der"], ["la of"], 2.5)


def numeric_preprocess(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 8 != 0, F.col("o_totalprice")).alias("price"),
                                      F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey").cast("double")).alias("owner"))
    df = mo.numeric_preprocess(o, ["price"], log=1, center=True, scale=True, impute="mean", flags=True)
    df = mo.numeric_preprocess(df, ["owner"], impute="median")
    return df.select("o_orderkey", r("price", 8).alias("price"), "missing_price", r("owner", 3).alias("owner"))


def classifiers(spark, sf):
    d = mo.with_tokens(_labelled(spark, sf)).withColumn("w", F.when(F.col("toxic") == 1, 1.5).otherwise(1.0))
    d = d.select("doc_id", "toxic", "w", "tokens").persist(StorageLevel.MEMORY_AND_DISK)  # three fits and the vote read it
    fits = {
        "forest": (mo.text_classifier("forest", "toxic", 1 << 16, weight="w", numTrees=20, seed=7).fit(d), 0.35),
        "logistic": (mo.text_classifier("logistic", "toxic", 1 << 16, regParam=0.05, maxIter=20).fit(d), 0.2),
        "bayes": (mo.text_classifier("bayes", "toxic", 1 << 16, smoothing=0.1).fit(d), 0.1),
    }
    voted = mo.weighted_vote(d, fits, "doc_id")
    return voted.select("doc_id", "toxic", "pred_forest", "pred_logistic", "pred_bayes", "vote")


def binary_metrics(spark, sf):
    df = me.binary_metrics(T(spark, sf, "labels"), "quality", "toxic")
    return df.select(*[r(c, 10).alias(c) for c in df.columns])


def geomean_hit_rate(spark, sf):
    return me.geomean_hit_rate(T(spark, sf, "labels"), "quality", "toxic").select(r("hit_rate", 10).alias("hit_rate"))


def pr_roc_curve(spark, sf):
    df = me.pr_roc_curve(_judged(spark, sf), "violent", "hate_score")
    return df.select("threshold", *[r(c, 9).alias(c) for c in ("precision", "recall", "fpr")])


def mean_pr_curve(spark, sf):
    lb = T(spark, sf, "labels").select("doc_id", "toxic", uniform("prob", "doc_id").alias("prob"))
    sample = sample_fixed_proportion(lb, "toxic", "doc_id", 0.4, "m11", 12)
    df = me.mean_pr_curve(sample, "toxic", "prob")
    return df.select(r("x", 9).alias("x"), r("precision", 9).alias("precision"), r("recall", 9).alias("recall"))


def baselines(spark, sf):
    df = me.baselines(T(spark, sf, "labels"), "toxic", "doc_id", 5, "m12")
    return df.select("guess", r("mean", 9).alias("mean"), r("deviation", 9).alias("deviation"))


def grid_search(spark, sf):
    d = mo.with_tokens(_labelled(spark, sf)).select("doc_id", "quality", "tokens")
    pipe = mo.text_classifier("logistic", "quality", 1 << 16, maxIter=15)
    return mo.grid_search(d, pipe, {pipe.getStages()[-1].regParam: [0.01, 0.3]}, mo.area_under_roc("quality"), 3, "doc_id", "m13")


def regression_scores(spark, sf):
    li = T(spark, sf, "lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint")))
    df = ad.regression_scores(li, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "k", 3, "m14")
    return df.select("score", r("mean", 5).alias("mean"), r("deviation", 5).alias("deviation"))


def learning_curve(spark, sf):
    counts = tm.term_counts(T(spark, sf, "documents"), "doc_id", "text")
    df = ad.bayes_learning_curve(counts, _labelled(spark, sf), "doc_id", "quality", uniform("m15-part", "doc_id") < 0.3, 4, "m15")
    return df.select("step", "n_train", r("train", 9).alias("train"), r("validation", 9).alias("validation"))


def learning_curve_estimator(spark, sf):
    """The same for any estimator of MLlib, with one fit per size."""
    d = mo.with_tokens(_labelled(spark, sf))
    late = uniform("m15-part", "doc_id") < 0.3
    pipe = mo.text_classifier("bayes", "quality", 1 << 16)
    return mo.learning_curve(d.where(~late), d.where(late), pipe, "quality", "doc_id", 4, "m15")


def cv_scores(spark, sf):
    counts = tm.term_counts(T(spark, sf, "documents"), "doc_id", "text")
    df = ad.bayes_cv_scores(counts, _labelled(spark, sf), "doc_id", "quality", [0.05, 0.5, 1.0], 5, "m13")
    return df.select("alpha", "score", *[r(c, 9).alias(c) for c in ("mean", "deviation", "mean_deviation")])


def bayes_predictions(spark, sf):
    counts = tm.term_counts(T(spark, sf, "documents"), "doc_id", "text")
    df = ad.bayes_predictions(counts, _labelled(spark, sf), "doc_id", "toxic", uniform("m8-part", "doc_id") < 0.7, 0.1)
    return df.select("doc_id", "prediction", r("odds", 6).alias("odds"))


def text_clusters(spark, sf):
    return mo.text_clusters(T(spark, sf, "documents").select("doc_id", "text"), "text", 12, 20, "doc_id").drop("text")


def class_weights(spark, sf):
    return tm.class_weights(T(spark, sf, "labels"), "toxic").select("toxic", "n", r("weight", 10).alias("weight"))


def platform_usage_model(spark, sf):
    o = T(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("assets"))
    c = T(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    c = c.withColumn("schooling", F.element_at(F.array(*[F.lit(x) for x in ("basic", "middle", "upper")]), (F.col("c_custkey") % 3 + 1).cast("int")))
    c = c.withColumn("nenhuma", (uniform("none", "c_custkey") < F.when(F.col("c_acctbal") > 0, 0.6).otherwise(0.3)).cast("int"))
    return ad.platform_usage_model(c, "nenhuma", ["c_mktsegment"], {"schooling": ["basic", "middle", "upper"]}, ["c_acctbal"], ["assets"], c=0.1)


def account_validator(spark, sf):
    c = T(spark, sf, "customer").select(
        "c_custkey", "c_acctbal", F.concat_ws(" ", "c_mktsegment", F.concat(F.lit("unit"), F.col("c_nationkey").cast("string"))).alias("description"),
        (uniform("same", "c_custkey") < F.when(F.col("c_mktsegment") < "F", 0.8).otherwise(0.2)).cast("int").alias("same"))
    train = uniform("m19", "c_custkey") < 0.8
    return mo.account_validator(c.where(train), c.where(~train), "same", ["c_acctbal"], "description", trees=20)


_W = SQL_WORDS.format("lower(strip_accents(text))")
_TC = f"tc AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({_W}) AS token FROM documents) GROUP BY ALL)"
_CW = f"""{_TC}, pt AS (SELECT token, sum(n) AS a, coalesce(sum(n) FILTER (WHERE toxic = 1), 0) AS p FROM tc JOIN labels USING (doc_id) GROUP BY 1),
  st AS (SELECT sum(a)::DOUBLE AS a, sum(p)::DOUBLE AS p, count(*) * 0.15::DOUBLE AS s FROM pt),
  cw AS (SELECT token, -ln((pt.p + 0.15::DOUBLE) / (st.p + s)) AS w0, -ln((pt.a - pt.p + 0.15::DOUBLE) / (st.a - st.p + s)) AS w1 FROM pt, st)"""

# From t (i, doc_id, y), the rows of each training set, and d: p has the prior of each set, g the sums of the words of each document of d.
_BAYES = """wc AS (SELECT i, token, coalesce(sum(n) FILTER (WHERE y = 0), 0)::DOUBLE AS a, coalesce(sum(n) FILTER (WHERE y = 1), 0)::DOUBLE AS b FROM tc JOIN t USING (doc_id) GROUP BY ALL),
  ws AS (SELECT i, sum(a) AS sa, sum(b) AS sb, count(*) AS v FROM wc GROUP BY 1),
  ww AS (SELECT i, token, ln((b + {alpha}) / (sb + {alpha} * v)) - ln((a + {alpha}) / (sa + {alpha} * v)) AS w FROM wc JOIN ws USING (i)),
  p AS (SELECT i, ln((count(*) FILTER (WHERE y = 1) + {alpha}) / (count(*) FILTER (WHERE y = 0) + {alpha})) AS prior FROM t GROUP BY 1),
  g AS (SELECT tc.doc_id, i, sum(n * w) AS g FROM tc JOIN d ON tc.doc_id = d.doc_id JOIN ww USING (token) GROUP BY ALL)"""


def _regression_sql() -> str:
    """Moments by fold around the means; coefficients of each training set by Cramer's rule."""
    x = ["a", "b", "c"]
    names = [*x, "y", "z"]
    pairs = [(p, q) for i, p in enumerate(names) for q in names[i:]]
    key = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT)"
    moment = ["count(*)::DOUBLE AS n"] + [f"sum({p}) AS {p}" for p in names] + [f"sum({p} * {q}) AS {p}x{q}" for p, q in pairs]
    fields = ["n", *names, *[f"{p}x{q}" for p, q in pairs]]
    sql = f"""WITH l AS (SELECT l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, l_tax::DOUBLE AS c, l_extendedprice::DOUBLE AS y, {key} AS k FROM lineitem),
      r AS (SELECT *, floor({U('m14', 'k')} * 3)::INT AS f, row_number() OVER (ORDER BY {U('m14-a', 'k')}, k) AS p,
        row_number() OVER (ORDER BY {U('m14-b', 'k')}, k) AS o FROM l),
      j AS (SELECT r.f, {", ".join(f"r.{v} - (SELECT avg({v}) FROM l) AS {v}" for v in [*x, "y"])}, s.y - (SELECT avg(y) FROM l) AS z FROM r JOIN r s ON r.p = s.o),
      m AS (SELECT f, {", ".join(moment)} FROM j GROUP BY f), t AS (SELECT {", ".join(f"sum({v}) AS {v}" for v in fields)} FROM m)"""
    for to in ("y", "z"):
        cov = lambda p, q: f"({p}x{q} / n - {p} / n * {q} / n)"
        system = ", ".join([f"{cov(p, q)} AS s{p}{q}" for i, p in enumerate(x) for q in x[i:]] + [f"{cov(p, to)} AS s{p}t" for p in x])
        det = "(saa * (sbb * scc - sbc * sbc) - sab * (sab * scc - sbc * sac) + sac * (sab * sbc - sbb * sac))"
        wa = "(sat * (sbb * scc - sbc * sbc) - sab * (sbt * scc - sbc * sct) + sac * (sbt * sbc - sbb * sct))"
        wb = "(saa * (sbt * scc - sbc * sct) - sat * (sab * scc - sbc * sac) + sac * (sab * sct - sbt * sac))"
        wc = "(saa * (sbb * sct - sbt * sbc) - sab * (sab * sct - sbt * sac) + sat * (sab * sbc - sbb * sac))"
        cross = lambda p, q: f"{p}x{q}" if f"{p}x{q}" in fields else f"{q}x{p}"
        error = lambda m: (f"({m}.{to}x{to} - 2 * w0 * {m}.{to} + w0 * w0 * {m}.n" + "".join(f" - 2 * w{p} * {m}.{cross(p, to)} + 2 * w0 * w{p} * {m}.{p}" for p in x)
                           + "".join(f" + w{p} * w{q} * {m}.{cross(p, q)}" for p in x for q in x) + ")")
        sql += f""",
      q{to} AS (SELECT m.f, {", ".join(f"t.{v} - m.{v} AS {v}" for v in fields)} FROM m, t UNION ALL SELECT -1, {", ".join(fields)} FROM t),
      s{to} AS (SELECT *, {system} FROM q{to}), v{to} AS (SELECT *, {wa} / {det} AS wa, {wb} / {det} AS wb, {wc} / {det} AS wc FROM s{to}),
      u{to} AS (SELECT *, ({to} - wa * a - wb * b - wc * c) / n AS w0 FROM v{to}),
      e{to} AS (SELECT h.f, sqrt({error("h")} / h.n) AS train, sqrt({error("m")} / m.n) AS test, {error("h")} AS sse, h.n, h.{to}x{to} - h.{to} * h.{to} / h.n AS sst
        FROM u{to} h LEFT JOIN m ON m.f = h.f)"""
    return sql + """
      SELECT 'adjusted_r2' AS score, round(1 - sse / sst * (n - 1) / (n - 4), 5) AS mean, 0.0::DOUBLE AS deviation FROM ey WHERE f = -1
      UNION ALL SELECT 'train', round(avg(train), 5), round(stddev_pop(train), 5) FROM ey WHERE f >= 0
      UNION ALL SELECT 'cross_validation', round(avg(test), 5), round(stddev_pop(test), 5) FROM ey WHERE f >= 0
      UNION ALL SELECT 'shuffled_target', round(avg(test), 5), round(stddev_pop(test), 5) FROM ez WHERE f >= 0"""


_REGRESSION = _regression_sql()

QUERIES = {
    "score_texts": (score_texts, None),
    "score_texts_custom": (score_texts_custom, """
        SELECT doc_id, round(length(regexp_replace(text, '[^A-Z]', '', 'g')) / greatest(length(text), 1), 12) AS hate_score,
          (length(regexp_replace(text, '[^A-Z]', '', 'g')) / greatest(length(text), 1) > 0.02::DOUBLE)::INT AS hate_class FROM documents"""),
    "final_probability": (final_prob, f"""WITH {M}
        SELECT id, round(hate_score * t_win_weight, 9) AS w_hate_score, round(hate_score * target_prob, 9) AS final_prob,
          round(hate_score * target_prob * t_win_weight, 9) AS w_final_prob FROM m"""),
    "term_counts": (term_counts, f"WITH {_TC} SELECT * FROM tc"),
    "complement_weights": (complement_weights, f"WITH {_CW} SELECT token, round(w0, 9) AS w0, round(w1, 9) AS w1 FROM cw"),
    "complement_scores": (complement_scores, f"""WITH {_CW}, s AS (SELECT doc_id, sum(n * w1) - sum(n * w0) AS g FROM tc JOIN cw USING (token) GROUP BY 1),
        p AS (SELECT doc_id, coalesce(g, 0) AS g FROM documents LEFT JOIN s USING (doc_id)),
        q AS (SELECT doc_id, CASE WHEN g > 0 THEN exp(-g) / (1 + exp(-g)) ELSE 1 / (1 + exp(g)) END AS p0 FROM p)
        SELECT doc_id, round(p0, 7) AS p0, round(1 - p0, 7) AS p1 FROM q"""),
    "token_weights": (token_weights, f"""WITH {_CW}, s AS (SELECT token, round(w1, 9) - round(w0, 9) AS w FROM cw)
        SELECT token, round(w, 7) AS weight FROM s ORDER BY abs(w) DESC, token LIMIT 40"""),
    "multi_column_counts": (multi_column_counts, f"""
        WITH t AS (SELECT conv_id, role, unnest({_W}) AS token FROM conversations),
        k AS (SELECT conv_id, token, role, count(*) AS k FROM t GROUP BY ALL),
        c AS (SELECT conv_id, token, k * CASE role WHEN 'user' THEN 1.0::DOUBLE WHEN 'assistant' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS n FROM k)
        SELECT conv_id, token, max(n) AS n_max, sum(n) AS n_sum FROM c GROUP BY ALL"""),
    "weighted_counts": (weighted_counts, f"""WITH {_TC}
        SELECT doc_id, token, n * CASE WHEN token IN ('the', 'and', 'une', 'der') THEN 2.5::DOUBLE ELSE 1 END AS n FROM tc"""),
    "numeric_preprocess": (numeric_preprocess, """
        WITH l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 8 <> 0 THEN log10(1 + o_totalprice) END AS p,
            CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey::DOUBLE END AS o FROM orders),
        s AS (SELECT o_orderkey, (p - avg(p) OVER ()) / stddev_pop(p) OVER () AS z, p, o FROM l)
        SELECT o_orderkey, round(coalesce(z, (SELECT avg(z) FROM s)), 8) AS price, (p IS NULL)::INT AS missing_price,
          round(coalesce(o, (SELECT median(o) FROM s)), 3) AS owner FROM s"""),
    "classifiers": (classifiers, None),
    "binary_metrics": (binary_metrics, """
        WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1)::DOUBLE AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp,
          count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn FROM labels)
        SELECT round((tp + tn) / (tp + fp + fn + tn), 10) AS accuracy, round(tp / (tp + fp), 10) AS precision, round(tp / (tp + fn), 10) AS recall,
          round(2 * tp / (2 * tp + fp + fn), 10) AS f1 FROM c"""),
    "geomean_hit_rate": (geomean_hit_rate, """
        SELECT round(sqrt(avg(toxic) FILTER (WHERE quality = 1) * avg(1 - toxic) FILTER (WHERE quality = 0)), 10) AS hit_rate FROM labels"""),
    "pr_roc_curve": (pr_roc_curve, f"""WITH {_JUDGED}, c AS (SELECT hate_score AS t, sum(violent) AS p, count(*) - sum(violent) AS n FROM j GROUP BY 1),
        s AS (SELECT t, sum(p) OVER (ORDER BY t DESC) AS tp, sum(n) OVER (ORDER BY t DESC) AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM c)
        SELECT t AS threshold, round(tp / (tp + fp), 9) AS precision, round(tp / ap, 9) AS recall, round(fp / an, 9) AS fpr FROM s"""),
    "mean_pr_curve": (mean_pr_curve, f"""
        WITH c AS (SELECT count(*) FILTER (WHERE toxic = 0) AS n0, count(*) FILTER (WHERE toxic = 1) AS n1 FROM labels),
        d AS (SELECT rep, unnest(range(floor(n0 * (0.4::DOUBLE / (1 - 0.4::DOUBLE)) + 0.5)::BIGINT)) AS draw, n1 FROM c, range(12) t(rep)),
        k AS (SELECT rep, floor({U('m11', 'rep', 'draw')} * n1)::BIGINT + 1 AS pos FROM d),
        p AS (SELECT doc_id, row_number() OVER (ORDER BY {U('m11-number', 'doc_id')}, doc_id) AS pos FROM labels WHERE toxic = 1),
        s AS (SELECT rep, {U('prob', 'doc_id')} AS t, 1 AS y FROM k JOIN p USING (pos) UNION ALL SELECT rep, {U('prob', 'doc_id')}, 0 FROM labels, range(12) t(rep) WHERE toxic = 0),
        g AS (SELECT rep, t, sum(y) AS a, count(*) - sum(y) AS b FROM s GROUP BY ALL),
        v AS (SELECT rep, t, sum(a) OVER w AS tp, sum(b) OVER w AS fp, sum(a) OVER (PARTITION BY rep) AS ap FROM g WINDOW w AS (PARTITION BY rep ORDER BY t DESC)),
        u AS (SELECT rep, t, tp / (tp + fp) AS p, tp / ap AS r FROM v),
        x AS (SELECT rep, i / 99.0::DOUBLE AS x FROM range(100) t(i), range(12) q(rep)),
        lo AS (SELECT x.rep, x, arg_max(p, t) AS p, arg_max(r, t) AS r, max(t) AS t FROM x JOIN u ON x.rep = u.rep AND t <= x GROUP BY ALL),
        hi AS (SELECT x.rep, x, arg_min(p, t) AS p, arg_min(r, t) AS r, min(t) AS t FROM x JOIN u ON x.rep = u.rep AND t >= x GROUP BY ALL),
        m AS (SELECT x.x, CASE WHEN lo.t IS NULL THEN hi.p WHEN hi.t IS NULL OR lo.t = hi.t THEN lo.p ELSE lo.p + (hi.p - lo.p) / (hi.t - lo.t) * (x.x - lo.t) END AS p,
          CASE WHEN lo.t IS NULL THEN hi.r WHEN hi.t IS NULL OR lo.t = hi.t THEN lo.r ELSE lo.r + (hi.r - lo.r) / (hi.t - lo.t) * (x.x - lo.t) END AS r
          FROM x LEFT JOIN lo ON x.rep = lo.rep AND x.x = lo.x LEFT JOIN hi ON x.rep = hi.rep AND x.x = hi.x)
        SELECT round(x, 9) AS x, round(avg(p), 9) AS precision, round(avg(r), 9) AS recall FROM m GROUP BY x"""),
    "baselines": (baselines, f"""
        WITH w AS (SELECT toxic AS y, floor({U('m12-fold', 'doc_id')} * 5)::INT AS f, {U('m12-any', 'doc_id')} AS u, {U('m12-freq', 'doc_id')} AS v FROM labels),
        h AS (SELECT f, (SELECT count(*) FROM w b WHERE b.f <> a.f AND b.y = 0)::DOUBLE / (SELECT count(*) FROM w b WHERE b.f <> a.f) AS q FROM (SELECT DISTINCT f FROM w) a),
        g AS (SELECT f, avg((y = (SELECT mode(toxic) FROM labels))::INT) AS c, avg((y = floor(u * 2))::INT) AS a, avg((y = (v >= q)::INT)::INT) AS p FROM w JOIN h USING (f) GROUP BY 1)
        SELECT 'constant' AS guess, round(avg(c), 9) AS mean, round(stddev_pop(c), 9) AS deviation FROM g
        UNION ALL SELECT 'uniform', round(avg(a), 9), round(stddev_pop(a), 9) FROM g UNION ALL SELECT 'frequency', round(avg(p), 9), round(stddev_pop(p), 9) FROM g"""),
    "grid_search": (grid_search, None),
    "regression_scores": (regression_scores, _REGRESSION),
    "learning_curve": (learning_curve, f"""WITH {_TC}, d AS (SELECT doc_id, quality AS y, {U('m15-part', 'doc_id')} < 0.3::DOUBLE AS late,
          greatest(ceil({U('m15', 'doc_id')} * 4), 1)::INT AS st FROM labels JOIN documents USING (doc_id)),
        t AS (SELECT i, doc_id, y FROM d, range(1, 5) r(i) WHERE NOT late AND st <= i), {_BAYES.format(alpha="1.0::DOUBLE")},
        o AS (SELECT d.*, p.i, (p.prior + coalesce(g, 0) > 0)::INT = y AS hit FROM d CROSS JOIN p LEFT JOIN g ON g.doc_id = d.doc_id AND g.i = p.i)
        SELECT i::INT AS step, count(*) FILTER (WHERE NOT late AND st <= i) AS n_train, round(avg(hit::INT) FILTER (WHERE NOT late AND st <= i), 9) AS train,
          round(avg(hit::INT) FILTER (WHERE late), 9) AS validation FROM o GROUP BY i"""),
    "learning_curve_estimator": (learning_curve_estimator, None),
    "cv_scores": (cv_scores, f"""WITH {_TC}, d AS (SELECT doc_id, quality AS y, floor({U('m13', 'doc_id')} * 5)::INT AS f FROM labels JOIN documents USING (doc_id)),
        al AS (SELECT unnest([0.05::DOUBLE, 0.5, 1.0]) AS alpha), ts AS (SELECT i, doc_id, y FROM d, range(5) r(i) WHERE f <> i),
        t AS (SELECT i * 100 + alpha AS i, doc_id, y FROM ts, al), {_BAYES.format(alpha="(i % 100)")},
        o AS (SELECT f, p.i % 100 AS alpha, y, (p.prior + coalesce(g, 0) > 0)::INT AS h FROM d JOIN p ON floor(p.i / 100) = f LEFT JOIN g ON g.doc_id = d.doc_id AND g.i = p.i),
        c AS (SELECT round(alpha, 6) AS alpha, f, count(*) FILTER (WHERE y = 1 AND h = 1)::DOUBLE AS tp, count(*) FILTER (WHERE y = 0 AND h = 1) AS fp,
          count(*) FILTER (WHERE y = 1 AND h = 0) AS fn, count(*) FILTER (WHERE y = 0 AND h = 0) AS tn FROM o GROUP BY ALL),
        s AS (SELECT alpha, 'accuracy' AS score, (tp + tn) / (tp + fp + fn + tn) AS v FROM c UNION ALL
          SELECT alpha, 'precision', CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END FROM c UNION ALL SELECT alpha, 'recall', CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END FROM c UNION ALL
          SELECT alpha, 'f1', CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END FROM c UNION ALL
          SELECT alpha, 'hit_rate', CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN sqrt(tp / (tp + fn) * tn / (tn + fp)) END FROM c)
        SELECT alpha, score, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS deviation, round(stddev_pop(v) / sqrt(count(v)), 9) AS mean_deviation FROM s GROUP BY ALL"""),
    "bayes_predictions": (bayes_predictions, f"""WITH {_TC}, d AS (SELECT doc_id, toxic AS y, {U('m8-part', 'doc_id')} < 0.7::DOUBLE AS part FROM labels JOIN documents USING (doc_id)),
        t AS (SELECT 0 AS i, doc_id, y FROM d WHERE part), {_BAYES.format(alpha="0.1::DOUBLE")}
        SELECT d.doc_id, (p.prior + coalesce(g, 0) > 0)::INT AS prediction, round(p.prior + coalesce(g, 0), 6) AS odds FROM d CROSS JOIN p LEFT JOIN g ON g.doc_id = d.doc_id"""),
    "text_clusters": (text_clusters, None),
    "class_weights": (class_weights, """
        SELECT toxic, count(*) AS n, round((SELECT count(*) FROM labels WHERE toxic = 0) / count(*), 10) AS weight FROM labels GROUP BY 1"""),
    "platform_usage_model": (platform_usage_model, None),
    "account_validator": (account_validator, None),
}
