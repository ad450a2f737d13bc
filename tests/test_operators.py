"""Rules that the whole-table checks do not reach, with literal expectations."""

import datetime as dt
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import dates, hashing, permutation, registers, text, urls
from tallyhouse.operators import additive, agreement, bins, dependencies, filters, joins, metrics, posterior, ranking, resampling
from tallyhouse.operators import sampling, selection, sets, terms, totals, windows
from tallyhouse.plans import violence_series as vs
from tallyhouse.sources import pages, sinks, tables


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "s STRING").select(fn(F.col("s")).alias("o")).first()[0]


# ---- agreement -------------------------------------------------------------------------
FLEISS = [
    (0, 0, 0, 0, 14), (0, 2, 6, 4, 2), (0, 0, 3, 5, 6), (0, 3, 9, 2, 0), (2, 2, 8, 1, 1),
    (7, 7, 0, 0, 0), (3, 2, 6, 3, 0), (2, 5, 3, 2, 2), (6, 5, 2, 1, 0), (0, 2, 2, 3, 7),
]


def test_fleiss_kappa_known_value(spark):
    rows = [(i, c, n) for i, r in enumerate(FLEISS) for c, n in enumerate(r) if n]
    out = agreement.fleiss_kappa(spark.createDataFrame(rows, "id INT, value INT, n LONG")).first()
    assert round(out["kappa"], 3) == 0.210 and out["n_votes"] == 14 and out["n_items"] == 10


def test_fleiss_kappa_needs_equal_votes(spark):
    bad = spark.createDataFrame([(1, 0, 2), (2, 0, 3)], "id INT, value INT, n LONG")
    with pytest.raises(Exception, match="number of votes"):
        agreement.fleiss_kappa(bad).collect()


def test_majority_label_ties_and_missing(spark):
    v = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, None), (3, None), (4, 0), (4, 0), (4, 1)], "id INT, value INT")
    got = {r["id"]: r["final"] for r in agreement.majority_label(v, default=1).collect()}
    assert got == {1: 1, 2: 1, 3: None, 4: 0}
    assert {r["id"]: r["final"] for r in agreement.majority_label(v, default=0).collect()}[1] == 0
    with pytest.raises(Exception, match="0, 1 or missing"):
        agreement.majority_label(spark.createDataFrame([(1, 2)], "id INT, value INT")).collect()


def test_join_rater_tables_checks_texts(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 0)], "id INT, text STRING, v INT")
    assert agreement.join_rater_tables({"A": a, "B": a}, ["text"], ["v"]).count() == 2
    other = spark.createDataFrame([(1, "x", 1), (2, "z", 0)], "id INT, text STRING, v INT")
    with pytest.raises(Exception, match="text differs"):
        agreement.join_rater_tables({"A": a, "B": other}, ["text"], ["v"]).collect()
    with pytest.raises(Exception, match="raters differ"):
        agreement.join_rater_tables({"A": a, "B": a.limit(1)}, ["text"], ["v"]).collect()


def test_join_rater_tables_shuffles_no_text(spark):
    a = spark.createDataFrame([(1, "x" * 50, 1), (2, None, 0)], "id INT, text STRING, v INT").where("id = 1")
    joined = agreement.join_rater_tables({"A": a, "B": a}, ["text"], ["v"])
    assert [tuple(r) for r in joined.collect()] == [(1, 1, 1)]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    with pytest.raises(Exception, match="text differs"):
        missing = spark.createDataFrame([(2, None, 0)], "id INT, text STRING, v INT")
        agreement.join_rater_tables({"A": missing, "B": missing}, ["text"], ["v"]).collect()


# ---- time series -----------------------------------------------------------------------
def _series(spark, values, name="v"):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(hours=3 * i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"ts TIMESTAMP_NTZ, {name} DOUBLE")


def test_interpolation_edges(spark):
    df = windows.interpolate_linear(_series(spark, [None, 1.0, None, None, 4.0, None]), "ts", "v", "o")
    assert [r["o"] for r in df.orderBy("ts").collect()] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    df = windows.interpolate_linear(_series(spark, [None, 1.0]), "ts", "v", "o", back_fill=False)
    assert [r["o"] for r in df.orderBy("ts").collect()] == [None, 1.0]


def test_seasonal_impute_frame_and_minimum(spark):
    vals = [float(i) for i in range(16)]
    vals[8] = None
    df = _series(spark, vals).withColumn("season", F.lit(1.0))
    out = [r["o"] for r in windows.seasonal_impute(df, "ts", "v", "season", 3, "o").orderBy("ts").collect()]
    # Rows -4..+3 around row 8 hold 4..11 without 8: seven known values.
    assert out[8] == pytest.approx(np.mean([4, 5, 6, 7, 9, 10, 11]))
    assert out[:8] == vals[:8]


def test_agg_period_is_right_closed_and_dense(spark):
    rows = [(dt.datetime(2024, 1, 1, 3, 0), 1.0), (dt.datetime(2024, 1, 1, 3, 0, 1), 2.0), (dt.datetime(2024, 1, 1, 11), 4.0)]
    df = windows.agg_period(spark.createDataFrame(rows, "ts TIMESTAMP_NTZ, v DOUBLE"), "ts", "v", 3)
    got = [(r["ts"].hour, r["v"]) for r in df.orderBy("ts").collect()]
    assert got == [(3, 1.0), (6, 2.0), (9, 0.0), (12, 4.0)]


def test_rolling_mean_counts_null_as_zero(spark):
    df = windows.rolling_mean(_series(spark, [3.0, None, 6.0]), "ts", "v", 2, "o")
    assert [r["o"] for r in df.orderBy("ts").collect()] == [None, 1.5, 3.0]


def test_batch_slot(spark):
    rows = [("2024-01-01 00:30:00",), ("2024-01-01 00:30:01",), ("2023-12-31 00:00:00",)]
    df = spark.createDataFrame(rows, "s STRING").select(F.col("s").cast("timestamp_ntz").alias("t"))
    got = [str(r[0]) for r in df.select(windows.batch_slot(F.col("t"), "2024-01-01 00:30:00", 3)).collect()]
    assert got == ["2024-01-01 00:30:00", "2024-01-01 03:30:00", "2024-01-01 00:30:00"]


def test_export_rounds_half_even_and_uses_rounded_counts(spark):
    s = spark.createDataFrame([(dt.date(2024, 1, 1), 2.5, 10.5), (dt.date(2024, 1, 2), 0.0, 0.0)], "day DATE, h DOUBLE, t DOUBLE")
    rows = sinks.export_series(s, "day", "h", "t").orderBy("day").collect()
    assert tuple(rows[0]) == ("2024-01-01", 10, 2, 20.0)
    assert rows[1]["percent"] is None


def test_headline_without_yesterday(spark):
    s = spark.createDataFrame([(dt.date(2024, 1, 1), 2.5)], "day DATE, h DOUBLE")
    assert tuple(sinks.headline_numbers(s, "day", "h", "2024-02-01").first()) == (3, 0)


def test_slot_without_requests_is_null_then_imputed(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h, 30)
    log = spark.createDataFrame([(t(0), 1, "ok", "a"), (t(3), 1, "error", "a"), (t(6), 1, "ok", "a")],
                                "batch_time TIMESTAMP_NTZ, id LONG, status STRING, file STRING")
    sel = spark.createDataFrame([(t(0), 2.0, 1.0), (t(3), 5.0, 5.0)], "batch_time TIMESTAMP_NTZ, t_win_weight DOUBLE, w_final_prob DOUBLE")
    ref = spark.createDataFrame([(1,), (2,)], "id LONG")
    fac = spark.createDataFrame([("a", 1.0, 1.0)], "pool_filename STRING, n_tweets_list_factor DOUBLE, n_hate_list_factor DOUBLE")
    rows = vs.population_estimate(sel, log, ref, fac, "2024-01-01 00:30:00").orderBy("slot").collect()
    assert [r["pop_n_tweets"] for r in rows] == [4.0, None, None]
    assert [r["n_accounts"] for r in rows] == [1, 0, 1]


# ---- two-level ranking -----------------------------------------------------------------
def test_rank_is_a_permutation_per_group_with_a_hot_group(spark):
    df = spark.range(3000).withColumn("g", F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 7))
    r = ranking.rank_by_uniform(df, hashing.uniform("x", "id"), ["id"], ["g"]).toPandas()
    for _, part in r.groupby("g"):
        assert sorted(part["rank"]) == list(range(1, len(part) + 1))


def test_running_sums_match_cumsum(spark):
    pdf = pd.DataFrame({"x": np.random.default_rng(1).permutation(500) / 7.0, "w": np.arange(500)})
    got = ranking.running_sums(spark.createDataFrame(pdf), "x", {"c": "w"}, descending=True).toPandas()
    want = pdf.sort_values("x", ascending=False)
    assert list(got.sort_values("x", ascending=False)["c"]) == list(want["w"].cumsum())


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_quantiles_with_ties_and_small_groups(spark, accuracy):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.r_[np.zeros(700), np.ones(300), [2, 2]].astype(int),
                        "v": np.r_[np.full(400, 5.0), rng.normal(size=300), rng.exponential(size=300), [1.0, 4.0]]})
    got = ranking.exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.75}, accuracy).toPandas()
    for _, r in got.iterrows():
        want = pdf.loc[pdf["g"] == r["g"], "v"].quantile([0.25, 0.5, 0.75]).to_numpy()
        assert np.allclose([r["a"], r["b"], r["c"]], want)


def test_top_per_group_above_the_native_limit(spark):
    df = spark.range(5000).withColumn("g", F.lit(1))
    got = ranking.top_per_group(df, ["g"], [F.col("id").desc()], 1500).agg(F.count("id"), F.min("id")).first()
    assert tuple(got) == (1500, 3500)


# ---- joins and keys --------------------------------------------------------------------
def test_attach_refuses_growth(spark):
    a = spark.createDataFrame([(1,)], "k INT")
    b = spark.createDataFrame([(1, "x"), (1, "y")], "k INT, v STRING")
    with pytest.raises(Exception, match="more than one row"):
        joins.attach(a, b, ["k"]).collect()


def test_many_intervals_meet_their_rows_only(spark):
    days = spark.range(20_000).selectExpr("timestamp'2001-01-01' + make_interval(0, 0, 0, 0, 0, cast(id * 90 as int)) as first", "id")
    days = days.selectExpr("first", "first + interval 89 minutes as last", "id as source").unionByName(
        spark.sql("select timestamp'2001-01-02' as first, timestamp'2001-01-01' as last, -1L as source"))
    rows = spark.range(500).selectExpr("id", "timestamp'2001-01-01 00:30:00' + make_interval(0, 0, 0, 0, 0, cast(id * 900 as int)) as at").unionByName(
        spark.sql("select -5L as id, cast(null as timestamp) as at"))
    joined = joins.interval_join(rows, days, "at", "first", "last")
    assert "BroadcastNestedLoopJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert {(r["id"], r["source"]) for r in joined.collect()} == {(i, i * 10) for i in range(500)}
    assert joins.all_pairs(spark.range(3), spark.range(20_000).toDF("b")).count() == 60_000


def test_drop_ids_keeps_rows_without_id(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "u LONG")
    assert {r[0] for r in joins.drop_ids(df, spark.createDataFrame([(1,)], "id LONG"), "u").collect()} == {None, 2}


def test_one_to_one_does_not_let_counts_cancel(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (2, "b"), (3, "c")], "a INT, b STRING")
    assert dependencies.is_one_to_one(df, "a", "b").first()["one_to_one"] == 0


def test_redundant_columns_prefer_dropping_the_prefix(spark):
    df = spark.createDataFrame([(1, 10, "x"), (2, 20, "x"), (3, 30, "y")], "CD_k INT, k INT, z STRING")
    assert dependencies.redundant_columns(df, "CD_") == ["CD_k"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_against_brute_force_with_nulls_a_hot_child_and_one_bad_row(spark):
    n = 6_000
    rows = [
        (i, i % 3000 if i % 3 else 7, None if i % 4 == 1 else i % 4, (i % 4 if i % 4 != 1 else None) is None, "same", 1 if i == n - 1 else 0,
         f"u{i}", i // 2, i % 3000)
        for i in range(n)
    ]
    names = ["key", "hot", "gap", "is_gap", "const", "nearly", "name", "half", "mod"]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` {t}" for c, t in zip(names, "LONG LONG INT BOOLEAN STRING INT STRING LONG LONG".split())))
    want = set()
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            partners = {}
            for row in rows:
                partners.setdefault(row[i], set()).add(row[j])
            if i != j and all(len(p) == 1 for p in partners.values()):
                want.add((a, b))
    out = dependencies.subcategory_pairs(df)
    assert {tuple(r) for r in out.collect()} == want
    assert ("gap", "is_gap") in want and ("const", "nearly") not in want and ("key", "nearly") in want
    assert "Expand" not in plan_of(out)
    assert dependencies.redundant_columns(df) == ["name"]


def test_sketches_rule_out_pairs_before_they_are_counted(spark):
    df = spark.range(20_000).select(*[(F.xxhash64("id", F.lit(i)) % 300).alias(f"c{i}") for i in range(30)], F.col("id").alias("key"))
    left = dependencies._open_pairs(df, df.columns)
    assert set(left) == {("key", f"c{i}") for i in range(30)}
    assert dependencies.subcategory_pairs(df).count() == 30


def test_pairs_and_profiles_of_odd_tables(spark):
    none = spark.createDataFrame([], "a INT, `b.c` STRING")
    assert {tuple(r) for r in dependencies.subcategory_pairs(none).collect()} == {("a", "b.c"), ("b.c", "a")}
    assert {tuple(r) for r in totals.distinct_profile(none).collect()} == {("a", 0), ("b.c", 0)}
    assert dependencies.subcategory_pairs(spark.range(3)).count() == 0
    df = spark.range(5_000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("few"), (F.col("id") % 1_001).alias("over"),
                                   (F.col("id") % 1_000).alias("just"))
    got = totals.distinct_profile(df, most=1_000)
    assert {tuple(r) for r in got.collect()} == {("few", 2), ("just", 1_000)}
    assert "Expand" not in plan_of(totals.distinct_profile(df))
    assert totals.distinct_profile(df.select("id"), most=10).collect() == []


def test_guess_data_types(spark):
    rows = [(float(i) + 0.5, str(i), f"0{i}", 10**i, None if i == 1 else i, f"{i}-{i}") for i in range(1, 5)]
    df = spark.createDataFrame(rows, "f DOUBLE, few STRING, lead STRING, big LONG, gap LONG, dash STRING")
    got = {r["column"]: r["dtype"] for r in dependencies.guess_data_types(df, max_int=3).collect()}
    assert got == {"f": "num", "few": "num", "lead": "cat", "big": "log", "gap": "cat", "dash": "cat"}


def test_is_key_and_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3)], "a INT, b INT")
    assert sets.is_key(df, ["a", "b"]).first()["is_key"] == 0
    assert sets.drop_duplicates(df, ["a", "b"], [F.col("a")]).count() == 2
    assert {r["a"] for r in sets.find_double_entries(df, "a", dropna=True).collect()} == {1}
    assert sets.find_double_entries(df, "b", dropna=False).count() == 2


# ---- filters ---------------------------------------------------------------------------
def test_direct_text(spark):
    rows = [("@a @b https://t.co/Abcdef1234", 1, 2), ("@a hi", 0, 2), ("@a hi", 0, 1), ("hi", 1, 3), ("@a ", 1, 1)]
    df = spark.createDataFrame(rows, "text STRING, direct_reply INT, n_mentions INT")
    assert [r["text"] for r in filters.select_direct_text(df).collect()] == ["@a hi", "hi"]


def test_standardize_columns_refuses_unknown(spark):
    df = spark.createDataFrame([(1, 2)], "NOME_A INT, ODD INT")
    schema = spark.createDataFrame([], "NM_A INT, NM_B STRING").schema
    with pytest.raises(ValueError, match="ODD"):
        filters.standardize_columns(df, schema, [], [("NOME_", "NM_")])
    got = filters.standardize_columns(df, schema, ["ODD"], [("NOME_", "NM_")])
    assert got.columns == ["NM_A", "NM_B", "ODD"] and got.first()["NM_B"] is None


# ---- text, links, dates ----------------------------------------------------------------
@pytest.mark.parametrize("raw, want", [
    ("01021950", "01/02/1950"), ("1 21950", "01/02/1950"), ("010250", "01/02/1950"), ("111950", "01/01/1950"),
    ("1311950", "13/01/1950"), ("1121950", "01/12/1950"), ("0102195", "01/02/1950"), ("3010196", "30/10/1960"), ("1234567", "1234567"),
    ("31041950", "30/04/1950"), ("29021951", "28/02/1951"), ("29021952", "29/02/1952"), ("01-FEB-50", "01/02/1950"),
    ("01-XYZ-50", None), ("1/2/1950", "1/2/1950"), ("01/02/0050", "01/02/1950"), ("01991950", None), ("abc", None), (None, ""),
])
def test_legacy_dates(spark, raw, want):
    assert one(spark, raw, dates.format_legacy_date) == want


@pytest.mark.parametrize("url, want", [
    ("https://twitter.com/Some_One", "some_one"), ("@João1", "joão1"), ("www.twitter/abc", "abc"),
    ("https://www.twitter.com/https://twitter.com/abc", "abc"), ("twiter.com.br/@x", "x"), ("https://site.org", None), (None, None),
])
def test_twitter_username(spark, url, want):
    assert one(spark, url, urls.twitter_username) == want


def test_instagram_username_repairs(spark):
    assert one(spark, "https://instagram.com/accounts/login/?next=/Ab.c", urls.instagram_username) == "ab.c"
    assert one(spark, "http://www.instagran.com/STORIES/zed/", urls.instagram_username) == "zed"


@pytest.mark.parametrize("url, want", [
    ("INSTAgram.com/x", {"instagram"}), ("instalação elétrica", {"usuario"}), ("instabio.cc/x", {"usuario"}),
    ("https://site.com.br", {"website"}), ("fale comigo @eu", {"arroba"}), ("(11) 99999-9999", {"telefone"}),
    ("NÃO TEM", {"nenhuma"}), ("maria silva", {"usuario"}), ("https://t.me/x", {"telegram"}),
])
def test_platform_flags(spark, url, want):
    row = spark.createDataFrame([(url,)], "u STRING").select(*urls.platform_flags(F.col("u"))).first().asDict()
    assert len(row) == len(urls.PLATFORMS) + 3
    assert {k for k, v in row.items() if v} == want


def test_std_string_takes_texts_in_runs(spark, monkeypatch):
    monkeypatch.setattr(text, "RUN_CHARS", 5)
    inputs = [" A \u00a0b", "ﬁ ½", None, "", "e\u0301 x", "plain  text ", "Ａｂ", None]
    rows = spark.createDataFrame(list(enumerate(inputs)), "id INT, t STRING").coalesce(1)
    got = rows.select("id", text.std_string(F.col("t"), "lower").alias("t")).orderBy("id").collect()
    assert [r["t"] for r in got] == ["a b", "fi 1⁄2", None, "", "é x", "plain text", "ab", None]


def test_text_functions(spark):
    assert one(spark, "  Ação:  São Paulo/SP ", text.text_to_tag) == "acao_sao_paulosp"
    assert one(spark, "ù Ç é", text.remove_accents) == "ù C e"
    assert one(spark, "𝗕𝗼𝗹𝗱 𝐫𝐬 ℎ𝑖", text.replace_bold_unicode) == "Bold rs hi"
    assert one(spark, " ﬁ  ½\tx ", text.std_string) == "fi 1⁄2 x"
    assert one(spark, "abcdef", lambda c: text.crop_strings(c, 0, 3)) == "abc…"
    assert one(spark, "abcdef", lambda c: text.crop_strings(c, 3, 9)) == "…def"
    assert one(spark, "A é x1 ção_b", text.tokens) == ["x1", "cao_b"]
    assert one(spark, "que V4GABUNDO", text.lexicon_match) is True
    assert text.typo_neighbours()["s"] == "ads"


def test_numbers(spark):
    assert one(spark, "1.573.345,98", registers.parse_ptbr_number) == 1573345.98
    assert one(spark, "x", registers.parse_ptbr_number) is None
    assert one(spark, "12 34", registers.pad_document) == "000000001234"
    assert one(spark, "2022-01-01T00:00:00-03:00", lambda c: dates.parse_mixed_offsets(c).cast("string")) == "2022-01-01 03:00:00"
    assert one(spark, "Março ", dates.month_name_to_num) == 3


def test_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (1.0,), (None,)], "x DOUBLE")
    assert [r[0] for r in df.select(bins.bin_prob(F.col("x"), 0.1)).collect()] == [0, 2, 10, None]
    wide = spark.createDataFrame([(float(v),) for v in (0, 10, 20, 40)], "x DOUBLE")
    edges = np.linspace(-1e-6, 40 + 1e-6, 5)
    labels = ((edges[1:] + edges[:-1]) / 2).astype(int)
    want = pd.cut(pd.Series([0, 10, 20, 40.0]), edges, labels=labels).astype(int)
    got = bins.values_to_bins(wide, "x", 4, "b").orderBy("x").collect()
    assert [r["b"] for r in got] == list(want)
    h = bins.histogram(wide, "x", 4).orderBy("bin").toPandas()
    assert list(h["height"]) == list(np.histogram([0, 10, 20, 40], 4)[0])


# ---- sampling --------------------------------------------------------------------------
def test_crc_split_matches_zlib(spark):
    words = ["ação", "b", "user:1", "", "zzz"]
    df = spark.createDataFrame([(w,) for w in words], "s STRING")
    got = {r["s"]: r["in_test"] for r in sampling.split_by_string(df, "s", 0.5, "user:").collect()}
    for w in words:
        assert got[w] == int(zlib.crc32(w.replace("user:", "").encode()) < 0.5 * 2**32)


def test_plan_batch_errors_when_too_large(spark):
    pool = spark.createDataFrame([(i, 1.0) for i in range(5)], "id LONG, sample_weight DOUBLE")
    with pytest.raises(Exception, match="smaller than the batch"):
        sampling.plan_batch(pool, 6, "2024-01-01 00:00:00", 1).collect()
    first = sampling.plan_batch(pool, 2, "2024-01-01 00:00:00", 1)
    second = sampling.plan_batch(pool, 3, "2024-01-01 03:00:00", 2, previous=first)
    assert not {r["id"] for r in first.collect()} & {r["id"] for r in second.collect()}


def test_set_sizes_and_partition_independence(spark):
    df = spark.range(103)
    a = sampling.random_set_split(df, [0.8, 0.2], "id", 5)
    assert {r["set"]: r["count"] for r in a.groupBy("set").count().collect()} == {0: 82, 1: 21}
    b = sampling.random_set_split(df.repartition(7), [0.8, 0.2], "id", 5)
    assert a.exceptAll(b).count() == 0


def test_shuffle_keeps_margins(spark):
    df = spark.range(200).withColumn("a", F.col("id") % 3).withColumn("b", F.col("id") % 5)
    out = sampling.shuffle_columns(df, ["a", "b"], "id", 1, replicas=3)
    assert out.count() == 600
    for c in ("a", "b"):
        want = {r[c]: r["count"] * 3 for r in df.groupBy(c).count().collect()}
        assert {r[c]: r["count"] for r in out.groupBy(c).count().collect()} == want


def test_permutations_are_one_to_one_for_any_number_of_rows(spark):
    def plain(x, n, ks):
        a, b = permutation.grid(n)
        while True:
            u, v = divmod(x, b)
            for i in range(permutation.rounds_for(n)):
                value = 0
                for c in ks[4 * i : 4 * i + 4]:
                    value = (value * (v if i % 2 == 0 else u) + c) % permutation.PRIME
                u, v = ((u + value) % a, v) if i % 2 == 0 else (u, (v + value) % b)
            x = u * b + v
            if x < n:
                return x

    for n in (1, 2, 3, 5, 997, 1024, 2003):
        keys = permutation.replica_keys(spark, {"k": "s"}, 2, n)
        ks = {r["replica"]: r["k"] for r in keys.collect()}
        assert ks[0] != ks[1] and all(0 <= c < permutation.PRIME for c in ks[0] + ks[1])
        got = permutation.permuted(spark.range(n).crossJoin(keys), "id", "k", n, "place").collect()
        for replica in (0, 1):
            assert sorted(r["place"] for r in got if r["replica"] == replica) == list(range(n))
        assert all(r["place"] == plain(r["id"], n, ks[r["replica"]]) for r in got)
    for n in (10**6 + 3, 10**9 + 7, 10**12 + 39):
        a, b = permutation.grid(n)
        assert 0 <= a * b - n <= 8 and a <= b <= 17 * a


def test_permutations_put_every_row_everywhere_equally_often(spark):
    n, replicas = 7, 4_000
    keys = permutation.replica_keys(spark, {"k": 3}, replicas, n)
    got = permutation.permuted(spark.range(n).crossJoin(keys), "id", "k", n, "p")
    cells = got.groupBy("id", "p").count().toPandas()
    want = replicas / n
    assert len(cells) == n * n and ((cells["count"] - want) ** 2 / want).sum() < 80  # 36 degrees of freedom
    pairs = got.alias("x").join(got.alias("y"), "replica").where("x.id = 0 and y.id = 1").groupBy("x.p", "y.p").count().toPandas()
    want = replicas / (n * (n - 1))
    assert len(pairs) == n * (n - 1) and ((pairs["count"] - want) ** 2 / want).sum() < 90  # 41 degrees of freedom


def test_replicas_are_joined_and_not_sorted(spark):
    df = spark.range(3_000).withColumn("a", F.col("id") % 3).withColumn("b", F.col("id") % 5)
    out = sampling.shuffle_columns(df, ["a", "b"], "id", 1, replicas=40)
    assert "Window" not in plan_of(out)
    again = sampling.shuffle_columns(df.repartition(5), ["a", "b"], "id", 1, replicas=40)
    assert out.exceptAll(again).count() == 0
    corr = [r[0] for r in resampling.permutation_correlation(df, "a", "b", "id", 200, 4).select("corr").collect()]
    assert abs(np.mean(corr)) < 4 / np.sqrt(200 * 3_000) and 0.8 < np.std(corr) * np.sqrt(3_000) < 1.2
    assert np.prod(permutation.grid(2_003)) > 2_003  # some rows walk
    for odd in (df.where("id < 0"), df.where("id < 1"), df.where("id < 2003")):
        assert sampling.shuffle_columns(odd, ["a", "b"], "id", 1, replicas=2).count() == 2 * odd.count()


def test_replicas_stream_past_bounded_hash_tables_of_partners(spark, monkeypatch):
    df = spark.range(3_000).withColumn("a", F.col("id") % 7).withColumn("b", (F.col("id") * 11) % 5).withColumn("c", F.col("id"))
    want = sampling.shuffle_columns(df, ["a", "b", "c"], "id", 1, replicas=4).toPandas()
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for most, shuffles in ((500_000, usual), (500, "2")):  # one table is small, the other larger than its partitions hold
            monkeypatch.setattr(sampling, "PARTNER_ROWS", most)
            spark.conf.set("spark.sql.shuffle.partitions", shuffles)
            out = sampling.shuffle_columns(df, ["a", "b", "c"], "id", 1, replicas=4)
            plan = plan_of(out)
            assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
            assert (", 6)" in plan or ", 6," in plan) == (most == 500)  # 3,000 rows, 500 to a task
            got = out.toPandas()
            assert sorted(map(tuple, got.to_numpy())) == sorted(map(tuple, want.to_numpy()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert sorted(got[got["replica"] == 3]["c"]) == list(range(3_000)) and len(got) == 12_000


def test_fixed_proportion(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    got = sampling.sample_fixed_proportion(df, "y", "id", 0.4, 3, replicas=2).groupBy("replica", "y").count().collect()
    assert {(r["replica"], r["y"]): r["count"] for r in got} == {(i, y): n for i in (0, 1) for y, n in ((0, 900), (1, 600))}


# ---- statistics ------------------------------------------------------------------------
def test_posterior_against_direct_computation(spark):
    g = spark.createDataFrame([("a", 0.3, 20, 0), ("b", 0.3, 7, 7)], "g STRING, mode DOUBLE, n LONG, k LONG")
    got = posterior.binomial_posterior(g, ["g"], "mode", "n", "k", 0.01).toPandas()
    p = np.arange(0, 1, 0.01)
    tri = np.where(p < 0.3, 2 * p / 0.3, 2 * (1 - p) / 0.7)
    for name, n, k in (("a", 20, 0), ("b", 7, 7)):
        raw = tri * p**k * (1 - p) ** (n - k)
        assert np.allclose(got[got["g"] == name].sort_values("p")["density"], raw / raw.sum() / 0.01)
    lim = posterior.credible_interval(posterior.binomial_posterior(g, ["g"], "mode", "n", "k", 0.01), ["g"], 0.01)
    assert {r["g"] for r in lim.where("low < high").collect()} == {"a", "b"}


def test_ks_matches_sorted_computation(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=80), rng.normal(0.5, size=60)
    rows = [("a", float(x)) for x in a] + [("b", float(x)) for x in b]
    got = resampling.ks_two_sample(spark.createDataFrame(rows, "s STRING, v DOUBLE"), "v", "s", "a", "b").first()
    xs = np.sort(np.r_[a, b])
    gap = np.abs(np.searchsorted(np.sort(a), xs, "right") / 80 - np.searchsorted(np.sort(b), xs, "right") / 60).max()
    assert got["statistic"] == pytest.approx(gap)


def test_hit_rate_needs_binary(spark):
    with pytest.raises(Exception, match="0 or 1"):
        metrics.geomean_hit_rate(spark.createDataFrame([(1, 2)], "a INT, b INT"), "a", "b").collect()


def test_published_percentages(spark):
    df = spark.createDataFrame([(dt.date(2022, 1, 1), 77.4, 1234.6)], "day DATE, h DOUBLE, t DOUBLE")
    assert sinks.export_series(df, "day", "h", "t").first()["percent"] == round(77 / 1235 * 100, 2)


def test_ngrams_without_names_by_list_or_table(spark):
    docs = spark.createDataFrame([(1, "http ana silva vota"), (2, "ana vota silva vota")], "id INT, t STRING")
    names = spark.createDataFrame([("silva",)], "token STRING")
    run = lambda stop, table: {tuple(r) for r in terms.ngram_counts(docs, "id", terms.link_words(F.col("t")), 1, stop, table).collect()}
    assert run([*terms.URL_STOPWORDS, "silva"], None) == run(terms.URL_STOPWORDS, names) == {("ana", 2, 2), ("vota", 3, 2), ("ana vota", 2, 2), ("vota vota", 1, 1)}


# ---- sources ---------------------------------------------------------------------------
def test_register_folder_rules(spark, tmp_path):
    d = tmp_path / "mixed"
    d.mkdir()
    (d / "a.csv").write_text("A;B\n1;2\n")
    (d / "b.txt").write_text("1;2\n")
    with pytest.raises(ValueError, match="both"):
        tables.load_register_dir(spark, str(d))
    e = tmp_path / "states"
    e.mkdir()
    (e / "x_SP.csv").write_text("A;B\n1;2\n")
    (e / "x_RJ.csv").write_bytes("A;B\n3;ção\n".encode("latin-1"))
    assert {r["B"] for r in tables.load_register_dir(spark, str(e)).collect()} == {"2", "ção"}
    (e / "x_BRASIL.csv").write_text("A;B\n9;9\n")
    assert [r["A"] for r in tables.load_register_dir(spark, str(e)).collect()] == ["9"]


def test_pages_do_not_grow_and_tolerate_missing_fields(spark, tmp_path):
    f = tmp_path / "p.json"
    f.write_text('{"data":[{"id":1,"text":"a\\rb","author_id":7,"created_at":"x"}],"includes":{"users":[{"id":7,"name":"N","username":"n"},'
                 '{"id":7,"name":"N","username":"n"}]},"meta":{"result_count":1}}\n')
    rows = pages.load_mentions_json(pages.read_pages(spark, str(f)), account="5").collect()
    assert len(rows) == 1 and rows[0]["text"] == "a b" and rows[0]["direct_reply"] == 0 and rows[0]["n_mentions"] == 0
    assert rows[0]["in_reply_to_user_id"] is None


def test_encryption_round_trip_and_absent_columns(spark):
    df = spark.createDataFrame([("x",), ("x",), (None,)], "a STRING")
    enc = registers.encrypt_cols(df, ["a", "zz"], "0123456789abcdef")
    seen = [r["a"] for r in enc.collect()]
    assert seen[0] != seen[1] and seen[2] is None
    assert [r["a"] for r in registers.decrypt_cols(enc, ["a"], "0123456789abcdef").collect()] == ["x", "x", None]


# ---- totals ----------------------------------------------------------------------------
def test_votes_reject_mixed_elections(spark):
    df = spark.createDataFrame([(1, 5, 1, 2), (1, 6, 2, 2), (2, 1, 1, 0)], "k INT, v LONG, turn INT, kind INT")
    with pytest.raises(Exception, match="type of election"):
        totals.nominal_votes(df, "k", "v", "turn", 1, "kind").collect()
    ok = totals.nominal_votes(df.where("kind = 2"), "k", "v", "turn", 1, "kind").collect()
    assert [tuple(r) for r in ok] == [(1, 5)]


def test_capture_weight_only_at_the_cap(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 1, m)
    rows = [("a", t(0)), ("a", t(30)), ("b", t(0))]
    df = spark.createDataFrame(rows, "r STRING, c TIMESTAMP_NTZ").withColumn("s", F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz"))
    df = df.withColumn("e", F.lit(dt.datetime(2024, 1, 1, 3)).cast("timestamp_ntz"))
    got = {r["r"]: r["t_win_weight"] for r in totals.capture_stats(df, ["r"], "c", "s", "e", cap=2).collect()}
    assert got == {"a": 6.0, "b": 1.0}


def test_unique_traits_fail_on_two_values_or_null(spark):
    for rows in ([(1, "a"), (1, "b")], [(1, "a"), (1, None)]):
        with pytest.raises(Exception, match="not unique"):
            totals.unique_traits(spark.createDataFrame(rows, "k INT, v STRING"), ["k"], ["v"]).collect()


# ---- whole inputs ----------------------------------------------------------------------
def test_long_texts_are_not_cut(spark):
    long = "x" * 5000
    df = spark.createDataFrame([(long, "a", "b")], "FAIXA_ETARIA STRING, SEXO STRING, GRAU_DE_ESCOLARIDADE STRING")
    assert registers.clean_voters(df).first()[0] == "X" + long[1:]
    parts = "1/2/" + "/".join(["1990"] * 148)
    assert one(spark, parts, dates.format_legacy_date) == parts


def test_one_hot_of_many_values(spark):
    df = spark.range(1500).selectExpr("id", "cast(id as string) as v")
    wide = bins.one_hot(df, ["v"])
    assert len(wide.columns) == 1501
    assert bins.one_hot_long(df, ["v"], ["id"]).count() == 1500
    assert bins.one_hot(df.limit(3), ["v"], values={"v": ["0", "9"]}).columns == ["id", "v_0", "v_9"]


def test_compatibility_forms_become_plain_words(spark):
    for given, plain in (("𝐁𝐨𝐥𝐝 𝒲ord", "bold word"), ("ﬁm ﬃ", "fim ffi"), ("ｆｕｌｌ ｗｉｄｔｈ", "full width"), ("½ é ñ ẽ", "1⁄2 e n e"), ("한국", "한국"), ("ا\u0301", "ا")):
        assert one(spark, given, lambda c: F.lower(text.strip_accents(c))) == plain


def test_readers_lose_no_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"x\ny, ""z"""\nX9,bad\n')
    found = tables.load_concat_csv(spark, str(tmp_path), "id LONG, t STRING", bad_rows="wrong").collect()
    assert [(r["id"], r["t"]) for r in found if r["wrong"] is None] == [(1, 'x\ny, "z"')]
    assert [r["wrong"] for r in found if r["wrong"]] == ["X9,bad"]
    for load in (tables.load_concat_csv, tables.robust_load_csv):
        with pytest.raises(Exception):
            load(spark, str(tmp_path), "id LONG, t STRING").collect()


def test_missing_keys_are_no_group_and_lookups_do_not_grow(spark):
    df = spark.createDataFrame([(1, 2.0), (None, 3.0)], "k INT, v DOUBLE")
    assert [tuple(r) for r in totals.asset_features(df, ["k"], "v").collect()] == [(1, 1, 2.0)]
    assert totals.counts_table(df, "k").count() == 2
    double = spark.createDataFrame([(1, 5.0), (1, 6.0)], "k INT, v DOUBLE")
    for run in (lambda: filters.fill_from(df, double, "k", ["v"], {}), lambda: joins.keep_facts(double, df.select("k"), ["k"])):
        with pytest.raises(Exception, match="more than one row"):
            run().collect()


def test_first_rows_for_any_number(spark):
    df = spark.range(5000).select("id", hashing.uniform("s", "id").alias("u"))
    for n in (0, 1, 7, 2500, 4999, 6000):
        got = [r["id"] for r in ranking.first_rows(df, F.col("u"), ["id"], n).collect()]
        assert sorted(got) == sorted(r["id"] for r in df.orderBy("u", "id").limit(n).collect())
    tied = spark.range(100).select("id", F.lit(0.5).alias("u"))
    assert sorted(r["id"] for r in ranking.first_rows(tied, F.col("u"), ["id"], 10).collect()) == list(range(10))
    plan = sampling.plan_batch(df.withColumn("sample_weight", F.lit(1.0)), 1000, "2024-01-01 00:30:00", "x")
    assert "TakeOrderedAndProject" not in plan._jdf.queryExecution().executedPlan().toString()


def test_log_batches_are_whole(spark):
    log = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 2), (2, dt.datetime(2024, 1, 1), 2)], "id LONG, batch_time TIMESTAMP_NTZ, batch_size LONG")
    assert vs.checked_log(log).count() == 2
    for bad in (log.limit(1), log.withColumn("batch_size", F.col("id"))):
        with pytest.raises(Exception, match="not whole"):
            vs.checked_log(bad).collect()


def test_majority_by_label_without_some_raters(spark):
    rows = [(1, "x", "A", 1), (1, "x", "B", 0), (1, "y", "A", 1), (1, "y", "B", 0), (1, "z", "A", 1), (1, "z", "C", 0), (1, "z", "D", 0)]
    votes = spark.createDataFrame(rows, "id INT, label STRING, annotator STRING, value INT")
    run = lambda **k: {r["label"]: r["final"] for r in agreement.majority_label(votes, {"x": 1, "y": 0}, ("id", "label"), **k).collect()}
    assert run() == {"x": 1, "y": 0, "z": 0} and run(ignored=["C", "D"]) == {"x": 1, "y": 0, "z": 1}


def test_outer_join_refuses_unmatched_ids(spark):
    a, b = spark.createDataFrame([(1, 2)], "id INT, x INT"), spark.createDataFrame([(1, 3), (4, 5)], "id INT, y INT")
    with pytest.raises(Exception, match="missing on one side"):
        joins.matched_only(joins.full_outer(a, b, "id")).collect()
    assert joins.matched_only(joins.full_outer(a, b.limit(1), "id")).count() == 1


def test_truncated_svd_against_numpy(spark):
    from tallyhouse.operators import factors

    rng = np.random.default_rng(4)
    m = rng.random((40, 25)) * (rng.random((40, 25)) < 0.3) * np.linspace(1, 6, 25)
    rows = [(i, f"t{j}", float(m[i, j])) for i in range(40) for j in range(25) if m[i, j]]
    placed, values = factors.truncated_svd(spark.createDataFrame(rows, "doc INT, token STRING, w DOUBLE"), "doc", "token", 3, rounds=12)
    u, s, _ = np.linalg.svd(m)
    assert values == pytest.approx(s[:3], rel=1e-6)
    got = placed.toPandas().sort_values("doc")[["z0", "z1", "z2"]].to_numpy()
    assert np.abs(got) == pytest.approx(np.abs(u[:, :3] * s[:3])[sorted({r[0] for r in rows})], abs=1e-4)


def test_matrix_blocks_hold_whole_rows(spark):
    from tallyhouse.operators import factors

    rows = [(i, f"t{j}", float(1 + i + j)) for i in range(1200) for j in range(i % 4, i % 4 + 3)]
    entries = spark.createDataFrame([*rows, (None, "t0", 1.0), (1, None, 1.0)], "doc INT, token STRING, w DOUBLE")
    blocks = factors._blocks(entries, "doc", "token", 1000).collect()
    names = {r["block"]: r["columns"] for r in blocks if r["columns"] is not None}
    members = [r for r in blocks if r["columns"] is None]
    assert len(names) > 2 and len(members) == 1200 and {r["block"] for r in members} == set(names)
    assert sorted((r["id"], names[r["block"]][at], w) for r in members for at, w in zip(r["at"], r["w"])) == sorted(rows)


def test_word_vectors_travel_in_parts(spark, monkeypatch):
    from tallyhouse.operators import factors, terms

    rng, stored = np.random.default_rng(3), {}
    texts = [" ".join(f"w{j}" for j in rng.integers(0, 40, 25)) for _ in range(60)]
    keys = [None, None, *range(56), 0, 1]  # rows without a key count as one row, rows with one key are added up
    docs = spark.createDataFrame(list(zip(keys, texts)), "doc INT, text STRING").repartition(6)
    keep = factors.kept_table

    def kept(df, name):
        out = keep(df, name)
        stored.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(factors, "kept_table", kept)
    monkeypatch.setattr(factors, "GROUP_ENTRIES", (200, 300))
    monkeypatch.setattr(factors, "PART_PLACES", 60)
    counts = terms.word_blocks(docs, "doc", F.split("text", " "))
    placed, values = factors.truncated_svd(factors.tf_idf(counts, "doc", min_df=20, max_df=0.9), "doc", "token", 4, rounds=12)

    matrix = pd.DataFrame(0.0, index=[-1, *range(56)], columns=[f"w{j}" for j in range(40)])
    for key, text in zip(keys, texts):
        for word in text.split():
            matrix.loc[-1 if key is None else key, word] += 1
    df = (matrix > 0).sum()
    assert 5 < ((df >= 20) & (df <= 0.9 * 57)).sum() < 40
    weights = (matrix * (np.log(58 / (1 + df)) + 1)).loc[:, (df >= 20) & (df <= 0.9 * 57)].drop(index=-1)
    weights = weights.div(np.sqrt((weights**2).sum(axis=1)), axis=0).to_numpy()
    u, want, _ = np.linalg.svd(weights, full_matrices=False)
    assert values == pytest.approx(want[:4], rel=1e-4)
    got = placed.toPandas().sort_values("doc")
    assert got["doc"].tolist() == list(range(56)) and np.abs(got["z0"].to_numpy()) == pytest.approx(np.abs(u[:, 0] * want[0]), abs=1e-4)
    assert len(stored["vectors"]) == 13 and max(stored["vectors"]) < 12  # a row per part of the columns, not per column


def test_words_of_single_keys_are_counted_without_a_shuffle(spark):
    from tallyhouse.operators import factors, terms

    docs = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "b c")], "doc INT, text STRING").coalesce(1)
    words = F.filter(F.split("text", " "), lambda t: t != "")
    assert "Exchange" not in factors.cut(docs.select(F.col("doc").alias("id"), words.alias("c")))._jdf.queryExecution().executedPlan().toString()
    blocks = terms.word_blocks(docs, "doc", words)
    assert [r["ids"] for r in blocks.members.collect()] == [[1, 4]]
    assert [(r["columns"], r["uses"], r["entries"]) for r in blocks.names.collect()] == [(["a", "b", "c"], [1, 2, 1], 4)]


def test_packed_numbers_and_uniforms(spark):
    from tallyhouse.operators import factors

    for x in ([1.0, 2.0, 300.0], [0.5, -1.0], [2.0**33], [7.0], [-3.0, 1.0]):
        assert factors._unpacked(factors._packed(np.array(x)), len(x), float).tolist() == x
    at = np.array([0, 5, 70_000], dtype=np.int32)
    assert len(factors._packed(at)) == 9 and factors._unpacked(factors._packed(at), 3, np.int32).tolist() == at.tolist()
    names = ["a", "é", "", "x y"]
    got = spark.createDataFrame([(n,) for n in names], "n STRING").select("n", *[hashing.uniform(f"s-{i}", "n") for i in range(3)]).collect()
    assert hashing.uniforms([f"s-{i}" for i in range(3)], names).tolist() == [list(r)[1:] for r in got]


def test_grid_search_computes_its_input_once(spark):
    from tallyhouse.operators import models

    def counted(df):
        seen = spark.sparkContext.accumulator(0)

        def run(batches):
            for b in batches:
                seen.add(len(b))
                yield b

        return seen, df.mapInPandas(run, df.schema)

    seen, rows = counted(spark.createDataFrame([(i, i % 2, [f"w{i % 2}", f"v{i % 3}"]) for i in range(40)], "doc INT, y INT, tokens ARRAY<STRING>"))
    pipe = models.text_classifier("logistic", "y", 64, maxIter=2)
    found = models.grid_search(rows, pipe, {pipe.getStages()[-1].regParam: [0.01, 0.3]}, models.area_under_roc("y"), 3, "doc", "s")
    assert found.count() == 2 and seen.value == 40


def test_tf_idf_weights(spark):
    from tallyhouse.operators import factors

    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1), (2, "c", 1), (3, "a", 1)], "doc INT, token STRING, n LONG")
    got = {(r["doc"], r["token"]): r["w"] for r in factors.tf_idf(counts, "doc").collect()}
    a, b = 2 * (np.log(4 / 4) + 1), np.log(4 / 2) + 1
    assert got[(1, "a")] == pytest.approx(a / np.hypot(a, b)) and got[(3, "a")] == pytest.approx(1.0)
    assert {r["token"] for r in factors.tf_idf(counts, "doc", max_df=0.9).collect()} == {"b", "c"}


# ---- order statistics and additive models -------------------------------------------------
@pytest.mark.parametrize("most", [4096, 7])
def test_order_statistics_of_any_spread(spark, most):
    rng = np.random.default_rng(0)
    parts = {
        "norm": rng.standard_normal(3001), "one": np.array([3.5]), "ties": rng.integers(0, 3, 1000), "near": 1 + rng.random(2000) * 1e-12,
        "scales": np.r_[1 + 1e-15 * rng.integers(0, 50, 500), 1 + 1e-7 * rng.random(500), rng.random(500)],
        "negative": -np.exp(rng.standard_normal(1000) * 50), "small": rng.integers(0, 100, 100) * 5e-324,
    }
    pdf = pd.DataFrame({"g": np.repeat(list(parts), list(map(len, parts.values()))), "v": np.concatenate(list(parts.values())).astype(float)})
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(None, 1.0), ("norm", None), ("empty", None)], "g STRING, v DOUBLE"))
    got = selection.exact_quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.9, "y": 0.0, "z": 1.0}, most).toPandas().set_index("g")
    assert set(got.index) == set(parts)
    for g, x in parts.items():
        assert got.loc[g, "n"] == len(x)
        assert np.allclose(got.loc[g, list("abcyz")].astype(float), pd.Series(x, dtype=float).quantile([0.25, 0.5, 0.9, 0, 1]), rtol=1e-15, atol=1e-322)


def test_selection_sorts_only_few_rows(spark):
    df = spark.range(1_000_000).select(F.lit("x").alias("g"), (F.xxhash64("id") / F.lit(2.0**63)).alias("v"))
    found = selection.exact_quantiles(df, ["g"], "v", {"q": 0.5}, 500)
    assert found.first()["q"] == pytest.approx(np.median(df.toPandas()["v"]), abs=0)
    found = selection.exact_quantiles(spark.createDataFrame([("x", float("inf")), ("x", float("nan")), ("x", 1.0)], "g STRING, v DOUBLE"), ["g"], "v", {"q": 0.5})
    assert found.first()["q"] == float("inf")


def test_regression_scores_against_fits(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 2)) * (3, 0.1) + 1000
    pdf = pd.DataFrame({"k": range(600), "a": x[:, 0], "b": x[:, 1], "y": x @ [2.0, -30.0] + rng.standard_normal(600)})
    df = spark.createDataFrame(pdf)
    for reg in (0.0, 0.3):
        got = additive.regression_scores(df, ["a", "b"], "y", "k", 4, "s", reg).toPandas().set_index("score")
        rows = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(df).withColumn("fold", F.floor(hashing.uniform("s", "k") * 4)).cache()
        test, train = [], []
        for f in range(4):
            model = LinearRegression(featuresCol="f", labelCol="y", regParam=reg, solver="normal").fit(rows.where(F.col("fold") != f))
            test.append(model.evaluate(rows.where(F.col("fold") == f)).rootMeanSquaredError)
            train.append(model.summary.rootMeanSquaredError)
        assert np.allclose(got.loc["cross_validation"], [np.mean(test), np.std(test)], rtol=1e-6)
        assert np.allclose(got.loc["train"], [np.mean(train), np.std(train)], rtol=1e-6)
        assert got.loc["shuffled_target", "mean"] > 3 * got.loc["cross_validation", "mean"] or reg
    empty = additive.regression_scores(df.where("false"), ["a"], "y", "k", 4, "s")
    assert empty.count() == 0


def test_ridge_logistic_is_a_minimum(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((800, 3)) * (1, 4, 0.2)
    y = (rng.random(800) < 1 / (1 + np.exp(-(x @ [1.0, -0.5, 3.0] + 0.3)))).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x0": x[:, 0], "x1": x[:, 1], "x2": x[:, 2], "y": y}))
    for c in (0.1, 100.0):
        got = additive.ridge_logistic(df, F.array("x0", "x1", "x2"), F.col("y"), c)
        z, w = np.c_[np.ones(800), x], np.zeros(4)
        for _ in range(100):  # plain Newton steps in memory
            p = 1 / (1 + np.exp(-z @ w))
            w = w - np.linalg.solve(c * (z.T * (p * (1 - p))) @ z + np.diag([0, 1, 1, 1]), c * z.T @ (p - y) + [0, *w[1:]])
        assert np.allclose(got, w, rtol=1e-8, atol=1e-8)


def test_platform_usage_model_columns(spark):
    rng = np.random.default_rng(4)
    n = 400
    pdf = pd.DataFrame({"cat": rng.choice(list("xyz"), n), "level": rng.choice(["low", "mid", "high"], n), "age": rng.normal(50, 9, n),
                        "assets": np.where(rng.random(n) < 0.2, np.nan, rng.exponential(1e5, n))})
    pdf["none"] = (rng.random(n) < np.where(pdf["cat"] == "y", 0.8, 0.3)).astype(int)
    df = spark.createDataFrame(pdf).withColumn("assets", F.when(~F.isnan("assets"), F.col("assets")))
    got = {r.feature: r.coefficient for r in additive.platform_usage_model(df, "none", ["cat"], {"level": ["low", "mid", "high"]}, ["age"], ["assets"], 0.5).collect()}
    log = np.log10(pdf["assets"] + 1)
    log = log.fillna(log.mean())
    scale = lambda v: (v - v.mean()) / v.std(ddof=0)
    z = np.c_[np.ones(n), pdf["cat"] == "y", pdf["cat"] == "z", pdf["level"].map({"low": 0, "mid": 1, "high": 2}), scale(pdf["age"]), scale(log)].astype(float)
    w, y = np.zeros(6), pdf["none"].to_numpy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve(0.5 * (z.T * (p * (1 - p))) @ z + np.diag([0] + [1] * 5), 0.5 * z.T @ (p - y) + [0, *w[1:]])
    assert np.allclose([got[k] for k in ("cat_y", "cat_z", "level", "age", "assets")], w[1:], atol=1e-8)
    with pytest.raises(Exception, match="missing or unknown"):
        additive.platform_usage_model(df.withColumn("level", F.lit("other")), "none", ["cat"], {"level": ["low"]}, ["age"], [], 0.5)
