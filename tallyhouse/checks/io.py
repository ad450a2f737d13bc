"""Sources and sinks: tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as TY

from tallyhouse import views
from tallyhouse.checks.base import M, T, day, r, stamp
from tallyhouse.operators.windows import agg_by_day
from tallyhouse.session import scratch_path
from tallyhouse.sources import pages as pg
from tallyhouse.sources import sinks, tables


def _quoted(writer):
    """Writer of texts with line breaks and quotes, as the readers expect them."""
    return (
        writer.option("header", True).option("escape", '"').option("quoteAll", True)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    )


def load_concat_csv(spark, sf):
    path = scratch_path(spark, "concat")
    note = F.concat(F.col("event_type"), F.lit('\n"q", '), F.col("event_id").cast("string"))
    ev = T(spark, sf, "events").select("event_id", "value", note.alias("note"), day("ts").alias("d"))
    _quoted(ev.hint("rebalance", F.col("d")).write.partitionBy("d")).csv(path)
    df = tables.load_concat_csv(spark, path, "event_id LONG, value DOUBLE, note STRING")
    return (
        df.groupBy(F.regexp_extract("filename", r"d=([\d-]+)", 1).alias("d"))
        .agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 4).alias("total"), F.min(F.md5("note")).alias("digest"))
    )


def robust_load_csv(spark, sf):
    path = scratch_path(spark, "robust")
    docs = T(spark, sf, "documents").select("doc_id", F.concat("text", F.lit('\r"q" '), "lang").alias("text"))
    (
        docs.write.option("header", True).option("escape", '"').option("quoteAll", True)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )
    df = tables.robust_load_csv(spark, path, "doc_id LONG, text STRING")
    return df.select("doc_id", F.md5("text").alias("digest"))


def load_register(spark, sf):
    path = scratch_path(spark, "register")
    c = T(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("AÇÃO "), "c_name").alias("c_name"), "c_nationkey",
        F.translate(F.col("c_acctbal").cast("decimal(18,2)").cast("string"), ".", ",").alias("c_acctbal"),
    )
    c.write.option("sep", ";").option("encoding", "ISO-8859-1").option("header", True).csv(path)
    df = tables.load_register(
        spark, path, "c_custkey LONG, c_name STRING, c_nationkey INT, c_acctbal STRING", ["c_custkey", "c_name"]
    )
    return df


def load_register_dir(spark, sf):
    path = scratch_path(spark, "registers")
    c = T(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    w = lambda df, name: df.write.option("sep", ";").option("encoding", "ISO-8859-1").csv(f"{path}/{name}")
    w(c.where("c_nationkey < 10"), "consulta_AC.txt")
    w(c.where("c_nationkey >= 10"), "consulta_BRASIL.txt")
    spark.createDataFrame([("KEY;NATION;SEGMENT",)], "value STRING").write.text(f"{path}/header.txt")
    df = tables.load_register_dir(spark, path)
    return df.groupBy("SEGMENT").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("KEY").cast("bigint")).alias("keys"),
        F.min(F.col("NATION").cast("int")).alias("lowest"),
    )


def _paged(spark, sf):
    c = T(spark, sf, "conversations").withColumn("page", F.floor(F.col("turn") / 100))
    code = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3).cast("bigint")
    d = F.struct(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("id"),
        F.concat("text", F.lit("\rx")).alias("text"),
        code.alias("author_id"),
        F.lit("2024-01-01T00:00:00.000Z").alias("created_at"),
        F.when(F.col("turn") > 0, F.lit("7")).alias("in_reply_to_user_id"),
        F.struct(
            F.transform(
                F.sequence(F.lit(1), (1 + F.col("turn") % 3).cast("int")),
                lambda i: F.struct(F.concat(F.lit("u"), i.cast("string")).alias("username"), i.cast("string").alias("id")),
            ).alias("mentions")
        ).alias("entities"),
    )
    user = F.struct(code.alias("id"), F.upper("role").alias("name"), F.col("role").alias("username"))
    return c.select("conv_id", "page", "turn", d.alias("d"), user.alias("u"))


def _fold(rows):
    return rows.groupBy("conv_id", "page").agg(
        F.collect_list("d").alias("data"),
        F.struct(F.collect_set("u").alias("users")).alias("includes"),
        F.struct(F.count(F.lit(1)).alias("result_count"), F.lit(None).cast("string").alias("next_token")).alias("meta"),
    ).drop("conv_id", "page")


def load_mentions_json(spark, sf):
    path = scratch_path(spark, "pages")
    _fold(_paged(spark, sf)).write.json(path)
    df = pg.load_mentions_json(pg.read_pages(spark, path), account="7")
    return df.select(
        "id", F.md5("text").alias("digest"), "author_name", "tweet_url", "n_mentions", "direct_reply",
        "in_reply_to_user_id",
    )


def union_pages(spark, sf):
    rows = _paged(spark, sf)
    thirds = [_fold(rows.where(F.col("turn") % 3 == i)) for i in range(3)]
    thirds[1] = thirds[1].withColumn(
        "errors", F.array(F.struct(F.lit("gone").alias("title"), F.lit("").alias("detail")))
    )
    merged = pg.union_pages(thirds)
    flat = pg.load_mentions_json(merged).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_mentions").alias("mentions"))
    tot = pg.page_totals(merged)
    return tot.select("result_count", "n_errors", flat.select("n_rows").scalar().alias("n_rows"),
                      flat.select("mentions").scalar().alias("mentions"))


def expand_struct(spark, sf):
    ev = T(spark, sf, "events").select("event_id", F.from_json("props", "k INT").alias("props"))
    return pg.expand_struct(ev)


def load_pool_sources(spark, sf):
    path = scratch_path(spark, "sources")
    week = F.date_trunc("week", "ts")
    w = T(spark, sf, "events").select(week.alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    last = w.agg(F.max("w")).scalar()
    out = w.select(
        F.concat(F.lit("list_"), F.date_format("w", "yyyyMMdd")).alias("file"),
        stamp("w").alias("first_batch"),
        F.when(F.col("w") < last, stamp(F.col("w") + F.expr("INTERVAL 7 DAYS"))).alias("last_batch"),
    )
    out.write.option("header", True).csv(path)
    df = tables.load_pool_sources(spark, path)
    return df.select("file", stamp("first_batch").alias("first_batch"), stamp("last_batch").alias("last_batch"))


def load_pools(spark, sf):
    root = scratch_path(spark, "pools")
    c = T(spark, sf, "customer").select("c_custkey", "c_acctbal", F.concat("c_mktsegment", F.lit('\n, "x"')).alias("c_mktsegment"))
    for name, cond in (("early", "c_mktsegment < 'G'"), ("late", "c_mktsegment >= 'G'")):
        _quoted(c.where(cond).write).csv(f"{root}/{name}.csv")
    df = tables.load_pools(spark, root, "c_custkey LONG, c_acctbal DOUBLE, c_mktsegment STRING")
    return df.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"), F.max(F.md5("c_mktsegment")).alias("digest"))


def load_group_data(spark, sf):
    path = scratch_path(spark, "groups")
    d = T(spark, sf, "documents").select("doc_id", "n_chars", F.concat("text", F.lit('\n"')).alias("text"), "lang")
    _quoted(d.hint("rebalance", F.col("lang")).write.partitionBy("lang")).csv(path)
    df = tables.load_group_data(spark, path, "doc_id LONG, n_chars LONG, text STRING", "lang=")
    return df.groupBy(F.regexp_extract("group", r"^(\w+)", 1).alias("sample")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.min(F.md5("text")).alias("digest")
    )


_ARFF_HEAD = ["@relation texts", "", "@attribute label {no, yes}", "@attribute document string", "", "% corpus", "", "@data"]


def read_labelled_arff(spark, sf):
    path = scratch_path(spark, "arff")
    body = T(spark, sf, "labels").join(T(spark, sf, "documents"), "doc_id").select(
        F.concat(
            F.when(F.col("toxic") == 1, "yes").otherwise("no"), F.lit(",'"),
            F.regexp_replace("text", r"[\r\n\\']", " "), F.lit("'"),
        ).alias("value")
    )
    spark.createDataFrame([(h,) for h in _ARFF_HEAD], "value STRING").unionByName(body).write.text(path)
    df = tables.read_labelled_arff(spark, path)
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def write_partitioned(spark, sf):
    path = scratch_path(spark, "batches")
    m = views.mentions(spark, sf).select("id", "hate_score", F.date_format("batch_time", "yyyyMMdd'T'HHmm").alias("batch_time"))
    sinks.write_partitioned(m, path)
    df = spark.read.schema("id LONG, hate_score DOUBLE, batch_time STRING").parquet(path)
    return df.groupBy("batch_time").agg(F.count(F.lit(1)).alias("n"), r(F.sum("hate_score")).alias("hate"))


def _daily(spark, sf):
    m = views.mentions(spark, sf).withColumn("w_hate", F.col("hate_score") * F.col("target_prob") * F.col("t_win_weight"))
    return agg_by_day(m, "batch_time", ["w_hate", "t_win_weight"])


def export_series(spark, sf):
    series = sinks.export_series(_daily(spark, sf), "day", "w_hate", "t_win_weight")
    path = scratch_path(spark, "series")
    sinks.write_series(series, path)
    return spark.read.option("header", True).schema("day STRING, total LONG, violent LONG, percent DOUBLE").csv(path)


def headline_numbers(spark, sf):
    return sinks.headline_numbers(_daily(spark, sf), "day", "w_hate", "2024-01-15")


def export_for_annotation(spark, sf):
    d = T(spark, sf, "documents").withColumn("prob_bin", (F.col("n_chars") % 10).cast("int"))
    sheet = sinks.export_for_annotation(
        d.select("doc_id", F.md5("text").alias("text_md5"), "source", "prob_bin"),
        ["doc_id", "text_md5", "source", "prob_bin"], ["violent", "target"],
    )
    blank = F.coalesce(F.col("violent"), F.col("target")).isNull().cast("int").alias("blank")
    return sheet.select("doc_id", "text_md5", "source", "prob_bin", blank)


_DAILY = f"""WITH {M}, d AS (
  SELECT CAST(batch_time - INTERVAL 90 MINUTE AS DATE) AS day, sum(hate_score * target_prob * t_win_weight) AS w_hate,
    sum(t_win_weight) AS w FROM m GROUP BY 1)"""

QUERIES = {
    "load_concat_csv": (load_concat_csv, """
        SELECT strftime(ts, '%Y-%m-%d') AS d, count(*) AS n, round(sum(value), 4) AS total,
          min(md5(event_type || chr(10) || '"q", ' || event_id::VARCHAR)) AS digest FROM events GROUP BY 1"""),
    "robust_load_csv": (robust_load_csv, """
        SELECT doc_id, md5(text || chr(13) || '"q" ' || lang) AS digest FROM documents"""),
    "load_register": (load_register, "SELECT c_custkey, 'AÇÃO ' || c_name AS c_name FROM customer"),
    "load_register_dir": (load_register_dir, """
        SELECT c_mktsegment AS "SEGMENT", count(*) AS n, sum(c_custkey)::BIGINT AS keys, min(c_nationkey) AS lowest
        FROM customer WHERE c_nationkey >= 10 GROUP BY 1"""),
    "load_mentions_json": (load_mentions_json, """
        SELECT conv_id * 100000 + turn AS id, md5(text || ' x') AS digest, upper(role) AS author_name,
          'https://twitter.com/' || role || '/status/' || (conv_id * 100000 + turn)::VARCHAR AS tweet_url,
          (1 + turn % 3)::INT AS n_mentions, (turn > 0)::INT AS direct_reply,
          CASE WHEN turn > 0 THEN '7' END AS in_reply_to_user_id
        FROM conversations"""),
    "union_pages": (union_pages, """
        SELECT count(*) AS result_count,
          (SELECT count(*) FROM (SELECT DISTINCT conv_id, turn // 100 FROM conversations WHERE turn % 3 = 1)) AS n_errors,
          count(*) AS n_rows, sum(1 + turn % 3)::BIGINT AS mentions FROM conversations"""),
    "expand_struct": (expand_struct, "SELECT event_id, (props->>'k')::INT AS k FROM events"),
    "load_pool_sources": (load_pool_sources, """
        WITH w AS (SELECT DISTINCT date_trunc('week', ts)::TIMESTAMP AS w FROM events)
        SELECT 'list_' || strftime(w, '%Y%m%d') AS file, strftime(w, '%Y-%m-%d %H:%M:%S') AS first_batch,
          CASE WHEN w < (SELECT max(w) FROM w) THEN strftime(w + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S')
            ELSE '2050-01-01 00:00:00' END AS last_batch FROM w"""),
    "load_pools": (load_pools, """
        SELECT CASE WHEN c_mktsegment < 'G' THEN 'early' ELSE 'late' END AS file, count(*) AS n,
          sum(c_custkey)::BIGINT AS keys, max(md5(c_mktsegment || chr(10) || ', "x"')) AS digest FROM customer GROUP BY 1"""),
    "load_group_data": (load_group_data, """
        SELECT lang AS sample, count(*) AS n, sum(n_chars)::BIGINT AS chars, min(md5(text || chr(10) || '"')) AS digest FROM documents GROUP BY 1"""),
    "read_labelled_arff": (read_labelled_arff, """
        SELECT toxic AS label, count(*) AS n, sum(length(regexp_replace(text, '[\\r\\n\\\\'']', ' ', 'g')))::BIGINT AS chars
        FROM labels JOIN documents USING (doc_id) GROUP BY 1"""),
    "write_partitioned": (write_partitioned, f"""WITH {M}
        SELECT strftime(batch_time, '%Y%m%dT%H%M') AS batch_time, count(*) AS n, round(sum(hate_score), 8) AS hate FROM m GROUP BY 1"""),
    "export_series": (export_series, _DAILY + """
        SELECT strftime(day, '%Y-%m-%d') AS day, round_even(w, 0)::BIGINT AS total, round_even(w_hate, 0)::BIGINT AS violent,
          round_even(round_even(w_hate, 0) / round_even(w, 0) * 100, 2) AS percent FROM d"""),
    "headline_numbers": (headline_numbers, _DAILY + """
        SELECT floor(sum(w_hate) + 0.5)::BIGINT AS total_counts,
          floor(coalesce(sum(w_hate) FILTER (WHERE day = DATE '2024-01-14'), 0) + 0.5)::BIGINT AS yesterday_counts FROM d"""),
    "export_for_annotation": (export_for_annotation, """
        SELECT doc_id, md5(text) AS text_md5, source, (n_chars % 10)::INT AS prob_bin, 1 AS blank
        FROM documents"""),
}
