"""Streaming jobs: files of the events table go through the jobs and the results are read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as TY

from tallyhouse import views
from tallyhouse.checks.base import M, SRC, T, r, stamp
from tallyhouse.functions.hashing import uniform
from tallyhouse.operators.windows import batch_slot
from tallyhouse.plans.violence_series import final_probability
from tallyhouse.session import scratch_path
from tallyhouse.streaming import mentions as sm
from tallyhouse.views import sql_uniform as U

DELAY = "6 hours"
FAR = "2100-01-01 00:00:00"


def _closing(df):
    """One row far in the future, so that every real window is final."""
    one = df.limit(1)
    return one.select(*[
        F.lit(FAR).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, TY.TimestampNTZType) else F.col(f.name)
        for f in df.schema.fields
    ])


def _totals(spark, sf, job, stats):
    src, out, check = (scratch_path(spark, n) for n in ("in", "out", "check"))
    m = final_probability(views.mentions(spark, sf)).select("id", "created_at", "t_win_weight", "w_final_prob")
    m.write.parquet(src)
    _closing(m).write.mode("append").parquet(src)
    sm.run_available(job(sm.read_batches(spark, src, m.schema), "created_at", stats), out, check)
    df = spark.read.parquet(out)
    return df.where(F.col("slot") < F.lit(FAR).cast("timestamp")).select(stamp("slot").alias("slot"), "n", *[r(s).alias(s) for s in stats])


def stream_score(spark, sf):
    src, out, check = (scratch_path(spark, n) for n in ("in", "out", "check"))
    m = views.mentions(spark, sf).withColumn("batch_time", F.date_format("batch_time", "yyyyMMdd'T'HHmm")).select(
        "id", "hate_score", "target_prob", "t_win_weight", "batch_time")
    late = F.col("batch_time") >= "20240115T0030"
    for part in (m.where(~late), m.where(late)):
        part.write.mode("append").parquet(src)
        sm.stream_score(sm.read_batches(spark, src, m.schema), final_probability, out, check)
    df = spark.read.schema("id LONG, w_final_prob DOUBLE, batch_time STRING").parquet(out)
    return df.select("id", "batch_time", r("w_final_prob", 9).alias("w_final_prob"))


def stream_batch_totals(spark, sf):
    return _totals(spark, sf, sm.stream_batch_totals, ["t_win_weight", "w_final_prob"])


def stream_period_totals(spark, sf):
    return _totals(spark, sf, lambda s, ts, st: sm.stream_period_totals(s, ts, st, 12), ["w_final_prob"])


def stream_dedupe(spark, sf):
    src, out, check = (scratch_path(spark, n) for n in ("in", "out", "check"))
    e = T(spark, sf, "events").select("event_id", "ts", "value")
    e.write.parquet(src)
    e.where("value > 20").write.mode("append").parquet(src)
    sm.run_available(sm.stream_dedupe(sm.read_batches(spark, src, e.schema), "event_id", "ts", "60 days"), out, check)
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_ids"), r(F.sum("value"), 4).alias("value"))


def stream_late_batches(spark, sf):
    """First run: most events before 20 January. Second run: all others, among them late ones."""
    src, out, check, late, check2 = (scratch_path(spark, n) for n in ("in", "out", "check", "late", "check"))
    e = T(spark, sf, "events").select("event_id", "ts", "value")
    early = (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")) & (uniform("late", "event_id") >= 0.1)
    slot = views.slot_end("ts")
    for part in (e.where(early), e.where(~early).unionByName(_closing(e))):
        part.write.mode("append").parquet(src)
        stream = lambda: sm.read_batches(spark, src, e.schema)
        sm.run_available(sm.stream_batch_totals(stream(), "ts", ["value"], DELAY), out, check)
        sm.stream_late_rows(stream(), "ts", slot, late, check2, DELAY)
    final = spark.read.parquet(out).where(F.col("slot") < F.lit(FAR).cast("timestamp"))
    late_rows = sm.read_late_rows(spark, late, e.schema)
    a = final.select(F.lit("final").alias("kind"), stamp("slot").alias("slot"), "n", r("value", 4).alias("value"))
    b = late_rows.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return a.unionByName(b.select(F.lit("late").alias("kind"), stamp("slot").alias("slot"), "n", r("value", 4).alias("value")))


def stream_enrich(spark, sf):
    src, out, check = (scratch_path(spark, n) for n in ("in", "out", "check"))
    m = views.mentions(spark, sf).select("id", "batch_user", "batch_time")
    m.write.parquet(src)
    bad = spark.createDataFrame([(i,) for i in views.BAD_ACCOUNTS], "id LONG")
    df = sm.stream_enrich(sm.read_batches(spark, src, m.schema), views.pool_sources(spark), "batch_time", bad)
    sm.run_available(df.select("id", "batch_user", "file"), out, check)
    return spark.read.parquet(out)


def batch_slot_query(spark, sf):
    e = T(spark, sf, "events")
    return e.select("event_id", stamp(batch_slot(F.col("ts"), "2024-01-01 00:30:00", 3)).alias("slot"),
                    stamp(batch_slot(F.col("ts"), "2024-01-10 04:00:00", 0.5)).alias("half"))


_W = "hate_score * target_prob * t_win_weight"
QUERIES = {
    "stream_score": (stream_score, f"""WITH {M}
        SELECT id, strftime(batch_time, '%Y%m%dT%H%M') AS batch_time, round({_W}, 9) AS w_final_prob FROM m"""),
    "stream_batch_totals": (stream_batch_totals, f"""WITH {M}
        SELECT strftime(batch_time, '%Y-%m-%d %H:%M:%S') AS slot, count(*) AS n, round(sum(t_win_weight), 8) AS t_win_weight,
          round(sum({_W}), 8) AS w_final_prob FROM m GROUP BY batch_time"""),
    "stream_period_totals": (stream_period_totals, f"""WITH {M}
        SELECT strftime(time_bucket(INTERVAL '12 hours', created_at - INTERVAL 1 MICROSECOND, TIMESTAMP '2024-01-01') + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S') AS slot,
          count(*) AS n, round(sum({_W}), 8) AS w_final_prob FROM m GROUP BY 1"""),
    "stream_dedupe": (stream_dedupe, """
        SELECT count(*) AS n, count(DISTINCT event_id) AS n_ids, round(sum(value), 4) AS value FROM events"""),
    "stream_late_batches": (stream_late_batches, f"""
        WITH e AS (SELECT ts, value, ts < TIMESTAMP '2024-01-20' AND {U('late', 'event_id')} >= 0.1::DOUBLE AS early,
            time_bucket(INTERVAL '3 hours', ts - INTERVAL 1 MICROSECOND, TIMESTAMP '2024-01-01 00:30:00') + INTERVAL 3 HOUR AS slot FROM events),
        w AS (SELECT date_trunc('millisecond', max(ts) - INTERVAL 1 MICROSECOND) - INTERVAL 6 HOUR AS w FROM e WHERE early)
        SELECT CASE WHEN early OR slot > w THEN 'final' ELSE 'late' END AS kind, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, count(*) AS n,
          round(sum(value), 4) AS value FROM e, w GROUP BY 1, 2"""),
    "stream_enrich": (stream_enrich, f"""WITH {M}, {SRC}
        SELECT id, batch_user, file FROM m JOIN src ON batch_time BETWEEN first_batch AND last_batch WHERE batch_user NOT IN (3, 5)"""),
    "batch_slot": (batch_slot_query, """
        SELECT event_id, strftime(TIMESTAMP '2024-01-01 00:30:00' + to_hours(3 * greatest(ceil((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:30:00')) / 10800000000.0), 0)::BIGINT), '%Y-%m-%d %H:%M:%S') AS slot,
          strftime(TIMESTAMP '2024-01-10 04:00:00' + to_minutes(30 * greatest(ceil((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 04:00:00')) / 1800000000.0), 0)::BIGINT), '%Y-%m-%d %H:%M:%S') AS half FROM events"""),
}
