"""Structured Streaming jobs over captured mentions.

Event time is the mention time minus one microsecond, so that the left-closed windows of
Spark become the right-closed slots of the batch operators.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyhouse.operators.joins import drop_ids, interval_join

EVENT_TIME = "_event_time"


def read_batches(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of the batch files below ``path``; directories of the form column=value add that column."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"').option("multiLine", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def with_event_time(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    moment = (F.col(ts) - F.expr("INTERVAL 1 MICROSECOND")).cast("timestamp")
    return stream.withColumn(EVENT_TIME, moment).withWatermark(EVENT_TIME, delay)


def run_available(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet", by: Sequence[str] = ()
) -> StreamingQuery:
    """Process all files present and stop; a later call with the same checkpoint takes only new ones."""
    writer = stream.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).option("path", path)
    if by:
        writer = writer.partitionBy(*by)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stream_score(
    stream: DataFrame, scorer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, slot: str = "batch_time",
    first: str | None = None, last: str | None = None,
) -> StreamingQuery:
    """Score the batches that were not scored yet, one output directory per batch.

    The checkpoint remembers finished files; a new checkpoint (and path) scores all again.
    """
    rows = stream
    if first:
        rows = rows.where(F.col(slot) >= F.lit(first))
    if last:
        rows = rows.where(F.col(slot) <= F.lit(last))
    return run_available(scorer(rows), path, checkpoint, by=[slot])


def stream_totals(stream: DataFrame, ts: str, stats: Sequence[str], period: str, offset: str, delay: str) -> DataFrame:
    """Sums per right-closed window labelled by its end; a window comes out once the watermark passes it."""
    timed = with_event_time(stream, ts, delay)
    win = F.window(EVENT_TIME, period, period, offset)
    return timed.groupBy(win.alias("w")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(s) for s in stats]).select(
        F.col("w.end").alias("slot"), "n", *stats
    )


def stream_batch_totals(stream: DataFrame, ts: str, stats: Sequence[str], delay: str = "6 hours") -> DataFrame:
    """Weighted sums per 3 h slot of the capture grid."""
    return stream_totals(stream, ts, stats, "3 hours", "30 minutes", delay)


def stream_period_totals(stream: DataFrame, ts: str, stats: Sequence[str], hours: int, delay: str = "6 hours") -> DataFrame:
    """Sums per analysis bin of ``hours``, bins starting at midnight."""
    return stream_totals(stream, ts, stats, f"{hours} hours", "0 minutes", delay)


def stream_dedupe(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Each mention once: repeats within ``delay`` of the first are dropped, state older than that is freed."""
    return with_event_time(stream, ts, delay).dropDuplicatesWithinWatermark([key]).drop(EVENT_TIME)


def stream_enrich(
    stream: DataFrame, sources: DataFrame, at: str, bad: DataFrame | None = None, user: str = "batch_user"
) -> DataFrame:
    """Mentions with the account list active at ``at``; listed bad accounts removed. No state is kept."""
    rows = interval_join(stream, sources, at, "first_batch", "last_batch")
    return drop_ids(rows, bad, user) if bad is not None else rows


def stream_late_rows(stream: DataFrame, ts: str, slot_end, path: str, checkpoint: str, delay: str) -> StreamingQuery:
    """Rows that arrive after their slot was final, which the totals leave out silently.

    Every micro-batch compares its slots with the newest time of the earlier ones minus
    ``delay``. The newest time is one value per micro-batch, kept in files written by
    batch number, so a repeated micro-batch overwrites its own results.
    """
    spark = stream.sparkSession
    times, late = f"{path}/times", f"{path}/late"
    spark.createDataFrame([], "newest TIMESTAMP, batch LONG").write.mode("append").parquet(times)

    def handle(batch: DataFrame, number: int) -> None:
        moment = (F.col(ts) - F.expr("INTERVAL 1 MICROSECOND")).cast("timestamp")
        seen = spark.read.schema("newest TIMESTAMP, batch LONG").parquet(times).where(F.col("batch") < number)
        mark = seen.agg(F.date_trunc("MILLISECOND", F.max("newest")) - F.expr(f"INTERVAL {delay}")).first()[0]
        if mark is not None:
            end = slot_end.cast("timestamp")
            batch.where(end <= F.lit(mark)).write.mode("overwrite").parquet(f"{late}/run={number}")
        newest = batch.agg(F.max(moment).alias("newest"), F.lit(number).cast("bigint").alias("batch"))
        newest.write.mode("overwrite").parquet(f"{times}/run={number}")

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_late_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/late")
