"""Token ids in Parquet list columns, written in id order and read in parts.

Method. Rows are cut into shards by ranges of (row id, hash of the text), each shard is sorted and encoded by one task, and
Spark's Parquet writer makes one file of it. The file format is set by the writer: ids in a list column with dictionary encoding
(delta, where a row group has too many different ids), row ids, positions and lengths with delta encoding, row groups and
pages of a given size, with the page indexes that the writer always adds. So a read of lengths or positions does not touch the
ids, and a read of some documents or of a span of tokens gets to the row groups and pages that hold them by their least and greatest values.

``tokens`` holds shard, row id, ``at`` (ids of the shard before this row), ``n_tokens`` and ``ids``. ``shards`` has one row per file: rows,
ids, least and greatest row id, and ``base``, the ids of all shards before it. A row's ids start at ``base + at``.

Texts are encoded unit by unit (see ``units``) with a memo, a long text in pieces, so a task holds one slice of texts and the ids of
one document. Equal row ids are ordered by their texts, rows with equal id and text may stand in either order; a random last key
lets even such rows be dealt over many shards.

Defined results: a null text counts as empty and has the end id alone; a null row id comes first; strings of special tokens in a text
become their ids, as the library does by default; extra columns are not written; an empty table gives files without rows, and no shards.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.llm import units as U
from tallyhouse.llm.words import lists, total_bytes

END_ID = 0
SHARD_BYTES = 64_000_000  # of text; its ids take about half of that
ROW_GROUP_BYTES = 16_000_000
PAGE_BYTES = 256_000
PAGE_ROWS = 1_000
RUN_CHARS = 2_000_000  # of texts that are encoded together
CHECK_ROWS = 10  # sizes are looked at after so many rows, since a row may be a long text

_ENCODERS: dict[str, tuple[U.ByteBpe, U.Memo]] = {}


def _encoder(path: str) -> tuple[U.ByteBpe, U.Memo]:
    """Encoder of a Python worker, kept with its memo for later tasks."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        model = U.ByteBpe(path)
        _ENCODERS[path] = model, U.Memo(model.encode_units)
    return _ENCODERS[path]


def _packed(texts: list[str], memo: U.Memo) -> Iterator[bytes]:
    """Ids of each of some texts. Every different unit of them is looked up once."""
    odd = list(map(U.is_odd, texts))
    names, place, units_at = U.unit_table([x for x, other in zip(texts, odd) if not other], fine=True)
    found = memo.values(names)
    ids, sizes = np.frombuffer(b"".join(found), dtype=np.int32), np.array([len(x) // 4 for x in found], dtype=np.int64)
    n = sizes[place]
    ids_at = np.r_[0, np.cumsum(n)]
    shift = (np.cumsum(sizes) - sizes)[place] - ids_at[:-1]
    data = ids[np.arange(ids_at[-1]) + np.repeat(shift, n)].tobytes()
    bounds = (4 * ids_at[units_at]).tolist()
    plain = (data[a:b] for a, b in zip(bounds, bounds[1:]))
    for text, other in zip(texts, odd):
        yield b"".join(memo.values(U.units(text, fine=True))) if other else next(plain)


def packed_ids(texts: list[str | None], memo: U.Memo) -> Iterator[bytes]:
    """Ids of each text as int32, for runs of texts at once."""
    run: list[str] = []
    chars = 0
    for text in texts:
        if text is not None and len(text) > U.PIECE_CHARS:
            yield from _packed(run, memo)
            run, chars = [], 0
            yield b"".join(x for piece in U.pieces(text) for x in _packed([piece], memo))
            continue
        run.append(text or "")
        chars += len(run[-1])
        if chars >= RUN_CHARS:
            yield from _packed(run, memo)
            run, chars = [], 0
    yield from _packed(run, memo)


def write(docs: DataFrame, path: str, tokenizer: str, row_id: str = "doc_id", text: str = "text", end_id: int = END_ID,
          shard_bytes: int = SHARD_BYTES, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Encode all texts and write the ids below ``path``, which must be new and reachable by all executors."""
    spark = docs.sparkSession
    plain = docs.select(F.col(row_id).alias("id"), F.col(text).alias("text"))
    n_shards = max(1, math.ceil(total_bytes(plain) / shard_bytes))
    keys = ["id", "tie", "salt"]
    placed = plain.withColumns({"tie": F.xxhash64("text"), "salt": F.rand(11)}).repartitionByRange(n_shards, *keys).sortWithinPartitions(*keys)
    kind = dict(plain.dtypes)["id"]
    end = np.array([end_id], dtype=np.int32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, shard, at = _encoder(tokenizer)[1], TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            first = 0
            parts: list[bytes] = []
            size = 0
            for i, packed in enumerate(packed_ids(texts.to_pylist(), memo), 1):
                parts.append(packed + end)
                size += len(packed)
                if size < 4 * U.PIECE_CHARS and i < batch.num_rows:
                    continue
                n = np.array([len(x) // 4 for x in parts], dtype=np.int64)
                bounds = np.r_[0, np.cumsum(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), shard, dtype=np.int32)), ids.slice(first, len(n)), pa.array(at + bounds[:-1]), pa.array(n),
                     lists(np.frombuffer(b"".join(parts), dtype=np.int32), bounds, pa.int32())],
                    names=["shard", row_id, "at", "n_tokens", "ids"])
                at += int(bounds[-1])
                first, parts, size = i, [], 0

    encoded = placed.select("id", "text").mapInArrow(run, f"shard int, `{row_id}` {kind}, at long, n_tokens long, ids array<int>")
    delta = {f"parquet.enable.dictionary#{c}": "false" for c in ("shard", row_id, "at", "n_tokens")}
    encoded.write.options(**{
        "parquet.writer.version": "PARQUET_2_0", "compression": "lz4_raw", "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes), "parquet.page.row.count.limit": str(page_rows), "parquet.page.size.row.check.min": str(CHECK_ROWS), **delta}).parquet(f"{path}/tokens")
    metadata = spark.read.parquet(f"{path}/tokens").select("shard", row_id, "n_tokens")
    sums = metadata.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").alias("n_tokens"), F.min(row_id).alias("first_id"), F.max(row_id).alias("last_id"))
    # One row per file, so the window is short.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))).coalesce(1).write.parquet(f"{path}/shards")


def shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, see above."""
    return spark.read.parquet(f"{path}/shards")


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """All rows with ``start``, the ids of all rows before each; columns that are not used further are not read."""
    return spark.read.parquet(f"{path}/tokens").join(shards(spark, path).select("shard", "base"), "shard").withColumn("start", F.col("base") + F.col("at"))


def documents(spark: SparkSession, path: str, first_id, last_id, row_id: str = "doc_id") -> DataFrame:
    """Rows whose id lies in a closed range; row groups and pages outside it are skipped."""
    return tokens(spark, path).where(F.col(row_id).between(F.lit(first_id), F.lit(last_id)))


def span(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The ids numbered from ``first`` to before ``last`` over all files, as parts of the rows that hold them."""
    met = shards(spark, path).where((F.col("base") < last) & (F.col("base") + F.col("n_tokens") > first)).agg(F.min("shard"), F.max("shard")).first()
    rows = tokens(spark, path).where(F.col("shard").between(F.lit(met[0]), F.lit(met[1])))
    rows = rows.where((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))
    skipped = F.greatest(F.lit(first) - F.col("start"), F.lit(0)).cast("int")
    wanted = (F.least(F.col("start") + F.col("n_tokens"), F.lit(last)) - F.col("start") - skipped).cast("int")
    return rows.withColumn("ids", F.slice("ids", skipped + 1, wanted)).withColumn("start", F.col("start") + skipped)


def checksums(spark: SparkSession, path: str, row_id: str = "doc_id") -> DataFrame:
    """Row id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit numbers, all from the files."""
    stored = spark.read.parquet(f"{path}/tokens")
    kind = dict(stored.dtypes)[row_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            bounds = ids.offsets.to_numpy()
            data = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = np.array([zlib.crc32(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums)], names=["shard", row_id, "at", "n_tokens", "ids_crc32"])

    summed = stored.select("shard", row_id, "at", "ids").mapInArrow(run, f"shard int, `{row_id}` {kind}, at long, n_tokens long, ids_crc32 long")
    placed = summed.join(shards(spark, path).select("shard", "base"), "shard")
    return placed.select(row_id, (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer(path: str | None = None) -> str:
    """The given file, by default the public one installed beside Python."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path
