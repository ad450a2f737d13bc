"""Sharding by extendible hashing.

Method. The directory is indexed by a prefix of the bits of a hash of the row key. A bucket whose rows exceed the
byte limit is split on one more bit, all others are left alone, until every shard fits. A bucket is too large exactly
if all its ancestors are, so the depth of a row's shard is the smallest number of bits whose bucket fits;
this is computed for all buckets at once from byte sums of fine cells (pre-aggregated in each task). Cells
that are still too large, because a few long rows meet there, are cut into finer cells in further rounds.

Rows whose keys are equal share all bits. If such rows exceed the limit, their shard gets overflow pages, numbered by
running bytes over the input order (not all numbers are used). A single row larger than the limit is a page or a shard of its own.

Defined results: the size of a row is the number of UTF-8 bytes of its text, 0 if null; a null key is one key like any
other; an empty table gives no rows and no shards; repeated rows are rows of their own; extra columns are
carried along by ``assign`` (its own four replace columns of the same names). A shard is named by its bits as text ("" if nothing was split), and
``page`` is 0 except for overflow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from tallyhouse.llm.saved import saved

LIMIT_BYTES = 32 << 20
BITS = 60
FINER = 3
ROUND_BITS = 8


def key_bits(key: str) -> Column:
    """The first 60 bits of the md5 of a key as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("~")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _right(value: Column, by: Column | int) -> Column:
    return F.call_function("shiftright", value, F.lit(by) if isinstance(by, int) else by)


def _left(value: Column, by: Column | int) -> Column:
    return F.call_function("shiftleft", value, F.lit(by) if isinstance(by, int) else by)


def directory(sizes: DataFrame, limit: int = LIMIT_BYTES) -> tuple[DataFrame, int]:
    """Leaves of the directory from rows (bits, bytes): depth, prefix, bytes, rows; those too large at full depth included.

    Also the number of bits of the first round: its cells are a fixed multiple of the number of shards needed.
    """
    total = sizes.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(total / limit, 1)))) + FINER)
    base = high
    rest, leaves = sizes, None
    while True:
        cells = rest.groupBy(_right(F.col("bits"), BITS - high).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        depths = F.sequence(F.lit(low), F.lit(high))
        buckets = saved(
            cells.select(F.explode(depths).alias("depth"), "cell", "bytes", "rows")
            .groupBy("depth", _right(F.col("cell"), F.lit(high) - F.col("depth")).alias("prefix"))
            .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")), "buckets")
        fits = (F.col("bytes") <= limit) | (F.col("rows") == 1) | (F.col("depth") == BITS)
        # A leaf fits and its parent does not. On the first level of a later round all parents are too large.
        parents = buckets.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        found = buckets.where(fits).withColumn("parent", _right(F.col("prefix"), 1))
        first = found.where(F.col("depth") == low)
        found = found.where(F.col("depth") > low).join(parents, ["depth", "parent"], "left_semi").select(*first.columns).unionByName(first)
        found = found.select("depth", "prefix", "bytes", "rows")
        leaves = found if leaves is None else leaves.unionByName(found)
        large = buckets.where(~fits & (F.col("depth") == high)).select(F.col("prefix").alias("cell"))
        if high >= BITS or large.isEmpty():
            return leaves, base
        rest = rest.withColumn("cell", _right(F.col("bits"), BITS - high)).join(large, "cell", "left_semi").drop("cell")
        low, high = high + 1, min(BITS, high + ROUND_BITS)


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> DataFrame:
    """All rows with the bits of their shard, its depth, overflow page, and the size of the row in bytes."""
    sized = docs.withColumns({"__th_bits": key_bits(key), "__th_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long")})
    leaves, cell = directory(sized.select(F.col("__th_bits").alias("bits"), F.col("__th_bytes").alias("bytes")), limit)
    leaves = saved(leaves, "leaves")
    bits = F.col("__th_bits")
    # Leaves of the first round, spelled out as cells of equal depth: as many as the directory has entries.
    shift = F.lit(cell) - F.col("depth")
    entries = leaves.where(F.col("depth") <= cell).select(
        F.explode(F.sequence(_left(F.col("prefix"), shift), _left(F.col("prefix") + 1, shift) - 1)).alias("__th_cell"),
        F.col("depth").alias("__th_depth"), F.col("prefix").alias("__th_prefix"))
    placed = sized.withColumn("__th_cell", _right(bits, BITS - cell)).join(entries, "__th_cell", "left").drop("__th_cell")
    deep = leaves.where(F.col("depth") > cell)
    for depth in sorted(r["depth"] for r in deep.select("depth").distinct().collect()):  # at most one row per bit
        mine = deep.where(F.col("depth") == depth).select(F.col("prefix").alias("__th_p"), F.col("depth").alias("__th_d"))
        placed = (placed.withColumn("__th_p", _right(bits, BITS - depth)).join(mine, "__th_p", "left")
                  .withColumns({"__th_depth": F.coalesce("__th_depth", "__th_d"), "__th_prefix": F.when(F.col("__th_d").isNotNull(), F.col("__th_p")).otherwise(F.col("__th_prefix"))})
                  .drop("__th_p", "__th_d"))
    placed = placed.drop("__th_bits")
    over = leaves.where((F.col("bytes") > limit) & (F.col("rows") > 1)).select(F.col("depth").alias("__th_depth"), F.col("prefix").alias("__th_prefix"))
    if not over.isEmpty():
        placed = _pages(placed, over, limit)
    else:
        placed = placed.withColumn("__th_page", F.lit(0).cast("long"))
    shard = F.when(F.col("__th_depth") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("__th_prefix").cast("string"), 10, 2), F.col("__th_depth"), F.lit("0")))
    kept = [c for c in docs.columns if c not in ("shard", "depth", "page", "n_bytes")]
    return placed.select(*kept, shard.alias("shard"), F.col("__th_depth").alias("depth"), F.col("__th_page").alias("page"), F.col("__th_bytes").alias("n_bytes"))


def _pages(placed: DataFrame, over: DataFrame, limit: int) -> DataFrame:
    """Overflow pages of rows with equal keys, numbered by running bytes in two levels: input parts, then rows inside each."""
    plain = placed.join(over, ["__th_depth", "__th_prefix"], "left_anti").withColumn("__th_page", F.lit(0).cast("long"))
    many = saved(placed.join(over, ["__th_depth", "__th_prefix"], "left_semi").withColumn("__th_seq", F.monotonically_increasing_id()), "overflow")
    part = F.floor(F.col("__th_seq") / 10_000).cast("long").alias("__th_part")  # parts of bounded size, whatever the key
    parts = many.select("__th_depth", "__th_prefix", part, "__th_bytes").groupBy("__th_depth", "__th_prefix", "__th_part").agg(F.sum("__th_bytes").alias("__th_sum"))
    order = Wd.partitionBy("__th_depth", "__th_prefix").orderBy("__th_part").rowsBetween(Wd.unboundedPreceding, -1)
    starts = parts.withColumn("__th_start", F.coalesce(F.sum("__th_sum").over(order), F.lit(0))).drop("__th_sum")
    inside = Wd.partitionBy("__th_depth", "__th_prefix", "__th_part").orderBy("__th_seq").rowsBetween(Wd.unboundedPreceding, -1)
    numbered = many.withColumn("__th_part", part).withColumn("__th_before", F.coalesce(F.sum("__th_bytes").over(inside), F.lit(0)))
    # Small rows of a page start within half a limit, so they fill at most one; each larger row has a page of its own.
    half = max(1, limit // 2)
    paged = numbered.join(starts, ["__th_depth", "__th_prefix", "__th_part"]).withColumn(
        "__th_page", 2 * F.floor((F.col("__th_start") + F.col("__th_before")) / half).cast("long") + (F.col("__th_bytes") > half).cast("long"))
    return plain.unionByName(paged.select(*plain.columns))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT_BYTES) -> None:
    """Write one folder per shard and page; a task writes one shard, as no shard exceeds the limit."""
    placed = assign(docs, key, text, limit)
    placed.withColumn("shard", F.concat(F.lit("b"), "shard")).repartition("shard", "page").write.partitionBy("shard", "page").parquet(path)
