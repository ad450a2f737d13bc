"""Documents that hold benchmark items, found by fingerprints of item-sized windows.

Method. Texts are compared in lower case, as words of letters and digits, in shingles of five
words (an item of fewer words is one shingle). All shingles weigh the same, so a similarity depends on the two
texts alone. The SimHash of a window is the sign of the sum of 128 pseudo-random
signs of its shingles. For every item size that occurs, windows of that size slide over every
whole text word by word; a text shorter than an item is one window as a whole. The 128 bits are cut into blocks so that two fingerprints
within ``radius`` differ in few bits in some block; the items' blocks are listed with all
values within that many bits, so an equi-join on (size, block, value) meets every pair
within the radius. Pairs within the radius are then compared exactly: Jaccard similarity of
the two multisets of shingles, kept from ``similarity`` on.

Before fingerprints are made, windows that cannot pass the exact comparison are left out: if less
than ``similarity`` of the shingles of a window are shingles of items of its size, the
Jaccard similarity with each such item is smaller still. The bound holds for all windows, so
nothing is lost.

Items are a table of their own size: they are handled in slices of ``ITEM_WORDS`` words, so that
what is sent to tasks is bounded; more items mean more passes over the texts.

Defined results: null and empty texts and items hold no words and match nothing; repeated items match under each of their ids; repeated rows of one
document id give one row. Only documents that match are returned. An empty table on either
side gives an empty result, extra columns are not used.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import words as W
from tallyhouse.llm.saved import saved

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 31
BLOCKS = 11
ITEM_WORDS = 1_000_000
BITS = 128
_U = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, W.Words]]:
    data, offsets = W.text_bytes(pc.utf8_lower(batch.column(batch.schema.get_field_index(column))))
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + 1_000_000, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last, W.cut(_FOLD[data[offsets[first]:offsets[last]]], offsets[first:last + 1] - offsets[first])
        first = last


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """Two longs with the 128 signs of the sum."""
    low = W.mix(shingles)
    high = W.mix(low ^ _U(0x5851F42D4C957F2D))
    planes = np.unpackbits(np.stack([low, high], axis=1).view(np.uint8), axis=1)
    signs = 2 * planes.sum(axis=0, dtype=np.int64) > len(planes)
    packed = np.packbits(signs).view(np.int64)
    return int(packed[0]), int(packed[1])


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        out: dict[str, list] = {"item_id": [], "size": [], "k": [], "shingles": []}
        for first, last, w in _slices(batch, "text"):
            h = w.hashes()
            for d in range(last - first):
                a, b = int(w.bounds[d]), int(w.bounds[d + 1])
                if b > a:
                    k = min(SHINGLE, b - a)
                    out["item_id"].append(ids[first + d])
                    out["size"].append(b - a)
                    out["k"].append(k)
                    out["shingles"].append(W.grams(h[a:b], k, k).view(np.int64))
        yield pa.RecordBatch.from_arrays([
            pa.array(out["item_id"], type=batch.schema.field(0).type), pa.array(out["size"], type=pa.int32()), pa.array(out["k"], type=pa.int32()),
            pa.array(out["shingles"], type=pa.list_(pa.int64()))], names=list(out))


def item_table(benchmark: DataFrame, row_id: str = "item_id", text: str = "text") -> DataFrame:
    """Items with their size in words, shingle length and shingles."""
    kind = dict(benchmark.dtypes)[row_id]
    cut = benchmark.select(F.col(row_id).alias("item_id"), F.col(text).alias("text")).mapInArrow(
        _items, f"item_id {kind}, size int, k int, shingles array<long>")
    return (cut.dropDuplicates(["item_id", "shingles"])
            .withColumn("row", F.pmod(F.xxhash64("item_id", "shingles"), F.lit(1 << 30))))


class ItemIndex:
    """Shingles of a slice of items, and the sizes of the items that hold each, by shingle length."""

    def __init__(self, rows: list):
        sizes: dict[int, set[tuple[int, int]]] = {}
        for r in rows:
            for shingle in r["shingles"]:
                sizes.setdefault(shingle, set()).add((r["k"], r["size"]))
        self.lengths = sorted({r["k"] for r in rows})
        self.shingles = np.array(sorted(sizes), dtype=np.int64)
        listed = [sorted(size for _, size in sizes[x]) for x in self.shingles.tolist()]
        self.bounds = np.r_[0, np.cumsum([len(x) for x in listed])].astype(np.int64)
        self.sizes = np.array([n for x in listed for n in x], dtype=np.int32)
        self.mask = _U((1 << max(16, int(len(self.shingles) * 32).bit_length())) - 1)
        self.seen = np.zeros(int(self.mask) + 1, dtype=bool)
        self.seen[(self.shingles.view(_U) & self.mask).astype(np.int64)] = True

    def find(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of shingles of any item, and their places in the index."""
        maybe = np.flatnonzero(self.seen[(shingles & self.mask).view(np.int64)])
        if not len(maybe) or not len(self.shingles):
            return maybe[:0], maybe[:0]
        value = shingles[maybe].view(np.int64)
        at = np.minimum(np.searchsorted(self.shingles, value), len(self.shingles) - 1)
        hit = self.shingles[at] == value
        return maybe[hit], at[hit]


def _near(w: W.Words, g: np.ndarray, k: int, index: ItemIndex, similarity: float) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Windows (document, first word, size, shingles) with enough shingles of items of just this size."""
    at, place = index.find(g)
    owner = np.searchsorted(w.bounds, at, side="right") - 1
    whole = at + k <= w.bounds[owner + 1]
    at, place, owner = at[whole], place[whole], owner[whole]
    many = index.bounds[place + 1] - index.bounds[place]
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    size = index.sizes[np.repeat(index.bounds[place], many) + step].astype(np.int64)
    hit, doc = np.repeat(np.arange(len(at)), many), np.repeat(owner, many)
    order = np.lexsort((hit, size, doc))
    hit, doc, size = hit[order], doc[order], size[order]
    cuts = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(size) != 0), True]) if len(hit) else []
    for i, j in zip(cuts[:-1], cuts[1:]):
        m, d = int(size[i]) - k + 1, int(doc[i])
        a, b = int(w.bounds[d]), int(w.bounds[d + 1]) - k + 1
        # A window needs at least similarity * m shingles of an item of m; a shorter text is one window.
        if m < 1 or j - i < similarity * m - 1e-9:
            continue
        m = min(m, b - a)
        own = np.zeros(b - a, dtype=np.int64)
        own[at[hit[i:j]] - a] = 1
        got = np.r_[0, np.cumsum(own)]
        for p in np.flatnonzero(got[m:] - got[:-m] >= similarity * m - 1e-9).tolist():
            yield d, p, int(size[i]), g[a + p:a + p + m]


def _windows(batches: Iterator[pa.RecordBatch], index: ItemIndex, similarity: float) -> Iterator[pa.RecordBatch]:
    """Item-sized windows, and shorter texts as a whole, that can reach the similarity, with fingerprint and shingles."""
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    for batch in batches:
        out: list[tuple] = []
        for first, _, w in _slices(batch, "text"):
            h = w.hashes()
            for k in index.lengths:
                if len(h) >= k:
                    out += [(first + d, p, size, *fingerprint(x), x.view(np.int64))
                            for d, p, size, x in _near(w, W.grams(h, k, k), k, index, similarity)]
        columns = list(zip(*out)) or [()] * 6
        rows = pa.array(columns[0], type=pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), batch.column(1).take(rows)] + [pa.array(v, type=t) for v, t in zip(columns[1:], kinds)],
            names=["doc", "row_key", "start", "size", "f0", "f1", "shingles"])


def _bounds() -> list[tuple[int, int]]:
    edges = np.linspace(0, BITS, BLOCKS + 1).round().astype(int).tolist()
    return list(zip(edges[:-1], edges[1:]))


def _blocks(f0, f1) -> list[F.Column]:
    """Value of each block of the fingerprint as a column."""
    out = []
    for lo, hi in _bounds():
        value = F.lit(0).cast("long")
        for word, base in ((f0, 0), (f1, 64)):
            a, b = max(lo, base), min(hi, base + 64)
            if a < b:
                part = F.shiftrightunsigned(word, a - base).bitwiseAND(F.lit((1 << (b - a)) - 1))
                value = value + F.shiftleft(part, a - lo)
        out.append(value)
    return out


def _item_blocks(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Every value of every block within the number of bits that some block of a near fingerprint keeps to."""
    spread = radius // BLOCKS
    for batch in batches:
        rows = []
        for r in batch.itertuples():
            f0, f1 = fingerprint(np.asarray(r.shingles, dtype=np.int64).view(_U))
            bits = (f0 & (2**64 - 1)) | ((f1 & (2**64 - 1)) << 64)
            for n, (lo, hi) in enumerate(_bounds()):
                value = (bits >> lo) & ((1 << (hi - lo)) - 1)
                for flips in range(spread + 1):
                    for chosen in combinations(range(hi - lo), flips):
                        rows.append((r.row, r.item_id, r.size, f0, f1, n, value ^ sum(1 << c for c in chosen)))
        yield pd.DataFrame(rows, columns=["item_row", "item_id", "size", "i0", "i1", "block", "value"])


def _similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        out = []
        for x, y in zip(a, b):
            left, right = Counter(x.tolist()), Counter(y.tolist())
            out.append((left & right).total() / (left | right).total())
        yield pd.Series(out, dtype="float64")


def matches(docs: DataFrame, benchmark: DataFrame, row_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
            item_text: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Windows that are near an item: doc, row_key, start word, size, item_id, similarity."""
    spark = docs.sparkSession
    items = saved(item_table(benchmark, item_id, item_text), "items")
    total = items.agg(F.sum("size").alias("n")).first()["n"] or 0
    passes = max(1, -(-total // ITEM_WORDS))
    keyed = docs.select(F.col(row_id).alias("doc"), W.row_key(row_id, text).alias("row_key"), F.col(text).alias("text"))
    doc_kind, item_kind = dict(keyed.dtypes)["doc"], dict(items.dtypes)["item_id"]
    exact = F.pandas_udf(_similarity, "double")
    found = None
    for n in range(passes):
        part = items.where(F.pmod(F.col("row"), F.lit(passes)) == n)
        # At most about ITEM_WORDS words of items: a bounded table.
        index = spark.sparkContext.broadcast(ItemIndex(part.select("size", "k", "shingles").collect()))
        windows = keyed.mapInArrow(
            lambda it, index=index: _windows(it, index.value, similarity),
            f"doc {doc_kind}, row_key long, start int, size int, f0 long, f1 long, shingles array<long>")
        windows = saved(windows, "windows")
        blocks = part.select("row", "item_id", "size", "shingles").mapInPandas(
            lambda it: _item_blocks(it, radius), f"item_row long, item_id {item_kind}, size int, i0 long, i1 long, block int, value long")
        probes = windows.select("doc", "row_key", "start", "size", "f0", "f1",
                                F.posexplode(F.array(*_blocks(F.col("f0"), F.col("f1")))).alias("block", "value"))
        near = (probes.join(blocks, ["size", "block", "value"])
                .where(F.bit_count(F.col("f0").bitwiseXOR(F.col("i0"))) + F.bit_count(F.col("f1").bitwiseXOR(F.col("i1"))) <= radius)
                .select("doc", "row_key", "start", "size", "item_id", "item_row").distinct())
        pairs = (near.join(windows.select("row_key", "start", "size", "shingles").dropDuplicates(["row_key", "start", "size"]),
                           ["row_key", "start", "size"])
                 .join(part.select(F.col("row").alias("item_row"), "item_id", F.col("shingles").alias("s")),
                       ["item_row", "item_id"]))
        done = (pairs.withColumn("similarity", exact("shingles", "s")).where(F.col("similarity") >= similarity - 1e-9)
                .select("doc", "row_key", "start", "size", "item_id", "similarity"))
        found = done if found is None else found.unionByName(done)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, row_id: str = "doc_id", **options) -> DataFrame:
    """One row per document that holds items: their ids in order, the number of near windows, the greatest similarity."""
    return (matches(docs, benchmark, row_id, **options).groupBy(F.col("doc").alias(row_id))
            .agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"),
                 F.count_distinct("row_key", "start", "size").alias("n_windows"), F.max("similarity").alias("similarity")))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, row_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Documents that hold no item, with their columns."""
    bad = matches(docs, benchmark, row_id, text, **options).select("row_key").distinct()
    return (docs.withColumn("__th_key", W.row_key(row_id, text))
            .join(bad.withColumnRenamed("row_key", "__th_key"), "__th_key", "left_anti").drop("__th_key"))
