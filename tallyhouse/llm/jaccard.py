"""Similarity join of documents on their sets of word shingles, with MinHash bands.

Method. A document is the set of its shingles of five words (all words if it has fewer). Documents
with one and the same set are a class and are represented by one member. A representative has
``rows * bands`` MinHash values; numbers of rows and bands are chosen so that a pair at the
threshold shares a band with at least the target probability, with as many rows as the number of hashes
allows. Band hashes are shuffled; representatives that share one are candidates.

Verification uses the full sets. Candidates are put into tiles of at most ``TILE`` documents (and a
bounded amount of text), near relatives together; a bucket of any size becomes pairs of tiles instead of pairs
of documents. Each pair of tiles that shares a bucket is one unit of work that holds only its own documents,
and compares all of them exactly. A unit returns one row per document with its number of links, and a spanning
forest of the links. No link between different sets that share a band is lost, and no table of all pairs is
made. Documents joined by chains of links are a group (``class_id``).

Defined results: null and empty texts have no shingles and are linked to nothing, not even to each other; texts
that differ only in the order or number of equal shingles are copies; rows with equal id and text count as copies
of each other; ``class_id`` is the smallest document id of a group, of the document itself if it has no relatives;
``n_links`` counts the other rows whose similarity reaches the threshold, copies included. Extra columns are not used.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import words as W
from tallyhouse.llm.components import components
from tallyhouse.llm.saved import saved

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.999
MOST_HASHES = 144
TILE = 256
TILE_BYTES = 4_000_000
UNIT_BYTES = 4_000_000  # of texts on average; one pair of tiles may have twice TILE_BYTES
SLICE_BYTES = 500_000  # of text hashed at once, at some hundred bytes of working space each
_U = np.uint64


def band_shape(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Rows and bands: the most rows per band for which the recall at the threshold is kept with at most ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        p = similarity**rows
        bands = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if rows * bands > most:
            break
        best = rows, bands
    if best is None:
        raise ValueError("the number of hashes is too small for this recall")
    return best


def shingle_sets(w: W.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document, flat, and their bounds."""
    h = w.hashes()
    n = np.diff(w.bounds)
    starts = w.window_starts(k)
    g = W.grams(h, k, k)[starts] if len(starts) else np.zeros(0, dtype=_U)
    doc = np.searchsorted(w.bounds, starts, side="right") - 1
    for size in range(1, k):
        short = np.flatnonzero(n == size)
        if len(short):
            at = w.bounds[short]
            part = W.grams(np.r_[h, np.zeros(k, dtype=_U)], size, size)[at]
            g, doc = np.r_[g, part], np.r_[doc, short]
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def _signatures(batches: Iterator[pa.RecordBatch], rows: int, bands: int) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(20231)
    multiply = rng.integers(1, 2**63, size=rows * bands, dtype=np.uint64) | _U(1)
    add = rng.integers(0, 2**63, size=rows * bands, dtype=np.uint64)
    for batch in batches:
        keys = batch.column(0)
        for first, last, w in W.slices(batch, "text", SLICE_BYTES):
            g, bounds = shingle_sets(w)
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            if not len(full):
                continue
            heads = bounds[:-1][full]
            least = np.empty((rows * bands, len(full)), dtype=_U)
            for i in range(rows * bands):
                mixed = g * multiply[i] + add[i]
                least[i] = np.minimum.reduceat(mixed ^ (mixed >> _U(32)), heads)
            hashes = np.stack([W.grams_down(least[b * rows:(b + 1) * rows], b) for b in range(bands)], axis=1)
            s1 = np.add.reduceat(W.mix(g ^ _U(0x1234567)), heads)
            s2 = np.bitwise_xor.reduceat(W.mix(g + _U(0x7654321)), heads)
            size = np.diff(w.offsets)[full]
            yield pa.RecordBatch.from_arrays([
                keys.slice(first, last - first).take(pa.array(full)), batch.column(1).slice(first, last - first).take(pa.array(full)),
                pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(sizes[full].astype(np.int32)), pa.array(size.astype(np.int64)),
                W.lists(hashes.view(np.int64).ravel(), np.arange(len(full) + 1) * bands, pa.int64()),
            ], names=["key", "id", "s1", "s2", "n", "bytes", "bands"])


def _verify(table: pa.Table, similarity: float) -> pa.Table:
    """Links inside the tile pairs of one unit of work: number of linked rows and forest parent of each document."""
    keys = table.column("key").to_numpy()
    members = table.column("members").to_numpy()
    side = table.column("side").to_numpy()
    pair = table.column("pair").to_numpy()
    batch = table.select(["text"]).combine_chunks().to_batches()
    found = [shingle_sets(w) for b in batch for _, _, w in W.slices(b, "text", SLICE_BYTES)]
    values = np.concatenate([g for g, _ in found]) if found else np.zeros(0, dtype=_U)
    sizes = np.concatenate([np.diff(b) for _, b in found]) if found else np.zeros(0, dtype=np.int64)
    bounds = np.r_[0, np.cumsum(sizes)]
    out_key, out_links, out_parent = [], [], []
    order = np.argsort(pair, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(pair[order]) != 0, True])
    for a, b in zip(cuts[:-1], cuts[1:]):
        rows = order[a:b]
        n = len(rows)
        if n < 2:
            continue
        doc = np.repeat(np.arange(n), sizes[rows])
        flat = np.concatenate([values[bounds[r]:bounds[r + 1]] for r in rows])
        _, column, uses = np.unique(flat, return_inverse=True, return_counts=True)
        shared = uses[column] > 1
        doc, column = doc[shared], np.unique(column[shared], return_inverse=True)[1]
        both = np.zeros((n, n), dtype=np.float32)
        by = np.argsort(column, kind="stable")
        doc, column = doc[by], column[by]
        width = max(256, 4_000_000 // n)
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            i, j = np.searchsorted(column, [lo, lo + width])
            incidence = np.zeros((n, min(width, int(column[-1]) + 1 - lo)), dtype=np.float32)
            incidence[doc[i:j], column[i:j] - lo] = 1
            both += incidence @ incidence.T
        size = sizes[rows].astype(np.float64)
        union = size[:, None] + size[None, :] - both
        linked = both >= similarity * union - 1e-6
        s = side[rows]
        if s.max() > 0:  # two tiles: their own pairs are another unit
            linked &= s[:, None] != s[None, :]
        np.fill_diagonal(linked, False)
        links = linked @ members[rows].astype(np.float64)
        parent = _forest(linked, keys[rows])
        used = np.flatnonzero(links > 0)
        out_key.append(keys[rows][used])
        out_links.append(links[used].astype(np.int64))
        out_parent.append(parent[used])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return pa.table({"key": join(out_key), "links": join(out_links), "parent": join(out_parent)})


def _forest(linked: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Smallest key of the component of each document."""
    label = keys.copy()
    while True:
        big = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(label, big)
        if (new == label).all():
            return label
        label = new


def near_duplicates(docs: DataFrame, row_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
                    recall: float = RECALL) -> DataFrame:
    """One row per input row: row id, row key, class_id, copy_id (smallest id with the same set), n_links, component (a key of the group)."""
    rows, bands = band_shape(similarity, recall)
    keyed = docs.select(W.row_key(row_id, text).alias("key"), F.col(row_id).alias("id"), F.col(text).alias("text"))
    kind = dict(keyed.dtypes)["id"]
    signed = saved(keyed.mapInArrow(lambda it: _signatures(it, rows, bands),
                                    f"key long, id {kind}, s1 long, s2 long, n int, bytes long, bands array<long>"), "signatures")
    copies = saved(signed.groupBy("s1", "s2").agg(F.min("key").alias("rep"), F.min("id").alias("copy_id"), F.count(F.lit(1)).alias("members"),
                                                  F.first("n").alias("n"), F.min("bytes").alias("bytes"), F.first("bands").alias("bands")), "copies")
    banded = copies.select(F.col("rep").alias("key"), F.posexplode("bands").alias("band", "hash"))
    buckets = saved(banded.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low")).where("n > 1"), "buckets")
    members = saved(banded.join(buckets, ["band", "hash"]).select("band", "hash", "key", "low"), "members")
    # Tiles: documents with one smallest relative, cut into parts of bounded number and text.
    roots = members.groupBy("key").agg(F.min("low").alias("root")).join(copies.select(F.col("rep").alias("key"), "members", "bytes"), "key")
    parts = roots.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(TILE / 2)), F.ceil(F.sum("bytes") / F.lit(TILE_BYTES))).alias("parts"))
    tiles = saved(roots.join(parts, "root").select("key", "members", "bytes", F.xxhash64(
        "root", F.pmod(F.xxhash64("key", F.lit(7)), F.col("parts"))).alias("tile")), "tiles")
    seen = members.join(tiles.select("key", "tile"), "key").select("band", "hash", "tile").distinct()
    other = seen.select("band", "hash", F.col("tile").alias("tile2"))
    across = seen.join(other, ["band", "hash"]).where("tile < tile2").select("tile", "tile2").distinct()
    units = tiles.select("tile", F.col("tile").alias("tile2")).distinct().unionByName(across).withColumn("pair", F.xxhash64("tile", "tile2"))
    sides = units.select("pair", "tile", F.lit(0).alias("side")).unionByName(
        units.where("tile <> tile2").select("pair", F.col("tile2").alias("tile"), F.lit(1).alias("side")))
    placed = saved(tiles.join(sides, "tile").select("key", "members", "bytes", "pair", "side"), "placed")
    total = placed.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    n_units = max(1, math.ceil(total / UNIT_BYTES))
    # Merged by the key at every size: one exchange of the texts, which grows with the input and no faster.
    texts = keyed.select("key", "text").join(placed.select("key").distinct().hint("merge"), "key", "left_semi").dropDuplicates(["key"])
    checked = saved(
        texts.join(placed, "key").select("key", "text", "members", "side", "pair", F.pmod("pair", F.lit(n_units)).alias("unit"))
        .groupBy("unit").applyInArrow(lambda t: _verify(t, similarity), "key long, links long, parent long"), "checked")
    links = checked.groupBy("key").agg(F.sum("links").alias("links"))
    groups = components(checked.where("key <> parent").select(F.col("key").alias("a"), F.col("parent").alias("b")))
    named = (copies.select(F.col("rep").alias("key"), "s1", "s2", "copy_id", "members")
             .join(links, "key", "left").join(groups.withColumnRenamed("node", "key"), "key", "left")
             .withColumn("component", F.coalesce("component", "key")))
    lowest = named.groupBy("component").agg(F.min("copy_id").alias("class_id"))
    classes = named.join(lowest, "component").select(
        "s1", "s2", "copy_id", "class_id", "component", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    linked = signed.select("key", "id", "s1", "s2").join(classes, ["s1", "s2"]).select("key", "id", "class_id", "copy_id", "n_links", "component")
    without = keyed.select("key", "id", "text").where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    rest = without.select("key", "id", F.col("id").alias("class_id"), F.col("id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"),
                          F.col("key").alias("component"))
    return linked.unionByName(rest).withColumnRenamed("id", row_id)


def one_per_group(docs: DataFrame, row_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The row with the smallest id of each group, with its columns.

    Of rows with equal id and text one stays; of rows of a group with one id but other texts the one with the smallest key.
    Rows without words are no group and stay.
    """
    found = saved(near_duplicates(docs, row_id, text, **options), "near")
    grouped = found.groupBy("component").agg(F.min(F.struct(F.col(row_id).alias("i"), F.col("key").alias("k"))).alias("least"), F.count(F.lit(1)).alias("n"))
    keys = grouped.select(F.col("least.k").alias("__th_key"), (F.col("n") > 1).alias("__th_many"))
    joined = docs.withColumn("__th_key", W.row_key(row_id, text)).join(keys.dropDuplicates(["__th_key"]), "__th_key")
    many = joined.where("__th_many").dropDuplicates(["__th_key"])
    return joined.where("not __th_many").unionByName(many).drop("__th_key", "__th_many")
