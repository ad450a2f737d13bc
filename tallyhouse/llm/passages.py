"""Removal of passages that repeat, by compaction of a De Bruijn graph of words.

Method. The edges of the graph are the windows of ``width`` words of all texts, and an edge is
repeated if its word sequence starts at two places or more. The graph is never spelled out
edge by edge. Each text is first compacted into paths: a run of consecutive windows that share
the same smallest k-mer (minimizer) is one path of edges without a branch inside, as in
partitioned De Bruijn compaction. Then, by Spark joins:

1. k-mers that are the minimizer of one path only are dropped: their windows cannot repeat.
2. Paths with the same words are one class. A class with two or more members is a repeated
   nonbranching path: all its windows are repeated, and nothing inside needs to be looked at.
3. The other paths of a repeated k-mer branch off somewhere. Only these, with one
   representative of each repeated class of the same k-mer, are spelled out into windows from
   the source text, at their source coordinates, and counted.
4. Repeated windows of one text that overlap are joined to spans in source coordinates.

Sequences are compared by 128 bits of hash from two independent functions. Every occurrence
moves through exchanges as a short row with its coordinates (row key, word position); groups
are aggregated before they are joined, so that a passage that many documents share stays
one class, and no pairs are formed.

Defined results: null and empty texts have no words and nothing is removed; a text shorter
than the window keeps all its words; repeats inside one text count, also overlapping ones;
rows that are repeated (same id and text) repeat each other, so both lose all windows. Extra
columns are not used. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import words as W
from tallyhouse.llm.saved import saved

WIDTH = 35
KMER = 12
_U = np.uint64


def _window_minimum(values: np.ndarray, span: int) -> np.ndarray:
    """Position of the smallest value (the first one of equals) in each window of ``span`` values."""
    n = len(values) - span + 1
    at = np.arange(len(values))
    size = 1
    while size < span:
        step = min(size, span - size)
        a, b = at[:len(at) - step], at[step:]
        at = np.where(values[b] < values[a], b, a)
        size += step
    return at[:n]


def _paths(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).to_numpy()
        for first, last, w in W.slices(batch, "text", 1_000_000):
            if len(w) < width:
                continue
            starts = w.window_starts(width)
            if not len(starts):
                continue
            h1, h2 = w.hashes(W.FIRST), w.hashes(W.SECOND)
            small = W.grams(h1, k)
            least = _window_minimum(small, width - k + 1)[starts]
            new = np.ones(len(starts), dtype=bool)
            new[1:] = (np.diff(least) != 0) | (np.diff(starts) != 1)
            head = np.flatnonzero(new)
            n = np.diff(np.r_[head, len(starts)])
            begin = starts[head]
            end = begin + n + width - 1
            p1, p2 = W.FIRST.prefix(h1), W.SECOND.prefix(h2)
            doc = np.searchsorted(w.bounds, begin, side="right") - 1
            yield pa.RecordBatch.from_arrays([
                pa.array(keys[first:last][doc]), pa.array((begin - w.bounds[doc]).astype(np.int32)), pa.array(n.astype(np.int32)),
                pa.array(small[least[head]].view(np.int64)),
                pa.array(W.FIRST.ranges(p1, begin, end).view(np.int64)), pa.array(W.SECOND.ranges(p2, begin, end).view(np.int64)),
            ], names=["key", "pos", "n", "kmer", "h1", "h2"])


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Windows of the listed paths of each text, with their hashes."""
    for batch in batches:
        keys = batch.column(0).to_numpy()
        wanted = batch.column(batch.schema.get_field_index("paths"))
        for first, last, w in W.slices(batch, "text", 1_000_000):
            p1, p2 = W.FIRST.prefix(w.hashes(W.FIRST)), W.SECOND.prefix(w.hashes(W.SECOND))
            part = wanted.slice(first, last - first)
            flat = part.flatten()
            sizes = np.diff(part.offsets.to_numpy())
            pos, n, own = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            doc = np.repeat(np.repeat(np.arange(last - first), sizes), n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(pos, n) + step
            begin = w.bounds[doc] + at
            end = begin + width
            yield pa.RecordBatch.from_arrays([
                pa.array(keys[first:last][doc]), pa.array(at.astype(np.int32)), pa.array(np.repeat(own, n)),
                pa.array(W.FIRST.ranges(p1, begin, end).view(np.int64)), pa.array(W.SECOND.ranges(p2, begin, end).view(np.int64)),
            ], names=["key", "pos", "own", "h1", "h2"])


def repeated_spans(docs: DataFrame, text: str = "text", row_id: str = "doc_id", width: int = WIDTH, k: int = KMER) -> DataFrame:
    """Covered words of each row that has any: key (see ``row_key``) and an array of spans [start, end) in words."""
    keyed = docs.select(W.row_key(row_id, text).alias("key"), F.col(text).alias("text"))
    paths = saved(keyed.mapInArrow(lambda it: _paths(it, width, k), "key long, pos int, n int, kmer long, h1 long, h2 long"), "paths")
    shared = saved(paths.groupBy("kmer").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1").select("kmer"), "kmers")
    # Written once, so that a k-mer of many texts can be split in the join and is pre-aggregated afterwards.
    open_paths = saved(paths.join(shared, "kmer"), "open")
    classes = open_paths.groupBy("kmer", "h1", "h2").agg(
        F.count(F.lit(1)).alias("members"), F.min(F.struct("key", "pos", "n")).alias("source"))
    classes = saved(classes, "classes")
    branching = classes.groupBy("kmer").agg(F.count(F.lit(1)).alias("ways")).where("ways > 1").select("kmer")
    # 2. All windows of a class with several members are repeated.
    whole = open_paths.join(classes.where("members > 1").select("kmer", "h1", "h2"), ["kmer", "h1", "h2"]).select("key", "pos", "n")
    # 3. Windows of branching k-mers, of one member of each class.
    spelled = (classes.join(branching, "kmer", "left_semi")
               .select("source.key", F.struct("source.pos", "source.n", (F.col("members") == 1).alias("own")).alias("path"))
               .groupBy("key").agg(F.collect_list("path").alias("paths")))
    windows = saved(keyed.join(spelled, "key").dropDuplicates(["key"]).select("key", "text", "paths")
                    .mapInArrow(lambda it: _windows(it, width), "key long, pos int, own boolean, h1 long, h2 long"), "windows")
    again = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1").select("h1", "h2")
    single = windows.where("own").join(again, ["h1", "h2"]).select("key", "pos", F.lit(1).alias("n"))
    # 4. Spans of one row; a row has at most as many as it has words.
    return (whole.unionByName(single).groupBy("key")
            .agg(F.array_sort(F.collect_set(F.struct("pos", (F.col("pos") + F.col("n") + F.lit(width - 1)).alias("end")))).alias("spans")))


def _cover(spans: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the spans of each row: the flat coverage mask of its words, and the number of covered words."""
    bounds = np.r_[0, np.cumsum(sizes)]
    change = np.zeros(bounds[-1] + 1, dtype=np.int32)
    flat = spans.flatten()
    if len(flat):
        counts = np.diff(spans.offsets.to_numpy())
        counts = np.where(spans.is_valid().to_numpy(zero_copy_only=False), counts, 0)
        base = np.repeat(bounds[:-1], counts)
        np.add.at(change, base + flat.field(0).to_numpy(zero_copy_only=False), 1)
        np.add.at(change, base + flat.field(1).to_numpy(zero_copy_only=False), -1)
    mask = np.cumsum(change[:-1]) > 0
    return mask, np.add.reduceat(np.r_[mask, False].astype(np.int64), np.minimum(bounds[:-1], bounds[-1])) * (sizes > 0)


def _kept(batches: Iterator[pa.RecordBatch], kept: list[str], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column(batch.schema.get_field_index("spans"))
        for first, last, w in W.slices(batch, "text", 1_000_000):
            sizes = np.diff(w.bounds)
            gone, removed = _cover(spans.slice(first, last - first), sizes)
            raw, digests, texts = w.data.tobytes(), [], []
            start, end = w.start.tolist(), w.end.tolist()
            stay = np.flatnonzero(~gone)
            stay_bounds = np.searchsorted(stay, w.bounds)
            for d in range(last - first):
                left = b" ".join([raw[start[i]:end[i]] for i in stay[stay_bounds[d]:stay_bounds[d + 1]].tolist()])
                digests.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode() if removed[d] else None)
            rows = batch.slice(first, last - first)
            out = [rows.column(rows.schema.get_field_index(c)) for c in kept]
            names = list(kept)
            out += [pa.array(sizes, type=pa.int64()), pa.array(removed, type=pa.int64()), pa.array(digests)]
            names += ["n_words", "n_removed", "kept_sha256"]
            if with_text:
                out.append(pa.array(texts, type=pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(out, names=names)


def remove_repeated(docs: DataFrame, text: str = "text", row_id: str = "doc_id", width: int = WIDTH, k: int = KMER,
                    with_text: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all), number of words, of removed words, and digest of the words left (joined by one space).

    With text, ``kept_text`` holds the words left of rows that lost any, else null.
    """
    keep = docs.columns if keep is None else keep
    spans = repeated_spans(docs, text, row_id, width, k)
    own = [f"c{i}" for i in range(len(keep))]  # no clash with the names used here
    flat = docs.select(W.row_key(row_id, text).alias("key"), F.col(text).alias("text"), *[F.col(c).alias(o) for c, o in zip(keep, own)])
    joined = flat.join(spans, "key", "left").select(*own, "text", "spans")
    kinds = dict(flat.dtypes)
    schema = ", ".join(f"{o} {kinds[o]}" for o in own)
    schema += ", n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    done = joined.mapInArrow(lambda it: _kept(it, own, with_text), schema)
    extra = ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    return done.select(*[F.col(o).alias(c) for o, c in zip(own, keep) if c not in extra], *extra)
