"""Stupid-backoff scores of documents against the n-gram counts of all other documents.

Method. S(w | context) is count(context w) / count(context) for the longest context that was seen with w, times
``ALPHA`` for every word the context was cut by; single words fall back to their share of all words, words that
occur nowhere else to one occurrence with one more factor. Every document is scored against the counts of the
whole corpus without its own n-grams, so nothing is trained on a sample and no document predicts itself.

Relations. Documents are dealt into blocks by a hash of the row. A block lists its distinct
n-grams of every order with their counts; these lists are cut by hash into buckets, in sorted packed runs, so that the exchange
moves a few bytes per distinct n-gram and a frequent n-gram counts once per block (pre-aggregation). Each bucket holds one
part of the count table: it adds the counts of all blocks and joins the totals back to each list. The
totals return to their block, are joined to its exploded n-grams, and are summed per document. Neither a bucket nor
a block depends on how frequent an n-gram is, and the numbers of both follow the size of the input.

Defined results: null and empty texts have no words, score null and share null; repeated rows are documents of their
own and do predict each other; extra columns are not used; an empty table gives an empty result. N-grams are
compared by hashes of ``SPARE_BITS`` bits more than the corpus needs to number its words, 64 at most.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import words as W
from tallyhouse.llm.saved import saved

ORDER = 3
ALPHA = 0.4
BLOCK_BYTES = 10_000_000
BUCKET_GRAMS = 2_000_000
SPARE_BITS = 24
BYTES_PER_WORD = 6
_U = np.uint64


def _pack(values: np.ndarray) -> bytes:
    """Byte planes of the numbers, compressed: those of small numbers take next to no room."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True) + len(planes).to_bytes(8, "little")


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = pa.decompress(raw[:-8], decompressed_size=int.from_bytes(raw[-8:], "little"), codec="zstd")
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


class Block:
    """Words of a block of documents, as hashes."""

    def __init__(self, table: pa.Table):
        hashes, sizes = [], []
        for batch in table.select(["text"]).combine_chunks().to_batches():
            for _, _, w in W.slices(batch, "text", 1_000_000):
                hashes.append(w.hashes())
                sizes.append(np.diff(w.bounds))
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, dtype=_U)
        self.sizes = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.place = np.arange(len(self.words)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)

    def grams(self, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the last words of all n-grams of one order, and ``bits`` bits of hash of these."""
        last = np.flatnonzero(self.place >= order - 1)
        return last, W.grams(self.words, order, order)[last - (order - 1)] >> _U(64 - bits)


def _sorted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    heads = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, dtype=np.int64)
    return order, ranked, heads


def _requests(table: pa.Table, orders: int, buckets: int, bits: int) -> pa.Table:
    """Distinct n-grams of a block and their counts, in one packed run for each order and bucket."""
    block = table.column("block")[0].as_py()
    words = Block(table)
    out: dict[str, list] = {"bucket": [], "block": [], "gram_order": [], "grams": [], "counts": []}
    step = (1 << bits) // buckets + 1
    edges = np.array([min(b * step, (1 << bits) - 1) for b in range(1, buckets)], dtype=_U)
    for k in range(1, orders + 1):
        _, grams = words.grams(k, bits)
        _, ranked, heads = _sorted(grams)
        values, counts = ranked[heads], np.diff(np.r_[heads, len(ranked)]).astype(np.uint32)
        cuts = np.r_[0, np.searchsorted(values, edges), len(values)]
        for b in range(buckets):
            part = values[cuts[b]:cuts[b + 1]]
            if len(part):
                out["bucket"].append(b)
                out["block"].append(block)
                out["gram_order"].append(k)
                out["grams"].append(_pack(np.diff(part, prepend=_U(0))))
                out["counts"].append(_pack(counts[cuts[b]:cuts[b + 1]]))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table([pa.array(v, type=t) for v, t in zip(out.values(), kinds)], names=list(out))


def _totals(table: pa.Table) -> pa.Table:
    """Counts over all blocks of the n-grams of one bucket, for each of the runs that ask for them."""
    orders = table.column("gram_order").to_numpy()
    answers: list[bytes] = [b""] * len(orders)
    for k in np.unique(orders).tolist():
        runs = np.flatnonzero(orders == k).tolist()
        grams = [np.cumsum(_unpack(table.column("grams")[i].as_py(), _U), dtype=_U) for i in runs]
        counts = [_unpack(table.column("counts")[i].as_py(), np.uint32) for i in runs]
        bounds = np.r_[0, np.cumsum([len(g) for g in grams])]
        order, ranked, heads = _sorted(np.concatenate(grams))
        sums = np.add.reduceat(np.concatenate(counts).astype(np.int64)[order], heads)
        totals = np.empty(len(ranked), dtype=np.uint64)
        totals[order] = np.repeat(sums, np.diff(np.r_[heads, len(ranked)]))
        for i, a, b in zip(runs, bounds[:-1], bounds[1:]):
            answers[i] = _pack(totals[a:b])
    return pa.table([table.column("block"), table.column("bucket"), table.column("gram_order"), pa.array(answers, type=pa.binary())],
                    names=["block", "bucket", "gram_order", "totals"])


def _scores(docs: pa.Table, answers: pa.Table, orders: int, alpha: float, bits: int) -> pa.Table:
    """Sum of the logarithms of S of each document, all but the number of words of the corpus."""
    words = Block(docs)
    n = len(words.words)
    penalty = math.log(alpha)
    counts = []  # by order and last word: occurrences in all other documents
    for k in range(1, orders + 1):
        last, grams = words.grams(k, bits)
        order, ranked, heads = _sorted(grams)
        mine = answers.filter(pc.equal(answers.column("gram_order"), k)).sort_by("bucket")
        runs = [_unpack(x.as_py(), np.uint64) for x in mine.column("totals")]
        total = np.repeat(np.concatenate(runs).astype(np.int64), np.diff(np.r_[heads, len(ranked)])) if runs else np.zeros(0, dtype=np.int64)
        doc = words.doc[last[order]]
        own = np.flatnonzero(np.r_[True, (ranked[1:] != ranked[:-1]) | (doc[1:] != doc[:-1])]) if len(ranked) else heads
        total -= np.repeat(np.diff(np.r_[own, len(ranked)]), np.diff(np.r_[own, len(ranked)]))
        found = np.zeros(n, dtype=np.int64)
        found[last[order]] = total
        counts.append(found)
    score = np.zeros(n)
    longest = np.minimum(words.place + 1, orders)
    open_ = np.ones(n, dtype=bool)
    for k in range(orders, 1, -1):
        hit = np.flatnonzero(open_ & (counts[k - 1] > 0))
        score[hit] = np.log(counts[k - 1][hit]) - np.log(counts[k - 2][hit - 1]) + penalty * (longest[hit] - k)
        open_[hit] = False
    rest = np.flatnonzero(open_)
    single = counts[0][rest]
    score[rest] = np.log(np.maximum(single, 1)) + penalty * (longest[rest] - 1 + (single == 0))
    rows = len(words.sizes)
    sums = np.bincount(words.doc, weights=score, minlength=rows)
    singles = np.bincount(words.doc[rest], minlength=rows)
    full = np.bincount(words.doc[~open_ & (counts[-1] > 0)], minlength=rows) if orders > 1 else singles
    return pa.table([docs.column("id"), pa.array(words.sizes, type=pa.int64()), pa.array(singles, type=pa.int64()),
                     pa.array(full, type=pa.int64()), pa.array(sums)], names=["id", "n_words", "n_single", "n_full", "partial"])


def score(docs: DataFrame, row_id: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA) -> DataFrame:
    """One row per row of the input: id, n_words, n_full (words found with the longest context), log_score, log_score_per_word."""
    keyed = docs.select(W.row_key(row_id, text).alias("key"), F.col(row_id).alias("id"), F.col(text).alias("text"))
    size = W.total_bytes(docs, text)
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    buckets = max(1, math.ceil(size / BYTES_PER_WORD * order / BUCKET_GRAMS))
    # So many bits that one n-gram in 2^24 meets another one's hash, or all there are.
    bits = min(64, SPARE_BITS + max(1, size // BYTES_PER_WORD).bit_length())
    dealt = keyed.select(F.pmod("key", F.lit(blocks)).cast("int").alias("block"), "id", "text")
    asked = dealt.groupBy("block").applyInArrow(
        lambda t: _requests(t, order, buckets, bits), "bucket int, block int, gram_order int, grams binary, counts binary")
    answered = asked.groupBy("bucket").applyInArrow(_totals, "block int, bucket int, gram_order int, totals binary")
    kind = dict(keyed.dtypes)["id"]
    partial = saved(dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        lambda left, right: _scores(left, right, order, alpha, bits), f"id {kind}, n_words long, n_single long, n_full long, partial double"), "scores")
    total = partial.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    others = F.greatest(F.lit(total) - F.col("n_words"), F.lit(1)).cast("double")
    whole = F.when(F.col("n_words") > 0, F.col("partial") - F.col("n_single") * F.ln(others))
    return partial.select(F.col("id").alias(row_id), "n_words", "n_full", whole.alias("log_score"),
                          (whole / F.col("n_words")).alias("log_score_per_word"))
