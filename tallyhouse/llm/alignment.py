"""Alignment of the tokens that two tokenizers make of the same texts, and how often their ids meet.

Method. Byte offsets at which a token of A and one of B both end cut the tokens of a text into groups. Every token of one that shares a byte
with a token of the other is linked to it. A space is put before each text for A; B puts its own mark there. Texts are aligned unit by unit
(see ``units``), and the result of a unit is remembered, since no token of either crosses the end of a unit. Where B has no piece with
a mark behind a letter, units are words without the marks behind them, as A cuts there anyway: far fewer of them are different.

Identity-map fast path: an array made once gives for each id of A the id of B with the same bytes, or none. A group of one token each is such a
pair, and all pairs of the map are counted in a vector of the length of A's vocabulary, one per task, which Spark sums. Only pairs outside the map,
from irregular groups, enter a shuffle: blocks of documents first count their different pairs, so a pair reaches the shuffle once per block and not once per
document, and no pair is hot. The counts that a block needs go back to the block, whose documents are then weighed against them. The
vectors of the map and of the highest count per id of A have the length of A's vocabulary, which bounds what is broadcast.

Defined results: a text that is null or empty, or whose tokens of A or B do not join to the bytes of space and text (as where it holds
the mark of B itself), has no tokens: zeros and an empty string. Strings of special tokens in texts are ordinary text. Every row is a document of its
own: repeated rows, and rows with equal ids, count each. Extra columns are not used. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import units as U
from tallyhouse.llm.saved import saved
from tallyhouse.llm.words import lists

MARK = "▁"
MEMO_UNITS = 200_000
KEPT = ("id", "n_a", "n_b", "n_groups", "n_links")
BLOCK_CHARS = 16_000_000  # of text, by whole batches; the pairs of a block are one group of a shuffle


class Pieces:
    """A SentencePiece model: ids of texts without the mark that it puts in front, and the bytes of each id."""

    LEAD = "x"  # stands before a unit in place of the text before it

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.surfaces = [bytes([int(t[1:-1], 16)]) if m.is_byte(i) else t.replace(MARK, " ").encode() for i, t in enumerate(names)]
        self.n_bytes = np.array([len(x) for x in self.surfaces], dtype=np.int64)
        self.n_lead = len(m.encode(self.LEAD))
        if any(re.search(f"[^{MARK}]{MARK}|[ \\n\\t]", p) for p in names):
            raise ValueError("a piece of this model holds white space behind another character, so units are not encoded alike alone")
        found = (t for i, t in enumerate(names) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i)))  # pieces of texts
        self.fine = not any(map(U.FINE_BORDER.search, found))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x[self.n_lead:], dtype=np.int32) for x in self.model.encode([self.LEAD + t for t in texts], num_threads=1)]


class Aligner:
    """Groups and linked pairs of units. A pair is ``a * n_b + b``."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = U.ByteBpe(a_path, specials_as_text=True), Pieces(b_path)
        self.n_a, self.n_b = len(self.a.surfaces), len(self.b.surfaces)
        place: dict[bytes, int] = {}
        for i in reversed(range(self.n_b)):
            if self.b.surfaces[i] and not (self.b.model.is_control(i) or self.b.model.is_unknown(i)):
                place[self.b.surfaces[i]] = i  # the smallest id of those with the same bytes
        self.identity = np.array([place.get(x, -1) for x in self.a.surfaces], dtype=np.int64)
        self.memo = U.Memo(self.align, MEMO_UNITS)

    def align(self, new: list[str]) -> list[tuple[int, int, int, bytes, bytes] | tuple[()]]:
        """Of each unit: tokens of A and of B, groups, the groups spelled out, packed pairs; nothing where bytes differ."""
        out: dict[str, tuple] = {}
        runs = U.joinable(new)
        texts = ["".join(run) for run in runs]
        alone = []
        for run, text, a, b in zip(runs, texts, self.a.ids(texts), self.b.ids(texts)):
            ends = [U.split_ids(ids, sizes, run, text) for ids, sizes in ((a, self.a.n_bytes), (b, self.b.n_bytes))]
            raw = text.encode()
            same = all(b"".join(map(surfaces.__getitem__, ids.tolist())) == raw for ids, surfaces in ((a, self.a.surfaces), (b, self.b.surfaces)))
            if same and ends[0] is not None and ends[1] is not None:
                out.update(zip(run, self._groups(a, b, *ends)))
            elif len(run) == 1:
                out[text] = ()
            else:
                alone += run
        for unit in alone:  # something in their run changed the bytes
            out[unit] = self._single(unit)
        return [out[u] for u in new]

    def _single(self, unit: str) -> tuple:
        a, b = self.a.ids([unit])[0], self.b.ids([unit])[0]
        if any(b"".join(map(s.__getitem__, x.tolist())) != unit.encode() for x, s in ((a, self.a.surfaces), (b, self.b.surfaces))):
            return ()
        return self._groups(a, b, np.array([len(a)]), np.array([len(b)]))[0]

    def _groups(self, a: np.ndarray, b: np.ndarray, a_upto: np.ndarray, b_upto: np.ndarray) -> list[tuple]:
        """Results of consecutive units, whose last ids have the given positions."""
        a_end, b_end = np.cumsum(self.a.n_bytes[a]), np.cumsum(self.b.n_bytes[b])
        shared = np.intersect1d(a_end, b_end, assume_unique=True)
        a_cut, b_cut = np.searchsorted(a_end, shared) + 1, np.searchsorted(b_end, shared) + 1
        first = np.searchsorted(b_end, a_end - self.a.n_bytes[a], side="right")
        last = np.searchsorted(b_end - self.b.n_bytes[b], a_end, side="left")
        n = last - first
        links = np.r_[0, np.cumsum(n)]
        at = np.arange(links[-1]) - np.repeat(links[:-1], n) + np.repeat(first, n)
        packed = (np.repeat(a.astype(np.int64), n) * self.n_b + b[at]).tobytes()
        shown_a, shown_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        spelled = [f"{','.join(shown_a[i:j])}|{','.join(shown_b[k:m])}" for i, j, k, m in zip(
            [0, *a_cut.tolist()], a_cut.tolist(), [0, *b_cut.tolist()], b_cut.tolist())]
        groups = np.searchsorted(a_cut, a_upto) + 1  # groups up to the end of each unit
        found, i, k, g, byte = [], 0, 0, 0, 0
        for j, m, h, upto in zip(a_upto.tolist(), b_upto.tolist(), groups.tolist(), (8 * links[a_upto]).tolist()):
            found.append((j - i, m - k, h - g, ";".join(spelled[g:h]).encode(), packed[byte:upto]))
            i, k, g, byte = j, m, h, upto
        return found

    def document(self, text: str | None) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        """Tokens of A and of B, groups, hash of the groups, different pairs and how often each is linked."""
        none = 0, 0, 0, "", np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if not text:
            return none
        n_a = n_b = n_groups = 0
        hashed = hashlib.sha256()
        pairs, times = none[4:]
        for number, piece in enumerate(U.pieces(" " + text)):
            found = self.memo.values(U.units(piece, self.b.fine))
            if () in found:
                return none
            a, b, g, spelled, packed = zip(*found)
            n_a, n_b, n_groups = n_a + sum(a), n_b + sum(b), n_groups + sum(g)
            if number:
                hashed.update(b";")
            hashed.update(b";".join(spelled))
            here, n = np.unique(np.frombuffer(b"".join(packed), dtype=np.int64), return_counts=True)
            if number:
                both, place = np.unique(np.r_[pairs, here], return_inverse=True)
                pairs, times = both, np.bincount(place, weights=np.r_[times, n], minlength=len(both)).astype(np.int64)
            else:
                pairs, times = here, n
        return n_a, n_b, n_groups, hashed.hexdigest(), pairs, times


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(a_path: str, b_path: str) -> Aligner:
    """Aligner of a Python worker, kept with its memo for later tasks."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def _arrays(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(batch.schema.get_field_index(name))
    bounds = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[bounds[0]:bounds[-1]], bounds - bounds[0]


def aligned(docs: DataFrame, a_path: str, b_path: str, row_id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row its block, n_a, n_b, n_groups, n_links, groups_sha256, and its pairs inside the identity map (``same``, by id of A) and outside it
    (``pairs``), with how often each is linked (``same_times``, ``pair_times``)."""
    plain = docs.select(F.col(row_id).alias("id"), F.col(text).alias("text"))
    kind = dict(plain.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, task, block, chars = _aligner(a_path, b_path), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for first in range(0, batch.num_rows, 100):
                part = batch.slice(first, 100)
                texts = part.column(1).to_pylist()
                found = [tool.document(x) for x in texts]
                n = [len(x[4]) for x in found]
                owner = np.repeat(np.arange(len(n)), n)
                codes, times = np.concatenate([x[4] for x in found]), np.concatenate([x[5] for x in found])
                a = codes // tool.n_b
                same = tool.identity[a] == codes % tool.n_b
                bounds = [np.searchsorted(owner[which], np.arange(len(n) + 1)) for which in (same, ~same)]
                links = np.bincount(owner, weights=times, minlength=len(n)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(n), (task << 32) + block, dtype=np.int64)), part.column(0),
                    *[pa.array([x[i] for x in found], type=pa.int64()) for i in range(3)], pa.array(links), pa.array([x[3] for x in found], type=pa.string()),
                    lists(a[same].astype(np.int32), bounds[0], pa.int32()), lists(times[same].astype(np.int32), bounds[0], pa.int32()),
                    lists(codes[~same], bounds[1], pa.int64()), lists(times[~same].astype(np.int32), bounds[1], pa.int32()),
                ], names=["block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "same_times", "pairs", "pair_times"])
                chars += sum(len(x or "") for x in texts)
                if chars >= block_chars:
                    block, chars = block + 1, 0

    return plain.mapInArrow(run, f"block long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                 "same array<int>, same_times array<int>, pairs array<long>, pair_times array<int>")


def _identity_counts(rows: DataFrame, n_a: int) -> np.ndarray:
    """Documents that hold each pair of the identity map: a vector per task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(n_a, dtype=np.int64)
        for batch in batches:
            vector += np.bincount(_arrays(batch, "same")[0], minlength=n_a)
        at = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(vector[at])], names=["a", "n"])

    total = np.zeros(n_a, dtype=np.int64)
    for a, n in rows.select("same").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).collect():  # at most n_a rows
        total[a] = n
    return total


def _pair_counts(rows: DataFrame) -> DataFrame:
    """Documents of each block that hold each pair outside the map (a block read by two tasks gives two rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []

        def counted() -> Iterator[pa.RecordBatch]:
            pair, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, dtype=np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), block or 0, dtype=np.int64)), pa.array(pair), pa.array(n.astype(np.int64))],
                                             names=["block", "pair", "n"])

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            pairs, bounds = _arrays(batch, "pairs")
            cuts = np.flatnonzero(np.r_[True, np.diff(blocks) != 0, True]) if len(blocks) else np.zeros(0, dtype=np.int64)
            for i, j in zip(cuts[:-1], cuts[1:]):
                if blocks[i] != block:
                    yield from counted()
                    block, parts = blocks[i], []
                parts.append(pairs[bounds[i]:bounds[j]].copy())
        yield from counted()

    return rows.select("block", "pairs").mapInArrow(run, "block long, pair long, n long")


def align(docs: DataFrame, a_path: str, b_path: str, row_id: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Row id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row."""
    spark = docs.sparkSession
    sizes = Aligner(a_path, b_path)
    n_a, n_b = sizes.n_a, sizes.n_b
    rows = saved(aligned(docs, a_path, b_path, row_id, text, block_chars), "aligned")
    by_block = saved(_pair_counts(rows), "block_pairs")
    counts = saved(by_block.groupBy("pair").agg(F.sum("n").alias("count")), "pair_counts")
    same = _identity_counts(rows, n_a)
    best = same.copy()
    for a, n in counts.groupBy(F.floor(F.col("pair") / F.lit(n_b)).alias("a")).agg(F.max("count").alias("n")).collect():  # at most n_a rows
        best[a] = max(best[a], n)
    vectors = spark.sparkContext.broadcast((same, best))

    def weigh(members: pa.Table, needed: pa.Table) -> pa.Table:
        same, best = vectors.value
        pair, count = needed.column("pair").to_numpy(), needed.column("count").to_numpy()
        order = np.argsort(pair)
        pair, count = pair[order], count[order]
        parts = []
        for batch in members.to_batches():
            a, bounds = _arrays(batch, "same")
            codes, pair_bounds = _arrays(batch, "pairs")
            times, pair_times = (_arrays(batch, c)[0].astype(np.int64) for c in ("same_times", "pair_times"))
            found = count[np.searchsorted(pair, codes)] if len(codes) else np.zeros(0, dtype=np.int64)
            sums = []
            for values, others in ((times * (same[a] == best[a]), pair_times * (found == best[codes // n_b])), (times * same[a], pair_times * found)):
                ends, other_ends = np.r_[0, np.cumsum(values)], np.r_[0, np.cumsum(others)]
                sums.append(pa.array(np.diff(ends[bounds]) + np.diff(other_ends[pair_bounds])))
            given = [batch.column(batch.schema.get_field_index(c)) for c in (*KEPT, "groups_sha256")]
            parts.append(pa.RecordBatch.from_arrays([*given[:-1], *sums, given[-1]], names=[*KEPT, "n_best", "count_sum", "groups_sha256"]))
        return pa.Table.from_batches(parts)

    needed = by_block.select("block", "pair").join(counts, "pair")
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    weighed = rows.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(weigh, schema)
    return weighed.withColumnRenamed("id", row_id)


def default_paths(a_path: str | None = None, b_path: str | None = None) -> tuple[str, str]:
    """The given files, by default the public ones installed beside Python."""
    import public_tokenizers

    return a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
