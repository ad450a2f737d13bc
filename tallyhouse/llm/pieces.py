"""SentencePiece encoding and decoding by a streaming Viterbi search.

Method. The search walks over a text once. For each position it keeps the best score and the
backpointer of the best segmentation that ends there, but only for a window: a piece has at
most ``longest`` characters, so only that many positions can still be the start of a piece.
Whenever all paths that survive share one boundary, the ids up to it are final and are
committed, and everything before it is forgotten. Memory therefore follows the piece length, not the
text; only where paths never meet (a long run of one character may be such a case) are backpointers kept longer.

Scores are those of the model file. The best path is the one of highest total score, which is
what SentencePiece computes when it reads these pieces as a unigram model. (A file of merge
rules stores negative ranks as scores; its greedy merges may give other ids for a word.)

Defined results: a null text has null ids; an empty text has no ids. A space is encoded as the
mark of the vocabulary and a mark is put in front of the text. A character without a piece, and
the mark itself where a text holds it, become the pieces of their UTF-8 bytes, so that decoding
gives back every text exactly. Strings that look like control symbols are ordinary text. Of two
paths with equal score the one whose last piece is longer wins. Rows are independent of each other:
repeated rows give repeated results, and extra columns are kept.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.words import lists

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MEMO_UNITS = 150_000


class Vocabulary:
    """Pieces with ids and scores, as a value that can be sent to tasks (some hundred kilobytes)."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], surfaces: list[bytes]):
        self.pieces = pieces
        self.byte_ids = byte_ids
        self.surfaces = surfaces
        self.name = hashlib.sha256(repr(sorted(pieces.items())).encode()).digest()
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min((s for _, s in pieces.values()), default=0.0) - UNKNOWN_PENALTY
        # No piece holds a space after another character, or a newline: then both always separate paths.
        self.separable = not any(re.search(r"[^ ] |\n", p) for p in pieces if len(p) > 1)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a SentencePiece model file."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids, surfaces = {}, [0] * 256, []
        for i in range(model.get_piece_size()):
            text = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(text[1:-1], 16)
                byte_ids[value] = i
                surfaces.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                surfaces.append(b"")
            else:
                shown = text.replace(MARK, " ")
                pieces[shown] = (i, model.get_score(i))
                surfaces.append(shown.encode())
        return cls(pieces, byte_ids, surfaces)


class Viterbi:
    """Streaming search over one text at a time."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        # Tree of characters: (id, or -1 if no piece ends here; score; branches or None).
        self.tree: dict = {}
        for text, (i, value) in sorted(vocabulary.pieces.items(), key=lambda x: -len(x[0])):
            level = self.tree
            for c in text[:-1]:
                if c not in level or level[c][2] is None:
                    level[c] = (*level.get(c, (-1, 0.0))[:2], {})
                level = level[c][2]
            level[text[-1]] = (i, value, level[text[-1]][2] if text[-1] in level else None)
        self.most_live = 0  # positions kept at once, for tests

    def ids(self, text: str) -> list[int]:
        """Best ids of a text, committed piece by piece."""
        tree, unknown, n = self.tree, self.v.unknown, len(text)
        patience = 4 * self.v.longest
        room = min(n, patience + 2 * self.v.longest) + 1
        out: list[int] = []
        base = reach = 0  # all before base is committed; no piece found so far goes beyond reach
        # By position from base on: best score, and start and id of the last piece of that path.
        score, start, piece = [-math.inf] * room, [0] * room, [-1] * room
        score[0] = 0.0
        for i in range(n):
            k = i - base
            if k > patience and (i == reach or k % self.v.longest == 0):
                at = k if i == reach else self._converge(k, reach - base, start)
                if at:  # all surviving paths share this boundary
                    self._commit(text, base, at, start, piece, out)
                    base, k = base + at, k - at
                    score = score[at:] + [-math.inf] * at
                    start, piece = [x - at for x in start[at:]] + [0] * at, piece[at:] + [-1] * at
            if k + self.v.longest >= len(score):  # no shared boundary so far: the backpointers are still needed
                if len(score) < n - base + 1:
                    score += [-math.inf] * room
                    start += [0] * room
                    piece += [-1] * room
            here = score[k]
            hit = tree.get(text[i])
            e, j = k + 1, i + 1
            if hit is None or hit[0] < 0:
                if here + unknown > score[e]:
                    score[e], start[e], piece[e] = here + unknown, k, -1
                if j > reach:
                    reach = j
            while hit is not None:
                number, gain, branches = hit
                if number >= 0:
                    if here + gain > score[e]:
                        score[e] = here + gain
                        start[e] = k
                        piece[e] = number
                    if j > reach:
                        reach = j
                if branches is None or j >= n:
                    break
                hit = branches.get(text[j])
                e += 1
                j += 1
        self.most_live = max(self.most_live, len(score))
        if n > base:
            self._commit(text, base, n - base, start, piece, out)
        return out

    def _converge(self, at: int, last: int, start: list[int]) -> int:
        """Greatest boundary before ``at`` that the best paths to all live positions share, or 0."""
        common: set[int] | None = None
        for p in range(at, last + 1):
            seen = set()
            while p > 0:
                p = start[p]
                seen.add(p)
            common = seen if common is None else common & seen
        return max((x for x in common or () if x <= at - self.v.longest), default=0)

    def _commit(self, text, base, end, start, piece, out) -> None:
        found = []
        while end > 0:
            if piece[end] >= 0:
                found.append(piece[end])
            else:
                found.extend(self.v.byte_ids[b] for b in reversed(text[base + start[end]:base + end].encode()))
            end = start[end]
        found.reverse()
        out.extend(found)


class Encoder(dict):
    """Packed ids by unit of text. A unit ends where no path can cross, so its ids are the same in every text."""

    UNITS = re.compile(r" *[^ \n]+| +|\n")

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.search = Viterbi(vocabulary)
        self.separable = vocabulary.separable

    def __missing__(self, unit: str) -> bytes:
        packed = np.array(self.search.ids(unit), dtype=np.int32).tobytes()
        if len(unit) < 64:
            if len(self) >= MEMO_UNITS:
                self.clear()
            self[unit] = packed
        return packed

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        text = " " + text
        if not self.separable:
            return np.array(self.search.ids(text), dtype=np.int32).tobytes()
        return b"".join(map(self.__getitem__, self.UNITS.findall(text)))


_ENCODERS: dict[bytes, Encoder] = {}


def encoder_of(vocabulary: Vocabulary) -> Encoder:
    """Encoder of a Python worker, kept with its memo for later tasks."""
    name = vocabulary.name
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(vocabulary)
    return _ENCODERS[name]


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids", check: str | None = None) -> DataFrame:
    """Add the ids of each whole text as an array of int, and with ``check`` whether decoding them gives the text back."""
    kept = [f.name for f in docs.schema if f.name not in (out, check)]
    added = [T.StructField(out, T.ArrayType(T.IntegerType(), False))] + ([T.StructField(check, T.BooleanType())] if check else [])
    schema = T.StructType([f for f in docs.schema if f.name in kept] + added)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, surfaces = encoder_of(shared.value), shared.value.surfaces
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for first in range(0, batch.num_rows, 200):
                given = texts.slice(first, 200).to_pylist()
                part = [None if x is None else encoder.encode(x) for x in given]
                sizes = np.array([0 if x is None else len(x) // 4 for x in part], dtype=np.int64)
                ids = lists(np.frombuffer(b"".join(x for x in part if x), dtype=np.int32), np.r_[0, np.cumsum(sizes)], pa.int32())
                if None in part:
                    gone = pa.array([x is None for x in part])
                    ids = pa.ListArray.from_arrays(ids.offsets, ids.values, mask=gone)
                rows = batch.slice(first, 200)
                columns = [rows.column(rows.schema.get_field_index(c)) for c in kept] + [ids]
                if check:
                    same = [x is None or decoded(np.frombuffer(p, dtype=np.int32).tolist(), surfaces) == x for x, p in zip(given, part)]
                    columns.append(pa.array(same, type=pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def decoded(ids: list[int], surfaces: list[bytes]) -> str:
    """Text of a list of ids, without the mark in front."""
    return b"".join(map(surfaces.__getitem__, ids))[1:].decode("utf-8", errors="replace")


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "text") -> DataFrame:
    """Add the text of each array of ids. Ids outside the vocabulary raise an error."""
    schema = T.StructType([f for f in encoded.schema if f.name != out] + [T.StructField(out, T.StringType())])
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [f.name for f in encoded.schema if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surfaces = shared.value.surfaces
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            for first in range(0, batch.num_rows, 200):
                texts = [decoded(row.values.to_numpy(zero_copy_only=False).tolist(), surfaces) if row.is_valid else None for row in column.slice(first, 200)]
                rows = batch.slice(first, 200)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(rows.schema.get_field_index(c)) for c in kept] + [pa.array(texts, type=pa.string())], names=[*kept, out])

    return encoded.mapInArrow(run, schema)


def encode_and_check(docs: DataFrame, vocabulary: Vocabulary, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Row id, ids, their number, and whether decoding them gives the text back exactly."""
    done = encode(docs.select(row_id, text), vocabulary, text, check="exact")
    return done.select(row_id, "ids", F.size("ids").alias("n_ids"), "exact")


def default_vocabulary(path: str | None = None) -> Vocabulary:
    """Vocabulary of the given file, by default the public one installed beside Python."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Vocabulary.load(path)

