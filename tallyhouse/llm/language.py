"""Language of documents as a mixture, by expectation-maximisation over n-gram likelihoods.

Method. For every language, the likelihood of a word is the product of the shares of its letter trigrams (word ends
included) in the training texts. The words of a document are draws from a mixture of
languages; expectation-maximisation estimates the proportions. The set of languages is the one among
the nested sets (most frequent one, two, ...) with the greatest penalised log-likelihood: each further language costs
``PENALTY * ln(words + 1)``. The prediction is the language with the greatest proportion in that set and the
score is this proportion.

Training. ``train`` counts trigrams in at most about ``TRAIN_DOCS`` labelled texts of each language, chosen by a hash of
the text; texts are whole. Prediction reads nothing but the text.

Defined results: a null text and one without letters is ``und`` with score 0; without any training texts everything is
``und``. Of equal proportions the language first in the alphabet wins. Upper and lower case are the same. Repeated rows
get equal results, extra columns are kept by ``predict``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm import words as W

UNKNOWN = "und"
TRAIN_DOCS = 4000
PENALTY = 3.0
SMOOTHING = 0.2
ROUNDS = 12
CLASSES = 128
# Letters of ASCII are classes 1 to 26, the bytes of other characters share 27 to 127, and all else ends a word.
_CLASS = np.zeros(256, dtype=np.int32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27 + np.arange(128) % 101
_SPACED = np.where(_CLASS > 0, np.arange(256), 0x20).astype(np.uint8)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, W.Words]]:
    data, offsets = W.text_bytes(pc.utf8_lower(batch.column(batch.schema.get_field_index(column))))
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + 400_000, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last, W.cut(_SPACED[data[offsets[first]:offsets[last]]], offsets[first:last + 1] - offsets[first])
        first = last


def _codes(w: W.Words) -> np.ndarray:
    """Trigram around each byte; documents are apart by the end of a word."""
    c = _CLASS[w.data]
    before, after = np.r_[0, c[:-1]], np.r_[c[1:], 0]
    inner = w.offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(c))]
    before[inner] = 0
    after[inner - 1] = 0
    return (before * CLASSES + c) * CLASSES + after


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for first, last, w in _slices(batch, "text"):
            codes = _codes(w)
            for lang in sorted(set(langs[first:last])):
                mine = np.repeat(langs[first:last] == lang, np.diff(w.offsets)) & (_CLASS[w.data] > 0)
                values, counts = np.unique(codes[mine], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), type=pa.string()), pa.array(values, type=pa.int32()),
                                                  pa.array(counts, type=pa.int64())], names=["lang", "code", "n"])


class Model:
    """Log share of each trigram by language."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", most: int = TRAIN_DOCS) -> Model:
    """Model of the languages of a labelled table. What reaches the driver is bounded by the number of trigrams and languages."""
    known = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((CLASSES**3, 0), dtype=np.float32))
    rate = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, most / n))])[F.col("lang")]
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    counts = known.where(draw < rate).mapInArrow(_count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    langs = sorted(found["lang"].unique())
    table = np.zeros((CLASSES**3, len(langs)), dtype=np.float64)
    table[found["code"].to_numpy(), found["lang"].map(langs.index).to_numpy(dtype=np.int64)] = found["n"]
    seen = (table.sum(axis=1) > 0).sum()
    share = (table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * (seen + 1))
    return Model(langs, np.log(share).astype(np.float32))


def _em(like: np.ndarray, bounds: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document, from word likelihoods; ``allowed`` masks languages by document."""
    n = np.diff(bounds)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        q = like * np.repeat(share, n, axis=0)
        q /= np.maximum(q.sum(axis=1, keepdims=True), 1e-300)
        share = np.add.reduceat(q, bounds[:-1], axis=0) / n[:, None]
    q = (like * np.repeat(share, n, axis=0)).sum(axis=1)
    return share, np.add.reduceat(np.log(np.maximum(q, 1e-300)), bounds[:-1])


def _mixture(scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Proportions (zero outside the chosen set) of documents with words, from the log-likelihoods of their words."""
    top = scores.max(axis=1)
    like = np.exp(scores - top[:, None]).astype(np.float64)
    n, k = np.diff(bounds), scores.shape[1]
    cost = PENALTY * np.log(n + 1.0)
    singles = np.add.reduceat((scores - top[:, None]).astype(np.float64), bounds[:-1], axis=0)
    best = singles.max(axis=1)
    chosen = np.zeros((len(n), k))
    chosen[np.arange(len(n)), singles.argmax(axis=1)] = 1.0
    # The words' own maxima bound the likelihood of every mixture (zero here): most documents need no search.
    open_ = np.flatnonzero(-cost > best)
    if not len(open_) or k == 1:
        return chosen
    rows = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in open_])
    inner = np.r_[0, np.cumsum(n[open_])]
    part = like[rows]
    share, value = _em(part, inner, np.ones((len(open_), k)))
    rank = np.argsort(-share, axis=1, kind="stable")
    good, gain = chosen[open_], best[open_]
    for size in range(2, k + 1):
        worth = np.flatnonzero(value - cost[open_] * (size - 1) > gain)  # larger sets fit no better than all languages
        if not len(worth):
            break
        if size < k:
            allowed = np.zeros((len(worth), k))
            np.put_along_axis(allowed, rank[worth, :size], 1.0, axis=1)
            sub = np.concatenate([np.arange(inner[d], inner[d + 1]) for d in worth])
            s, v = _em(part[sub], np.r_[0, np.cumsum(np.diff(inner)[worth])], allowed)
        else:
            s, v = share[worth], value[worth]
        v = v - cost[open_][worth] * (size - 1)
        better = v > gain[worth]
        good[worth[better]], gain[worth[better]] = s[better], v[better]
    chosen[open_] = good
    return chosen


def _predict(batches: Iterator[pa.RecordBatch], model: Model, kept: list[str]) -> Iterator[pa.RecordBatch]:
    langs = model.langs
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        for first, last, w in _slices(batch, "text"):
            rows = last - first
            share = np.zeros((rows, len(langs)))
            full = np.flatnonzero(np.diff(w.bounds))
            if len(full) and langs:
                letters = model.table[_codes(w)]
                letters[_CLASS[w.data] == 0] = 0
                scores = np.add.reduceat(letters, w.start, axis=0)
                share[full] = _mixture(scores, np.r_[w.bounds[full], w.bounds[-1]])
            ascii_letters = np.r_[0, np.cumsum((w.data < 128) & (_CLASS[w.data] > 0))]
            has = ascii_letters[w.offsets[1:]] > ascii_letters[w.offsets[:-1]]
            for d in np.flatnonzero(~has):  # no letter of ASCII: look at the characters themselves
                has[d] = any(c.isalpha() for c in texts[first + int(d)].as_py() or "")
            share[~has] = 0
            at = share.argmax(axis=1) if langs else np.zeros(rows, dtype=np.int64)
            score = share.max(axis=1) if langs else np.zeros(rows)
            found = [langs[i] if s > 0 else UNKNOWN for i, s in zip(at.tolist(), score.tolist())]
            sets = [[langs[i] for i in np.flatnonzero(s > 0)] for s in share]
            part = batch.slice(first, rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index(c)) for c in kept]
                + [pa.array(found, type=pa.string()), pa.array(np.minimum(score, 1.0)), pa.array(sets, type=pa.list_(pa.string()))],
                names=[*kept, "lang_pred", "score", "langs"])


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all) with lang_pred, score and the set of languages of each whole text."""
    keep = docs.columns if keep is None else keep
    own = [f"c{i}" for i in range(len(keep))]
    flat = docs.select(F.col(text).alias("text"), *[F.col(c).alias(o) for c, o in zip(keep, own)])
    kinds = dict(flat.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "".join(f"{o} {kinds[o]}, " for o in own) + "lang_pred string, score double, langs array<string>"
    done = flat.mapInArrow(lambda it: _predict(it, shared.value, own), schema)
    extra = ["lang_pred", "score", "langs"]
    return done.select(*[F.col(o).alias(c) for o, c in zip(own, keep) if c not in extra], *extra)


def fold(row_id: str = "doc_id") -> F.Column:
    """Fold 0 to 3 of a document; fold 2 is held out from training."""
    return F.pmod(F.crc32(F.col(row_id).cast("string").cast("binary")), F.lit(4))
