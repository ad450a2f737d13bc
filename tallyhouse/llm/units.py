"""Units of text that a tokenizer encodes alike alone and inside any text, and a memo of what they encode to.

A unit ends before a space, tab or newline that follows a character that is no white space. Byte-level BPE cuts
there before it merges, and a vocabulary without a piece that holds white space behind another character never merges over
it, so the ids of a text are those of its units, one after the other. Texts are walked over in pieces of bounded length,
so that memory depends on neither the number of documents nor, but for one unit without white space, on their length.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa

PIECE_CHARS = 1_000_000
JOINED_CHARS = 20_000
MEMO_UNITS = 400_000  # of each of the two generations
MEMO_CHARS = 64
# Characters that some definition of white space holds, other than the three that a unit may start with.
_BLANKS = frozenset("\u180e\u200b\ufeff")
_ODD = tuple(sorted({chr(i) for i in range(0x3001) if chr(i).isspace()} - set(" \n\t") | _BLANKS))
_PLAIN = re.compile(r"[ \n\t]*[^ \n\t]+|[ \n\t]+")
# Byte-level BPE also cuts between a letter and a mark that is no letter; the letters and marks named here are such in any Unicode version.
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-@\[-`{-~"
_FINE = re.compile(rf"[ \n\t]*[{_LETTER}]+(?=[ \n\t{_MARK}]|\Z)|[ \n\t]*[^ \n\t]+|[ \n\t]+")
FINE_BORDER = re.compile(rf"[{_LETTER}][{_MARK}]")  # what a piece must not hold for fine units to be encoded alike alone
_BORDER = re.compile("(?<![\\s\\u180e\\u200b\\ufeff])(?=[ \\n\\t])")
_SPACE = frozenset(" \n\t")


_MARK_BYTE = np.array([b < 128 and re.match(f"[{_MARK}]", chr(b)) is not None for b in range(256)])
_LATIN = 0xC3  # first byte of the letters of _LETTER beyond ASCII, all of whose second bytes are letters but those of the two signs
_SIGNS = (0x97, 0xB7)


def units(text: str, fine: bool = False) -> list[str]:
    """Units of a text, in order; joined they are the text. ``fine``: words without the marks behind them, for byte-level BPE and vocabularies without ``FINE_BORDER``."""
    if is_odd(text):
        return [x for x in _BORDER.split(text) if x]
    return (_FINE if fine else _PLAIN).findall(text)


def is_odd(text: str) -> bool:
    """Whether a text holds white space other than that a unit may start with."""
    return any(map(text.__contains__, _ODD))


def unit_table(texts: list[str], fine: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different units of texts that are not odd, the place of every unit among them, and the units before each text and after all.

    The same units as of ``units``, but found in the bytes of all texts at once, so that a memo is asked once for each.
    """
    data = "".join(texts).encode()
    sizes = [len(x) if x.isascii() else len(x.encode()) for x in texts]
    text_at = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return [], np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
    begins = np.zeros(len(raw) + 1, dtype=bool)
    begins[text_at] = True
    begins = begins[:-1]
    space = (raw == 32) | (raw == 10) | (raw == 9)
    cut = begins.copy()
    cut[1:] |= space[1:] & ~space[:-1]
    if fine:
        letter = (raw | 32) - 97 < 26  # of one byte, so what lies below a wraps around
        if not data.isascii():
            lead = np.flatnonzero(raw == _LATIN)
            lead = lead[~np.isin(raw[lead + 1], _SIGNS)]
            letter[lead] = letter[lead + 1] = True
        opens = letter.copy()  # first letters of runs of letters
        opens[1:] &= ~letter[:-1] | begins[1:]
        runs = np.flatnonzero(opens)
        after_space = begins[runs] | space[runs - 1]
        ends = np.flatnonzero(_MARK_BYTE[raw[1:]] & letter[:-1] & ~begins[1:]) + 1  # marks behind letters
        cut[ends[after_space[np.searchsorted(runs, ends) - 1]]] = True
    starts = np.flatnonzero(cut)
    offsets = np.r_[starts, len(raw)].astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), np.searchsorted(starts, text_at)


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """A text in pieces that end with a unit, of about ``most`` characters each."""
    first = 0
    while len(text) - first > most:
        border = _BORDER.search(text, first + most)
        if border is None or border.start() >= len(text):
            break
        yield text[first:border.start()]
        first = border.start()
    if first < len(text):
        yield text[first:] if first else text


def joinable(new: list[str]) -> list[list[str]]:
    """Units in runs whose joined text has exactly these units; a unit that cannot stand in one is a run of its own."""
    runs, run, size = [], [], 0
    for unit in new:
        if unit[0] in _SPACE and len(unit) <= MEMO_CHARS and unit[-1] not in _BLANKS and not unit[-1].isspace():
            run.append(unit)
            size += len(unit)
            if size >= JOINED_CHARS:
                runs.append(run)
                run, size = [], 0
        else:
            runs.append([unit])
    return runs + ([run] if run else [])


def split_ids(ids: np.ndarray, n_bytes: np.ndarray, run: list[str], joined: str) -> np.ndarray | None:
    """Number of ids up to the end of each unit of a run, or None where no id ends with some unit."""
    ends = np.cumsum(n_bytes[ids])
    wanted = np.cumsum(list(map(len, run)) if joined.isascii() else [len(u.encode()) for u in run])
    at = np.searchsorted(ends, wanted)
    if not len(ends) or ends[-1] != wanted[-1] or (ends[at] != wanted).any():
        return None
    return at + 1


class Memo:
    """Values of units. Two generations: units still in use move to the young one, and the old one goes when that is full."""

    def __init__(self, encode: Callable[[list[str]], list], most: int = MEMO_UNITS):
        self.encode, self.most = encode, most
        self.young: dict = {}
        self.old: dict = {}

    def values(self, asked: list[str]) -> list:
        found = list(map(self.young.get, asked))
        if None not in found:
            return found
        missing = list(compress(range(len(found)), map(is_, found, repeat(None))))
        names = list(dict.fromkeys(map(asked.__getitem__, missing)))
        kept = list(map(self.old.get, names))
        fresh = dict(zip(names, kept))
        new = [unit for unit, x in zip(names, kept) if x is None]
        if new:
            fresh.update(zip(new, self.encode(new)))
        for i in missing:
            found[i] = fresh[asked[i]]
        if len(self.young) + len(fresh) > self.most:
            self.old, self.young = self.young, {}
        if max(map(len, names)) > MEMO_CHARS:
            fresh = {u: x for u, x in fresh.items() if len(u) <= MEMO_CHARS}
        self.young.update(fresh)
        return found


class ByteBpe:
    """Byte-level BPE of a tokenizers file: ids of units, and the bytes of each id."""

    def __init__(self, path: str, specials_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = specials_as_text
        # Byte-level files write a byte that is printable in Latin-1 as itself, and the others as characters from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {i for i, token in self.model.get_added_tokens_decoder().items()}
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.surfaces = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.surfaces[i] = token.encode() if i in special else bytes(byte_of[c] for c in token)
        self.n_bytes = np.array([len(x) for x in self.surfaces], dtype=np.int64)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_units(self, new: list[str]) -> list[bytes]:
        """Packed ids of each unit."""
        out: dict[str, bytes] = {}
        runs = joinable(new)
        texts = ["".join(run) for run in runs]
        for run, text, ids in zip(runs, texts, self.ids(texts)):
            if len(run) == 1:
                out[text] = ids.tobytes()
                continue
            ends = split_ids(ids, self.n_bytes, run, text)
            if ends is None:
                out.update(zip(run, (x.tobytes() for x in self.ids(run))))
            else:
                packed, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
                out.update((u, packed[a:b]) for u, a, b in zip(run, bounds, bounds[1:]))
        return [out[u] for u in new]
