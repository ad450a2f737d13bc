"""Deterministic uniforms: the same key and seed give the same draw on any partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = 13  # 52 bits, so the integer is exact as a double


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """Number in [0, 1) from the md5 of ``seed:key[:key...]``."""
    parts = [F.lit(str(seed))] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def uniforms(seeds: Sequence[int | str], keys: Iterable[str]) -> np.ndarray:
    """What ``uniform`` gives for each key (line) and seed (column), without a session."""
    starts = [f"{seed}:".encode() for seed in seeds]
    first = b"".join([hashlib.md5(start + key, usedforsecurity=False).digest()[:8] for key in map(str.encode, keys) for start in starts])
    return (np.frombuffer(first, ">u8") >> (64 - 4 * _DIGITS)).astype(float).reshape(-1, len(starts)) / 16**_DIGITS


def exponential_key(u: Column, weight: Column) -> Column:
    """Weighted sampling key: the n smallest are a weighted sample without replacement."""
    return -F.ln(F.when(u > 0, u).otherwise(F.lit(2.0**-53))) / weight
