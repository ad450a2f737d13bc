"""Distinct counts from sketches, used to leave out what need not be counted exactly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG_CELLS = 12  # 4,096 cells: a standard error of 1.6 percent, and at most 4 KB for a sketch
PER_PASS = 1_000  # sketches in one aggregate, so that a task holds about 4 MB of them
MARGIN, SLACK = 1.25, 4  # ten standard errors of the ratio of two sketches; a few values more where counts are small


def distinct_estimates(df: DataFrame, sets: Mapping[str, Sequence[str]]) -> dict[str, int]:
    """Estimated number of distinct combinations of each named set of columns; null counts as a value.

    One aggregate without shuffle keys takes up to ``PER_PASS`` sets. What comes to the driver is one number for each.
    """
    names, found = list(sets), {}
    for start in range(0, len(names), PER_PASS):
        part = names[start : start + PER_PASS]
        hashes = [F.xxhash64(*[F.col(f"`{c}`") for c in sets[n]]) for n in part]
        row = df.agg(*[
            F.hll_sketch_estimate(F.hll_sketch_agg(h, F.lit(LG_CELLS))).alias(f"e{i}") for i, h in enumerate(hashes)
        ]).first()
        found.update({n: row[f"e{i}"] or 0 for i, n in enumerate(part)})
    return found


def surely_more(estimate: float, other: float) -> bool:
    """Whether a set of this estimated size has more values than one of size ``other``, beyond the error of both."""
    return estimate > MARGIN * (other + SLACK)
