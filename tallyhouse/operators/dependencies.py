"""Functional dependencies between columns and agreement between sources."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.operators.sketches import distinct_estimates, surely_more


def is_one_to_one(df: DataFrame, a: str, b: str) -> DataFrame:
    """Whether every ``a`` has exactly one ``b`` and the other way round.

    Judged on the extremes, so that a value without partner and one with two partners
    cannot cancel out. Rows with a null key are not groups.
    """
    pairs = df.select(a, b).distinct()
    side = lambda key, other: pairs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(other).alias("n"))
    ends = lambda key, other: side(key, other).agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    x, y = ends(a, b), ends(b, a)
    out = x.select(
        F.col("lo").alias("min_right"), F.col("hi").alias("max_right"),
        y.select("lo").scalar().alias("min_left"), y.select("hi").scalar().alias("max_left"),
    )
    one = [F.col(c) == 1 for c in out.columns]
    return out.withColumn("one_to_one", (one[0] & one[1] & one[2] & one[3]).cast("int"))


def one_to_one_violations(df: DataFrame, a: str, b: str, keep_all: bool = False) -> DataFrame:
    """Keys of ``a`` with more than one ``b``, one row per partner (long form)."""
    return shared_children(df, [a], b, keep_all)


def shared_children(df: DataFrame, child: Sequence[str], parent: str, keep_all: bool = False) -> DataFrame:
    """Children under more than one parent, one row per parent; ``keep_all`` lists every child."""
    pairs = df.dropna(subset=list(child)).select(*child, parent).distinct()
    counts = pairs.groupBy(*child).agg(F.count(parent).alias("n_partners"))
    if not keep_all:
        counts = counts.where("n_partners > 1")
    return pairs.join(counts, list(child)).select(*child, "n_partners", parent)


def _open_pairs(df: DataFrame, cols: Sequence[str]) -> list[tuple[str, str]]:
    """Ordered pairs (child, parent) that sketches cannot rule out.

    A pair that holds adds no combinations to those of the child alone, so a pair sketch that is larger than the
    child's by more than the error of both rules it out.
    """
    couples = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    sets = {f"s{i}": [a] for i, a in enumerate(cols)} | {f"p{i}": pair for i, pair in enumerate(couples)}
    size = distinct_estimates(df, sets)
    single = {a: size[f"s{i}"] for i, a in enumerate(cols)}
    both = {pair: size[f"p{i}"] for i, pair in enumerate(couples)}
    return [
        (a, b) for a in cols for b in cols
        if a != b and not surely_more(both[(a, b) if (a, b) in both else (b, a)], single[a])
    ]


def _holding(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Those of the pairs (child, parent) that hold, decided on all rows.

    The table is grouped once for each child, over its own columns only: where the least and the greatest hash of a parent
    are equal in every group, the child has a single value of it. Rows meet per task before the shuffle, so a frequent
    child value is no burden, and no pair of values is ever listed.
    """
    spark = df.sparkSession
    parents: dict[str, list[str]] = {}
    for a, b in pairs:
        parents.setdefault(a, []).append(b)
    found = []
    for a, others in parents.items():
        hashes = [F.xxhash64(F.col(f"`{b}`")).alias(f"h{i}") for i, b in enumerate(others)]
        ends = [f(f"h{i}").alias(f"{n}{i}") for i in range(len(others)) for f, n in ((F.min, "lo"), (F.max, "hi"))]
        groups = df.select(F.col(f"`{a}`").alias("k"), *hashes).groupBy("k").agg(*ends)
        row = groups.agg(*[F.coalesce(F.bool_and(F.col(f"lo{i}") == F.col(f"hi{i}")), F.lit(True)).alias(f"b{i}") for i in range(len(others))])
        cells = [F.struct(F.lit(a).alias("child"), F.lit(b).alias("parent"), F.col(f"b{i}").alias("holds")) for i, b in enumerate(others)]
        found.append(row.select(F.explode(F.array(*cells)).alias("c")).where("c.holds").select("c.child", "c.parent"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "child STRING, parent STRING")


def subcategory_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Ordered pairs (child, parent): each value of the child has a single value of the parent.

    Null counts as a value, and in an empty table every pair holds. Sketches of all columns and pairs, from one pass,
    rule out most pairs; the others are decided on all rows. The table is read once more for each child with an open
    pair, so it should be a stored one.
    """
    cols = list(columns or df.columns)
    return _holding(df, _open_pairs(df, cols))


def redundant_columns(df: DataFrame, prefix: str | None = None, columns: Sequence[str] | None = None) -> list[str]:
    """Columns that can go because another column maps one to one onto them.

    Of each such set one column stays: one without the prefix if there is one. The
    choice is made on the pairs of column names, never on rows. Only pairs that sketches
    leave open in both directions are decided on all rows.
    """
    cols = list(columns or df.columns)
    left = set(_open_pairs(df, cols))
    mutual = [(a, b) for a in cols for b in cols if (a, b) in left and (b, a) in left]
    pairs = {(r["child"], r["parent"]) for r in _holding(df, mutual).collect()}
    drop: list[str] = []
    for i, a in enumerate(cols):
        for b in cols[i + 1 :]:
            if a in drop or b in drop or (a, b) not in pairs or (b, a) not in pairs:
                continue
            drop.append(a if prefix and a.startswith(prefix) and not b.startswith(prefix) else b)
    return drop


def drop_redundant(df: DataFrame, prefix: str | None = None) -> DataFrame:
    return df.drop(*redundant_columns(df, prefix))


def guess_data_types(df: DataFrame, max_mag: float = 2, max_int: int = 30) -> DataFrame:
    """``num``, ``log`` or ``cat`` for each column.

    Dates are ``num``. Text that no number would hold (a null counts as such), a minus
    sign not in front, whole numbers with a leading zero, or few distinct whole numbers
    make a column ``cat``. Other numbers are ``log`` when positive over more than
    ``max_mag`` decades.

    One pass gathers a few figures per column, which decide on the driver. Distinct
    counts come from a sketch there; it cannot exceed ``max_int`` + 1 for a column with at
    most ``max_int`` values, so only columns at or below that are counted exactly and no
    column with many values is shuffled.
    """
    dates = (T.DateType, T.TimestampType, T.TimestampNTZType)
    fields = [f for f in df.schema.fields if not isinstance(f.dataType, dates)]
    kinds = {f.name: "num" for f in df.schema.fields}
    aggs = []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        number = c.try_cast("double")
        whole = F.signum(number) * F.floor(F.abs(number))
        size = F.abs(number)
        if isinstance(f.dataType, T.NumericType):
            # What the digits of a number would show: an exponent, a leading zero.
            odd = c.isNull() | F.isnan(number) | (size >= 1e16) | ((size > 0) & (size < 1e-4))
            dash, zero = F.lit(False), (number >= 0) & (number < 1)
        else:
            text = c.cast("string")
            odd = c.isNull() | text.rlike(r"[^\d,.\-]")
            dash, zero = text.contains("-") & ~text.rlike(r"^-[\d.,]+"), text.rlike("^0")
        aggs += [
            F.bool_or(odd).alias(f"odd{i}"), F.bool_or(dash).alias(f"dash{i}"),
            F.bool_or(F.abs(number - whole) > 1e-8 + 1e-5 * size).alias(f"frac{i}"), F.bool_or(zero).alias(f"zero{i}"),
            F.min(number).alias(f"lo{i}"), F.max(number).alias(f"hi{i}"),
            F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(c), F.lit(12))).alias(f"few{i}"),
        ]
    seen = df.agg(*aggs).first() if aggs else {}

    def scale(i: int) -> str:
        lo, hi = seen[f"lo{i}"], seen[f"hi{i}"]
        return "log" if lo is not None and lo > 0 and math.log10(hi) - math.log10(lo) > max_mag else "num"

    open_cases = []
    for i, f in enumerate(fields):
        if seen[f"odd{i}"] or seen[f"dash{i}"] or (seen[f"zero{i}"] and not seen[f"frac{i}"]):
            kinds[f.name] = "cat"
        elif seen[f"frac{i}"] or seen[f"few{i}"] > max_int + 1:
            kinds[f.name] = scale(i)
        else:
            open_cases.append((i, f.name))
    if open_cases:
        exact = df.agg(*[F.count_distinct(f"`{n}`").alias(f"d{i}") for i, n in open_cases]).first()
        for i, n in open_cases:
            kinds[n] = scale(i) if exact[f"d{i}"] > max_int else "cat"
    return df.sparkSession.createDataFrame(list(kinds.items()), "column STRING, dtype STRING")


def cross_source_mismatch(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Cells that differ between two sources, and keys missing from one, as (key, problem, left, right)."""
    left = a.select(key, *[F.col(c).cast("string").alias(f"l_{c}") for c in columns], F.lit(1).alias("_l"))
    right = b.select(key, *[F.col(c).cast("string").alias(f"r_{c}") for c in columns], F.lit(1).alias("_r"))
    joined = left.join(right, key, "full_outer")
    none = F.lit(None).cast("string")
    cell = lambda name, cond, x, y: F.when(cond, F.struct(F.lit(name).alias("problem"), x.alias("left"), y.alias("right")))
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    found = [cell("missing_right", F.col("_r").isNull(), none, none), cell("missing_left", F.col("_l").isNull(), none, none)]
    found += [
        cell(c, both & ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.col(f"l_{c}"), F.col(f"r_{c}")) for c in columns
    ]
    return joined.select(key, F.explode(F.array_compact(F.array(*found))).alias("p")).select(key, "p.*")


def count_consistency(df: DataFrame, key: str, counts: Sequence[str]) -> DataFrame:
    """Rows whose annotation counts are not all equal."""
    cols = [F.col(c) for c in counts]
    return df.where(F.greatest(*cols) != F.least(*cols)).select(key, *counts)
