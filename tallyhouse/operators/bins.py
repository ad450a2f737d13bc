"""Bins, histograms, logarithms, one-hot columns and replicated rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_prob(col: Column, width: float) -> Column:
    """Number of the bin of a probability; 1.0 has a bin of its own."""
    return (col / F.lit(float(width))).cast("int")


def clip(col: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Values moved inside the bounds; nulls stay null."""
    if lower is not None:
        col = F.when(col < lower, F.lit(float(lower))).otherwise(col)
    if upper is not None:
        col = F.when(col > upper, F.lit(float(upper))).otherwise(col)
    return col


def values_to_bins(
    df: DataFrame, column: str, bins: int, out: str, lower: float | None = None, upper: float | None = None,
    log: bool = False, pad: float = 1e-6,
) -> DataFrame:
    """Whole-number middle of the right-closed bin of each known value.

    Edges run from the smallest to the largest clipped value, widened by ``pad``, in
    equal steps of the value or of its logarithm. Rows without a value are dropped.
    """
    rows = df.where(F.col(column).isNotNull()).withColumn("_v", clip(F.col(column).cast("double"), lower, upper))
    ends = rows.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    scale = F.log10 if log else (lambda c: c)
    first = ends.select(scale(F.col("lo") - pad)).scalar()
    last = ends.select(scale(F.col("hi") + pad)).scalar()
    rows = rows.withColumn("_a", first).withColumn("_step", (last - F.col("_a")) / F.lit(float(bins)))
    raw = lambda k: F.col("_a") + k * F.col("_step")
    edge = (lambda k: F.pow(F.lit(10.0), raw(k))) if log else raw
    x = F.log10("_v") if log else F.col("_v")
    guess = F.greatest(F.least(F.ceil((x - F.col("_a")) / F.col("_step")) - 1, F.lit(bins - 1)), F.lit(0))
    rows = rows.withColumn("_g", guess)
    k = F.when(F.col("_v") <= edge(F.col("_g")), F.col("_g") - 1).when(
        (F.col("_v") > edge(F.col("_g") + 1)) & (F.col("_g") < bins - 1), F.col("_g") + 1
    ).otherwise(F.col("_g"))
    rows = rows.withColumn("_k", F.greatest(k, F.lit(0)))
    middle = ((edge(F.col("_k")) + edge(F.col("_k") + 1)) / 2).cast("bigint")
    return rows.withColumn(out, middle).drop("_v", "_a", "_step", "_g", "_k")


def histogram(df: DataFrame, column: str, bins: int, density: bool = False) -> DataFrame:
    """Centre, height and error of equal bins over the range of the data.

    Bins are closed on the left, the last one on both sides; empty bins are listed. The
    error is sqrt(n (1 - n/N)); ``density`` divides by N and the bin width.
    """
    x = F.col(column).cast("double")
    rows = df.where(x.isNotNull())
    ends = rows.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(F.lit(1)).cast("double").alias("n"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    k = F.least(F.floor((x - lo) / (hi - lo) * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = ends.select("lo", ((F.col("hi") - F.col("lo")) / F.lit(float(bins))).alias("dx"), F.col("n").alias("total"),
                       F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = grid.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))
    err = F.sqrt(F.col("n") * (1 - F.col("n") / F.col("total")))
    unit = F.col("total") * F.col("dx") if density else F.lit(1.0)
    return full.select(
        "bin", (F.col("lo") + (F.col("bin") + 0.5) * F.col("dx")).alias("center"), (F.col("n") / unit).alias("height"),
        (err / unit).alias("error"),
    )


def bin_counts(binned: DataFrame, label: str) -> DataFrame:
    """Rows per bin label."""
    return binned.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def log_plus(df: DataFrame, columns: Sequence[str], offset: float | str = 0, base10: bool = True) -> DataFrame:
    """Logarithm of offset + x; ``auto`` makes the smallest logarithm of each column 0."""
    fn = F.log10 if base10 else F.ln
    if offset == "auto":
        low = df.agg(*[F.min(c).alias(c) for c in columns])
        shift = {c: F.lit(1.0) - low.select(F.col(c).cast("double")).scalar() for c in columns}
    else:
        shift = {c: F.lit(float(offset)) for c in columns}
    return df.withColumns({c: fn(shift[c] + F.col(c)) for c in columns})


def one_hot(
    df: DataFrame, columns: Sequence[str], drop: str | None = None, by_cardinality: bool = True,
    values: Mapping[str, Sequence[str | None]] | None = None,
) -> DataFrame:
    """One 0/1 column per value, columns of variables with fewer values first.

    The values become column names, so they are known to the driver: those declared in ``values``, or else all that
    occur. For variables whose number of values grows with the data use ``one_hot_long``.
    ``drop`` is ``first`` or ``if_binary``.
    """
    open_ = [c for c in columns if c not in (values or {})]
    found = one_hot_long(df, open_).select("variable", "value").distinct().collect() if open_ else []
    values = dict(values or {}) | {c: sorted((r["value"] for r in found if r["variable"] == c), key=lambda v: (v is None, v)) for c in open_}
    order = sorted(columns, key=lambda c: len(values[c])) if by_cardinality else list(columns)
    out = []
    for c in order:
        kept = values[c]
        if drop == "first" or (drop == "if_binary" and len(kept) == 2):
            kept = kept[1:]
        out += [F.col(c).cast("string").eqNullSafe(F.lit(v)).cast("int").alias(f"{c}_{v}") for v in kept]
    return df.select(*[c for c in df.columns if c not in columns], *out)


def one_hot_long(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The same facts in long form: one row (kept columns, variable, value) per row and variable, for any number of values."""
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.*")


def replicate_rows(df: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` times; zero drops it."""
    return df.withColumn("_r", F.explode(F.array_repeat(F.lit(0), times.cast("int")))).drop("_r")
