"""Row filters and alignment of tables to a fixed set of columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.operators.joins import single_row_per_key

# Fixed pattern: text made only of mentions and at most one shortened link.
ONLY_MENTIONS = r"^(?:@[A-Za-z0-9_]{1,15} )+(?:https://t.co/[A-Za-z0-9]{10})?$"
# Tokens that stand for a missing value in the public registers.
NULL_TOKENS = ("-1", "-3", "#NULO#", "#NE#", "#NI#", "00000000#NI#", "0000000000-1")
# Fixed pattern: links to a post, an invitation or a video, which name no account.
NOT_AN_ACCOUNT = r"/p/|/invites/|/tv/"


def select_direct_text(df: DataFrame) -> DataFrame:
    """Texts that say something and are clearly meant for the mentioned account."""
    return df.where(~F.col("text").rlike(ONLY_MENTIONS) & ((F.col("direct_reply") == 1) | (F.col("n_mentions") == 1)))


def filter_expr(df: DataFrame, query: str) -> DataFrame:
    """Subset by a predicate string taken from a configuration."""
    return df.where(F.expr(query))


def regex_flag(col: Column, regex: str, exists: bool = True, case: bool = True) -> Column:
    """True where the text contains (or, with ``exists=False``, lacks) the pattern."""
    found = col.rlike(regex if case else f"(?iu){regex}")
    return found if exists else ~found


def standardize_columns(
    df: DataFrame, template: T.StructType, extra: Sequence[str], replacements: Sequence[tuple[str, str]]
) -> DataFrame:
    """Rename by ordered substring replacements, then align to the template.

    Columns of the template that are absent become null; a column known to neither the
    template nor ``extra`` is an error.
    """
    names = []
    for name in df.columns:
        for old, new in replacements:
            name = name.replace(old, new)
        names.append(name)
    unknown = sorted(set(names) - set(template.names) - set(extra))
    if unknown:
        raise ValueError(f"columns not accounted for: {unknown}")
    renamed = df.toDF(*names)
    out = [
        (F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in template.fields
    ]
    out += [F.col(c) if c in names else F.lit(None).cast("string").alias(c) for c in extra]
    return renamed.select(*out)


def clear_null_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Every known missing-value token becomes null, in every column."""
    return df.select(
        *[
            F.when(F.col(f.name).cast("string").isin(*tokens), None).otherwise(F.col(f.name)).alias(f.name)
            for f in df.schema.fields
        ]
    )


def map_values(col: Column, mapping: Mapping, default: str = "identity") -> Column:
    """Dictionary lookup; unknown keys stay as they are, or become null with ``default="null"``."""
    table = F.create_map(*[F.lit(x) for x in chain(*mapping.items())])
    found = F.element_at(table, col)
    return F.coalesce(found, col) if default == "identity" else found


def legacy_to_full(
    df: DataFrame, names: Mapping[str, str], template: T.StructType, codes: Mapping[str, tuple[str, Mapping]]
) -> DataFrame:
    """Short table in the columns of the full one; ``codes`` = {code column: (description column, mapping)}."""
    renamed = df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])
    have = set(renamed.columns)
    out = []
    for f in template.fields:
        if f.name in codes:
            source, mapping = codes[f.name]
            value = map_values(F.col(source), mapping, default="null")
        else:
            value = F.col(f.name) if f.name in have else F.lit(None)
        out.append(value.cast(f.dataType).alias(f.name))
    return renamed.select(*out)


def date_range_filter(df: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """Rows of the days ``first`` to ``last``, both included.

    Written as a range on the timestamp itself so that the scan can use it.
    """
    lo = F.lit(first).cast("date")
    hi = F.date_add(F.lit(last).cast("date"), 1)
    kind = df.schema[column].dataType
    return df.where((F.col(column) >= lo.cast(kind)) & (F.col(column) < hi.cast(kind)))


def drop_bad_urls(df: DataFrame, column: str = "url") -> DataFrame:
    return df.where(~F.col(column).rlike(NOT_AN_ACCOUNT))


def fill_from(df: DataFrame, other: DataFrame, key: str, columns: Sequence[str], constants: Mapping) -> DataFrame:
    """Nulls filled from ``other`` (one row per key, or the job stops), then by constants."""
    look = single_row_per_key(other, [key]).select(key, *[F.col(c).alias(f"_f_{c}") for c in columns])
    joined = df.join(look, key, "left")
    out = []
    for c in df.columns:
        parts = [F.col(c)]
        if c in columns:
            parts.append(F.col(f"_f_{c}"))
        if c in constants:
            parts.append(F.lit(constants[c]))
        out.append(F.coalesce(*parts).alias(c) if len(parts) > 1 else F.col(c))
    return joined.select(*out)
