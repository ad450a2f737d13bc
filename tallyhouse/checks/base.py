"""Shared helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse import views

T = views.table
M, LOG, SRC, POOL, RATINGS = views.SQL_M, views.SQL_LOG, views.SQL_SRC, views.SQL_POOL, views.SQL_RATINGS


def r(col: Column | str, n: int = 8) -> Column:
    """Rounded to ``n`` digits, since two engines add doubles in different orders."""
    return F.round(F.col(col) if isinstance(col, str) else col, n)


def stamp(col: Column | str) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def day(col: Column | str) -> Column:
    return F.date_format(col, "yyyy-MM-dd")
