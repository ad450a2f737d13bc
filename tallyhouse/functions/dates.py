"""Dates and times as the sources write them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.text import let
from tallyhouse.operators.filters import map_values

# Month names, long and short, Portuguese and English.
MONTHS = {
    "jan": 1, "fev": 2, "mar": 3, "abr": 4, "mai": 5, "jun": 6, "jul": 7, "ago": 8, "set": 9, "out": 10, "nov": 11, "dez": 12,
    "janeiro": 1, "fevereiro": 2, "março": 3, "abril": 4, "maio": 5, "junho": 6, "julho": 7, "agosto": 8, "setembro": 9,
    "outubro": 10, "novembro": 11, "dezembro": 12, "marco": 3, "feb": 2, "apr": 4, "may": 5, "aug": 8, "sep": 9, "oct": 10,
    "dec": 12, "january": 1, "february": 2, "march": 3, "april": 4, "june": 6, "july": 7, "august": 8, "september": 9,
    "october": 10, "november": 11, "december": 12,
}
# English month abbreviations of old registers, and days per month.
MONTH_CODES = {m: f"{i:02d}" for i, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), 1)}
MONTH_DAYS = dict(zip(MONTH_CODES.values(), (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)))


def month_name_to_num(col: Column) -> Column:
    return map_values(F.lower(F.trim(col)), MONTHS, default="null")


def _cut(s: Column, start: int, end: int | None = None) -> Column:
    """Characters ``start`` to ``end`` as Python slices them."""
    return F.substr(s, F.lit(start + 1)) if end is None else F.substring(s, start + 1, end - start)


def _parts(d: Column, m: Column, y: Column, rest: Column | None = None) -> Column:
    return F.struct(d.alias("d"), m.alias("m"), y.alias("y"), (F.lit("") if rest is None else rest).alias("rest"))


def _two_digits(s: Column) -> Column:
    n = F.trim(s).try_cast("int")
    return F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))


def _checked_digits(p: Column) -> Column:
    """Day clamped to the month; null when the month does not exist."""
    top = map_values(p["m"], MONTH_DAYS, default="null")
    number = p["d"].try_cast("int")
    common = (p["m"] == "02") & ((p["y"].try_cast("int") - 1900) % 4 != 0)

    def place(d: Column) -> Column:
        return _parts(F.when((d == "29") & common, "28").otherwise(d), p["m"], p["y"])

    clamped = F.when(number > top, (number - 1).cast("string")).otherwise(p["d"])
    return F.when(p.isNotNull() & top.isNotNull(), let(clamped, place))


def _split_parts(s: Column, sep: str) -> Column:
    def place(a: Column) -> Column:
        rest = F.when(F.size(a) > 3, F.concat(F.lit("/"), F.array_join(F.slice(a, F.lit(4), F.greatest(F.size(a) - 3, F.lit(0))), "/"))).otherwise("")
        return F.when(F.size(a) >= 3, _parts(F.get(a, F.lit(0)), F.get(a, F.lit(1)), F.get(a, F.lit(2)), rest))

    return let(F.split(s, sep), place)


def _named_month(p: Column) -> Column:
    code = map_values(p["m"], MONTH_CODES, default="null")
    year = F.when(F.length(p["y"]) == 2, F.concat(F.lit("19"), p["y"])).otherwise(p["y"])
    return F.when(p["m"].rlike("^[0-9]+$"), p).when(code.isNotNull(), _parts(p["d"], code, year, p["rest"]))


def _join_parts(p: Column) -> Column:
    year = F.trim(p["y"]).try_cast("int")
    return F.when(
        (year < 1800) | (year > 2100), F.concat(p["d"], F.lit("/"), p["m"], F.lit("/19"), _cut(p["y"], 2))
    ).when(year.isNotNull(), F.concat(p["d"], F.lit("/"), p["m"], F.lit("/"), p["y"], p["rest"]))


def format_legacy_date(col: Column) -> Column:
    """Old date spellings to ``DD/MM/YYYY``.

    Handles blanks inside (``1 21950``, ``01121950`` with spaces), 6 to 8 digits, dashes
    with month names and slashes. Days past the end of the month lose one, 29 February
    of a common year becomes 28. Seven digits that fit no pattern come back unchanged,
    other unreadable dates become null and a missing date an empty text.
    """
    s = col
    n = F.length(s)
    zero = F.lit("0")
    packed = F.regexp_replace(s, " ", "")
    spaced = F.when(
        n == 7, _parts(F.concat(zero, _cut(packed, 0, 1)), F.concat(zero, _cut(packed, 1, 2)), _cut(packed, 2))
    ).otherwise(_parts(_two_digits(_cut(s, 0, 2)), _two_digits(_cut(s, 2, 4)), _cut(s, 4)))
    early_year = (n == 6) & (_cut(s, 2, 4) == "19")
    middle_year = (n == 7) & (_cut(s, 3, 5) == "19")
    short_year = (n == 7) & (_cut(s, 4, 6) == "19")
    late = _cut(s, 1, 3).try_cast("int") > 12
    plain = (
        F.when(early_year, _parts(F.concat(zero, _cut(s, 0, 1)), F.concat(zero, _cut(s, 1, 2)), _cut(s, 2)))
        .when(n == 6, _parts(_cut(s, 0, 2), _cut(s, 2, 4), F.concat(F.lit("19"), _cut(s, 4))))
        .when(middle_year & late, _parts(_cut(s, 0, 2), F.concat(zero, _cut(s, 2, 3)), _cut(s, 3)))
        .when(middle_year, _parts(F.concat(zero, _cut(s, 0, 1)), _cut(s, 1, 3), _cut(s, 3)))
        .when(short_year, _parts(_cut(s, 0, 2), _cut(s, 2, 4), F.concat(_cut(s, 4), zero)))
        .when(n != 7, _parts(_cut(s, 0, 2), _cut(s, 2, 4), _cut(s, 4)))
    )
    all_digits = s.rlike("^[0-9]+$")
    parts = (
        F.when(s.contains(" "), spaced).when(all_digits, let(plain, _checked_digits))
        .when(s.contains("-"), let(_split_parts(s, "-"), _named_month)).otherwise(_split_parts(s, "/"))
    )
    unreadable = all_digits & (n == 7) & ~middle_year & ~short_year
    return F.when(s.isNull(), "").when(unreadable, s).otherwise(let(parts, _join_parts))


def date_replace(col: Column, year: int | None = None, month: int | None = None, day: int | None = None) -> Column:
    """Date with some of its parts set; a day the month lacks is an error."""
    return F.make_date(
        F.lit(year) if year else F.year(col), F.lit(month) if month else F.month(col), F.lit(day) if day else F.dayofmonth(col)
    )


def capture_utc(ts: Column) -> Column:
    """UTC of a capture time written in Brasília time (always three hours behind)."""
    return ts + F.expr("INTERVAL 3 HOURS")


def local_time(ts: Column, zone: str = "America/Sao_Paulo") -> Column:
    """Wall clock of ``zone`` for a UTC time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def parse_mixed_offsets(col: Column) -> Column:
    """UTC wall clock of texts that end in ``+00:00``, ``-03:00`` or another offset."""
    shown = F.regexp_extract(col, r"([+-])(\d\d):(\d\d)$", 0)
    minutes = (F.substring(shown, 2, 2).try_cast("int") * 60 + F.substring(shown, 5, 2).try_cast("int")) * F.when(
        shown.startswith("-"), 1
    ).otherwise(-1)
    wall = F.to_timestamp_ntz(F.regexp_replace(F.regexp_replace(col, r"[+-]\d\d:\d\d$", ""), "T", " "))
    return F.timestamp_add("MINUTE", minutes, wall)


def parse_datetimes(df: DataFrame, columns: Sequence[str], fmt: str | None = None) -> DataFrame:
    """Text columns to timestamps; unreadable texts become null."""
    args = [F.lit(fmt)] if fmt else []
    return df.withColumns({c: F.try_to_timestamp(F.col(c), *args) for c in columns})
