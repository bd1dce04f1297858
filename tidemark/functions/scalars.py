"""Scalar functions over columns: lenient casts, calendars, robust speed, digests, keyed random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing number.
SENTINELS = ("", ".", "-", "NA", "N/A", "ND", "NaN", "nan", "null", "*", "..", "n.a.")
#: Accepted date masks, tried in this order; Y stands for four digits of a year, y for two, m and d for one or two, b for a month's name.
DATE_MASKS = ("Y-m-d", "m/d/Y", "d-b-Y", "d b Y", "Y-m", "b-y", "Ymd", "d/m/Y", "m/d/y", "Y:m:d", "Y:m")
#: Names of the months.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_FIELDS = {"Y": r"(\d{4})", "y": r"(\d{2})", "m": r"(\d{1,2})", "d": r"(\d{1,2})", "b": r"([A-Za-z]{3})"}


def lenient_double(text: Column) -> Column:
    """A number with optional thousands commas, inf and infinity in any case; sentinels and what else isn't one give null, letters after a number too."""
    clean = F.regexp_replace(F.trim(text), ",", "")
    number = clean.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|(?i)^[+-]?inf(inity)?$")
    return F.when(~clean.isin(*SENTINELS) & number, clean.try_cast("double"))


def excel_date(serial: Column) -> Column:
    """Date of a spreadsheet serial between 1 and 200 000, day 0 being 1899-12-30."""
    days = serial.try_cast("double")
    return F.when((days > 1) & (days < 200_000), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(days).cast("int")))


def _masked(s: Column, mask: str) -> Column:
    """The date of a text under one mask, null if it isn't one."""
    packed = mask == "Ymd"
    pattern = r"^(\d{4})(\d{2})(\d{2})$" if packed else "^" + "".join(_FIELDS.get(c, c) for c in mask) + "$"
    fields = [c for c in mask if c in _FIELDS]
    part = {c: F.regexp_extract(s, pattern, i + 1) for i, c in enumerate(fields)}
    year = part["Y"] if "Y" in part else part["y"].try_cast("int") + F.when(part["y"].try_cast("int") < 69, 2000).otherwise(1900)
    if mask == "b-y":  # a month so far ahead belongs to the century before
        year = year - F.when(year > F.year(F.current_date()) + 5, 100).otherwise(0)
    month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part["b"])), F.lit(0)) if "b" in part else part["m"]
    text = F.concat(year.cast("string"), F.lit("-"), month.cast("string"), F.lit("-"), part["d"] if "d" in part else F.lit("1"))
    return F.when(s.rlike(pattern), F.try_to_date(text, "yyyy-M-d"))


def lenient_date(text: Column, annual: bool = False, serial: bool = False) -> Column:
    """A date in any accepted mask, YYYYQn, YYYYMnn, YYYYMM, YYYY where annual, a spreadsheet serial where the text was a number (serial); else null.

    Six digits are always year and month.
    """
    s = F.trim(text)
    part = lambda pattern, group: F.regexp_extract(s, pattern, group).try_cast("int")
    day = lambda y, m: F.when(m.between(1, 12), F.make_date(y, m, F.lit(1)))
    quarter, month, packed = r"^(\d{4})[-/]?[Qq]([1-4])$", r"^(\d{4})[Mm](\d{2})$", r"^(\d{4})(\d{2})$"
    choices = [_masked(s, m) for m in DATE_MASKS]
    choices += [F.when(s.rlike(quarter), day(part(quarter, 1), part(quarter, 2) * 3 - 2)), F.when(s.rlike(month), day(part(month, 1), part(month, 2))), F.when(s.rlike(packed), day(part(packed, 1), part(packed, 2)))]
    if annual:
        choices.append(F.when(s.rlike(r"^\d{4}$"), F.make_date(s.try_cast("int"), F.lit(1), F.lit(1))))
    if serial:
        choices.append(F.when(s.rlike(r"^\d{1,6}(\.\d+)?$"), excel_date(s)))
    return F.coalesce(*choices)


def epoch_date(seconds: Column) -> Column:
    """UTC date of epoch seconds, which may be negative."""
    return F.to_date(F.timestamp_seconds(seconds))


def month_index(date: Column) -> Column:
    return (F.year(date) * 12 + F.month(date) - 1).cast("bigint")


def month_date(index: Column) -> Column:
    return F.make_date(F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"), F.lit(1))


def quarter_index(date: Column) -> Column:
    return (F.year(date) * 4 + F.quarter(date) - 1).cast("bigint")


def available_date(date: Column, lag_months: int, day: int) -> Column:
    """When a month's figure is published: day of the month lag_months later, no later than its last."""
    later = F.add_months(F.trunc(date, "MM"), lag_months)
    return F.least(F.date_add(later, day - 1), F.last_day(later))


def decimal_month(value: Column) -> Column:
    """First of the month of a YYYY.MM number, in which .1 is October."""
    return F.make_date(F.floor(value).cast("int"), F.round((value - F.floor(value)) * 100).cast("int"), F.lit(1))


def norm_speed(raw: Column, mad: Column) -> Column:
    """raw in units of its normal-consistent MAD, clipped to 3 and scaled to -1 .. 1; null for a zero scale."""
    scaled = F.try_divide(raw, F.lit(1.4826) * F.nullif(mad, F.lit(0.0)))
    return F.greatest(F.lit(-3.0), F.least(F.lit(3.0), scaled)) / 3 + F.lit(0.0) * scaled


def finite(value: Column) -> Column:
    """value, or null where it is NaN or infinite."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def series_digest(at: Column, value: Column) -> Column:
    """Aggregate: SHA-256 of the lines at,value in order of at, values to six places."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(at.alias("a"), value.alias("v")))), lambda x: F.concat_ws(",", x["a"].cast("string"), F.format_string("%.6f", x["v"])))
    return F.sha2(F.array_join(lines, "\n"), 256)


def keyed_random(n: Column | int, *key: Column) -> Column:
    """A whole number 0 .. n - 1 that depends on the key alone: counter-based, the same on every engine."""
    word = F.conv(F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("bigint")
    return F.pmod(word, n if isinstance(n, Column) else F.lit(n))


def overlaps(start: Column, end: Column, low: str, high: str) -> Column:
    """Whether start .. end meets the excluded dates low .. high."""
    return (start <= F.lit(high).cast("date")) & (end >= F.lit(low).cast("date"))
