"""Date scalars: day-first parsing of import text and display formats."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The month names a reader of English date text knows.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
          "december"]
_WEEKDAYS = "mon(day)?|tue(s|sday)?|wed(nesday)?|thu(r|rs|rsday)?|fri(day)?|sat(urday)?|sun(day)?"
# What a date text may have besides its date, and what stands for it, in the order in which it is taken off.
_CLOCK = r"([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d([.]\d+)?)?([ ]?[AaPp][Mm])?"
_AROUND = [
    (rf"(?i)^({_WEEKDAYS})[.,]?\s+", ""),
    (rf"(?:\s+|T){_CLOCK}([ ]?(Z|GMT|UTC|[+-]\d{{2}}:?\d{{2}}))?$", ""),
    (rf"^({_CLOCK}|\d{{1,2}}[ ]?[AaPp][Mm])\s+(?=\S)", ""),
    (r"^(.+\D\d{4}|\d+[./-]+\d+[./-]+\d+)(?:\s+|T)([01]?\d|2[0-3])([ ]?[AaPp][Mm])?$", "$1"),  # an hour alone
    (r"[.,]+$", ""),
    (r"(?i)(\d)(st|nd|rd|th)\b(\s+of\b)?", "$1"),
    (r"^(\d{1,2})([A-Za-z]{3,9})(\d{4}|\d{2})$", "$1 $2 $3"),
]
#: Dates outside cannot be held by a pandas time stamp, which the reference reads into.
FIRST_DATE, LAST_DATE = "1677-09-22", "2262-04-11"


def default_pivot_year() -> int:
    return _dt.date.today().year + 50


def _date(year: Column, month: Column, day: Column) -> Column:
    """The date of three numbers as text, null when there is none."""
    return F.concat_ws("-", F.lpad(year, 4, "0"), month, day).try_cast("date")


def _month_number(name: Column) -> Column:
    """1 to 12 for an English month name or its first three letters (and ``sept``), as text; else null."""
    n = F.lower(name)
    full, short = F.array(*[F.lit(m) for m in MONTHS]), F.array(*[F.lit(m[:3]) for m in MONTHS])
    at = F.greatest(F.array_position(full, n), F.array_position(short, n), F.when(n == "sept", 9).otherwise(0).cast("long"))
    return F.when(at > 0, at.cast("string"))


def parse_day_first(col, iso: str = "ymd", pivot_year: int | None = None) -> Column:
    """F8: import date text -> DATE, null when it reads as no date.

    A weekday, a time of day and what makes a day an ordinal are dropped. Then three parts in any usual order, between
    ``.``, ``/``, ``-``, commas or blanks: day, month, year (an impossible day-first reading falls back to
    month-first), year first, and month names in any place; a month (number or name) and a year of four digits, which
    mean its first day; a year alone; eight digits ``yyyyMMdd`` or six ``ddMMyy``.
    Two-digit years at or above ``pivot_year`` are moved back one century. ``iso="ymd"``
    reads ``2026-01-05`` as 5 January; ``iso="dayfirst"`` reproduces the day/month swap of
    a day-first reader on ISO text (1 May); either falls back to the other where it is impossible. Dates beyond
    ``FIRST_DATE`` and ``LAST_DATE`` are none. Words for a day (``today``) and quarters are not read.
    """
    if iso not in ("ymd", "dayfirst"):
        raise ValueError("iso must be 'ymd' or 'dayfirst'")
    c = F.trim(F.col(col) if isinstance(col, str) else col)
    pivot = default_pivot_year() if pivot_year is None else pivot_year
    plain = c
    for pattern, to in _AROUND:
        plain = F.regexp_replace(plain, pattern, to)
    # The text is split once: transform binds the parts of the one-element array.
    parts = F.split(F.regexp_replace(plain, r"[\s./,-]+", "-"), "-")

    def numbered(x: Column, digits: str) -> Column:
        return x.rlike(rf"^\d{{{digits}}}$")

    def full_year(z: Column) -> Column:
        near = F.lit(2000) + F.when(numbered(z, "1,2"), z).try_cast("int")
        short = F.when(near >= pivot, near - 100).otherwise(near).cast("string")
        return F.when(numbered(z, "4"), z).when(numbered(z, "1,2"), short)

    def read(p: Column) -> Column:
        x, y, z = (p.getItem(k) for k in range(3))
        number, four = [numbered(v, "1,2") for v in (x, y, z)], [numbered(v, "4") for v in (x, y, z)]
        word = [v.rlike(r"^[A-Za-z]{3,9}$") for v in (x, y, z)]
        year = full_year(z)
        ymd, ydm = _date(x, y, z), _date(x, z, y)
        return (F.when(four[0] & number[1] & number[2], F.coalesce(ydm, ymd) if iso == "dayfirst" else F.coalesce(ymd, ydm))
                 .when(four[0] & word[1] & number[2], _date(x, _month_number(y), z))
                 .when(number[0] & number[1] & year.isNotNull(), F.coalesce(_date(year, y, x), _date(year, x, y)))
                 .when(number[0] & word[1] & year.isNotNull(), _named(year, y, x))
                 .when(word[0] & number[1] & year.isNotNull(), _named(year, x, y)))

    def read_month(p: Column) -> Column:
        x, y = p.getItem(0), p.getItem(1)
        month = lambda v: F.when(numbered(v, "1,2"), v).otherwise(_month_number(v))
        return F.when(numbered(y, "4"), _named(y, x, F.lit("1"), month)).when(numbered(x, "4"), _named(x, y, F.lit("1"), month))

    def read_alone(x: Column) -> Column:
        at = lambda k, n: F.substring(x, k, n)
        year = full_year(at(5, 2))
        return (F.when(numbered(x, "8"), _date(at(1, 4), at(5, 2), at(7, 2)))
                 .when(numbered(x, "6"), F.coalesce(_date(year, at(3, 2), at(1, 2)), _date(year, at(1, 2), at(3, 2))))
                 .when(numbered(x, "4"), _date(x, F.lit("1"), F.lit("1"))))

    found = F.transform(F.array(parts), lambda p: F.when(F.size(p) == 3, read(p)).when(F.size(p) == 2, read_month(p))
                        .when(F.size(p) == 1, read_alone(p.getItem(0)))).getItem(0)
    inside = F.transform(F.array(found), lambda d: F.when(d.between(F.lit(FIRST_DATE).cast("date"), F.lit(LAST_DATE).cast("date")), d))
    return inside.getItem(0)


def _named(year: Column, name: Column, day: Column, number=_month_number) -> Column:
    month = number(name)
    return F.when(month.isNotNull(), _date(year, month, day))


def date_text(col) -> Column:
    """``DD-MM-YYYY``; text that is not a date passes through unchanged."""
    c = F.col(col) if isinstance(col, str) else col
    s = c.cast("string")
    return F.coalesce(F.date_format(F.try_to_timestamp(s, F.lit("yyyy-MM-dd")), "dd-MM-yyyy"), s)


def month_key(col) -> Column:
    """first seven characters of the ISO date."""
    return F.substring((F.col(col) if isinstance(col, str) else col).cast("string"), 1, 7)


def iso_text(col) -> Column:
    """a DATE as ISO text."""
    return F.date_format(F.col(col) if isinstance(col, str) else col, "yyyy-MM-dd")


def timestamp_text(col) -> Column:
    """Python ``str(datetime)``: microseconds shown only when not zero."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd HH:mm:ss")) \
            .otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def stamp_text(col) -> Column:
    """``yyyyMMdd_HHmmss`` used in snapshot folder names."""
    return F.date_format(F.col(col) if isinstance(col, str) else col, "yyyyMMdd_HHmmss")


def same_month(col, as_of) -> Column:
    """same calendar year and month as ``as_of`` (ISO text or a date Column)."""
    c = F.col(col) if isinstance(col, str) else col
    d = as_of if isinstance(as_of, Column) else F.to_date(F.lit(as_of))
    return (F.year(c) == F.year(d)) & (F.month(c) == F.month(d))
