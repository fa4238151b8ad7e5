"""Money scalars.

Sums are accumulated in DECIMAL and turned into DOUBLE only in the last projection, so
results are exact to the cent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.schemas import MONEY
from .text import py_strip

WIDE = T.DecimalType(38, 2)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


_NUMBER = r"^\s*[+-]?(\d+[.]?\d*|[.]\d+)([eE][+-]?\d+)?\s*$"
_NO_AMOUNT = r"(?i)^\s*[+-]?(inf|infinity|nan)\s*$"  # numbers to a float reader, but no amounts


def _digits(col) -> Column:
    """Number text without the white space around it and the underscores between digits that Python allows."""
    return F.regexp_replace(py_strip(col), r"(?<=\d)_(?=\d)", "")


def parse_amount(col) -> Column:
    """amount text -> DECIMAL(18,2); what is no number (``1,200``) or missing -> 0. A number
    that the column cannot hold also gives 0: see ``amount_out_of_range``, which rejects it."""
    return F.coalesce(_digits(col).try_cast(MONEY), F.lit(0).cast(MONEY))


def amount_readable(col) -> Column:
    """True when the amount text is missing or reads as a number."""
    return _c(col).isNull() | _digits(col).try_cast(MONEY).isNotNull()


def amount_out_of_range(col) -> Column:
    """True for a number that the amount column cannot hold (an insert of it fails)."""
    text = _digits(col)
    number = text.rlike(_NUMBER) | text.rlike(_NO_AMOUNT)
    return F.coalesce(number & text.try_cast(MONEY).isNull(), F.lit(False))


def zero_if_null(col) -> Column:
    return F.coalesce(_c(col), F.lit(0).cast(MONEY))


def sum0(col) -> Column:
    """A1: SUM that gives 0 over no rows or only nulls."""
    return F.coalesce(F.sum(_c(col)), F.lit(0).cast(MONEY))


def to_double(col) -> Column:
    return _c(col).cast("double")


def debit_part(col) -> Column:
    """the positive side of a balance."""
    return F.greatest(_c(col), F.lit(0).cast(MONEY))


def credit_part(col) -> Column:
    """minus the negative side of a balance."""
    return F.greatest(-_c(col), F.lit(0).cast(MONEY))


def fixed2(col) -> Column:
    """two-decimal text, rounded half up from the exact value."""
    return _c(col).cast(WIDE).cast("string")


def balance_label(col) -> Column:
    """``123.45 Dr`` for a balance >= 0, ``123.45 Cr`` below 0."""
    c = _c(col)
    return F.concat(fixed2(F.abs(c)), F.when(c < 0, F.lit(" Cr")).otherwise(F.lit(" Dr")))


def indian_money(col) -> Column:
    """F16: Indian digit groups (last three, then pairs), two decimals, null -> 0.00."""
    text = F.coalesce(_c(col), F.lit(0)).cast(MONEY).cast("string")
    return F.regexp_replace(text, r"(?<=\d)(?=(\d\d)*\d{3}\.)", ",")


def ratio_pct(part, total) -> Column:
    """``part / total * 100`` when total > 0, else 0 (double arithmetic)."""
    p, t = _c(part).cast("double"), _c(total).cast("double")
    return F.when(t > 0, p / t * F.lit(100.0)).otherwise(F.lit(0.0))


def py_float_text(col) -> Column:
    """Python ``str(float)``: the shortest text that reads back, plain from 1e-4 up to 1e16 (``25.0``,
    ``12345678.5``, ``0.0005``), else with an exponent of two digits or more (``1e+16``, ``5e-05``)."""
    x = _c(col).cast("double")
    java = x.cast("string")  # the same digits, with an exponent from 1e7 and below 1e-3
    size = F.abs(x)
    plain = F.regexp_replace(java.try_cast("decimal(38,21)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    digits = F.regexp_replace(F.split(java, "E").getItem(0), r"[.]0$", "")
    power = F.split(java, "E").getItem(1).try_cast("int")
    sign = F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+"))
    power = F.when(F.abs(power) < 10, F.concat(F.lit("0"), F.abs(power).cast("string"))).otherwise(F.abs(power).cast("string"))
    return (F.when(x.isNull(), F.lit(None).cast("string"))
             .when(F.isnan(x), F.lit("nan"))
             .when(size == float("inf"), F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf")))
             .when(~java.contains("E"), java)
             .when((size >= 1e-4) & (size < 1e16), plain)
             .otherwise(F.concat(digits, sign, power)))
