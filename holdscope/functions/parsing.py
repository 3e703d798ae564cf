"""Lenient parsing of landed text: bad input becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdscope.functions.text import strip

_NO_DECIMAL = ("", "-", "null", "None")
_NO_FLOAT = ("", "---", "--")
DATE_FORMATS = ("yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd")


def to_decimal(c: Column, kind: str = "decimal(18,4)") -> Column:
    """Trimmed number text without thousands commas; markers for "no value" are NULL."""
    t = F.replace(strip(c), F.lit(","), F.lit(""))
    return F.when(~t.isin(*_NO_DECIMAL), t.try_cast(kind))


def to_int(c: Column) -> Column:
    """Whole part of a number text."""
    return to_decimal(c, "decimal(28,10)").cast("bigint")


def to_float(c: Column) -> Column:
    """Number text with commas and percent signs dropped."""
    t = F.replace(F.replace(strip(c), F.lit(","), F.lit("")), F.lit("%"), F.lit(""))
    # Trimmed once; other texts for "no value" are no numbers either.
    return F.when(c != "", t.try_cast("double"))


def to_fraction(c: Column) -> Column:
    """``8.5%`` becomes 0.085; a plain number stays."""
    t = F.replace(strip(c), F.lit(","), F.lit(""))
    n = F.replace(t, F.lit("%"), F.lit("")).try_cast("double")
    return F.when(~strip(c).isin(*_NO_FLOAT), F.when(t.contains("%"), n / 100.0).otherwise(n))


def to_date(c: Column, first_ten: bool = True) -> Column:
    """First of the known date formats that fits; empty text, which fits none, is not tried with each.

    ``first_ten`` cuts a longer text such as a timestamp before parsing.
    """
    t = strip(c)
    if first_ten:
        t = F.substring(t, 1, 10)
    return F.when(t != "", F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("date") for f in DATE_FORMATS]))


def to_date_or_today(c: Column, today: Column) -> Column:
    """A date that may also be given as the words ``today`` or ``now``, in any case."""
    return F.when(F.lower(strip(c)).isin("today", "now"), today).otherwise(to_date(c))


def page_number(value: int | None) -> int:
    """Page numbers start at one."""
    return 1 if value is None or value < 1 else value


def page_size(value: int | None, default: int = 25) -> int:
    """A page holds 1 to 200 rows; anything else means the default."""
    return default if value is None or not 1 <= value <= 200 else value


def clamp(c: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
