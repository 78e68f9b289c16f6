"""Dates that are parsed from the accepted text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushjoin.functions.text import ascii_digits, passing, strip, swap

# Fixed pattern: the shapes a date may have.
SHAPE = r"^(?:\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[-./]\d{2}[-./]\d{4}|\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{3})?(?:Z|[+-]\d{2}:\d{2})?)$"

_YEAR, _MONTH, _DAY = r"(\d{4})", "(1[0-2]|0[1-9])", r"(3[01]|[12]\d|0[1-9])"
_TIME = r"T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d{1,6})?(?:Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)"
#: Each form with its own groups: year month day, month day year, day month year; anything else becomes "--".
_FORMS = (
    rf"\A(?:{_YEAR}-{_MONTH}-{_DAY}(?:{_TIME})?|{_YEAR}/{_MONTH}/{_DAY}|{_MONTH}([-/]){_DAY}\8{_YEAR}|{_DAY}\.{_MONTH}\.{_YEAR})\z" + r"|\A(?s:.*)\z"
)
_ISO = "$1$4$10$13-$2$5$7$12-$3$6$9$11"


def parse(c: Column) -> Column:
    """Date of a stripped value, null if no form fits. A timestamp needs a zone, and keeps its local day. Years begin at 1."""
    text = ascii_digits(swap(strip(c), _FORMS, _ISO))
    return passing(text.try_cast("date"), lambda d: d >= F.lit("0001-01-01").cast("date"))


def iso(d: Column) -> Column:
    """Year-month-day; years under 1000 are written without leading zeros."""
    return F.ltrim(d.cast("string"), F.lit("0"))
