"""Row predicates over a raw value. A null value is never valid."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushjoin.functions import dates
from hushjoin.functions.text import ascii_digits, is_blank, let, matches, strip


def sure(c: Column) -> Column:
    """A predicate with null as false."""
    return F.coalesce(c, F.lit(False))


def not_blank(c: Column) -> Column:
    return ~is_blank(c)


def not_in(c: Column, values) -> Column:
    """Ignoring case, without stripping."""
    return sure(~F.lower(c).isin(sorted({v.lower() for v in values})))


def not_starts_with(c: Column, prefixes) -> Column:
    return sure(~matches(strip(c), rf"\A(?:{'|'.join(map(re.escape, prefixes))})"))


def regex(c: Column, pattern: str) -> Column:
    """The pattern matches from the start of the value."""
    return sure(matches(c, rf"\A(?:{pattern})"))


def in_days(d: Column, first: str | None = None, last: str | None = None, until_today: bool = False) -> Column:
    """Whether a date is in the range; both ends belong to it."""
    ok = d.isNotNull()
    if first:
        ok = ok & (d >= F.lit(first).cast("date"))
    if until_today:
        ok = ok & (d <= F.current_date())
    elif last:
        ok = ok & (d <= F.lit(last).cast("date"))
    return ok


def date_range(c: Column, first: str | None = None, last: str | None = None, until_today: bool = False) -> Column:
    return sure(let(dates.parse(c), lambda d: in_days(d, first, last, until_today)))


def in_numbers(n: Column, low: int, high: Column | int) -> Column:
    """Whether a whole number, as text, is in the range."""
    return n.try_cast("decimal(38,0)").between(F.lit(low), high if isinstance(high, Column) else F.lit(high))


def number_range(c: Column, low: int, high: Column | int) -> Column:
    return sure(matches(c, r"^\s*[+-]?\d+\s*$") & in_numbers(ascii_digits(strip(c)), low, high))


def born(n: Column) -> Column:
    return in_numbers(n, 1910, F.year(F.current_date()))


def aged(n: Column) -> Column:
    return in_numbers(n, 0, 120)


def year_range(c: Column) -> Column:
    return number_range(c, 1910, F.year(F.current_date()))


def age_range(c: Column) -> Column:
    return number_range(c, 0, 120)


def any_of(*tests: Column) -> Column:
    return sure(reduce(lambda a, b: a | b, tests))
