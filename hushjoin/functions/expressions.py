"""The attribute-expression language: steps parted by |, compiled to Columns on the driver.

T strips, U upper-cases, S(a,b) cuts like a slice, R('x','y') replaces text, M(regex) keeps all matches, D writes a
date as yyyy-MM-dd. Wrong steps raise ValueError here, when the expression is compiled; a value that D cannot read
gives null.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushjoin.functions.text import is_blank, matches, strip

_STEP = re.compile(r"\s*([^ (]+)(?:\(([^)]+)\))?")


def _bad(step: str) -> ValueError:
    return ValueError(f"Unable to evaluate expression [{step}]")


def _slice(c: Column, a: int, b: int) -> Column:
    a = max(0, a)
    if b >= 0:
        return F.substring(c, a + 1, max(0, b - a))
    return F.substring(c, F.lit(a + 1), F.greatest(F.lit(0), F.length(c) + F.lit(b - a)))


def _date(c: Column) -> Column:
    parts = F.split(c, "-")
    text = F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    d = F.when(matches(c, r"\A\d{4}-\d{1,2}-\d{1,2}\z") & ~c.startswith("0000"), F.try_to_date(text, "yyyy-MM-dd"))
    return F.concat(F.year(d).cast("string"), F.date_format(d, "-MM-dd"))


def _step(c: Column, step: str) -> Column:
    m = _STEP.match(step)
    op, args = m[1].upper(), m[2].split(",") if m[2] else []
    if op == "T":
        return strip(c)
    if op == "U":
        return F.upper(c)
    if op == "D":
        return _date(c)
    if op == "S":
        return _slice(c, *map(int, args))
    if op == "R":
        return F.replace(c, F.lit(args[0][1:-1]), F.lit(args[1][1:-1]))
    return F.array_join(F.regexp_extract_all(c, F.lit("(?dU)" + args[0]), F.lit(re.compile(args[0]).groups)), "")


def _steps(expression: str | None) -> list[str]:
    found = expression.split("|") if expression and expression.strip() else []
    for s in found:
        _check(s)
    return found


def compile_expression(expression: str | None):
    """Column to Column. Null and blank values become the empty text; a blank expression changes nothing else."""
    steps = _steps(expression)

    def apply(c: Column) -> Column:
        return F.when(is_blank(c), F.lit("")).otherwise(reduce(_step, steps, c))

    return apply


def compile_settled(expression: str | None, settled: str):
    """compile_expression() for values that are never blank: null stays null, and leading steps among `settled` change nothing."""
    steps = _steps(expression)
    while steps and _STEP.match(steps[0])[1].upper() in settled:
        steps.pop(0)
    return lambda c: reduce(_step, steps, c)


def _check(step: str) -> None:
    """Raise for a wrong step without a session."""
    m = _STEP.match(step)
    if not m or m[1].upper() not in "TUDSRM" or len(m[1]) != 1:
        raise _bad(step)
    args = m[2].split(",") if m[2] else []
    op = m[1].upper()
    if op == "S":
        try:
            _a, _b = map(int, args)
        except ValueError as e:
            raise _bad(step) from e
    if op == "R" and (len(args) != 2 or min(map(len, args)) < 2):
        raise _bad(step)
    if op == "M":
        try:
            ok = len(args) == 1 and re.compile(args[0]).groups < 2
        except re.error as e:
            raise _bad(step) from e
        if not ok:
            raise _bad(step)


HELP = """Steps, parted by |
T            strip white space
U            upper case
S(from,to)   part of the text, from 0, end left out
D            date as yyyy-MM-dd
M(regex)     all matches, joined
R('x','y')   replace x by y
Examples: T|U   T|S(0,3)|U   T|D   T|M(\\d+)
"""


def expression_help() -> str:
    return HELP
