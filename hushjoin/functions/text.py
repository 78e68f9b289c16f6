"""String primitives as Column expressions. Patterns carry (?dU): Unicode classes, and only \\n ends a line."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS, FLAGS_I = "(?dU)", "(?dUi)"
BLANK = r"[\s\x1c-\x1f]"

# Letters that do not decompose to plain ones.
TRANSLITERATION = {
    "Æ": "AE", "æ": "ae", "Ð": "D", "ð": "d", "Ø": "O", "ø": "o", "Þ": "TH", "þ": "th", "ß": "ss", "ẞ": "SS",
    "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "ı": "i", "Ĳ": "IJ", "ĳ": "ij", "Ŀ": "L", "ŀ": "l", "Ł": "L",
    "ł": "l", "ŉ": "n", "Ŋ": "NG", "ŋ": "ng", "Œ": "OE", "œ": "oe", "Ŧ": "T", "ŧ": "t", "ſ": "s", "Ƒ": "F",
    "ƒ": "f", "Ǆ": "DZ", "ǅ": "Dz", "ǆ": "dz", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj",
    "Ǳ": "DZ", "ǲ": "Dz", "ǳ": "dz", "Ǽ": "AE", "ǽ": "ae", "Ǿ": "O", "ǿ": "o",
}


def _spelled(pattern: str) -> str:
    """The pattern with \\s standing for all white space: four separators are missing from the engine's own class."""
    kept = {r"[^\s]": r"[^\s\x1c-\x1f]", BLANK: BLANK, r"\s": BLANK}
    return re.sub("|".join(map(re.escape, kept)), lambda m: kept[m[0]], pattern)


def matches(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    return c.rlike((FLAGS_I if ignore_case else FLAGS) + _spelled(pattern))


def swap(c: Column, pattern: str, to: str, ignore_case: bool = False) -> Column:
    return F.regexp_replace(c, (FLAGS_I if ignore_case else FLAGS) + _spelled(pattern), to)


#: All white space: what strip() of a Python string takes off.
BLANKS = "".join(filter(str.isspace, map(chr, range(0x10000))))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def passing(value: Column, test) -> Column:
    """The value, worked out once, where test(value) holds; else null."""
    return F.get(F.filter(F.array(value), test), F.lit(0))


def strip(c: Column) -> Column:
    """Both ends without any Unicode white space."""
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def squeeze_out(c: Column) -> Column:
    """Without any white space."""
    return F.translate(c, BLANKS, "")


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


@cache
def _digits() -> str:
    """All decimal digits beyond ASCII, in runs of 0 to 9."""
    return "".join(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")


def ascii_digits(c: Column) -> Column:
    """Digits of any script as 0 to 9."""
    found = _digits()
    return F.when(is_ascii(c), c).otherwise(F.translate(c, found, "".join(str(unicodedata.digit(d)) for d in found)))


@cache
def _plain_letters() -> tuple[str, str]:
    """Each precomposed letter with the one plain character that is left of it without its marks."""
    source, target = [], []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF or chr(code) in TRANSLITERATION:
            continue
        parts = unicodedata.normalize("NFD", chr(code))
        if parts == chr(code):
            continue
        left = [p for p in parts if not unicodedata.category(p).startswith("M")]
        if len(left) == 1:
            source.append(chr(code))
            target.append(left[0])
    return "".join(source), "".join(target)


def plain(c: Column) -> Column:
    """A stripped value without diacritics. ASCII values take the short way."""
    long = F.expr(f"array({', '.join(f"struct('{k}' AS k, '{v}' AS v)" for k, v in TRANSLITERATION.items() if len(v) > 1)})")
    short = {k: v for k, v in TRANSLITERATION.items() if len(v) == 1}
    source, target = _plain_letters()
    wide = F.aggregate(long, c, lambda x, pair: F.replace(x, pair["k"], pair["v"]))
    wide = F.translate(wide, "".join(short) + source, "".join(short.values()) + target)
    # a syllable block decomposes to more than one character; only their number matters further on
    wide = F.regexp_replace(wide, "[가-힣]", "가")
    return F.when(is_ascii(c), c).otherwise(F.regexp_replace(wide, r"\p{M}", ""))


def _replaced(c: Column, pairs: dict[str, str]) -> Column:
    """Single texts replaced one after the other: on long values faster than translate()."""
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), pairs.items(), c)


def base64_line(c: Column) -> Column:
    """Base64 without line breaks."""
    return _replaced(F.base64(c), {"\r\n": ""})


def base64_url(c: Column) -> Column:
    """Base64 of the URL alphabet, without padding."""
    return _replaced(F.base64(c), {"\r\n": "", "+": "-", "/": "_", "=": ""})


def from_base64_url(c: Column) -> Column:
    """Binary; null if malformed."""
    plain_text = _replaced(c, {"-": "+", "_": "/"})
    padded = F.concat(plain_text, F.repeat(F.lit("="), F.pmod(-F.length(c), F.lit(4))))
    return F.try_to_binary(padded, F.lit("base64"))
