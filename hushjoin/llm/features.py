"""Text features for the classifiers: a few figures of style and hashed word marks.

Null and empty texts have figures of zero and no marks. Whole texts are read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np

from hushjoin.llm.common import CACHES, WORD

BITS = 0x7FFFFFFF
MEMO = 150_000
STYLE = ("log_words", "upper_words", "bang_words", "bar_words", "symbol_chars", "mark_words", "digit_chars", "distinct_words", "top_word", "same_next", "dup_lines", "repeat_pairs", "mean_word", "long_words", "one_char", "line_words", "letters", "non_ascii", "commas", "stops", "upper_chars")
UPPER, BANG, BAR, TAIL, LONG, ONE = 1, 2, 4, 8, 16, 32
_OUTER = ".,;:!?\"'()[]{}*#%&$|<>"
_SYMBOLS, _DIGITS, _CAPS, _BLANKS = b"#*$%&|<>", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" \t\n\x0b\x0c\r"


_WORD, _FIRST = zlib.crc32(b"w"), [(n, zlib.crc32(b"p%d" % n)) for n in (4, 5, 6, 7)]
_TWICE, _THRICE, _DENSE = 2, 3, 5


def word_marks(word: str) -> list[int]:
    """Hashed marks of a word, in lower case and without outer punctuation: itself, and its first four to seven letters."""
    core = word.lower().strip(_OUTER)
    if not core:
        return []
    raw, crc = core.encode("utf-8", "surrogatepass"), zlib.crc32
    out, size = [crc(raw, _WORD) & BITS], len(core)
    plain = len(raw) == size
    for n, seed in _FIRST:
        if size <= n:
            break
        out.append(crc(raw[:n] if plain else core[:n].encode("utf-8", "surrogatepass"), seed) & BITS)
    return out


def frequent(mark: int) -> tuple[int, int, int]:
    """Further marks of a mark that comes twice, three times, or as one word in sixty."""
    return (mark * 31 + _TWICE) & BITS, (mark * 31 + _THRICE) & BITS, (mark * 31 + _DENSE) & BITS


def needed_for(chosen: np.ndarray) -> set[int]:
    """The marks that are chosen or from which a chosen mark is made: frequent() turned round."""
    back = pow(31, -1, BITS + 1)
    return {m for c in chosen.tolist() for m in (c, *((c - k) * back & BITS for k in (_TWICE, _THRICE, _DENSE)))}


class Marks(dict):
    """Word to its marks; with `only` to those that the chosen marks need, which most words have none of."""

    def __init__(self, only: np.ndarray | None = None):
        super().__init__()
        self.only = None if only is None else needed_for(only)

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > MEMO:
            self.clear()
        marks = word_marks(word)
        if self.only is not None:
            only = self.only
            marks = [m for m in marks if m in only]
        out = self[word] = tuple(marks)
        return out

    def of(self, counts: Counter, n: int) -> np.ndarray:
        """Sorted distinct marks of a text of n words."""
        found: dict[int, int] = {}
        for w, c in counts.items():
            for m in self[w]:
                found[m] = found.get(m, 0) + c
        out = set(found)
        for m, c in found.items():
            if c > 1:
                twice, thrice, dense = frequent(m)
                out.add(twice)
                if c > 2:
                    out.add(thrice)
                if c * 60 >= n:
                    out.add(dense)
        return np.array(sorted(out), np.int32)


class _Kinds(dict):
    """Word to the bits of what is odd about it; 0 for most words."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        tail = word[-1] in "*#%&$|<>"
        kind = UPPER * (word.isupper() and len(word) > 1) | BANG * ("!" in word) | BAR * (word == "|") | TAIL * tail | LONG * (len(word) > 14) | ONE * (len(word) == 1)
        self[word] = kind
        return kind


_kinds = _Kinds()
CACHES.append(_kinds)


def words_of(text: str | None) -> tuple[list[str], Counter]:
    words = WORD.findall(text) if text else []
    return words, Counter(words)


def style_of(text: str | None, words: list[str], counts: Counter) -> list[float]:
    n = len(words)
    if not n:
        return [0.0] * len(STYLE)
    odd: Counter = Counter()
    get = _kinds.__getitem__
    for w, c in counts.items():
        if kind := get(w):
            odd[kind] += c
    upper, bang, bar, tail, long, one = (sum(c for k, c in odd.items() if k & bit) for bit in (UPPER, BANG, BAR, TAIL, LONG, ONE))
    size, raw = len(text), text.encode("utf-8", "surrogatepass")
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    symbols, digits, caps, chars = without(_SYMBOLS), without(_DIGITS), without(_CAPS), size - without(_BLANKS)
    commas, stops = text.count(","), text.count(".")
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    return [
        math.log1p(n), upper / n, bang / n, bar / n, symbols / size, tail / n, digits / size, len(counts) / n**0.85,
        max(counts.values()) / n, sum(map(str.__eq__, words, words[1:])) / n, 1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(zip(words, words[1:]))) / max(1, n - 1),
        chars / n, long / n, one / n, n / max(1, len(lines)), 1 - (symbols + digits + stops + commas + text.count("!")) / chars,
        (len(raw) - size) / size, commas / n, stops / n, caps / size,
    ]


def matrix(rows: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """Dense 0/1 matrix of the chosen marks. columns: sorted marks; rows: sorted marks of each text."""
    out = np.zeros((len(rows), len(columns)), np.float32)
    if len(columns):
        for i, r in enumerate(rows):
            at = np.searchsorted(columns, r)
            at[at == len(columns)] = 0
            out[i, at[columns[at] == r]] = 1
    return out


def informative(rows: list[np.ndarray], target: np.ndarray, least: int, most: int, z: float) -> np.ndarray:
    """Marks whose share differs between target 1 and 0 (weights in between allowed), the clearest first up to most; sorted."""
    n1, n0 = float(target.sum()), float((1 - target).sum())
    if not len(rows) or n1 <= 0 or n0 <= 0:
        return np.empty(0, np.int32)
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if sizes.sum() else np.empty(0, np.int32)
    marks, place = np.unique(flat, return_inverse=True)
    weight = np.repeat(target, sizes)
    c1 = np.bincount(place, weight, len(marks))
    c0 = np.bincount(place, 1 - weight, len(marks))
    both = c1 + c0
    p = both / (n1 + n0)
    score = np.abs(c1 / n1 - c0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    score[both < least] = 0
    top = np.argsort(-score, kind="stable")[:most]
    return np.sort(marks[top[score[top] >= z]]).astype(np.int32)
