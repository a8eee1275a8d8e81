"""Vectorised pre-tokenisation for byte-level BPE.

The split rule is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
It is evaluated on whole arrays of code points instead of with a regex engine:
every alternative only looks at runs of one character class, so boundaries are
class changes plus three local corrections (a space joins the run behind it,
the last white space of a run stands alone, contractions take letters from the
run behind the apostrophe).
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: Code points with the Unicode property White_Space.
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

#: Contractions of the split rule, without their apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def char_classes() -> np.ndarray:
    """Class of each code point by Python's Unicode tables, as one byte."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[list(WHITE_SPACE)] = SPACE
    return table


#: Planes in which Unicode assigns nothing.
EMPTY_PLANES = range(4, 14)


@functools.cache
def split_classes() -> np.ndarray:
    """Class of each code point as the tokenizers library's split rule sees it.

    Its Unicode tables may be newer than Python's, so it is asked about all
    code points that Python's don't know.
    """
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    table = char_classes().copy()
    unknown = np.array([c for c in range(0x110000) if c >> 16 not in EMPTY_PLANES and unicodedata.category(chr(c)) == "Cn"])
    text = "".join(map(chr, unknown.tolist()))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for _, (start, stop) in Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            table[unknown[start:stop]] = kind
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def utf8_lengths(points: np.ndarray) -> np.ndarray:
    return (1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64)


def word_starts(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of several texts that lie one after another.

    points: code points of all texts; breaks: the texts' starts, ascending, the
    first 0. A text's end ends each pre-token and each white-space run.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = split_classes()[points]
    first = np.zeros(n, bool)  # of a text
    first[breaks[breaks < n]] = True
    last = np.empty(n, bool)
    last[:-1], last[-1] = first[1:], True
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # The last character of a white-space run that text follows stands alone, or, if U+0020, joins what follows.
    tail = np.zeros(n, bool)
    tail[:-1] = space[:-1] & ~space[1:] & ~last[:-1]
    start |= tail
    joins = np.flatnonzero(tail & (points == 0x20))
    start[joins + 1] = False
    # Contractions: an apostrophe that is a whole run of its own and begins a pre-token.
    marks = np.flatnonzero((points == 0x27) & start)
    if len(marks):
        follow = np.zeros((len(marks), 2), np.uint32)
        for k in (1, 2):
            at = marks + k
            ok = at < n
            at = np.where(ok, at, 0)
            ok &= ~first[at]
            if k == 2:
                ok &= follow[:, 0] > 0
            follow[:, k - 1] = np.where(ok, points[at], 0)
        taken = np.zeros(len(marks), np.int64)
        for word in CONTRACTIONS:
            hit = (taken == 0) & (follow[:, 0] == ord(word[0]))
            if len(word) == 2:
                hit &= follow[:, 1] == ord(word[1])
            taken[hit] = len(word)
        hit = taken > 0
        marks, taken = marks[hit], taken[hit]
        start[marks + 1] = False
        end = marks + 1 + taken
        end = end[end < n]
        # What is left of the letters, or whatever follows, is a new pre-token. A space behind was one already.
        start[end] = True
    return np.flatnonzero(start)
