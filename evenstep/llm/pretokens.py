"""Splitting text before byte-level merges, as array operations on code points.

The split is that of the public pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import regex

_LETTER, _NUMBER, _SPACE, _OTHER = 0, 1, 2, 3
# The endings that the pattern takes after an apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def _classes() -> np.ndarray:
    """Class of every code point, from the pattern's own character classes."""
    points = [chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000)]
    every = "".join(points)
    classes = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for run in regex.finditer(pattern, every):
            classes[run.start() : run.end()] = kind
    return classes


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def lower_letters(points: np.ndarray) -> np.ndarray:
    """Letters in lower case; a space for anything else. One code point stays one code point."""
    return _lowered()[points]


@cache
def _lowered() -> np.ndarray:
    table = np.full(0x110000, 32, np.uint32)
    for c in np.flatnonzero(_classes() == _LETTER).tolist():
        low = chr(c).lower()
        table[c] = ord(low) if len(low) == 1 else c
    return table


def boundaries(text: str) -> np.ndarray:
    """Positions in ``text`` where a match of the pattern starts, and the text's length."""
    points = code_points(text)
    n = len(points)
    if not n:
        return np.zeros(1, np.int64)
    kinds = _classes()[points]
    starts = np.empty(n + 1, bool)
    starts[0] = starts[n] = True
    np.not_equal(kinds[1:], kinds[:-1], out=starts[1:n])
    # The last white space of a run before something else is a match's first character: of the next
    # match if it is a plain space, of its own if not.
    last = np.flatnonzero((kinds[:-1] == _SPACE) & (kinds[1:] != _SPACE))
    starts[last] = True
    starts[last[points[last] == 32] + 1] = False
    if "'" in text:
        _split_endings(text, kinds, starts)
    return np.flatnonzero(starts)


def _split_endings(text: str, kinds: np.ndarray, starts: np.ndarray) -> None:
    """Let an apostrophe that begins a match take a known ending, and start anew after it."""
    at = text.find("'")
    while at >= 0:
        if starts[at] and at + 1 < len(kinds) and kinds[at + 1] == _LETTER:
            for ending in _ENDINGS:
                if text.startswith(ending, at + 1):
                    starts[at + 1] = False
                    starts[at + 1 + len(ending)] = True
                    break
        at = text.find("'", at + 1)


def pretokens(text: str) -> list[str]:
    """The pattern's matches in order; together they are the text."""
    cuts = boundaries(text).tolist()
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]
