"""Whole texts as numpy arrays of code points, cut into words of letters:
the vectorised base of the text models.  Runs inside Spark tasks on slices
of a partition."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np

# Code points of the texts of one slice (a longer text is a slice by itself).
SLICE_CHARS = 1_000_000


class Words(NamedTuple):
    """Words of a slice in order.  chars: lower-cased code points with a 0
    before each text and at the end; letters: positions of letters in chars;
    starts: first letter of each word, as an index into letters; doc: text
    number of each word; text_at: position in chars where each text begins."""
    chars: np.ndarray
    letters: np.ndarray
    starts: np.ndarray
    doc: np.ndarray
    text_at: np.ndarray

    def lengths(self) -> np.ndarray:
        return np.diff(np.append(self.starts, len(self.letters)))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: is it part of a word (letter or mark), is it a
    mark, and its lower case where that is one code point."""
    is_letter, is_mark = np.zeros(sys.maxunicode + 1, bool), np.zeros(sys.maxunicode + 1, bool)
    lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if (kind := unicodedata.category(c)[0]) in "LM":
            is_letter[i], is_mark[i] = True, kind == "M"
            small = c.lower()
            if len(small) == 1:
                lower[i] = ord(small)
    return is_letter, is_mark, lower


def slices(texts: Sequence[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(from, to) ranges of texts of at most ``most`` code points, one text at least."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if i > first and total + len(t) > most:
            yield first, i
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)


def letter_words(texts: Sequence[str]) -> Words:
    """Runs of letters and marks with one letter at least (the marks of an
    emoji or a keycap are no word)."""
    is_letter, is_mark, lower = _tables()
    joined = "\0" + "\0".join(texts) + "\0"
    chars = lower[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    text_at = np.cumsum([1, *[len(t) + 1 for t in texts]])[:-1]
    letters = np.flatnonzero(is_letter[chars])
    starts = np.flatnonzero(np.diff(letters, prepend=-2) > 1)
    marks = is_mark[chars[letters]]
    if marks.any():
        lengths = np.diff(np.append(starts, len(letters)))
        words = ~np.logical_and.reduceat(marks, starts)
        letters, lengths = letters[np.repeat(words, lengths)], lengths[words]
        starts = np.cumsum(lengths) - lengths
    doc = np.searchsorted(text_at, letters[starts], "right") - 1
    return Words(chars, letters, starts, doc, text_at)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (unsigned, wraps)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def segment_hash(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of ``values`` that begins at ``starts``: a
    polynomial in an odd multiplier, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = np.diff(np.append(starts, len(values)))
    place = np.arange(len(values)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
    return mix(np.add.reduceat((values.astype(np.uint64) + np.uint64(1)) * powers[place], starts))
