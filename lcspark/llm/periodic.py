"""Periodic runs of words, by block convolution.

A run is a stretch of words with smallest period q (words q apart are the
same), at least ``max(MIN_LENGTH, 3 q)`` long, that no neighbouring word
extends.  Periods q from B to 2B - 1 are searched at scale B = 8, 16, 32, ...
(those below 8 at scale 8, too): the text is cut into blocks of B words, and
a run of such a period holds a whole block and the block's next occurrence q
words on.  Words become numbers, and for every shift q of its scale the sum
of squared differences of a block and the words q on is

    sum x^2 + sum y^2 - 2 sum x y,

the last by a number-theoretic transform modulo a prime that is larger than
the whole sum, so it is exact, and zero where the block occurs again.  The
transforms of all blocks of a scale and slice are made together; a window of
two blocks has the transform of its blocks, the second times (-1)^k, so each
block is transformed once.  Each zero is a seed: a block and a distance.
Seeds are extended to both sides on the words themselves, which also settles
the rare case that different words got equal numbers.

A text's work grows as its length times the square of that length's
logarithm; every text is searched whole, at all its scales.

Defined cases: a null or empty text, or one of white space, has no words and
no runs; rows are searched each for itself, repeated or without id; columns
of the input named as new ones are replaced, others kept; an empty table
gives no rows.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lcspark.llm.common import add_columns
from lcspark.llm.textvec import mix, slices

MIN_LENGTH, MIN_PERIODS, FIRST_BLOCK = 24, 3, 8
# 15 * 2^27 + 1: transforms of up to 2^27 numbers; 31 generates its units.
PRIME, GENERATOR = 2013265921, 31
_P = np.uint64(PRIME)
# Numbers transformed at a time (a longer transform is made by itself).
BATCH_NUMBERS = 1 << 16


# -- transform modulo PRIME ------------------------------------------------
def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME (division by a constant is vectorised, remainder isn't)."""
    x -= x // _P * _P
    return x


@lru_cache(maxsize=64)
def _roots(n: int, inverse: bool) -> np.ndarray:
    """Powers 0 to n/2 - 1 of an n-th root of unity."""
    root = pow(GENERATOR, (PRIME - 1) // n, PRIME)
    if inverse:
        root = pow(root, -1, PRIME)
    powers = np.ones(max(1, n // 2), np.uint64)
    have = 1
    while have < len(powers):
        powers[have:2 * have] = _reduced(powers[:have] * np.uint64(pow(root, have, PRIME)))
        have *= 2
    return powers


def transform(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform along the last axis (a power of two),
    values below PRIME; the inverse isn't divided by its length.  Stockham's
    order: each step halves one axis and doubles another, without reordering."""
    n = x.shape[-1]
    rows = x.size // n
    roots = _roots(n, inverse)
    x = x.reshape(rows, n, 1)
    while x.shape[1] > 1:
        half, done = x.shape[1] // 2, x.shape[2]
        a, b = x[:, :half], x[:, half:]
        out = np.empty((rows, half, 2, done), np.uint64)
        total = np.add(a, b, out=out[:, :, 0])
        total -= (total >= _P) * _P
        gap = (a + (_P - b)) * roots[::done][:half, None]
        out[:, :, 1] = _reduced(gap)
        x = out.reshape(rows, half, 2 * done)
    return x.reshape(rows, n)


def block_distances(x: np.ndarray, block: int, first: int) -> np.ndarray:
    """x: [blocks + 2, block] numbers, consecutive blocks of a text (or of
    several).  [blocks, block] sums of squared differences of each block and
    the words ``first * block`` + 0 .. block - 1 after its start (first 0 or 1)."""
    blocks = len(x) - 2
    spectrum = transform(np.concatenate([x, np.zeros_like(x)], axis=1))
    window = spectrum[1 + first:][:blocks].copy()            # the second block of each window, times (-1)^k
    window[:, 1::2] = _P - window[:, 1::2]
    window += spectrum[first:][:blocks]
    reverse = np.concatenate([spectrum[:blocks, :1], spectrum[:blocks, :0:-1]], axis=1)    # transform of the block reversed
    product = _reduced(_reduced(window) * reverse)
    inner = transform(product, inverse=True)[:, :block]
    inner = _reduced(inner * np.uint64(2 * pow(2 * block, -1, PRIME) % PRIME))             # twice the inner product
    squares = np.cumsum(np.concatenate([np.zeros((len(x), 1), np.uint64), x * x], axis=1), axis=1)
    whole = squares[:, -1]
    # squares of the words shift .. shift + block - 1 after the window's start
    of_window = (whole[first:][:blocks, None] - squares[first:][:blocks, :-1] + squares[first + 1:][:blocks, :-1])
    return _reduced(whole[:blocks, None] + of_window + (_P - inner))


# -- runs of texts -----------------------------------------------------------
def word_numbers(words: list[bytes]) -> np.ndarray:
    """Each word's number in the order of first occurrence."""
    known: dict[bytes, int] = {}
    fresh = count()
    return np.array([known[w] if w in known else known.setdefault(w, next(fresh)) for w in words], np.int64)


def _seeds(texts: list[np.ndarray], block: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(text, starts, distances) of zero sums at one scale, by distance, then start."""
    least = 1 if block == FIRST_BLOCK else block
    chosen = [i for i, t in enumerate(texts) if len(t) >= max(MIN_LENGTH, MIN_PERIODS * least)]
    most = int((PRIME / block) ** 0.5)                       # numbers 0 .. most - 1: the sum stays below PRIME
    per_batch = max(1, BATCH_NUMBERS // block)
    out = []
    group: list[int] = []
    rows = 0

    def flush():
        # a text's blocks, then two blocks of padding
        cells = [-(-len(texts[i]) // block) + 2 for i in group]
        at = np.concatenate([[0], np.cumsum(cells)])
        numbers = np.zeros(int(at[-1]) * block, np.uint64)
        for i, first in zip(group, at[:-1] * block):
            coded = mix(texts[i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(block))
            numbers[first:first + len(coded)] = coded % np.uint64(most)
        numbers = numbers.reshape(-1, block)
        found: list[list] = [[] for _ in group]
        for lo in range(0, len(numbers) - 2, per_batch):
            part = numbers[lo:lo + per_batch + 2]
            for first in ((0, 1) if block == FIRST_BLOCK else (1,)):
                row, shift = np.nonzero(block_distances(part, block, first) == 0)
                row, distance = row + lo, shift + first * block
                which = np.searchsorted(at, row, "right") - 1
                start = (row - at[which]) * block
                real = (distance > 0) & (start + block + distance <= np.array([len(texts[i]) for i in group])[which])
                for g in np.unique(which[real]):
                    mine = real & (which == g)
                    found[g].append((start[mine], distance[mine]))
        for i, f in zip(group, found):
            if f:
                start, distance = (np.concatenate(c) for c in zip(*f))
                order = np.lexsort((start, distance))
                out.append((i, start[order], distance[order]))

    for i in chosen:
        if group and rows + len(texts[i]) > BATCH_NUMBERS:
            flush()
            group, rows = [], 0
        group.append(i)
        rows += len(texts[i]) + 2 * block
    if group:
        flush()
    return out


def _first_false(same, begin: int, end: int) -> int:
    """The first position of begin .. end - 1 where ``same(lo, hi)``, a Boolean
    array, is false; ``end`` if it is nowhere.  Looks at twice as much each time."""
    step = 64
    while begin < end:
        upto = min(end, begin + step)
        hits = same(begin, upto)
        if not hits.all():
            return begin + int(hits.argmin())
        begin, step = upto, 2 * step
    return end


def _extended(x: np.ndarray, start: int, block: int, q: int) -> tuple[int, int]:
    """The stretch of period q around a block and its next occurrence: from, to
    (exclusive); empty if the words differ after all."""
    if not np.array_equal(x[start:start + block], x[start + q:start + q + block]):
        return start, start
    right = _first_false(lambda lo, hi: x[lo:hi] == x[lo + q:hi + q], start + block, len(x) - q)

    def backwards(lo, hi):                                   # lo, hi count back from start - 1
        left = x[start - hi:start - lo]
        return (left == x[start - hi + q:start - lo + q])[::-1]
    return start - _first_false(backwards, 0, start), right + q


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text of word numbers, by
    start, then period."""
    runs: list[dict[tuple[int, int], int]] = [{} for _ in texts]      # (from, to) -> smallest period
    cover: dict[int, tuple[np.ndarray, np.ndarray]] = {}              # text -> end and period of the run around a word
    longest = max(map(len, texts), default=0)
    block = FIRST_BLOCK
    while MIN_PERIODS * (1 if block == FIRST_BLOCK else block) <= longest and longest >= MIN_LENGTH:
        for i, starts, distances in _seeds(texts, block):
            x = texts[i]
            if i not in cover:
                cover[i] = np.zeros(len(x), np.int64), np.ones(len(x), np.int64)
            end, period = cover[i]
            edges = np.flatnonzero(np.diff(distances, prepend=0, append=-1))
            for lo, hi in zip(edges[:-1], edges[1:]):
                q = int(distances[lo])
                # seeds within a run whose period divides q lead to that run again
                at = starts[lo:hi]
                at = at[~((end[at] >= at + block + q) & (q % period[at] == 0))]
                n = 0
                while n < len(at):
                    first, last = _extended(x, int(at[n]), block, q)
                    if last - first >= max(MIN_LENGTH, MIN_PERIODS * q) and (first, last) not in runs[i]:
                        runs[i][first, last] = q
                        further = end[first:last] < last
                        end[first:last][further] = last
                        period[first:last][further] = q
                    # the same stretch takes in all seeds up to its end
                    n = max(n + 1, int(np.searchsorted(at, last - block - q, "right")))
        block *= 2
    return [sorted((a, b - a, q) for (a, b), q in found.items()) for found in runs]


def collapsed_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: of each run only its first period does."""
    gone = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    return np.cumsum(gone[:-1]) == 0


def with_runs(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``df``, then n_words, runs (array of start, length,
    period, by start, then period) and collapsed (the text's words without
    the repetitions of its runs, joined by one space)."""
    def compute(texts: list[str]) -> list[list]:
        n_words, runs, collapsed = [], [], []
        for a, b in slices(texts):
            # bytes.split() cuts at the white space of the word rule
            words = [t.encode("utf-8", "surrogatepass").split() for t in texts[a:b]]
            found = find_runs([word_numbers(w) for w in words])
            for w, f in zip(words, found):
                stay = [w[i] for i in np.flatnonzero(collapsed_words(len(w), f))] if f else w
                n_words.append(len(w))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in f])
                collapsed.append(b" ".join(stay).decode("utf-8", "surrogatepass"))
        return [n_words, runs, collapsed]
    return add_columns(df, text_col, "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, "
                                     "collapsed string", compute)


def most_periodic(runs: Column) -> Column:
    """The run of the greatest exact length / period; ties: least start, then
    period.  Null without runs."""
    def order(a: Column, b: Column) -> Column:
        more = b["length"] * a["period"] - a["length"] * b["period"]
        return F.when(more != 0, F.signum(more)).when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(
            F.signum(a["period"] - b["period"])).cast("int")
    return F.try_element_at(F.array_sort(runs, order), F.lit(1))
