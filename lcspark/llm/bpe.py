"""Byte-level BPE.  A text is split by the pre-tokenizer's pattern; the
pieces are put into matrices by byte length, one padded row each, and in
each round every row merges its leftmost pair of least rank.  Pairs are
looked up in an open-addressing hash table; after a merge a row is compacted
by one place, and rows without a mergeable pair leave the matrix.

Pieces recur, so a worker keeps those it has encoded in a cache of bounded
size.  A piece of over ``LONG_PIECE`` bytes would need as many rounds over as
wide a row; it takes the same merges in the same order from a heap.

Defined cases: null and empty texts have no ids and decode to no bytes;
special-token strings are ordinary text; ids outside the vocabulary raise.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from lcspark.llm.chunks import SLICE_ROWS, ChunkCache, encode_texts, sliced
from lcspark.llm.common import add_columns, parts, ship_package

LONG_PIECE = 512
CACHE_PIECES = 250_000
_INNER_BLANK = re.compile(r"\s \s|\s \Z")
_NONE = np.int32(2 ** 31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines ``base64 rank``, read on the driver (a
    vocabulary is of fixed size) and sent to the tasks from there."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """Hash table (a, b) -> rank of the token they make, linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        todo, rank = np.array(keys, np.int64), np.array(values, np.int32)
        at = self._slot(todo)
        while len(todo):
            free = self.keys[at] == -1
            _, first = np.unique(at, return_index=True)
            wins = np.zeros(len(todo), bool)
            wins[first] = True
            wins &= free
            self.keys[at[wins]], self.values[at[wins]] = todo[wins], rank[wins]
            # the others' slots are taken now; they move on one place, as lookups do
            todo, rank, at = todo[~wins], rank[~wins], (at[~wins] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, a large number where there is none; -1 is padding."""
        key = (a.astype(np.int64) << 32) | b.astype(np.int64)
        key[(a < 0) | (b < 0)] = -2
        at, out = self._slot(key), np.full(key.shape, _NONE, np.int32)
        open_ = np.flatnonzero(key != -2)
        at, key = at.ravel(), key.ravel()
        flat = out.ravel()
        while len(open_):
            found = self.keys[at[open_]]
            hit = found == key[open_]
            flat[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(out.shape)


class BytePairCodec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_pieces: int = CACHE_PIECES):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.pairs = PairTable(ranks)
        self.byte_rank = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.tokens = np.full(max(ranks.values()) + 1, None, object)
        self.tokens[list(ranks.values())] = list(ranks)
        self.pieces = ChunkCache(lambda new: self.encode_pieces(p.encode("utf-8") for p in new), cache_pieces // 2)
        self.chunks = ChunkCache(self._encode_chunks, cache_pieces)      # a blank and a chunk
        self.firsts = ChunkCache(lambda new: self._joined([self.pattern.findall(c) for c in new]), cache_pieces)

    # -- merging ---------------------------------------------------------
    def _merge_matrix(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (32-bit, native) of pieces of similar length."""
        lengths = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), lengths.max()), -1, np.int32)
        ids[np.arange(ids.shape[1]) < lengths[:, None]] = self.byte_rank[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.pairs.lookup(ids[:, :-1], ids[:, 1:])
        rows, done = np.arange(len(pieces)), [b""] * len(pieces)
        while len(rows):
            if not rank.shape[1]:
                merging = np.zeros(len(rows), bool)
            else:
                at = rank.argmin(axis=1)               # argmin takes the leftmost of equals
                least = rank[np.arange(len(rows)), at]
                merging = least != _NONE
            ended = ids[~merging]
            blob, ends = ended[ended >= 0].tobytes(), (np.cumsum((ended >= 0).sum(axis=1)) * 4).tolist()
            for row, start, end in zip(rows[~merging].tolist(), [0, *ends], ends):
                done[row] = blob[start:end]
            if not merging.any():
                break
            rows, ids, rank, at, least = rows[merging], ids[merging], rank[merging], at[merging], least[merging]
            each, n = np.arange(len(rows)), ids.shape[1]
            ids[each, at] = least
            # drop place at + 1 of the ids, and rank at of the pairs
            keep = np.arange(n - 1)
            ids = np.take_along_axis(ids, keep + (keep > at[:, None]), 1)
            keep = keep[:-1]
            rank = np.take_along_axis(rank, keep + (keep >= at[:, None]), 1)
            for left in (at - 1, at):                  # the two pairs that the new token makes
                ok = np.flatnonzero((left >= 0) & (left < n - 2))
                rank[ok, left[ok]] = self.pairs.lookup(ids[ok, left[ok]], ids[ok, left[ok] + 1])
        return done

    def _merge_long(self, piece: bytes) -> bytes:
        """The same merges from a heap of (rank, place) over a linked list."""
        ids = self.byte_rank[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of = lambda a, b: self.ranks.get(self.tokens[a] + self.tokens[b])
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue                               # one of the pair has been merged since
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (new := rank_of(r, ids[after[i]])) is not None:
                    heapq.heappush(heap, (new, i, r, ids[after[i]]))
            if before[i] >= 0 and (new := rank_of(ids[before[i]], r)) is not None:
                heapq.heappush(heap, (new, before[i], ids[before[i]], r))
        return np.array([x for x in ids if x >= 0], np.int32).tobytes()

    def encode_pieces(self, pieces: Iterable[bytes]) -> list[bytes]:
        pieces = list(pieces)
        out = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = np.int32(whole).tobytes()
            elif len(p) > LONG_PIECE:
                out[i] = self._merge_long(p)
            else:                                      # widths 1-16 by themselves, then in steps of a quarter
                step = max(1, 1 << max(0, len(p).bit_length() - 3)) if len(p) > 16 else 1
                by_width.setdefault(-(-len(p) // step) * step, []).append(i)
        for members in by_width.values():
            for i, ids in zip(members, self._merge_matrix([pieces[i] for i in members])):
                out[i] = ids
        return out

    # -- texts -----------------------------------------------------------
    def _joined(self, split: list[list[str]]) -> list[bytes]:
        """Ids of lists of pieces."""
        distinct = list(dict.fromkeys(p for pieces in split for p in pieces))
        ids = dict(zip(distinct, self.pieces.ids(distinct)))
        return [ids[pieces[0]] if len(pieces) == 1 else b"".join([ids[p] for p in pieces]) for pieces in split]

    def _encode_chunks(self, new: list[str]) -> list[bytes]:
        """Ids of a blank and a chunk.  Chunks without white space at their
        ends are matched together: there each begins with the only piece of
        its own that starts with a blank."""
        plain = [bool(c) and not c[0].isspace() and not c[-1].isspace() for c in new]
        pieces = self.pattern.findall(" " + " ".join([c for c, p in zip(new, plain) if p])) if any(plain) else []
        starts = [i for i, p in enumerate(pieces) if p[0] == " "]
        grouped = map(pieces.__getitem__, map(slice, starts, [*starts[1:], len(pieces)]))
        return self._joined([next(grouped) if p else self.pattern.findall(" " + c) for c, p in zip(new, plain)])

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text.  No match of the pattern has a blank but at its
        start or in a run of white space, so a text is cut before each blank
        and its chunks, which recur, are looked up; a text where a blank
        stands inside or at the end of a longer run is matched whole."""
        whole = [i for i, t in enumerate(texts) if _INNER_BLANK.search(t)]
        cut = dict.fromkeys(whole, "")
        out = encode_texts([cut.get(i, t) for i, t in enumerate(texts)] if whole else texts, self.chunks.ids, self.firsts.ids)
        for i in whole:
            out[i] = np.frombuffer(self._joined([self.pattern.findall(texts[i])])[0], np.int32)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.tokens)):
            raise KeyError("an id is outside the vocabulary")
        found = self.tokens[ids].tolist()
        if None in found:
            raise KeyError("an id is not in the vocabulary")
        return b"".join(found)


_CODECS: dict = {}


def _codec(shared) -> BytePairCodec:
    """A worker keeps one codec per vocabulary (a broadcast variable)."""
    if shared not in _CODECS:
        _CODECS.clear()
        _CODECS[shared] = BytePairCodec(*shared.value)
    return _CODECS[shared]


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and ``ids`` array<int>."""
    shared = df.sparkSession.sparkContext.broadcast((ranks, pattern))
    return add_columns(df, text_col, "ids array<int>", lambda texts: [sliced(texts, _codec(shared).encode_texts)], SLICE_ROWS)


def decode(df: DataFrame, ranks: dict[bytes, int], pattern: str, ids_col: str = "ids") -> DataFrame:
    """All columns of ``df`` and ``decoded`` binary."""
    shared = df.sparkSession.sparkContext.broadcast((ranks, pattern))
    ship_package(df.sparkSession)
    kept = df.drop("decoded")

    def run(batches):
        codec = _codec(shared)
        for part in parts(batches):
            lists = part.column(ids_col).fill_null([])
            flat, cuts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy().tolist()
            made = pa.array([codec.decode(flat[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, "decoded"])
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("decoded", BinaryType())]))
