"""Best-fit packing of token sequences by exact complements.

Texts are tokenized where they are read; only their pieces' lengths go on.
The plan is made from the histogram of lengths (at most ``capacity`` numbers,
whatever the input's size): for each length from the longest down, the gap
it leaves is looked up in an index of single lengths, pair sums and triple
sums, and combinations that fill it exactly are consumed, as many at once as
the counts allow; what is left is packed best-fit in decreasing order.  The
plan says, for the n-th piece of each length, its sequence and place; pieces
get their n by ranks within cells of bounded size, so neither a length that
a third of all pieces have nor any other group meets in one task.

Defined cases: null and empty texts are documents of the end token alone;
repeated rows are packed each for itself; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lcspark.llm.chunks import ChunkCache, gathered, picked
from lcspark.llm.common import freed, ship_package, staged

CAPACITY = 4096
END_TOKEN = 1
# Pieces of one length that are ranked in one group.
CELL_ROWS = 50_000
CACHE_CHUNKS = 200_000
# Bytes of the texts whose chunks are told apart together (the more, the
# fewer are looked up twice), and of those whose ids are held at a time.
SLICE_BYTES, GATHERED_BYTES = 4_000_000, 500_000
# Parts that the tokenizer gets at a time: it holds about 1 KB for each.
PARTS_ENCODED = 4000
# Marks that end a word; the tokenizer takes a run of them by itself.
_MARKS = ".,;:!?"


class ChunkTokenizer:
    """Ids of whole texts.  The tokenizer never joins across a blank or a
    line feed, so a text's ids are those of its chunks between them.  Nor
    does it join letters with the marks after them, and it lower-cases, so a
    chunk's ids are those of its letters, in lower case, and of its marks.
    Arrow splits a slice of texts and tells the distinct chunks and their
    parts; only parts come up as Python strings, once a slice, and their ids
    are kept in a cache of bounded size."""

    def __init__(self, definition: str, cache_chunks: int = CACHE_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True   # their strings in a text are ordinary text
        suffix = json.loads(definition)["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.parts = ChunkCache(self._encode_parts, cache_chunks)

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Words of letters, encoded as one text: each ends with its only id
        that ends a word.  Nothing if one of them has several."""
        if not words or self.ends is None:
            return {}
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        return dict(zip(words, self._cut(ids, cuts))) if len(cuts) == len(words) else {}

    def _encode_parts(self, new: list[str]) -> list[bytes]:
        """Words of letters are encoded as a text, other parts as a list."""
        blobs: dict[str, bytes] = {}
        for plain in (True, False):                   # lower case may cut words that aren't ASCII
            words = [p for p in new if p.isascii() is plain and p.isalpha()]
            for at in range(0, len(words), PARTS_ENCODED):
                blobs.update(self._encode_words(words[at:at + PARTS_ENCODED]))
        others = [p for p in new if p not in blobs]
        for at in range(0, len(others), PARTS_ENCODED):
            some = others[at:at + PARTS_ENCODED]
            made = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            of = np.array([-1 if w is None else w for w in made.word_ids], np.int64)
            blobs.update(zip(some, self._cut(np.array(made.ids, "<u4"), np.searchsorted(of, np.arange(len(some)) + 1))))
        return [blobs[p] for p in new]

    @staticmethod
    def _cut(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        blob, cuts = ids.tobytes(), (4 * ends).tolist()
        return [blob[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]

    def _encode_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks one after another, and where each begins
        (and the end).  Anything but letters and marks after them is one part."""
        words = pc.ascii_rtrim(chunks, characters=_MARKS)
        plain = pc.string_is_ascii(words)
        letters = pc.and_(plain, pc.ascii_is_alpha(words)).to_numpy(zero_copy_only=False).copy()
        other = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        letters[other] = [w.isalpha() for w in _strings(words.take(pa.array(other)))]
        parts = pc.if_else(pa.array(letters), pc.if_else(plain, pc.ascii_lower(words), words), chunks).dictionary_encode()
        marked = np.flatnonzero(letters & (pc.binary_length(chunks).to_numpy() > pc.binary_length(words).to_numpy()))
        at = pa.array(marked)
        ends = pa.array([c[len(w):] for c, w in zip(_strings(chunks.take(at)), _strings(words.take(at)))], pa.string()).dictionary_encode()
        blobs = [*self.parts.ids(_strings(parts.dictionary)), *self.parts.ids(_strings(ends.dictionary)), b""]
        order = np.full(2 * len(chunks), len(blobs) - 1)
        order[0::2] = parts.indices.to_numpy()
        order[2 * marked + 1] = ends.indices.to_numpy() + len(parts.dictionary)
        flat, places = gathered(blobs, order)
        return flat, places[::2]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, by slices of ``SLICE_BYTES``."""
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        for some in _runs(sizes, SLICE_BYTES):
            lists = pc.split_pattern(pc.replace_substring(texts[some.start:some.stop].cast(pa.large_string()), "\n", " "), " ")
            cuts, coded = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
            flat, places = self._encode_chunks(coded.dictionary)
            at = coded.indices.to_numpy()
            for few in _runs(sizes[some.start:some.stop], GATHERED_BYTES):
                first, last = cuts[few.start], cuts[few.stop]
                ids, where = picked(flat, places, at[first:last])
                ends = where[cuts[few.start:few.stop + 1] - first].tolist()
                yield from (ids[a:b] for a, b in zip(ends[:-1], ends[1:]))

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        return list(self.encode(pa.array(texts, pa.large_string())))


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


def _runs(sizes: np.ndarray, most: int) -> Iterator[range]:
    """Runs of texts of at most ``most`` bytes, one text at least."""
    sums, first = np.cumsum(sizes, dtype=np.int64), 0
    while first < len(sums):
        last = max(first + 1, int(np.searchsorted(sums, sums[first] - sizes[first] + most, "right")))
        yield range(first, last)
        first = last


_TOKENIZERS: dict = {}


def _tokenizer(shared) -> ChunkTokenizer:
    if shared not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[shared] = ChunkTokenizer(shared.value)
    return _TOKENIZERS[shared]


_PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint"


def tokenize(df: DataFrame, definition: str, capacity: int = CAPACITY, end_token: int = END_TOKEN,
             id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids, array<bigint>, with
    ``with_ids``): the documents' ids and end token, cut after every
    ``capacity`` ids.  ``definition`` is the tokenizer's JSON."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(definition)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    end, width = np.array([end_token], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in freed(batches):
            made: list[tuple] = []
            for key, found in zip(part.column("id").to_pylist(), _tokenizer(shared).encode(pc.fill_null(part.column("text"), ""))):
                ids = found.tobytes() + end
                for at in range(0, len(ids), width):
                    cut = ids[at:at + width]
                    made.append((key, at // width, at // 4, len(cut) // 4, zlib.crc32(cut),
                                 *([np.frombuffer(cut, "<u4").tolist()] if with_ids else [])))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
            columns = list(zip(*made)) if made else [()] * (6 if with_ids else 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names[:len(columns)])
    return rows.mapInArrow(run, f"id bigint, {_PIECE}" + (", ids array<bigint>" if with_ids else ""))


class Plan:
    """Entries: pieces number first_unit to first_unit + units - 1 of a
    length; the u-th of them goes to sequence first_bin + u // per_bin, at
    place offset + (u % per_bin) * length."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity, self.left = capacity, counts.astype(np.int64).copy()
        self.used, self.bins, self.entries = np.zeros_like(self.left), 0, []
        self._exact()
        self._best_fit()
        table = np.array(self.entries, np.int64).reshape(-1, 6)
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        self.length, self.first_unit, _, self.first_bin, self.per_bin, self.offset = table.T
        self.key = (self.length << 44) + self.first_unit

    def _place(self, length: int, units: int, first_bin: int, per_bin: int, offset: int) -> None:
        self.entries.append((length, self.used[length], units, first_bin, per_bin, offset))
        self.used[length] += units
        self.left[length] -= units

    @staticmethod
    def _pair(left: np.ndarray, total: int) -> list[int] | None:
        """Two available lengths of the given sum, the most unequal ones."""
        if total < 2:
            return None
        small = np.arange(1, total // 2 + 1)
        ok = (left[small] > 0) & (left[total - small] > 0)
        if total % 2 == 0 and left[total // 2] < 2:
            ok[-1] = False
        found = int(ok.argmax())
        return [total - found - 1, found + 1] if ok[found] else None

    def _complement(self, length: int) -> list[int] | None:
        """Available lengths, three at most, that fill the gap of ``length`` exactly."""
        gap, left = self.capacity - length, self.left.copy()
        left[length] -= 1
        if gap == 0:
            return []
        if left[gap] > 0:
            return [gap]
        if found := self._pair(left, gap):
            return found
        # lengths whose rest may be a pair's sum: the pair sums are the lengths' self-convolution
        there = (left[:gap] > 0).astype(float)
        spectrum = np.fft.rfft(there, 2 * gap)
        sums = np.fft.irfft(spectrum * spectrum, 2 * gap)[:gap + 1] > 0.5
        third = np.arange(gap)
        for third in third[(there > 0) & sums[gap - third]][::-1]:
            left[third] -= 1
            if found := self._pair(left, gap - int(third)):
                return [int(third), *found]
            left[third] += 1
        return None

    def _exact(self) -> None:
        for length in range(self.capacity, 0, -1):
            while self.left[length] > 0 and (rest := self._complement(length)) is not None:
                parts = [length, *rest]
                copies = int(min(self.left[p] // parts.count(p) for p in parts))
                offset = 0
                for p in parts:
                    self._place(p, copies, self.bins, 1, offset)
                    offset += p
                self.bins += copies

    def _best_fit(self) -> None:
        """Decreasing lengths into the fullest sequences that still take them;
        sequences of equal space are handled as one run of numbers."""
        space: list[list[tuple[int, int]]] = [[] for _ in range(self.capacity + 1)]   # by space: (first_bin, bins)
        filled = np.zeros(self.capacity + 1, bool)
        for length in range(self.capacity, 0, -1):
            while self.left[length] > 0:
                todo = int(self.left[length])
                fits = np.flatnonzero(filled[length:])
                room = length + int(fits[0]) if len(fits) else self.capacity
                per_bin = room // length
                if len(fits):
                    first, bins = space[room].pop()
                else:
                    first, bins = self.bins, max(1, todo // per_bin)
                    self.bins += bins
                whole = min(bins, todo // per_bin)
                if whole == 0:                        # fewer than one sequence takes
                    whole, per_bin = 1, todo
                self._place(length, whole * per_bin, first, per_bin, self.capacity - room)
                space[room - per_bin * length].append((first, whole))
                filled[room - per_bin * length] = True
                if whole < bins:
                    space[room].append((first + whole, bins - whole))
                filled[room] = bool(space[room])

    def locate(self, length: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the unit-th piece of each length."""
        at = np.searchsorted(self.key, (length << 44) + unit, "right") - 1
        n = unit - self.first_unit[at]
        return self.first_bin[at] + n // self.per_bin[at], self.offset[at] + n % self.per_bin[at] * length


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (id, piece, length and more; read more than once, so
    stored) with sequence_id and offset."""
    spark = pieces.sparkSession
    ship_package(spark)
    found = pieces.groupBy("length").count().collect()          # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for row in found:
        counts[row["length"]] = row["count"]
    plan = spark.sparkContext.broadcast(Plan(counts, capacity))
    # an Arrow table: a list of rows would go through Python workers of another kind, kept beside the others
    cells_of = spark.createDataFrame(pa.table({"length": pa.array([r["length"] for r in found], pa.int64()),
                                               "cells": pa.array([-(-r["count"] // CELL_ROWS) for r in found], pa.int64())}))
    celled = pieces.join(F.broadcast(cells_of), "length").withColumn(
        "cell", F.pmod(F.xxhash64("id", "piece"), "cells")).drop("cells")
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (celled.groupBy("length", "cell").count()
              .select("length", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")))
    in_cell = Window.partitionBy("length", "cell").orderBy("id", "piece")
    ranked = (celled.withColumn("rank", F.row_number().over(in_cell) - 1).join(firsts, ["length", "cell"])
              .withColumn("unit", (F.col("first") + F.col("rank")).cast("bigint")).drop("cell", "first", "rank"))
    kept = ranked.drop("sequence_id", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.value.locate(batch.column("length").to_numpy(), batch.column("unit").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(offset)],
                                             [*batch.schema.names, "sequence_id", "offset"])
    placed = [StructField(name, LongType()) for name in ("sequence_id", "offset")]
    return kept.mapInArrow(run, StructType([*kept.schema.fields, *placed])).drop("unit")


def pack_documents(df: DataFrame, definition: str, capacity: int = CAPACITY, end_token: int = END_TOKEN,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize and pack: id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(staged(tokenize(df, definition, capacity, end_token, id_col, text_col), "pieces"), capacity)
