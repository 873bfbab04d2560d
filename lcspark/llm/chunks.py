"""Token ids of whole texts from those of their chunks between blanks.

A slice's texts are split and dictionary-encoded by Arrow; only chunks that
are new to the slice come up as Python strings, only those that the worker's
cache lacks are encoded, and the ids of all occurrences are gathered by
numpy from one block with offsets.  The cache has two generations of bounded
size; a slice that has more distinct chunks than that is still whole."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lcspark.llm.textvec import slices


class ChunkCache:
    """Ids (32-bit, as bytes) of chunks; ``encode`` makes those of new ones."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int):
        self.encode, self.most = encode, most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, chunks: list[str]) -> list[bytes]:
        """Of distinct chunks, in order."""
        young, old = self.young, self.old
        found = [young.get(c) for c in chunks]
        missing = [i for i, f in enumerate(found) if f is None]
        new = []
        for i in missing:
            kept = old.get(chunks[i])
            if kept is None:
                new.append(i)
            found[i] = kept
        for i, made in zip(new, self.encode([chunks[i] for i in new]) if new else ()):
            found[i] = made
        if len(young) + len(missing) > self.most:
            self.old, self.young = young, {}
        self.young.update((chunks[i], found[i]) for i in missing)
        return found


def picked(flat: np.ndarray, cuts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of ``flat`` between ``cuts``, numbers at[0], at[1], ... one
    after another, and the place where each begins (and the end)."""
    n = np.diff(cuts)[at]
    places = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(cuts[at] - places[:-1], n) + np.arange(places[-1])], places


def gathered(blobs: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``picked`` from the ids of blobs."""
    lengths = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
    return picked(np.frombuffer(b"".join(blobs), np.int32), np.concatenate([[0], np.cumsum(lengths)]), at)


# Rows of a slice, and its code points (a longer text is a slice by itself):
# the more texts share a slice, the fewer chunks are looked up twice.
SLICE_ROWS, SLICE_CHARS = 500, 2_000_000


def sliced(texts: list[str], encode: Callable[[list[str]], list[np.ndarray]]) -> list[np.ndarray]:
    return [ids for a, b in slices(texts, SLICE_CHARS) for ids in encode(texts[a:b])]


def encode_texts(texts: list[str], rest: Callable[[list[str]], list[bytes]],
                 head: Callable[[list[str]], list[bytes]] | None = None) -> list[np.ndarray]:
    """Ids of each text: the chunks between its blanks, each by ``rest``, but
    the first by ``head`` (if given)."""
    if not texts:
        return []
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    cuts, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
    coded = flat.dictionary_encode()
    at = coded.indices.to_numpy().astype(np.int64)
    if head is None:
        blobs = rest(coded.dictionary.to_pylist())
    else:
        firsts = flat.take(pa.array(cuts[:-1])).dictionary_encode()
        inner = np.ones(len(at), bool)
        inner[cuts[:-1]] = False
        used, place = np.unique(at[inner], return_inverse=True)
        blobs = rest(coded.dictionary.take(pa.array(used)).to_pylist())
        at[inner] = place
        at[cuts[:-1]] = firsts.indices.to_numpy() + len(blobs)
        blobs = blobs + head(firsts.dictionary.to_pylist())
    ids, places = gathered(blobs, at)
    ends = places[cuts]
    return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
