"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans (e-mail, IP, card and phone numbers).  They
miss what looks less plain: a number without its plus sign, one that runs
into its neighbour or has a digit wrong, an address's local part by itself or
without its dots.  Such mentions are candidate nodes of a CRF over the
document's mentions; base spans are observed nodes.  Neighbours share chain
potentials; mentions that are equal (the same last seven digits, the same
local part) or similar (digits one edit apart, a local part but for its marks),
however far apart, share skip and near potentials, and loopy belief
propagation makes their labels agree.  A candidate with a label other than O
adds a span; base spans always stay.

The CRF is trained here, all its potentials together, by pseudo-likelihood:
a logistic model of a mention's label given its shape and the labels of its
neighbours and of the mentions linked with it.  The examples are base spans
that are hidden (their plus sign and domain removed) and recovered, each also
as it is found again elsewhere, of the same shape and of any other; other
numbers and words are examples of O unless they are linked with a base span:
what those are is for the field to say, not for the examples.  It is fitted on
the mentions of about ``SAMPLE_DOCS`` documents (kept by hash of the id).

Defined cases: null and empty texts have no spans; a text without a base span
keeps what shapes alone make certain; a mention that repeats any number of
times is linked with its previous occurrence and its first, so the graph grows
with the text and not with its square; without an example of a kind nothing
of that kind is added; offsets are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lcspark.llm.common import add_columns, freed, fresh, ship_package

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
SAMPLE_DOCS = 20_000
# Letters and digits of a local part that is known without its marks, digits of similar numbers.
NEAR_LETTERS, NEAR_DIGITS = 5, 7
# Code points up to which two mentions are neighbours.
CHAIN_DISTANCE = 40
ROUNDS = 10
DAMPING = 0.5
# Log-odds by which a candidate is O to begin with: shapes never seen stay so.
PRIOR_O = 1.5
# Bounds of the log-potentials of neighbours and of linked mentions.
CHAIN_LIMIT, LINK_LIMIT = 1.0, 6.0
# Weight of an example found again as a similar mention, to one found again as an equal one.
NEAR_WEIGHT = 0.5
# Probability from which a candidate's label adds a span.
CERTAIN = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number can't begin inside a run of digits whose start has failed, so runs are entered at their start only.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_NUMBER = re.compile(r"(?<![A-Za-z0-9.])(?:(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}"
                     r"|[0-9]{7,19})(?![A-Za-z0-9])")
_HANDLE = re.compile(r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9_%+-]*[A-Za-z][A-Za-z0-9._%+-]*[0-9_%+](?![A-Za-z0-9_%+@-])")
_RUN = re.compile(r"[A-Za-z0-9._%+-]+")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[0::2]) + sum(2 * d - 9 * (d > 4) for d in values[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain, found from each @
    (a match's local part is all that may precede it), so a long run of
    letters costs its length once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    if not _ANY.search(text):
        return []
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGIT.findall(m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# -- mentions ----------------------------------------------------------------
@dataclass
class Mention:
    start: int
    end: int
    label: int | None      # observed label, None for a candidate
    shape: str             # the text whose shape is scored
    key: str               # equal for similar mentions
    also: str | None = None   # second key, of a number that is a local part too
    near: bool = False     # equal to its key's local part but for marks


def _number_key(s: str) -> str:
    digits = "".join(_DIGIT.findall(s))
    return "#" + digits[-7:]


def _squeezed(s: str) -> str:
    return re.sub(r"[._%+-]", "", s)


def _handles(text: str, locals_: set[str]) -> Iterator[tuple[int, int, str, bool]]:
    """Where one of ``locals_`` stands by itself, but for marks around it (the
    longest, if they differ in marks only); or, of one of ``NEAR_LETTERS`` or
    more, but for marks inside it.  start, end, local part, is it the latter."""
    by_core: dict[str, list[str]] = {}
    by_squeezed: dict[str, str] = {}
    for local in sorted(locals_, key=lambda x: (-len(x), x)):
        by_core.setdefault(local.strip("._%+-"), []).append(local)
        if len(_squeezed(local)) >= NEAR_LETTERS:
            by_squeezed.setdefault(_squeezed(local), local)
    for m in _RUN.finditer(text):
        run = m.group().lower()
        core = run.strip("._%+-")
        for local in by_core.get(core, ()):
            if (at := run.find(local)) >= 0:
                yield m.start() + at, m.start() + at + len(local), local, False
                break
        else:
            if (local := by_squeezed.get(_squeezed(core))) is not None and core not in by_core:
                at = run.find(core)
                yield m.start() + at, m.start() + at + len(core), local, True


def mentions(text: str, base: list[tuple[int, int, int]], handles: bool = False) -> list[Mention]:
    """Base spans and candidates outside them, by position.  Candidates are
    numbers and, in a text with an e-mail address, all words equal to its
    local part, whatever their shape and length (with ``handles``, to train
    on, all words that end in a digit or a mark instead)."""
    nodes = []
    for start, kind, end in base:
        own = text[start:end]
        if kind == 0:
            local = own.split("@", 1)[0]
            nodes.append(Mention(start, end, 1, local, "@" + local.lower()))
        else:
            nodes.append(Mention(start, end, kind + 1, own.lstrip("+"), _number_key(own)))
    taken = sorted((n.start, n.end) for n in nodes)
    starts = np.array([a for a, _ in taken], np.int64)
    reach = np.maximum.accumulate(np.array([b for _, b in taken], np.int64)) if taken else starts

    def is_free(a, b):
        before = int(np.searchsorted(starts, b)) - 1
        return before < 0 or reach[before] <= a
    free = [Mention(m.start(), m.end(), None, m.group().lstrip("+"), _number_key(m.group()))
            for m in _NUMBER.finditer(text) if is_free(m.start(), m.end())]
    if handles:
        for m in _HANDLE.finditer(text):
            if is_free(m.start(), m.end()):
                free.append(Mention(m.start(), m.end(), None, m.group(), "@" + m.group().lower()))
    elif locals_ := {n.key[1:] for n in nodes if n.label == 1}:
        numbers = {(n.start, n.end): n for n in free}
        for a, b, local, near in _handles(text, locals_):
            if (a, b) in numbers:
                numbers[a, b].also = numbers[a, b].also or (None if near else "@" + local)
            elif is_free(a, b):
                free.append(Mention(a, b, None, text[a:b], "@" + local, near=near))
    out: list[Mention] = []
    end = -1
    for n in sorted(free, key=lambda n: (n.start, -n.end)):
        if n.start >= end:
            out.append(n)
            end = n.end
    return sorted(nodes + out, key=lambda n: (n.start, n.end))


# Features of a mention's shape, then one per label for neighbours, equal and similar mentions.
N_SHAPES = 64
CHAIN, SKIP, NEAR = (N_SHAPES + i * len(LABELS) for i in range(3))
N_FEATURES = NEAR + len(LABELS)


def shape_features(shape: str) -> list[int]:
    """Numbers of the features that a mention's shape has; 0 is always there."""
    digits = "".join(_DIGIT.findall(shape))
    letters = sum(c.isalpha() for c in shape)
    found = [0, 1 + min(len(digits), 20), 22 + min(letters, 8)]
    found += [31 + i for i, c in enumerate("( -._%") if c in shape]
    found.append(37 + min(shape.count("."), 4))
    if len(digits) >= 13:
        found.append(42 + luhn(digits))
    if shape.count("(") == 1 and shape.count(")") == 1:
        found.append(44)
    if digits == shape:
        found.append(45)
    return found


# -- the field ---------------------------------------------------------------
@dataclass
class SkipChainCRF:
    weights: np.ndarray    # [N_SHAPES, labels]
    chain: np.ndarray      # [labels, labels], log-potentials
    skip: np.ndarray
    near: np.ndarray

    def unary(self, nodes: list[Mention]) -> np.ndarray:
        out = np.array([self.weights[shape_features(n.shape)].sum(axis=0) for n in nodes])
        out[:, 0] += PRIOR_O
        for i, n in enumerate(nodes):
            if n.label is not None:
                out[i] = -1e9      # no number of messages moves an observed node
                out[i, n.label] = 0.0
        return out


def _one_edit_keys(shape: str) -> list[str]:
    """Digits, and digits without one of them: numbers one edit apart share a key."""
    digits = "".join(_DIGIT.findall(shape))
    return list({digits, *(digits[:i] + digits[i + 1:] for i in range(len(digits)))}) if len(digits) >= NEAR_DIGITS else []


def edges_of(nodes: list[Mention]) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between neighbours; skip edges from a mention to the
    previous equal one and to the first observed equal one; near edges
    likewise, between mentions that are similar and not equal."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1].start - nodes[i].end <= CHAIN_DISTANCE]
    keys = [[n.key] if n.also is None else [n.key, n.also] for n in nodes]
    close = [_one_edit_keys(n.shape) if n.key[0] == "#" else [n.key] for n in nodes]
    first: dict[str, int] = {}
    first_close: dict[str, int] = {}
    for i, n in enumerate(nodes):
        if n.label is not None:
            for k in (() if n.near else keys[i]):
                first.setdefault(k, i)
            for k in close[i]:
                first_close.setdefault(k, i)
    skip, near, last, last_close = [], [], {}, {}
    for i, n in enumerate(nodes):
        equal = set() if n.near else {of.get(k) for of in (last, first) for k in keys[i]} - {None, i}
        skip += [(j, i) for j in sorted(equal)]
        similar = {of.get(k) for of in (last_close, first_close) for k in close[i]} - {None, i} - equal
        near += [(j, i) for j in sorted(similar) if n.near or nodes[j].near or not set(keys[i]) & set(keys[j])]
        if not n.near:
            last.update(dict.fromkeys(keys[i], i))
        last_close.update(dict.fromkeys(close[i], i))
    return chain, skip, near


def beliefs(unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray) -> np.ndarray:
    """Loopy sum-product in log space: marginals [nodes, labels].  edges
    [E, 2]; potentials [E, labels, labels] by (first node, second node)."""
    total = unary
    if len(edges):
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pair = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
        reverse = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), unary.shape[1]))
        for _ in range(ROUNDS):
            total = unary.copy()
            np.add.at(total, target, message)
            new = np.logaddexp.reduce((total[source] - message[reverse])[:, :, None] + pair, axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * new
        total = unary.copy()
        np.add.at(total, target, message)
    return np.exp(total - np.logaddexp.reduce(total, axis=1, keepdims=True))


def find_spans(text: str, model: SkipChainCRF) -> tuple[list, list]:
    """(base spans, all spans) of a text as (start, kind number, end)."""
    base = base_spans(text)
    if not base and not _ANY.search(text):
        return base, base
    nodes = mentions(text, base)
    if all(n.label is not None for n in nodes):
        return base, base
    kinds = edges_of(nodes)
    edges = np.array([e for of_kind in kinds for e in of_kind], np.int64).reshape(-1, 2)
    potentials = np.concatenate([np.repeat(p[None], len(e), 0) for p, e in zip((model.chain, model.skip, model.near), kinds)])
    probability = beliefs(model.unary(nodes), edges, potentials)
    best = probability.argmax(axis=1)
    added = [(n.start, int(k) - 1, n.end) for n, k, p in zip(nodes, best, probability.max(axis=1))
             if n.label is None and k and p >= CERTAIN]
    return base, sorted(base + added)


# -- training ----------------------------------------------------------------
def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (label, features, n): a mention's shape with its label and
    the known labels of the mentions around it and linked with it.  Base
    spans stand for what they are, hidden; candidates that are linked with
    one are left out and say nothing to others; other candidates are O."""
    counts: dict[tuple, int] = {}
    for batch in freed(batches):
        for text in batch.column("text").to_pylist():
            if not text or not _ANY.search(text):
                continue
            nodes = mentions(text, base_spans(text), handles=True)
            kinds = edges_of(nodes)
            open_ = set()
            for i, j in (*kinds[1], *kinds[2]):
                if (nodes[i].label is None) != (nodes[j].label is None):
                    open_ |= {i if nodes[i].label is None else j}
            around: list[list[int]] = [[] for _ in nodes]
            for first, edges in zip((CHAIN, SKIP, NEAR), kinds):
                for i, j in edges:
                    for here, there in ((i, j), (j, i)):
                        if there not in open_:
                            around[here].append(first + (nodes[there].label or 0))
            for i, n in enumerate(nodes):
                if i not in open_:
                    made = (n.label or 0, ",".join(map(str, shape_features(n.shape) + sorted(around[i]))))
                    counts[made] = counts.get(made, 0) + 1
    rows = list(zip(*[(*k, n) for k, n in counts.items()])) or [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.string(), pa.int64()))], ["label", "of", "n"])


def fit(rows: list[tuple[int, str, int]], steps: int = 8000) -> SkipChainCRF:
    """Logistic model by gradient steps on the counted examples.  Each is
    also there as it is found again: linked with a mention of its own label,
    by its shape and without it; and a mention that is linked with a base
    span is of its kind even in the shapes of O."""
    k = len(LABELS)
    examples: dict[tuple, float] = {}

    def add(label, found, n):
        examples[label, found] = examples.get((label, found), 0.0) + n
    known = {label for label, _, _ in rows} - {0}
    for label, of, n in rows:
        found = tuple(int(x) for x in of.split(","))
        add(label, found, n)
        shape = tuple(x for x in found if x < N_SHAPES)
        for link, share in ((SKIP, 1.0), (NEAR, NEAR_WEIGHT)):
            add(label, (*shape, link + label), n * share)
            add(label, (0, link + label), n * share)
            if label == 0:                    # words may be local parts, numbers may be numbers, whatever their shape
                for j in known & ({1} if any(22 < x < 31 for x in shape) else {2, 3, 4}):
                    add(j, (*shape, link + j), n * share)
    weights = np.zeros((N_FEATURES, k))
    if examples:
        x = np.zeros((len(examples), N_FEATURES))
        for i, (_, found) in enumerate(examples):
            np.add.at(x[i], list(found), 1)
        label = np.array([e[0] for e in examples])
        n = np.sqrt(np.array(list(examples.values())))           # an example's weight grows slower than its count
        for j in range(k):                                       # and the labels weigh the same
            if (mine := label == j).any():
                n[mine] /= n[mine].sum()
        target = np.eye(k)[label]
        for _ in range(steps):
            z = x @ weights
            p = np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True))
            weights -= 0.5 * (x.T @ ((p - target) * (n / n.sum())[:, None]) + 1e-4 * weights)
    for j in range(1, k):
        if not any(e[0] == j for e in examples):
            weights[0, j] -= 20.0

    def potentials(first, limit):
        w = weights[first:first + k]
        return np.clip((w + w.T) / 2, -limit, limit)
    return SkipChainCRF(weights[:N_SHAPES], potentials(CHAIN, CHAIN_LIMIT), potentials(SKIP, LINK_LIMIT), potentials(NEAR, LINK_LIMIT))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> SkipChainCRF:
    """Fit on about ``sample_docs`` of the documents; only counts of distinct
    examples reach the driver."""
    ship_package(df.sparkSession)
    rate = min(1.0, sample_docs / max(df.count(), 1))
    unit = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("pii")), F.lit(1_000_000)) / 1_000_000
    counted = (df.where(unit < rate).select(F.col(text_col).alias("text"))
               .mapInArrow(_examples, "label int, of string, n bigint")
               .groupBy("label", "of").agg(F.sum("n").alias("n")).collect())
    return fit(sorted(tuple(r) for r in counted))


# -- DataFrames --------------------------------------------------------------
_SPANS = "array<struct<kind:string,start:int,end:int>>"


def find(df: DataFrame, model: SkipChainCRF, text_col: str = "text") -> DataFrame:
    """All columns of ``df``, then pii_base and pii_spans, sorted by start
    and kind as in ``KINDS``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def compute(texts):
        found = [find_spans(t, shared.value) for t in texts]
        return [[[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans] for spans in side] for side in zip(*found)] \
            if found else [[], []]
    return add_columns(df, text_col, f"pii_base {_SPANS}, pii_spans {_SPANS}", compute)


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span replaced by its kind in brackets; spans that overlap are one, of the first's kind."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, k, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([a, k, b])
    for a, k, b in merged:
        out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join(out) + text[at:]


def redact(df: DataFrame, model: SkipChainCRF, text_col: str = "text") -> DataFrame:
    """``df`` with personal data in its texts replaced; a null text stays null."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    name = fresh(df, "_redacted")
    made = add_columns(df, text_col, f"{name} string", lambda texts: [
        [redact_text(t, find_spans(t, shared.value)[1]) for t in texts]])
    text = F.when(F.col(text_col).isNotNull(), F.col(name))
    return made.select(*[text.alias(c) if c == text_col else F.col(c) for c in df.columns])
