"""Toxicity classifier with a counterfactual penalty.

A text is the set of its hashed words and word beginnings; a logistic model
scores it.  Training minimises the log-loss plus ``FAIRNESS`` times the
squared change of the score when the identity terms of a sentence are
swapped for others of their group, over all training sentences that have
such terms, plus an L1 term that leaves most features out.  So words that
only go along with a group don't raise the score.

Labelled rows may be many; the model is fitted on a sample of at most
``SAMPLE_PER_LABEL`` ids of each label (those of least hash, so it is the
same in every run; ids without a document aren't counted).  All sentences of
those texts that have identity terms are counterfactuals; those whose swap
changes the same features come to the driver as one row with their number.

Defined cases: null and empty texts have no feature and the score of the
intercept; rows without a label or with labels other than 0 and 1 are passed
over; labels for ids that don't occur are passed over; without both labels
in the sample the score is the share of label 1 (0.0 without any label).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lcspark.llm.common import add_columns, ship_package
from lcspark.llm.textvec import letter_words, mix, segment_hash, slices

FEATURE_BITS = 18
STEM_LETTERS = (4, 5)
SAMPLE_PER_LABEL = 4000
FAIRNESS = 5.0
L1 = 5e-4
STEPS = 200
# Groups of interchangeable identity terms: a term is swapped for the next of its group.
IDENTITY_TERMS: Sequence[Sequence[str]] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("gay", "straight"), ("lesbian", "heterosexual"), ("transgender", "cisgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "arab"),
    ("immigrants", "citizens"), ("blind", "deaf", "disabled"), ("old", "young"))


@dataclass
class ToxicityModel:
    weights: np.ndarray
    intercept: float


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature), distinct and sorted: words and the first
    letters of longer words, which inflected forms share."""
    docs, found = [], []
    for a, b in slices(texts):
        w = letter_words(texts[a:b])
        if not len(w.starts):
            continue
        letters, length = w.chars[w.letters], w.lengths()
        both, of = [segment_hash(letters, w.starts)], [w.doc]
        for n in STEM_LETTERS:
            longer = length > n
            first = letters[w.starts[longer][:, None] + np.arange(n)].ravel()
            both.append(mix(segment_hash(first, np.arange(longer.sum()) * n) + np.uint64(n)))
            of.append(w.doc[longer])
        both, of = np.concatenate(both) >> np.uint64(64 - FEATURE_BITS), np.concatenate(of)
        key = np.unique((of.astype(np.int64) << FEATURE_BITS) | both.astype(np.int64))
        docs.append((key >> FEATURE_BITS) + a)
        found.append(key & ((1 << FEATURE_BITS) - 1))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(found)


def _swaps(terms: Sequence[Sequence[str]]) -> tuple[re.Pattern | None, dict[str, str]]:
    following = {t: group[(i + 1) % len(group)] for group in terms for i, t in enumerate(group)}
    if not following:
        return None, following
    return re.compile(r"\b(" + "|".join(map(re.escape, sorted(following))) + r")\b", re.IGNORECASE), following


def counterfactuals(text: str, terms: Sequence[Sequence[str]] = IDENTITY_TERMS) -> list[tuple[str, str]]:
    """(sentence, sentence with its identity terms swapped) of a text."""
    pattern, following = _swaps(terms)
    if pattern is None or not pattern.search(text):
        return []
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n", text) if pattern.search(s)]
    return [(s, pattern.sub(lambda m: following[m.group().lower()], s)) for s in sentences]


def _rows(docs: np.ndarray, found: np.ndarray, n: int) -> list[list[int]]:
    cuts = np.searchsorted(docs, np.arange(n + 1))
    return [found[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]


def sample_labels(marks: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> DataFrame:
    """(id, label) of at most ``per_label`` ids of each label, those of least
    hash.  An id that is marked both ways counts as 1."""
    once = marks.groupBy("id").agg(F.max("label").alias("label"))
    chosen = [once.where(F.col("label") == label).orderBy(F.xxhash64("id", F.lit("toxicity")), "id").limit(per_label)
              for label in (0, 1)]
    return chosen[0].unionByName(chosen[1])


def sample_features(chosen: DataFrame, terms: Sequence[Sequence[str]]) -> DataFrame:
    """label, features, gained, lost, times of (label, text) rows; for
    counterfactual sentences rows with label null, the features that the swap
    adds and removes, and the number of sentences where it does."""
    ship_package(chosen.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = _rows(*features(texts), len(texts))
            pairs = [p for t in texts for p in counterfactuals(t, terms)]
            before = _rows(*features([p[0] for p in pairs]), len(pairs))
            after = _rows(*features([p[1] for p in pairs]), len(pairs))
            labels = batch.column("label").to_pylist() + [None] * len(pairs)
            some = [[]] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels, pa.int32()), pa.array(rows + [[]] * len(pairs), pa.list_(pa.int32())),
                 pa.array(some + [sorted(set(y) - set(x)) for x, y in zip(before, after)], pa.list_(pa.int32())),
                 pa.array(some + [sorted(set(x) - set(y)) for x, y in zip(before, after)], pa.list_(pa.int32()))],
                ["label", "features", "gained", "lost"])
    rows = chosen.mapInArrow(run, "label int, features array<int>, gained array<int>, lost array<int>")
    one = F.lit(1).cast("bigint").alias("times")
    swaps = rows.where("label IS NULL").groupBy("label", "features", "gained", "lost").agg(F.count("*").alias("times"))
    return rows.where("label IS NOT NULL").select("label", "features", "gained", "lost", one).unionByName(swaps)


def _sparse(lists: list) -> tuple[np.ndarray, np.ndarray]:
    lengths = [len(x) for x in lists]
    return np.repeat(np.arange(len(lists)), lengths), (np.concatenate(lists) if sum(lengths) else np.zeros(0)).astype(np.int64)


def fit(lists: list, labels: np.ndarray, gained: list, lost: list, times: np.ndarray | None = None,
        fairness: float = FAIRNESS, l1: float = L1, steps: int = STEPS) -> ToxicityModel:
    """Accelerated proximal gradient on the penalised loss; both labels weigh
    the same.  ``times``: how often each counterfactual occurs (once)."""
    size, n = 1 << FEATURE_BITS, len(labels)
    share = float(labels.mean()) if n else 0.0
    if share in (0.0, 1.0):
        return ToxicityModel(np.zeros(size), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    # features seen once can't be told from noise
    row, col = _sparse(lists)
    often = np.bincount(col, minlength=size) > 1
    row, col = row[often[col]], col[often[col]]
    kept, col = np.unique(col, return_inverse=True)
    place = np.full(size, -1)
    place[kept] = np.arange(len(kept))
    swap_row, swap_col, sign = [], [], []
    for lists_, s in ((gained, 1.0), (lost, -1.0)):
        r, c = _sparse(lists_)
        known = place[c] >= 0
        swap_row.append(r[known])
        swap_col.append(place[c[known]])
        sign.append(np.full(known.sum(), s))
    swap_row, swap_col, sign = map(np.concatenate, (swap_row, swap_col, sign))
    swaps = max(len(gained), 1)
    times = np.ones(swaps) if times is None or not len(times) else times / times.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / n
    w, b, ahead, ahead_b, t = np.zeros(len(kept)), 0.0, np.zeros(len(kept)), 0.0, 1.0

    def fairness_gradient(w):
        change = times * np.bincount(swap_row, sign * w[swap_col], swaps)
        return 2 * fairness / swaps * np.bincount(swap_col, sign * change[swap_row], len(w))

    # the step is the inverse of the loss's greatest curvature, by power iteration
    probe, probe_b, most = np.ones(len(kept)), 1.0, 1.0
    for _ in range(30):
        size_ = np.sqrt(probe @ probe + probe_b * probe_b)
        probe, probe_b = probe / size_, probe_b / size_
        r = 0.25 * weight * (probe_b + np.bincount(row, probe[col], n))
        probe, probe_b = np.bincount(col, r[row], len(kept)) + fairness_gradient(probe), r.sum()
        most = np.sqrt(probe @ probe + probe_b * probe_b)
    step = 0.9 / max(most, 1e-9)

    def gradient(w, b):
        z = b + np.bincount(row, w[col], n)
        r = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        return np.bincount(col, r[row], len(w)) + fairness_gradient(w), r.sum()
    for _ in range(steps):
        g, gb = gradient(ahead, ahead_b)
        moved = ahead - step * g
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
        new_b = ahead_b - step * gb
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new, new_b, t_new
    weights = np.zeros(size)
    weights[kept] = w
    return ToxicityModel(weights, float(b))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          terms: Sequence[Sequence[str]] = IDENTITY_TERMS, per_label: int = SAMPLE_PER_LABEL) -> ToxicityModel:
    """Fit on the documents that ``labels`` marks 0 or 1."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # at most two times ``per_label`` ids: they go to the texts, not the texts to them
    marks = marks.join(texts.select("id"), "id", "left_semi")
    chosen = texts.join(F.broadcast(sample_labels(marks, per_label)), "id").select("label", "text")
    rows = sample_features(chosen, terms).toPandas()
    of_text = rows[rows["label"].notna()]
    swaps = rows[rows["label"].isna()]
    return fit(of_text["features"].tolist(), of_text["label"].to_numpy(float), swaps["gained"].tolist(), swaps["lost"].tolist(),
               swaps["times"].to_numpy(float))


def scores(texts: list[str], model: ToxicityModel) -> np.ndarray:
    docs, found = features(texts)
    z = model.intercept + np.bincount(docs, model.weights[found], len(texts))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and toxicity (0 to 1)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return add_columns(df, text_col, "toxicity double", lambda texts: [scores(texts, shared.value)])
