"""Language identification.  A word's script leaves the languages that use
it; each word is scored under each of these by its character trigrams; and
Viterbi over the words, with a penalty for a change of language, labels
spans.  A text's language is the one with most letters in its spans.

The model holds, per language, log-probabilities of ``BUCKETS`` hashed
trigrams and the share of each script, counted over all training texts in
one pass: ``BUCKETS`` floats a language, whatever the input's size.

Defined cases: a null text or one without letters has no span and language
``und`` with score 0; a training text without a language is passed over;
ties go to the language that comes first by name; with no training text at
all every text is ``und``; a text's memory is some 60 bytes per code point
and 4 bytes per word and language, so a very long text is held once, never
cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lcspark.llm.common import add_columns, freed, ship_package
from lcspark.llm.textvec import Words, letter_words, slices

UNDETERMINED = "und"
BUCKETS = 1 << 15
# Log-odds that a change of language costs, in nats.
SWITCH_PENALTY = 12.0
# Share of a language's words that must be in a script for the script to count as its own.
SCRIPT_SHARE = 0.01
# First code points of script ranges (public Unicode blocks); a range ends where the next begins.
SCRIPT_STARTS = {
    "latin": 0x0041, "greek": 0x0370, "cyrillic": 0x0400, "armenian": 0x0530, "hebrew": 0x0590, "arabic": 0x0600,
    "indic": 0x0900, "thai": 0x0E00, "tibetan": 0x0F00, "georgian": 0x10A0, "hangul_jamo": 0x1100, "ethiopic": 0x1200,
    "american": 0x13A0, "khmer": 0x1780, "latin_extended": 0x1E00, "greek_extended": 0x1F00, "symbols": 0x2000,
    "kana": 0x3040, "cjk": 0x3400, "other_asian": 0xA000, "hangul": 0xAC00, "compatibility": 0xF900,
    "supplementary": 0x10000, "cjk_supplementary": 0x20000}
_STARTS = np.array(list(SCRIPT_STARTS.values()))
_SPAN = "array<struct<start:int,end:int,lang:string>>"
_FAR = np.float32(-1e4)


@dataclass
class LanguageModel:
    languages: list[str]
    trigram: np.ndarray    # [BUCKETS, languages], log-probabilities
    allowed: np.ndarray    # [scripts, languages], 0 or a large negative number
    penalty: float = SWITCH_PENALTY


def _trigrams(w: Words) -> np.ndarray:
    """Bucket of the trigram around each letter; what is no letter counts as a space."""
    def at(step):
        c = w.chars[w.letters + step].astype(np.uint64)
        joined = np.diff(w.letters, prepend=-2) == 1 if step < 0 else np.diff(w.letters, append=-2) == 1
        return np.where(joined, c, np.uint64(32))
    h = (at(-1) * np.uint64(0x9E3779B97F4A7C15) ^ w.chars[w.letters].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
         ^ at(1) * np.uint64(0x165667B19E3779F9))
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64)


def _scripts(w: Words) -> np.ndarray:
    return np.maximum(np.searchsorted(_STARTS, w.chars[w.letters[w.starts]], "right") - 1, 0)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, bucket, n) of a partition; buckets from BUCKETS on count words by script."""
    sums: dict[str, np.ndarray] = {}
    for batch in freed(batches):
        for lang, group in batch.groupby("lang"):
            own = sums.setdefault(lang, np.zeros(BUCKETS + len(_STARTS)))
            texts = group["text"].tolist()
            for a, b in slices(texts):
                w = letter_words(texts[a:b])
                own[:BUCKETS] += np.bincount(_trigrams(w), minlength=BUCKETS)
                own[BUCKETS:] += np.bincount(_scripts(w), minlength=len(_STARTS))
    for lang, own in sums.items():
        seen = np.flatnonzero(own)
        yield pd.DataFrame({"lang": lang, "bucket": seen, "n": own[seen]})


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", penalty: float = SWITCH_PENALTY) -> LanguageModel:
    """Count all rows of ``df`` that have a text and a language."""
    ship_package(df.sparkSession)
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    counts = (rows.mapInPandas(_count, "lang string, bucket int, n double")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(counts["lang"].unique())
    table = np.zeros((BUCKETS + len(_STARTS), len(languages)))
    table[counts["bucket"], counts["lang"].map({x: i for i, x in enumerate(languages)}).astype(int)] = counts["n"]
    grams, by_script = table[:BUCKETS] + 0.5, table[BUCKETS:]
    share = by_script / np.maximum(by_script.sum(axis=0), 1)
    allowed = np.where(share >= SCRIPT_SHARE, 0, _FAR)
    allowed[~(share >= SCRIPT_SHARE).any(axis=1)] = 0   # a script no language uses rules none out
    return LanguageModel(languages, np.log(grams / grams.sum(axis=0)).astype(np.float32), allowed.astype(np.float32), penalty)


def word_scores(w: Words, model: LanguageModel) -> np.ndarray:
    """[words, languages]: sum of trigram log-probabilities, less a large
    number where the language does not use the word's script."""
    return np.add.reduceat(model.trigram[_trigrams(w)], w.starts, axis=0) + model.allowed[_scripts(w)]


def _one_language(scores: np.ndarray, penalty: float) -> int | None:
    """The language of the best path if that provably never changes: no run
    of words gains more than half a penalty by another language.  (A path
    with k >= 2 stretches of other languages pays k - 1 penalties at least
    and gains at most k halves.)"""
    best = int(scores.sum(axis=0).argmax())
    gain = np.cumsum(scores - scores[:, best:best + 1], axis=0, dtype=np.float64)
    low = np.minimum(np.minimum.accumulate(np.vstack([np.zeros((1, gain.shape[1])), gain[:-1]]), axis=0), 0)
    return best if (gain - low).max() <= penalty / 2 else None


def viterbi(block: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best path of each text of a block (score arrays [words, languages]),
    all stepped together; a path only changes language for a gain over the penalty."""
    longest, n, k = max(map(len, block)), len(block), block[0].shape[1]
    scores = np.zeros((longest, n, k), np.float32)
    for i, s in enumerate(block):
        scores[:len(s), i] = s
    back = np.empty((longest, n, k), np.int16)
    here, stay = scores[0].astype(np.float64), np.arange(k, dtype=np.int16)
    for t in range(1, longest):
        top = here.argmax(axis=1)
        moved = here[np.arange(n), top][:, None] - penalty
        change = moved > here
        back[t] = np.where(change, top[:, None], stay)
        here = np.where(change, moved, here) + scores[t]   # beyond a text's end: zeros, the best end stays best
    paths = []
    for i, s in enumerate(block):
        path = np.empty(longest, np.int16)
        path[-1] = here[i].argmax()
        for t in range(longest - 1, 0, -1):
            path[t - 1] = back[t, i, path[t]]
        paths.append(path[:len(s)])
    return paths


# Cells (words x texts) of one Viterbi block.
_BLOCK_CELLS = 200_000


def _paths(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    paths: list = [None] * len(scores)
    mixed = []
    for i, s in enumerate(scores):
        only = _one_language(s, penalty) if len(s) else 0
        if only is None:
            mixed.append(i)
        else:
            paths[i] = np.full(len(s), only, np.int16)
    mixed.sort(key=lambda i: len(scores[i]))
    block: list[int] = []
    for at, i in enumerate(mixed):
        block.append(i)
        following = len(scores[mixed[at + 1]]) if at + 1 < len(mixed) else None
        if following is None or following * (len(block) + 1) > _BLOCK_CELLS or following > 2 * len(scores[block[0]]) + 64:
            for j, path in zip(block, viterbi([scores[j] for j in block], penalty)):
                paths[j] = path
            block = []
    return paths


def label_texts(texts: list[str], model: LanguageModel) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, language) of each text, in code points from the
    first letter of the first word to the last letter of the last."""
    out: list[list] = [[] for _ in texts]
    if not model.languages:
        return out
    for a, b in slices(texts):
        w = letter_words(texts[a:b])
        if not len(w.starts):
            continue
        scores = word_scores(w, model)
        cuts = np.searchsorted(w.doc, np.arange(b - a + 1))
        first = w.letters[w.starts]
        last = w.letters[np.append(w.starts[1:], len(w.letters)) - 1] + 1
        for i, path in enumerate(_paths([scores[cuts[i]:cuts[i + 1]] for i in range(b - a)], model.penalty)):
            if not len(path):
                continue
            change = np.flatnonzero(np.diff(path)) + 1
            begins, ends = np.append(0, change), np.append(change, len(path)) - 1
            at = cuts[i]
            out[a + i] = [(int(first[at + x] - w.text_at[i]), int(last[at + y] - w.text_at[i]), model.languages[path[x]])
                          for x, y in zip(begins, ends)]
    return out


def verdict(spans: list[tuple[int, int, str]]) -> tuple[str, float]:
    """Language with most code points in the spans, and its share of them."""
    if not spans:
        return UNDETERMINED, 0.0
    by_lang: dict[str, int] = {}
    for start, end, lang in spans:
        by_lang[lang] = by_lang.get(lang, 0) + end - start
    best = min(by_lang, key=lambda x: (-by_lang[x], x))
    return best, by_lang[best] / sum(by_lang.values())


def identify(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns of ``df``, then lang_pred, lang_score and lang_spans
    (columns of these names are replaced)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def compute(texts):
        labelled = label_texts(texts, shared.value)
        found = [verdict(s) for s in labelled]
        return ([x[0] for x in found], [x[1] for x in found],
                [[{"start": a, "end": b, "lang": c} for a, b, c in s] for s in labelled])
    return add_columns(df, text_col, f"lang_pred string, lang_score double, lang_spans {_SPAN}", compute)
