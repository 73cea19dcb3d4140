"""Sentence scores by weighted PageRank (Mihalcea & Tarau 2004).

Two sentences are linked by (words in common) / (ln len a + ln len b).  The divisor
depends on the two lengths only, so a step of the iteration sums scores per (word,
sentence length) and never forms the pairs of sentences.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need no copy of this package: the functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sentence_scores(sentences, rounds: int = 20, damping: float = 0.85) -> np.ndarray:
    """Scores of sentences given as strings of words separated by a blank."""
    words = [s.split(" ") if s else [] for s in sentences]
    n = len(words)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    vocabulary: dict[str, int] = {}
    cells = [
        (i, vocabulary.setdefault(w, len(vocabulary))) for i, ws in enumerate(words) for w in dict.fromkeys(ws)
    ]
    if not cells:
        return np.full(n, 1.0 - damping)
    row, word = np.array(cells, dtype=np.int64).T
    log_len = np.log(np.maximum(lengths, 1))

    # One slot per (word, sentence length); slots of a word are neighbours.
    width = int(lengths.max()) + 1
    slots, slot = np.unique(word * width + lengths[row], return_inverse=True)
    slot_word, slot_log = slots // width, np.log(slots % width)
    starts = np.flatnonzero(np.r_[True, np.diff(slot_word) > 0])
    counts = np.diff(np.r_[starts, len(slots)])
    size, begin = np.repeat(counts, counts), np.repeat(starts, counts)
    left = np.repeat(np.arange(len(slots)), size)
    right = np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
    total = slot_log[left] + slot_log[right]
    weight = np.divide(1.0, total, out=np.zeros_like(total), where=total > 0)

    own = np.bincount(row, minlength=n).astype(float)
    own = np.divide(own, 2 * log_len, out=np.zeros(n), where=log_len > 0)

    def spread(x):
        per_slot = np.bincount(slot, weights=x[row], minlength=len(slots))
        reached = np.bincount(left, weights=per_slot[right] * weight, minlength=len(slots))
        return np.bincount(row, weights=reached[slot], minlength=n) - own * x

    out_weight = spread(np.ones(n))
    linked = out_weight > 1e-9
    score = np.ones(n)
    for _ in range(rounds):
        share = np.divide(score, out_weight, out=np.zeros(n), where=linked)
        score = (1.0 - damping) + damping * np.where(linked, spread(share), 0.0)
    return score


def scores_udf(rounds: int = 20, damping: float = 0.85):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(sentences: pd.Series) -> pd.Series:
        return sentences.map(lambda s: sentence_scores(s, rounds, damping))

    return score
