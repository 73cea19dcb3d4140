"""Severity of toxic language by cumulative-link ordinal regression on sparse word features.

The grades 0 < 1 < ... share one weight a word; each step from a grade to the next has its
own threshold: P(grade <= k) = 1 / (1 + exp(w.x - t_k)), with t_0 < t_1 < ... The expected
severity is the mean grade under these probabilities; a document is toxic if a grade above
0 is likelier than not.

``labels`` (doc_id, toxic) know only toxic or not. The grade of a toxic document for the
fit follows from how often words marked by the labels stand in it (``STEPS``).

The model is fitted on at most ``SAMPLE`` labelled documents, those of least hash of doc_id;
copies among them count as one, by their majority. Every document is scored, on its whole text.
Null texts count as empty and have the severity of no evidence. Labels with a null doc_id or
toxic are ignored; a doc_id labelled twice is toxic if it ever is. Without labels of both
kinds nothing is toxic and every severity is 0. ``doc_id`` may be null or repeated: rows are
scored one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.llm import text_arrays as A
from leafgraph.llm.columns import carried

#: Bound of the labelled documents the model is fitted on, and of the words it weighs.
SAMPLE = 20_000
WORDS = 512
#: A word is a feature if its association with the label has at least this likelihood ratio.
EVIDENCE = 16.0
#: A feature marks toxic language if its odds are at least so many times higher in toxic documents.
MARK_ODDS = 8.0
#: Marked words from which on a toxic document has the next grade.
STEPS = (3, 8)


@dataclass
class Model:
    names: np.ndarray  # sorted
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """One column a grade."""
        up = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))
        edge = np.hstack([np.ones((len(score), 1)), up, np.zeros((len(score), 1))])
        return edge[:, :-1] - edge[:, 1:]


def letter_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e = A.pretokens(data, off)
    s = s + ((data[s] == 32) & (e - s > 1))
    letter = A._byte_classes(data)[s] == A.LETTER if len(s) else np.zeros(0, bool)
    return s[letter], e[letter]


def word_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, name) of every word of letters; A-Z count as a-z."""
    low = A.lower_ascii(data)
    s, e = letter_runs(low, off)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return A.owners(off, s), A.names(low, s, e)


def features(data: np.ndarray, off: np.ndarray, names: np.ndarray):
    """(document, feature, value): 1 + log(how often the word stands in the document)."""
    doc, own = word_features(data, off)
    if not len(own) or not len(names):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at = np.minimum(np.searchsorted(names, own), len(names) - 1)
    hit = np.flatnonzero(names[at] == own)
    pair, n = np.unique(doc[hit] * len(names) + at[hit], return_counts=True)
    return pair // len(names), pair % len(names), 1 + np.log(n)


def _word_batches(batches):
    """In how many toxic and clean documents each word stands."""
    for batch in batches:
        data, off = A.utf8(batch.column("text"))
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for i, j in A.runs(off):
            low, o = A.lower_ascii(data[off[i]:off[j]]), off[i:j + 1] - off[i]
            s, e = letter_runs(low, o)
            doc = A.owners(o, s)
            both = np.stack([doc.astype(np.uint64), A.names(low, s, e)], 1)
            _, first = np.unique(both, axis=0, return_index=True)
            name, where, inverse = np.unique(both[first, 1], return_index=True, return_inverse=True)
            yes = np.bincount(inverse, toxic[i + doc[first]] > 0, len(name)).astype(np.int64)
            both_kinds = np.bincount(inverse, minlength=len(name))
            yield pa.RecordBatch.from_arrays(
                [pa.array(name.view(np.int64)), pa.array(yes), pa.array(both_kinds - yes)], names=["word", "toxic", "clean"])


def _feature_batches(names: np.ndarray):
    def run(batches):
        for batch in batches:
            data, off = A.utf8(batch.column("text"))
            for i, j in A.runs(off):
                doc, feature, value = features(data[off[i]:off[j]], off[i:j + 1] - off[i], names)
                edge = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("toxic").slice(i, j - i),
                    pa.ListArray.from_arrays(pa.array(edge), pa.array(feature.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(edge), pa.array(value)),
                ], names=["toxic", "feature", "value"])

    return run


def fit_ordinal(row, feature, value, grade, n_features: int, n_grades: int, penalty: float = 0.3, rounds: int = 300):
    """Weights and rising thresholds of least penalised loss, by gradient steps of adapted length."""
    n = len(grade)
    share = np.cumsum(np.bincount(grade, minlength=n_grades))[:-1] / n
    share = np.clip(share, 1e-6, 1 - 1e-6)
    t = np.log(share / (1 - share))
    x = np.concatenate([np.zeros(n_features), t[:1], np.log(np.maximum(np.diff(t), 1e-3))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for k in range(1, rounds + 1):
        w, t = x[:n_features], np.cumsum(np.concatenate([x[n_features:n_features + 1], np.exp(x[n_features + 1:])]))
        score = np.bincount(row, value * w[feature], n)
        edge = np.concatenate([[-np.inf], t, [np.inf]])
        cdf = 1 / (1 + np.exp(np.clip(score[:, None] - edge[None, :], -40, 40)))
        cdf[:, 0], cdf[:, -1] = 0, 1
        at = np.arange(n)
        high, low = cdf[at, grade + 1], cdf[at, grade]
        p = np.maximum(high - low, 1e-12)
        dh, dl = high * (1 - high), low * (1 - low)
        g_score = (dh - dl) / p
        g_t = np.zeros(n_grades + 1)
        np.add.at(g_t, grade + 1, -dh / p)
        np.add.at(g_t, grade, dl / p)
        g_t = g_t[1:-1]
        after = np.cumsum(g_t[::-1])[::-1]
        g = np.concatenate([np.bincount(feature, value * g_score[row], n_features) + penalty * w, after[:1], after[1:] * np.exp(x[n_features + 1:])]) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - 0.1 * (1 - k / (rounds + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-10)
    return x[:n_features], np.cumsum(np.concatenate([x[n_features:n_features + 1], np.exp(x[n_features + 1:])]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model, or None if the labels are not of both kinds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic").cast("double") > 0).cast("int").alias("toxic"))
    known = known.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(known), "doc_id").groupBy("text").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    total = rows.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("all")).first()
    yes, no = total["toxic"] or 0, total["all"] - (total["toxic"] or 0)
    if not yes or not no:
        return None
    words = rows.mapInArrow(_word_batches, "word long, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    a, b, n = F.col("a"), F.col("b"), float(yes + no)
    gain = F.lit(0.0)
    for seen, side, of in ((a, a + b, yes), (b, a + b, no), (yes - a, n - a - b, yes), (no - b, n - a - b, no)):
        gain = gain + F.when(seen > 0, 2 * seen * F.log(seen * n / (side * of))).otherwise(0.0)
    odds = ((a + 0.5) / (yes - a + 0.5)) / ((b + 0.5) / (no - b + 0.5))
    chosen = words.select("word", gain.alias("gain"), odds.alias("odds")).where(F.col("gain") >= EVIDENCE)
    chosen = chosen.orderBy(F.desc("gain"), "word").limit(WORDS).collect()
    if not chosen:
        return None
    names = np.array([r["word"] for r in chosen], np.int64).view(np.uint64)
    order = np.argsort(names)
    marked = np.array([r["odds"] >= MARK_ODDS for r in chosen])[order]
    names = names[order]
    got = rows.mapInArrow(_feature_batches(names), "toxic int, feature array<int>, value array<double>").toArrow()
    toxic = got["toxic"].to_numpy()
    size = np.array([len(x) for x in got["feature"]])
    row = np.repeat(np.arange(len(toxic)), size)
    feature = np.concatenate([x.values.to_numpy() for x in got["feature"]] or [np.zeros(0, np.int32)])
    value = np.concatenate([x.values.to_numpy() for x in got["value"]] or [np.zeros(0)])
    hits = np.bincount(row, np.exp(value - 1) * marked[feature], len(toxic)).round()
    grade = np.where(toxic > 0, 1 + sum((hits >= s).astype(int) for s in STEPS), 0)
    used = np.unique(grade)  # a grade without a document has no threshold
    weights, thresholds = fit_ordinal(row, feature, value, np.searchsorted(used, grade), len(names), len(used))
    return Model(names, weights, thresholds)


def _score_batches(model: Model | None, keep: tuple[str, ...]):
    def run(batches):
        for batch in batches:
            data, off = A.utf8(batch.column("text"))
            for i, j in A.runs(off):
                n = j - i
                if model is None:
                    severity, grade, toxic = np.zeros(n), np.zeros(n, np.int32), np.zeros(n, bool)
                else:
                    doc, feature, value = features(data[off[i]:off[j]], off[i:j + 1] - off[i], model.names)
                    p = model.probabilities(np.bincount(doc, value * model.weights[feature], n))
                    severity = p @ np.arange(p.shape[1])
                    grade, toxic = p.argmax(1).astype(np.int32), p[:, 0] < 0.5
                rest = [batch.column(c).slice(i, n) for c in keep]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(severity), pa.array(grade), pa.array(toxic)], names=[*keep, "severity", "grade", "toxic"])

    return run


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every document, with its expected severity, likeliest grade and verdict."""
    rows = docs.select("text", *[c for c in keep if c != "text"])
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + ["severity double", "grade int", "toxic boolean"])
    return rows.mapInArrow(_score_batches(model, keep), schema)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that are not toxic, as they are; their other columns may have any names."""
    rows, restored = carried(docs, "doc_id", "text")
    scored = score(rows, fit(rows, labels), tuple(rows.columns))
    return restored(scored.where("NOT toxic"))
