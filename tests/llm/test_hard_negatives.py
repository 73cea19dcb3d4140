"""Hard negatives against brute force, bounds that hold and prune, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafgraph.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, score string, v string"


def brute(ids, labels, v, every, positives=5, negatives=5, percent=80):
    out = set()
    order = np.argsort(ids)
    ids, labels, v = ids[order], labels[order], v[order]
    for a in np.flatnonzero(ids % every == 0):
        score = v @ v[a]
        best = [i for i in np.argsort(-score, kind="stable") if i != a]
        for p in [i for i in best if labels[i] == labels[a]][:positives]:
            hit = [i for i in best if labels[i] != labels[a] and percent * score[p] <= 100 * score[i] <= 100 * score[p]]
            out |= {(ids[a], ids[p], r + 1, ids[i], score[p], score[i]) for r, i in enumerate(hit[:negatives])}
    return out


def clustered(n=900, spread=1.0, seed=2):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(8, 10)) * 3
    v = (centre[rng.integers(0, 8, n)] + spread * rng.normal(size=(n, 10))).astype(np.float32)
    labels = rng.integers(0, 6, n)
    labels[rng.random(n) < 0.4] = 9  # a hot label
    v[300:420] = v[300]  # copies, in all labels
    v[500:504] = 0
    return np.arange(n), labels, v


def frame(spark, ids, labels, v, more=()):
    rows = [(int(i), x.tolist(), int(k), 1, "x", "y") for i, k, x in zip(ids, labels, v)]
    return spark.createDataFrame(rows + list(more), SCHEMA)


@pytest.mark.parametrize("block,chunk", [(16384, 8192), (100, 7)])
def test_against_brute_force(spark, block, chunk, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_ROWS", block)
    monkeypatch.setattr(H, "CHUNK_ROWS", chunk)
    ids, labels, v = clustered()
    odd = [(0, [90.0] * 10, 8, 1, None, None), (None, v[0].tolist(), 1, 1, "", ""), (1000, None, 1, 1, "", ""), (1020, v[0].tolist(), None, 1, "", ""),
           (1040, [None] * 10, 1, 1, "", ""), (1060, [float("nan")] * 10, 1, 1, "", ""), (1080, [1.0, 2.0], 1, 1, "", ""), (1100, [], 1, 1, "", ""),
           (300, v[300].tolist(), int(labels[300]), 2, "again", "")]
    least = min((v[0].tolist(), labels[0]), ([90.0] * 10, 8))
    v = v.copy()
    v[0], labels[0] = least
    got = H.hard_negatives(frame(spark, ids, labels, v, odd), "vec_id % 20 = 0").collect()
    want = brute(ids, labels, np.floor(256 * v.astype(np.float64)).astype(np.int64), 20)
    assert len(got) == len(want) > 500 and {tuple(r) for r in got} == want


def test_labels_of_the_query(spark):
    ids, labels, v = clustered(400, seed=5)
    moved = np.where(ids % 7 == 0, (labels + 1) % 10, labels)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = {tuple(r) for r in H.hard_negatives(frame(spark, ids, labels, v), "vec_id % 10 = 0", label, positives=2, negatives=3, percent=60).collect()}
    assert got == brute(ids, moved, np.floor(256 * v.astype(np.float64)).astype(np.int64), 10, 2, 3, 60)


def test_bounds_hold_and_prune():
    for spread in (0.01, 0.3, 3.0):
        _, _, v = clustered(600, spread)
        v = np.floor(256 * v.astype(np.float64))
        references = v[[0, 50, 100, 150, 200]]
        references /= np.sqrt((references**2).sum(1))[:, None]
        norm, angles = H.angles_to(v, references)
        low, high = H.pair_bounds(angles, norm, angles, norm)
        score = v @ v.T
        assert (low <= score).all() and (score <= high).all()
        if spread == 0.01:
            assert np.median(high - low) < 0.2 * np.median(np.abs(score))
        own = angles.argmin(1)
        groups = [np.flatnonzero(own == g) for g in np.unique(own)]
        least, most = H.cluster_bounds(
            angles, norm, np.stack([angles[g].min(0) for g in groups]), np.stack([angles[g].max(0) for g in groups]),
            np.array([norm[g].min() for g in groups]), np.array([norm[g].max() for g in groups]))
        for k, g in enumerate(groups):
            assert (least[:, k, None] <= score[:, g]).all() and (score[:, g] <= most[:, k, None]).all()


def test_integer_scores_of_large_numbers():
    q = np.array([[3_000_000_019, -7], [1, 2]], np.int64)
    x = np.array([[3_000_000_021, 5], [0, 1]], np.int64)
    got = H.integer_scores(q, x, np.array([[True, True], [False, True]]))
    assert got.tolist() == [[3_000_000_019 * 3_000_000_021 - 35, -7], [H.NONE, 2]]


def test_empty_and_zero(spark):
    assert H.hard_negatives(spark.createDataFrame([], SCHEMA), "vec_id % 20 = 0").count() == 0
    zero = frame(spark, np.arange(4), np.array([1, 1, 2, 2]), np.zeros((4, 3)))
    assert {tuple(r) for r in H.hard_negatives(zero, "vec_id = 0").collect()} == {(0, 1, 1, 2, 0, 0), (0, 1, 2, 3, 0, 0)}
