"""Both searches over vectors against brute force."""

import numpy as np
import pytest

from leafgraph.llm import knn_join, multi_index, queries

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, group int, v string"


def brute(ids, vectors, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = vectors @ vectors[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [(r + 1, int(ids[j]), s[j]) for r, j in enumerate(order)]
    return out


def listed(rows):
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {k: sorted(v) for k, v in out.items()}


def odd(spark, n=900):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(8, 10)) * 3
    v = (centre[rng.integers(0, 8, n)] + rng.normal(size=(n, 10))).astype(np.float32)
    v[300:600] = v[300]  # a third are copies
    rows = [(i, x.tolist(), 1, "x") for i, x in enumerate(v)]
    rows += [(0, v[0].tolist(), 2, None), (None, v[1].tolist(), 1, "x"), (1000, None, 1, "x"), (1020, [1.0] * 9 + [None], 1, "x"),
             (1040, [float("nan")] + [0.0] * 9, 1, "x"), (1060, [float("inf")] + [0.0] * 9, 1, "x"), (1080, [1.0, 2.0], 1, "x"), (1100, [], 1, "x")]
    return np.arange(n), v.astype(np.float64), spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("pivots", [1, 16])
def test_knn_join_is_exact(spark, pivots, monkeypatch):
    monkeypatch.setattr(knn_join, "BLOCK_ROWS", 100)
    monkeypatch.setattr(knn_join, "BLOCK_QUERIES", 7)
    ids, v, frame = odd(spark)
    want = brute(ids, np.floor(64 * v), 20)
    assert listed(knn_join.knn_join(frame, "vec_id % 20 = 0", pivots=pivots).collect()) == want


def test_multi_index(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK_ROWS", 100)
    ids, v, frame = odd(spark)
    want = brute(ids, v, 20)
    got = listed(multi_index.search(frame, "vec_id % 20 = 0", share=1.0).collect())
    assert {k: [x[1] for x in w] for k, w in got.items()} == {k: [x[1] for x in w] for k, w in want.items()}
    assert all(np.isclose(a[2], b[2]) for k in got for a, b in zip(got[k], want[k]))
    some = listed(multi_index.search(frame, "vec_id % 20 = 0", share=0.3, least=200).collect())
    assert all(len(x) == 20 for x in some.values())
    zero = spark.createDataFrame([(20, [0.0, 0.0], 1, "x"), (40, [1.0, 0.0], 1, "x"), (41, [1.0, 1.0], 1, "x")], SCHEMA)
    assert listed(multi_index.search(zero, "vec_id % 20 = 0").collect()) == {40: [(1, 41, 1.0)]}


def test_recall_of_the_query(spark):
    t = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas()
    want = brute(t.vec_id.to_numpy(), np.stack(t.embedding).astype(np.float64), 20)
    got = listed(queries.op6(spark, FOLDER).collect())
    hits = sum(len({x[1] for x in want[k]} & {x[1] for x in got[k]}) for k in want)
    assert hits >= 0.9 * 20 * len(want)


def test_walk_is_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=7), rng.normal(size=5)
    sizes = rng.integers(0, 4, (7, 5))
    score = a[:, None] + b[None, :]
    for enough in (1, 10, 1000):
        met = multi_index.walk(a, b, sizes, enough)
        order = np.argsort(-score.ravel())
        rows, want = 0, np.zeros(35, bool)
        for c in order:
            if rows >= enough:
                break
            want[c] = sizes.ravel()[c] > 0
            rows += sizes.ravel()[c]
        assert (met.ravel() == want).all()


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert knn_join.knn_join(none, "vec_id % 20 = 0").count() == 0
    assert multi_index.search(none, "vec_id % 20 = 0").count() == 0
