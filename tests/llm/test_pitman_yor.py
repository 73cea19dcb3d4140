"""Counts and base scores against plain ones; the model by what it must satisfy."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from leafgraph.llm import pitman_yor as M
from leafgraph.llm import queries
from leafgraph.llm.packed import packed, unpacked

FOLDER = "/root/testdata/sf0.001"


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in docs}
    c = Counter(x for k, t in docs.items() if not held[k] for x in tokens(t))
    n, v = sum(c.values()), len(c)
    rows = queries.op3(spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        own = tokens(docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(c[x] > 0 for x in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own), rel_tol=1e-9)
        assert r.score < 0
    for side in (True, False):
        base, score = (sum(r[x] for r in rows if r.held_out == side) for x in ("base_score", "score"))
        assert score > base


def test_probabilities_sum_to_one(spark):
    rows = [(i, t) for i, t in enumerate(["the cat sat", "the dog sat on the cat", "a cat", None, "the the the"] * 4)]
    docs = M.keyed(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("held_out", F.col("doc_id") == 1)
    words, of = M.fit(docs)
    rows = words.collect()
    assert of["train_tokens"] == sum(r.c for r in rows) and of["distinct"] == sum(r.c > 0 for r in rows)
    # One token more, which was not seen, has the rest.
    seen = np.array([r.p for r in rows if r.c > 0]).sum(0)
    assert ((0.7 < seen) & (seen < 1.0)).all()
    n = np.array([[3.0, 1, 0], [0, 0, 2], [0, 0, 0]])
    t = np.minimum(n, 1)
    totals = {"c": n.sum(0), "t": t.sum(0), "parent_c": t.sum(), "parent_t": 2, "distinct": 2}
    p = M.predictive(n, t, t.sum(1), np.array([1, 1, 0]), totals)
    assert np.allclose(p.sum(0), 1)


def test_context_is_the_last_frequent_token():
    mark = np.array([-1, 2, -1, -1, 3, -1, -1])
    doc = np.array([0, 0, 0, 0, 0, 1, 1])
    assert M._last_marks(mark, doc).tolist() == [-1, -1, 2, 2, 2, -1, -1]


def test_seating():
    rng = np.random.default_rng(1)
    n = np.array([0, 1, 5, 63, 64, 65, 1000, 10**9])
    t = M.seat(n, np.full(len(n), 0.001), 50.0, 0.5, rng)
    assert t[0] == 0 and t[1] == 1 and (t <= n).all() and (t[1:] >= 1).all()
    # Groups of customers give what single ones give.
    many = np.full(4000, 400)
    grouped = M.seat(many, np.full(4000, 0.01), 200.0, 0.5, rng).mean()
    tables = np.ones(4000)
    for k in range(1, 400):
        tables += rng.random(4000) * (2.0 + k - 0.5 * tables) < 2.0
    assert abs(grouped - tables.mean()) < 0.03 * tables.mean()


def test_odd_rows(spark):
    rows = [(None, "a b", "x"), (None, None, "x"), (5, "a a", "y"), (5, "a a", "y"), (5, "c", "z"), (6, "long " * 20_000, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens) for r in M.score(frame, F.col("doc_id") == 6).collect())
    assert got == [(0, 1, 1, 12), (0, 3, 3, 12), (5, 2, 2, 12), (5, 3, 3, 12), (5, 3, 3, 12), (6, 20_001, 1, 12)]
    assert M.score(frame.limit(0), F.lit(False)).count() == 0
    every = M.score(frame, F.lit(True)).collect()
    assert len(every) == 6 and all(r.score == 0 == r.base_score for r in every)


def test_context_is_the_token_before(spark):
    texts = ["a b a c", "b a b b a", "c", None, "z a b", "x y x y x", "a b a c"]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    train = [[None, *tokens(t)] for i, t in rows if i != 4]
    c = Counter((u, w) for t in train for u, w in zip(t, t[1:]))
    size, tables, customers = Counter(), Counter(), Counter()
    for (u, w), n in c.items():  # one table a pair, as before the first sweep
        size[u] += n
        tables[u] += 1
        customers[w] += 1
    (d, th), (d0, th0), v = M.CONTEXT, M.PARENT, len(customers)

    def log(u, w):
        p0 = (customers[w] - d0 * (w in customers) + (th0 + d0 * v) / (v + 1)) / (th0 + len(c))
        return math.log10((c[u, w] - d * ((u, w) in c) + (th + d * tables[u]) * p0) / (th + size[u]))

    for frequent in (M.FREQUENT, 0.1, 0.2, 1.1):  # all, some or no tokens are sent to every task
        got = {r.doc_id: r.score for r in M.score(frame, F.col("doc_id") == 4, 0, frequent).collect()}
        for i, t in rows:
            own = [None, *tokens(t)]
            assert math.isclose(got[i], sum(log(u, w) for u, w in zip(own, own[1:])), rel_tol=1e-9), (i, frequent)
    # Seated, with all or none of the tokens joined by key, the scores agree but for the draws.
    a, b = ({r.doc_id: r.score for r in M.score(frame, F.col("doc_id") == 4, 4, f).collect()} for f in (M.FREQUENT, 1.1))
    assert all(abs(a[i] - b[i]) < 0.15 * abs(a[i]) for i in a)


def test_hot_pairs_and_rare_tokens(spark):
    texts = ["x y " * 300, "x y " * 90 + "rare", "rare once x", "y x", "again rare x y", "once again"]
    rows = [(i, t) for i, t in enumerate(texts)]
    train = [[None, *tokens(t)] for i, t in rows if i != 3]
    c = Counter((u, w) for t in train for u, w in zip(t, t[1:]))
    size, tables, customers = Counter(), Counter(), Counter()
    for (u, w), n in c.items():
        size[u] += n
        tables[u] += 1
        customers[w] += 1
    (d, th), (d0, th0), v = M.CONTEXT, M.PARENT, len(customers)

    def log(u, w):
        p0 = (customers[w] - d0 * (w in customers) + (th0 + d0 * v) / (v + 1)) / (th0 + len(c))
        return math.log10((c[u, w] - d * ((u, w) in c) + (th + d * tables[u]) * p0) / (th + size[u]))

    counts = Counter(x for t in train for x in t[1:])
    n = sum(counts.values())
    for frequent in (M.FREQUENT, 0.01, 1.1):
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        got = {r.doc_id: r for r in M.score(frame, F.col("doc_id") == 3, 0, frequent).collect()}
        for i, t in rows:
            own = [None, *tokens(t)]
            assert math.isclose(got[i].score, sum(log(u, w) for u, w in zip(own, own[1:])), rel_tol=1e-9), (i, frequent)
            assert math.isclose(got[i].base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own[1:]), rel_tol=1e-9)
            assert got[i].n_known == sum(counts[w] > 0 for w in own[1:])


def test_scores_do_not_depend_on_the_split(spark):
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    for frequent in (M.FREQUENT, 1e-3):
        one, many = ({r.doc_id: r for r in M.score(frame.repartition(n), held_out, frequent=frequent).collect()} for n in (1, 4))
        assert one.keys() == many.keys()
        assert all(math.isclose(one[i].score, many[i].score, rel_tol=1e-9) for i in one)


def test_packed_arrays():
    arrays = [np.array(x) for x in ([], [0], [-1, 3, 1 << 40], [0.5, -2.25], [300, 70_000])]
    arrays[0] = arrays[0].astype(np.int64)
    got = unpacked(packed(*arrays))
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(arrays, got))
