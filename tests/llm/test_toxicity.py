"""Held-out accuracy of the severity model, and odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from leafgraph.llm import queries, toxicity

FOLDER = "/root/testdata/sf0.01"
RUDE = [f"rude{c}" for c in "abcdef"]


def corpus(n, seed=1):
    rnd = random.Random(seed)
    words = ["w" + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(60)]
    docs = []
    for i in range(n):
        own = [rnd.choice(words) for _ in range(rnd.randint(5, 200))]
        k = rnd.choice([2, 4, 9]) if rnd.random() < 0.2 else 0
        for _ in range(k):
            own.insert(rnd.randrange(len(own)), rnd.choice(RUDE).title())
        docs.append((i, " ".join(own), k, int(k > 0)))
    return docs


def test_held_out_documents(spark):
    docs = corpus(3000)
    frame = spark.createDataFrame(docs, "doc_id long, text string, severity int, toxic int")
    labels = spark.createDataFrame([(d[0], d[3], 1) for d in docs[:1500]], "doc_id long, toxic int, quality int")
    model = toxicity.fit(frame.select("doc_id", "text"), labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    held = docs[1500:]
    assert sum(got[d[0]].toxic == (d[3] > 0) for d in held) / len(held) > 0.98
    mean = lambda k: np.mean([got[d[0]].severity for d in held if d[2] == k])
    assert mean(0) < 0.5 < mean(2) < mean(4) < mean(9)
    assert all(0 <= r.severity <= 3 for r in got.values())


def test_fit_is_ordinal():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    score = x @ np.array([2.0, -1.0])
    u = rng.random(4000)
    grade = (score + np.log(u / (1 - u)) > -1).astype(int) + (score + np.log(u / (1 - u)) > 2)
    row, feature = np.divmod(np.arange(8000), 2)
    w, t = toxicity.fit_ordinal(row, feature, x.ravel(), grade, 2, 3)
    assert np.allclose(w, [2, -1], atol=0.25) and np.allclose(t, [-1, 2], atol=0.25)


def test_query(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = queries.op1(spark, FOLDER).collect()
    known = [(labels[r.doc_id], r.toxic) for r in rows if r.doc_id in labels]
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert sum(p for y, p in known if not y) <= 0.02 * len(known)
    assert sum(p for y, p in known if y) >= 0.5 * sum(y for y, _ in known)


def test_odd_rows(spark):
    docs = [(None, "rude"), (1, None), (1, ""), (2, "rudea"), (2, "rudea"), (3, "x " * 50_000)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, grade int, word string")
    labels = spark.createDataFrame([(None, 1, 1), (1, None, 0), (2, 1, 1), (2, 0, 1)], "doc_id long, toxic int, quality int")
    assert toxicity.fit(frame, labels) is None  # of one kind only
    got = toxicity.score(frame, None).collect()
    assert len(got) == 6 and not any(r.toxic or r.severity for r in got)
    clashing = frame.withColumns({n: F.lit("x") for n in ("grade", "toxic", "severity")})
    kept = toxicity.without_toxic(clashing, labels.limit(0)).collect()
    assert len(kept) == 6 and all((r.grade, r.toxic, r.severity) == ("x", "x", "x") for r in kept)
    assert toxicity.score(frame.limit(0), None).count() == 0
