"""Repeated passages against every window of every text."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from leafgraph.llm import queries, repeats

FOLDER = "/root/testdata/sf0.001"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, bytes(x for x, g in zip(d, gone) if not g)))
    return out


def odd_corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rnd.randint(5, 60)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [rnd.choice(passages) if rnd.random() < 0.4 else prose(rnd.randint(1, 30)) for _ in range(rnd.randint(1, 6))]
        texts.append(" ".join(parts))
    texts += [texts[0], texts[1], texts[1], texts[2][:-3], "x" + texts[3], "ab" * 200, "ab" * 150, "z" * 500, "é" * 90, None, "", "a"]
    return texts


@pytest.mark.parametrize("together", [1000, 2])
@pytest.mark.parametrize("seed, length, kernel", [(1, 60, 16), (2, 200, 64), (3, 24, 24)])
def test_against_every_window(spark, seed, length, kernel, together):
    texts = odd_corpus(seed)
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, low int")
    got = {r.doc_id: (r.n_bytes, sum(x.end - x.start for x in r.removed), len(r.removed), bytes(r.kept)) for r in repeats.cut_out(frame.repartition(5), length=length, kernel=kernel, together=together).collect()}
    assert got == dict(enumerate(brute(texts, length)))


def test_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    want = {(r.doc_id, n, m, s, hashlib.sha256(k).hexdigest()) for r, (n, m, s, k) in zip(rows, brute([r.text for r in rows], 200))}
    assert {tuple(r) for r in queries.op5(spark, FOLDER).collect()} == want


def test_keys_repeats_and_empty(spark):
    one, two = " ".join(map(str, range(100))), " ".join(map(str, range(500, 600)))
    rows = [(None, one), (None, two), (7, one + two), (7, "short"), (8, two), (8, two), (9, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_bytes, bytes(r.kept)) for r in repeats.cut_out(frame).collect()))
    assert got == sorted([(0, len(one), b""), (0, len(two), b""), (7, len(one + two), b""), (7, 5, b"short"), (8, len(two), b""), (8, len(two), b""), (9, 0, b"")])
    assert repeats.cut_out(frame.limit(0)).count() == 0


def test_text_keeps_whole_characters(spark):
    same = "é" * 150
    frame = spark.createDataFrame([(1, "ö" + same + "a", 1), (2, "ü" + same + "ß", 2)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in repeats.without_repeats(frame).collect()}
    assert got == {1: ("a", 1), 2: ("", 0)} or all(len(t) == n and "é" not in t for t, n in got.values())


def test_clashing_names(spark):
    names = ["kept", "d1", "d2", "spans", "packed", "n_bytes", "removed"]
    frame = spark.createDataFrame([(i, "ab" * 150, *names) for i in (1, 2)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    assert sorted(tuple(r) for r in repeats.without_repeats(frame).collect()) == [(i, "", *names) for i in (1, 2)]


def test_edges_of_tasks():
    f, t = False, True
    whole, on = repeats.decide(*(np.array(x) for x in ([f, t, t, t, f], [f, f, t, t, f], [t, t, t, f, f], [f, t, t, f, f])))
    assert whole.tolist() == [f, t, t, t, f] and on.tolist() == [t, t, f, f, f]
