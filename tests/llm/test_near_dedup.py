"""Near copies against all pairs, and odd rows."""

import random
import re

import pytest

from leafgraph.llm import near_dedup, queries

FOLDER = "/root/testdata/sf0.001"


def sets_of(texts, words):
    out = {}
    for key, text in texts.items():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out[key] = {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    return out


def brute(texts, words):
    sets = sets_of(texts, words)
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    by = {}
    for k, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(k)
    pairs = {(a, b) for keys in by.values() for a in keys for b in keys if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {(k, len(s), root(k), root(k) == k) for k, s in sets.items()}


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert {tuple(r) for r in queries.op7(spark, FOLDER).collect()} == brute(texts, 2)


@pytest.mark.parametrize("words", [2, 5])
def test_groups_of_near_copies(spark, words):
    rnd = random.Random(words)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, key = {}, 0
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 150))]
        for _ in range(rnd.randint(1, 12)):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 6])):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            texts[key] = " ".join(own)
            key += 1
    drift = [f"d{i}" for i in range(120)]  # a chain: neighbours are alike, ends are not
    for i in range(25):
        drift[(i * 4) % 120] = f"e{i}"
        texts[key] = " ".join(drift)
        key += 1
    texts |= {key: None, key + 1: "", key + 2: " \t", key + 3: "One", key + 4: "one", key + 5: "x " * 20_000}
    ids = list(texts)
    rnd.shuffle(ids)
    frame = spark.createDataFrame([(i, texts[i], "x", 1) for i in ids], "doc_id long, text string, rep string, key int")
    assert {tuple(r) for r in near_dedup.near_copies(frame, words).collect()} == brute(texts, words)


def test_nulls_repeats_and_empty(spark):
    schema = "doc_id long, text string"
    rows = [(None, "a b c"), (None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c"), (3, None)]
    got = sorted(near_dedup.near_copies(spark.createDataFrame(rows, schema), 2).collect(), key=lambda r: (r.doc_id or 0))
    assert [(r.doc_id, r.component_id, r.kept) for r in got] == [
        (None, None, True), (None, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert near_dedup.near_copies(spark.createDataFrame([], schema), 2).count() == 0


def test_posterior_bounds_rise():
    least = near_dedup.least_agreements(0.8, 1e-7)
    assert list(least) == sorted(least) and least[0] > 0 and least[-1] < 0.8 * near_dedup.HASHES


def test_one_doc_id_on_two_texts(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    a = [word() for _ in range(60)]
    alike = " ".join([*a[:-1], "changed"])
    other = " ".join(word() for _ in range(60))
    schema = "doc_id long, text string, gone long, t string, n string, _gone_id long"
    rows = [(3, alike, 1, "x", None, 3), (5, " ".join(a), 2, "y", None, 5), (5, other, 3, "z", None, 5), (None, other, 4, None, None, None), (9, None, 5, None, None, 9)]
    frame = spark.createDataFrame(rows, schema)
    got = sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles, r.kept) for r in near_dedup.near_copies(frame, 2).collect())
    assert got == [(0, 0, 59, True), (3, 3, 59, True), (5, 3, 59, False), (5, 5, 59, True), (9, 9, 0, True)]
    kept = near_dedup.without_near_copies(frame, 2)
    assert kept.columns == frame.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], *rows[2:]], key=str)
    assert near_dedup.without_near_copies(spark.createDataFrame([], schema)).count() == 0


def test_large_groups_and_blocks(spark, monkeypatch):
    """Stars and blocks of a few members, hot labels, and stragglers that only other members reach."""
    for name, size in (("BLOCK", 4), ("STAR", 3), ("KEPT_BYTES", 2_000)):
        monkeypatch.setattr(near_dedup, name, size)
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    texts, key = {}, 0
    for size, changes in ((40, 2), (25, 5), (3, 1), (12, 9)):
        base = [rnd.choice(vocabulary) for _ in range(100)]
        for _ in range(size):
            own = list(base)
            for _ in range(rnd.randint(0, changes)):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            texts[key] = " ".join(own)
            key += 1
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {tuple(r) for r in near_dedup.near_copies(frame, 2).collect()} == brute(texts, 2)
