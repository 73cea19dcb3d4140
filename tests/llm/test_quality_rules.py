"""Counts against plain Python, sketches and their merging, odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from leafgraph.llm import quality_rules as Q
from leafgraph.llm import text_arrays as A

SCHEMA = "doc_id long, text string, lang string, source string, rate string, kept string, n_docs int"


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    again = {i + d for i in range(len(w) - 2) if at[tuple(w[i:i + 3])] > 1 for d in range(3)}
    return [len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(again)]


def odd_texts():
    rnd = random.Random(5)
    parts = ["a", "b", "é", "日", "x#", "|", " ", " ", "\n", "\n", "\t", "\r", "a b a", "\x0b"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(2_000)]
    return texts + [None, "", "\n", "a", "a b", "\n\na\n\na", "a b c " * 5_000, "w" * 100_000]


@pytest.mark.parametrize("size", [50, 1 << 20])
def test_counts(size, monkeypatch):
    texts = odd_texts()
    data, off = A.utf8(pa.array(texts))
    got = []
    for i, j in A.runs(off, size):
        got += np.array(Q.counts(data[off[i]:off[j]], off[i:j + 1] - off[i])).T.tolist()
    assert got == [plain(t) for t in texts]


def quantile(values, q):
    """The bucket that holds the least value with at least q quarters of all at or below it."""
    v = sorted(values)[-(-q * len(values) // 4) - 1]
    shift = max(v.bit_length() - Q.DIGITS, 0)
    return v >> shift << shift


def judged(rows, least):
    """A plain version of the whole."""
    own = [(plain(r[1]), r[2], r[3]) for r in rows]
    failed = [n[0] < 50 or 100 * n[5] > 50 * n[0] for n, _, _ in own]
    rates = [(100 * n[1] // n[0], 1000 * n[2] // n[0], 1000 * n[4] // n[3], 1000 * n[5] // n[0]) if n[0] else None for n, _, _ in own]
    out = []
    for i, (_, lang, source) in enumerate(own):
        if failed[i]:
            out.append((True, False))
            continue
        ok = [j for j in range(len(own)) if not failed[j]]
        group = [j for j in ok if own[j][1:] == (lang, source)]
        if len(group) < least:
            group = [j for j in ok if own[j][1] == lang]
        if len(group) < least:
            group = ok
        kept = True
        for k, (_, allowance, lower) in enumerate(Q.RATES.values()):
            q1, q3 = (quantile([rates[j][k] for j in group], q) for q in (1, 3))
            reach = max(Q.REACH * (q3 - q1), allowance)
            kept &= rates[i][k] <= q3 + reach and (not lower or rates[i][k] >= q1 - reach)
        out.append((False, kept))
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(8)
    out = []
    for i in range(700):
        source = "hot" if i % 3 else rnd.choice(["a", "b", None, "c"])
        lang = rnd.choice(["en", "en", "en", "de", None])
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(30, 120))]
        kind = rnd.randint(0, 12)
        if kind == 0:
            words = [w + "###" for w in words]
        elif kind == 1:
            words = [w * 3 for w in words]
        elif kind == 2:
            words = words[:9] * 9
        sep = "\n" if kind == 3 else " "
        out.append((i if i % 50 else None, sep.join(words), lang, source, "x", "y", 7))
    return out + out[:5] + [(9_000, None, "en", "a", None, None, None), (9_001, "", None, None, None, None, None)]


@pytest.mark.parametrize("least", [1, 20, 10_000])
def test_verdicts(spark, rows, least):
    want = judged(rows, least)
    assert len(set(want)) == 3
    got = Q.quality(spark.createDataFrame(rows, SCHEMA), least).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    left = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got), key=key)
    right = sorted(((r[0], *plain(r[1]), *w) for r, w in zip(rows, want)), key=key)
    assert left == right


def test_groups_by_key_give_the_same(spark, rows, monkeypatch):
    frame = spark.createDataFrame(rows, SCHEMA)
    order = lambda out: sorted(map(tuple, out.collect()), key=str)
    first = order(Q.quality(frame, 20))
    monkeypatch.setattr(Q, "HEAVY", 0)
    assert order(Q.quality(frame, 20)) == first


def test_sketches_merge(spark, rows):
    counts = Q.counted(spark.createDataFrame(rows, SCHEMA))
    parts = [Q.sketches(counts.where(f"n_words % 2 = {i}")) for i in (0, 1)]
    got = Q.merged(parts[0].unionByName(parts[1]), "lang", "source")
    order = lambda x: sorted(map(tuple, x.select("lang", "source", "rate", "bucket", "n").collect()), key=str)
    assert order(got) == order(Q.sketches(counts))


def test_empty(spark):
    assert Q.quality(spark.createDataFrame([], SCHEMA)).count() == 0
    few = Q.quality(spark.createDataFrame([(1, "too short", "en", "a", "x", "y", 1)], SCHEMA)).collect()
    assert [(r.doc_id, r.base_failed, r.kept) for r in few] == [(1, True, False)]
