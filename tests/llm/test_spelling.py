"""Near words against all pairs, runs and slips against plain Python, forms and roots, odd words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from leafgraph.llm import spelling as S

WORDS = "word string, n long"
DOCS = "doc_id long, text string, word string, n string, id int, run int, h int"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def pairs(words):
    return {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def edited(word, rnd, letters):
    i = rnd.randrange(len(word))
    return rnd.choice([word[:i] + word[i + 1:], word[:i] + rnd.choice(letters) + word[i + 1:], word[:i] + rnd.choice(letters) + word[i:]])


def vocabulary(seed, n=500, letters="abcdeéß÷"):
    rnd = random.Random(seed)
    found = {"".join(rnd.choice(letters) for _ in range(rnd.randint(6, 12))) for _ in range(n)}
    for w in sorted(found):
        for _ in range(rnd.randint(0, 3)):
            found.add(edited(w, rnd, letters))
    long = "ab" * 3_000
    found |= {long, long[1:], "c" + long[1:], long[:-2], "aaaaaaaa", "aaaaaaaaa", "aaaaaaab", "aabaaaaa"}
    return {w: rnd.choice([5, 6, 30, 150, 800]) for w in sorted(found)}


@pytest.mark.parametrize("leaf_words", [3, 50, 20_000])
def test_near_words(spark, leaf_words):
    n = vocabulary(leaf_words)
    got = [tuple(r) for r in S.near_words(spark.createDataFrame(list(n.items()), WORDS), leaf_words=leaf_words).collect()]
    assert len(got) == len(set(got))
    assert {tuple(sorted((a, b))) for a, _, b, _ in got} == pairs(n)
    assert all(n[a] == x and n[b] == y for a, x, b, y in got)


def test_words_of_one_leaf(spark):
    """Anagrams share all their counts, so their shard is met in blocks."""
    rnd = random.Random(3)
    found = sorted({"".join(rnd.sample("aabbccdd", 8)) for _ in range(300)} | {"aabbccde", "abbccdd", "aabbccddd"})
    got = S.near_words(spark.createDataFrame([(w, 5) for w in found], WORDS), leaf_words=20).collect()
    assert {tuple(sorted((r.a, r.b))) for r in got} == pairs(found)


def test_one_edit_is_exact():
    rnd = random.Random(1)
    a = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 6))) for _ in range(3_000)]
    b = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 6))) for _ in range(3_000)]
    at = np.arange(3_000)
    got = S.one_edit(*S._code_points(pa.array(a)), *S._code_points(pa.array(b)), at, at)
    assert got.tolist() == [one_edit(x, y) for x, y in zip(a, b)]


def test_pruning():
    """Most words are never compared."""
    words = pa.array(list(vocabulary(9, 4_000, "abcdefghijklmnop")))
    table = np.arange(256) % S.GROUPS
    counts = S.vectors(words, table, S.GROUPS)
    keys = np.sort(S.packed(counts))
    _, lo, hi = S.search(counts, keys)
    assert len(words) <= (hi - lo).sum() < 0.01 * len(words) ** 2


def plain_words(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def test_words(spark):
    rnd = random.Random(4)
    known = ["Straße", "ÉCOLES", "éCOLES", "garden", "Gardens", "short", "x×y÷zzz", "日本語", "naïveté", "égalité"]
    rows = [(i if i % 9 else None, rnd.choice(" -1\n").join(rnd.choice(known) for _ in range(rnd.randint(0, 40)))) for i in range(1_000)]
    rows += [(7, None), (8, ""), (9, "a" * 100_000), *rows[:3]]
    frame = spark.createDataFrame([(*r, "x", "y", 1, 2, 3) for r in rows], DOCS)
    want = plain_words(rows)
    assert {r.word: r.n for r in S.words(frame).collect()} == want
    assert any(len(w) == 6 and w + "s" in want for w in want) and len(want) > 8


def test_forms_and_roots(spark):
    rows = [("gardens", 5), ("garden", 30), ("gardex", 30), ("gardan", 200), ("gurdan", 1_000), ("island", 10), ("islend", 49), (None, 3)]
    got = {r.word: tuple(r)[1:] for r in S.variants(spark.createDataFrame(rows, WORDS)).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    assert got == {
        "gardens": (5, 1, "garden", 30, "gurdan"),  # the only near word
        "garden": (30, 3, "gardan", 200, "gurdan"),
        "gardex": (30, 1, None, None, "gardex"),
        "gardan": (200, 2, "gurdan", 1_000, "gurdan"),
        "gurdan": (1_000, 1, None, None, "gurdan"),
        "island": (10, 1, None, None, "island"),
        "islend": (49, 1, None, None, "islend"),
    }
    tie = [("abcdef", 5), ("abcdez", 30), ("abcdeé", 30)]
    assert {r.word: r.form for r in S.variants(spark.createDataFrame(tie, WORDS)).collect()}["abcdef"] == "abcdez"


def test_empty(spark):
    none = S.words(spark.createDataFrame([], DOCS))
    assert S.variants(none).count() == 0
    one = S.variants(spark.createDataFrame([("garden", 5)], WORDS)).collect()
    assert [(r.word, r.n_near, r.form, r.root) for r in one] == [("garden", 0, None, "garden")]
