"""Fixed patterns against a plain reading of them, and the weakly supervised rest."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from leafgraph.llm import personal_data as P
from leafgraph.llm import queries

FOLDER = "/root/testdata/sf0.001"


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def plain(text):
    text, out = text or "", []
    only = lambda m: re.sub("[^0-9]", "", m[0])
    checks = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(only(m)) <= 19 and luhn(only(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(only(m)) <= 15),
    )
    for kind, (pattern, good) in enumerate(checks):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if good(m)]
    return sorted(out)


def odd_texts(n):
    rnd = random.Random(5)
    parts = ["a@b.c", "x_y.z@mail-1.example.com", "@", ".", "..", "a.b", " ", "-", "1.2.3.4", "300.1.1.1", "001.002.003.004", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111",
             "4111-1111-1111-1111", "4111111111111112", "+1 (555) 010-9999", "+49-", "+1 2", "12", "7", "é", "😀", "(", ")", "+", "0", "%", "at", "tel ", "\n"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(n)]


def test_patterns(spark):
    texts = [*odd_texts(3000), None, "", "9" * 50_000, "a" * 50_000 + "@", "1 " * 20_000, "+1" + " " * 30_000, "1." * 20_000, "a@b" + ".c" * 10_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(x.start, x.kind, x.end) for x in r.base] for r in P.candidates(frame).select("doc_id", "base").collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain(t), t[:200]


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op4(spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain(docs[r.doc_id])
        names = [f"{P.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert set(names) <= set(r.spans.split(",")) or not names


def people(spark):
    rnd = random.Random(3)
    texts = []
    for i in range(400):
        texts.append(f"Contact: user{i}@mail.example.com or tel +1 (555) 010-{rnd.randint(1000, 9999)} now")
        texts.append(f"Write to john.doe{i} (at) example (dot) com today")
        texts.append(f"see version 10 200 {rnd.randint(100, 999)} 44 of x{i} and look at the.end of it")
    return texts


def test_votes_find_more(spark):
    texts = people(spark)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in P.personal_spans(frame).collect()}
    spelled = [rows[i] for i in range(1, len(texts), 3)]
    assert all(len(r.base) == 0 and [x.kind for x in r.spans] == [0] for r in spelled)
    assert all(len(r.spans) == 2 for i, r in rows.items() if i % 3 == 0)
    assert all(len(r.spans) == 0 for i, r in rows.items() if i % 3 == 2)


def test_expectation_maximisation_finds_reliable_labelers(spark):
    rnd = random.Random(1)
    counts, truth = {}, {}
    for _ in range(20_000):
        y = rnd.random() < 0.4
        v = "".join("n" if rnd.random() < 0.3 else str(int(y if rnd.random() < r else not y)) for r in (0.95, 0.9, 0.9, 0.8, 0.7, 0.55))
        key = str(rnd.randrange(4)) + v
        counts[key] = counts.get(key, 0) + 1
        truth.setdefault(key, []).append(y)
    got = {r.key: r.p for r in P.accepted(spark.createDataFrame(list(counts.items()), "key string, n long")).collect()}
    right = sum(sum(y == (got[k] >= 0.5) for y in ys) for k, ys in truth.items())
    assert right / 20_000 > 0.9


def test_masked(spark):
    rows = [(1, "at a@b.c, ip 1.2.3.4 é", "en", 5), (2, None, None, None), (2, "clean", "x", 5), (None, "+1 555 010 9999", "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, base string, n_chars long")
    got = sorted(((r.doc_id or 0, r.text, r.n_chars) for r in P.masked(frame).collect()))
    assert got == sorted([(1, "at [EMAIL], ip [IP] é", 21), (2, "", 0), (2, "clean", 5), (0, "[PHONE]", 7)])


def test_clashing_names(spark):
    names = ["base", "loose", "spans", "key", "x"]
    frame = spark.createDataFrame([(1, "mail a@b.c", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    assert [tuple(r) for r in P.masked(frame).collect()] == [(1, "mail [EMAIL]", *names)]


def test_empty(spark):
    assert P.personal_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
