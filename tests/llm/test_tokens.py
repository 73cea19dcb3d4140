"""Split pattern, byte-level BPE and packing against the tokenizers' own libraries."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from leafgraph.llm import bpe, packing, queries
from leafgraph.llm import text_arrays as A
from leafgraph.llm.word_ids import WordIds

FOLDER = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = list("abstrevmld'' \n\t\r19²½_-.,é ß\xa0　日本😀\x1c\x85 ") + ["'s", "'re", "'ll", "'ve"]


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 30))) for _ in range(n)] + ["", " ", "a", "\n\n"]


def test_pretokens_are_the_matches_of_the_pattern():
    texts = odd_texts(20_000)
    data, off = A.utf8(pa.array(texts))
    s, e = A.pretokens(data, off)
    want = [x for t in texts for x in regex.findall(public_tokenizers.PATTERN, t)]
    assert [bytes(data[a:b]).decode() for a, b in zip(s, e)] == want


def test_words_and_names():
    texts = odd_texts(5_000, 2) + [None]
    data, off = A.utf8(pa.array(texts))
    s, e = A.words(data, off)
    got = [bytes(data[a:b]).decode() for a, b in zip(s, e)]
    assert got == [x for t in texts if t for x in regex.findall(r"[^\x20\x09-\x0D]+", t)]
    names = A.names(data, s, e).tolist()
    assert len(set(names)) == len(set(got)) == len(set(zip(names, got)))


def frame(spark, texts):
    rows = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


@pytest.fixture(scope="module")
def texts():
    return [*odd_texts(300, 3), None, "same", "same", "x" * 30_000, "<|endoftext|>", "word " * 5_000]


def test_bpe_matches_the_library(spark, texts):
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rows = bpe.decode(bpe.encode(frame(spark, texts), RANKS), RANKS).collect()
    got = sorted((r.doc_id or -1, list(r.ids), bytes(r.decoded)) for r in rows)
    want = sorted(((i if i % 7 else None) or -1, lib.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts))
    assert got == want


def test_bpe_query(spark):
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    want = set()
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        ids = lib.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert {tuple(r) for r in queries.op10(spark, FOLDER).collect()} == want


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_of_one_name(spark, monkeypatch):
    """Texts whose sums of powers agree, and words that are given one name on purpose."""
    import tiktoken
    from tokenizers import Tokenizer

    twins = [thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")]
    data, off = A.utf8(pa.array(twins))
    assert len(set(A.names(data, off[:-1], off[1:]).tolist())) == 2
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    assert lib.encode_ordinary(twins[0]) != lib.encode_ordinary(twins[1])
    rows = spark.createDataFrame([(i + 1, t, "x") for i, t in enumerate(twins)], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in bpe.encode(rows, RANKS).collect()}
    assert got == {i + 1: lib.encode_ordinary(t) for i, t in enumerate(twins)}
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = Tokenizer.from_file(path)
    check_packs(packing.pack(rows, path).withColumn("ids_crc32", F.crc32("ids")).collect(), {i + 1: packed.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(twins)})
    # Every name alike: nothing may be confused, in one batch or over batches.
    monkeypatch.setattr(A, "names", lambda d, s, e: np.full(len(s), 7, np.uint64))
    words = WordIds(bpe.Merger(RANKS).encode)
    for text in ("one two one", "two three one", "four"):
        data, off = A.utf8(pa.array([text]))
        s, e = A.pretokens(data, off)
        assert words.gather(*words.of(data, s, e)).tolist() == lib.encode_ordinary(text)


def test_decoding_of_long_lists(monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 7)
    merger = bpe.Merger(RANKS)
    lists = [[1, 2, 3], [], list(range(100, 150)), [5], list(range(40, 54))]
    token = {n: t for t, n in bpe.read_ranks(RANKS).items()}
    got = merger.decode(np.array([len(x) for x in lists]), np.array([x for y in lists for x in y]))
    assert got == [b"".join(token[x] for x in y) for y in lists]


def test_cuts():
    n = np.array([1, 2, 3, 1023, 1024, 1025, 5000])
    doc, start, length = packing.cuts(n, 1024)
    for i, x in enumerate(n):
        own = length[doc == i]
        assert own.sum() == x and all(v & (v - 1) == 0 for v in own) and list(own) == sorted(own, reverse=True)
        assert list(start[doc == i]) == list(np.cumsum(own) - own)


def check_packs(rows, ids_of):
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert len({r.sequence_id for r in rows}) == len(rows)
    for key, ids in ids_of.items():
        at = 0
        for r in sorted(by[key], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length & (r.length - 1) == 0
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at:at + r.length]))
            at += r.length
        assert at == len(ids)
    assert set(by) == set(ids_of)


def test_packing_query(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    ids_of = {r.doc_id: lib.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs}
    check_packs(queries.op8(spark, FOLDER).collect(), ids_of)


def test_packing_odd_rows(spark, texts):
    rows = packing.pack(frame(spark, texts), public_tokenizers.path("byte_bpe_50k.json"), longest=8).collect()
    assert max(r.length for r in rows) == 8
    whole = sum(r.length for r in rows)
    first = [r for r in rows if r.start == 0]
    assert len(first) == len(texts) and whole == sum(r.doc_tokens for r in first)
    assert all(len(r.ids) == 4 * r.length and 1 << r.bucket == r.length for r in rows)


def test_empty_table(spark):
    none = frame(spark, [])
    assert bpe.decode(bpe.encode(none, RANKS), RANKS).count() == 0
    assert packing.pack(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(none, "x", longest=1000)
