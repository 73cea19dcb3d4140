"""Packing by power-of-two decomposition: no sequence holds two documents, none needs padding.

A document of n ids is cut into n // longest pieces of the longest length and one piece for
each binary digit of the rest, longest first. Pieces of equal length make up a bucket; each
piece is a sequence by itself, its length is a power of two, so nothing is padded.

Null texts count as empty: their only id is the separator. ``doc_id`` may be null or
repeated; sequences are numbered by row, not by it. Other columns are
ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.llm import text_arrays as A
from leafgraph.llm.word_ids import WordIds, per_document

SCHEMA = "doc_id long, start long, length long, bucket int, doc_tokens long, sequence_id long, ids binary"


@lru_cache(2)
def worker(path: str) -> WordIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text

    def encode(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        off = np.frombuffer(words.buffers()[1], np.int64)[:len(words) + 1]
        data = words.buffers()[2].to_pybytes()
        edge = off.tolist()
        lengths, ids = [], []
        for i in range(0, len(words), 20_000):
            some = [data[a:b].decode() for a, b in zip(edge[i:i + 20_000], edge[i + 1:i + 20_001])]
            for x in tokenizer.encode_batch_fast(some, add_special_tokens=False):
                own = x.ids
                lengths.append(len(own))
                ids += own
        return np.array(lengths, np.int64), np.array(ids, np.int32)

    return WordIds(encode)


def cuts(n: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of n > 0 ids: the document, the start and the length of every piece, in order."""
    full, rest = n // longest, n % longest
    digits = [1 << k for k in range(longest.bit_length() - 2, -1, -1)]
    number = full + sum((rest & d) > 0 for d in digits)
    doc = np.repeat(np.arange(len(n)), number)
    length = np.full(len(doc), longest, np.int64)
    first = np.cumsum(number) - number
    at = first + full
    for d in digits:
        has = (rest & d) > 0
        length[at[has]] = d
        at += has
    total = np.cumsum(length) - length
    start = total - np.repeat(total[first], number)
    return doc, start, length


def _pack(path: str, longest: int, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        known = worker(path)
        number = TaskContext.get().partitionId() << 40  # a retried task gives the same numbers
        for batch in batches:
            data, off = A.utf8(batch.column("text"))
            key = batch.column("doc_id")
            for i, j in A.runs(off):
                own, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                s, e = A.pretokens(own, o)
                start, length = known.of(own, s, e)
                text_ids = per_document(length, o, s)
                n = text_ids + 1
                last = np.cumsum(n) - 1
                flat = np.empty(int(n.sum()), "<u4")
                ordinary = np.ones(len(flat), bool)
                ordinary[last] = False
                flat[ordinary] = known.gather(start, length)
                flat[last] = end_id
                doc, at, size = cuts(n, longest)
                edge = np.concatenate([[0], np.cumsum(size)]) * 4
                for a in range(0, len(doc), 200_000):
                    b = min(a + 200_000, len(doc))
                    ids = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((edge[a:b + 1] - edge[a]).astype(np.int32)), pa.py_buffer(flat[edge[a] // 4:edge[b] // 4])])
                    yield pa.RecordBatch.from_arrays(
                        [key.take(pa.array(i + doc[a:b])), pa.array(at[a:b]), pa.array(size[a:b]), pa.array(np.log2(size[a:b]).astype(np.int32)), pa.array(n[doc[a:b]]), pa.array(np.arange(number + a, number + b)), ids],
                        names=["doc_id", "start", "length", "bucket", "doc_tokens", "sequence_id", "ids"],
                    )
                number += len(doc)

    return run


def pack(docs: DataFrame, tokenizer: str, longest: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all documents: where each starts, its ids (32-bit, little-endian), bucket and sequence.

    Each piece is a sequence of its own, numbered by the task that makes it.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pack(tokenizer, longest, end_id), SCHEMA)


def write_buckets(packed: DataFrame, folder: str) -> None:
    """Sequences as Parquet, a folder for each length, so that a reader takes equal lengths together."""
    packed.write.mode("overwrite").partitionBy("bucket").parquet(folder)
