"""Byte-level BPE encoding and decoding with recursive queries of DuckDB in each partition.

A text is cut into words by the split pattern. The distinct words a worker has not met yet
become token-position rows; a recursive query joins each position and its successor to the
merge table and contracts the leftmost pair of least rank in every word, until no word has a
pair left. Decoding joins the ids to the token bytes and puts them together in order.

Null texts count as empty and give no ids. ``doc_id`` may be null or repeated: rows are
never matched by it. Columns besides ``doc_id`` and ``text`` are ignored. A text of any
length is encoded whole; the queries see distinct words, in groups of bounded size.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.llm import text_arrays as A
from leafgraph.llm.word_ids import WordIds, per_document

#: Bytes of words given to one recursive query.
GROUP_BYTES = 1 << 18

#: Ids of one row of the ordered aggregation, and of one such query.
PIECE = 1 << 18

#: Words of more bytes than this are contracted at all equal pairs at once.
LONG_WORD = 64

# Each row is a token: its word, position, successor's position and successor. The least of
# (rank, position) picks one pair a word and step; its second token goes, and its neighbours
# are told. Rows of a word without a pair leave the recursion as they are.
ENCODE = """
WITH RECURSIVE step(w, p, t, next_p, next_t, live) AS (
    SELECT w, p, t, next_p, next_t, true FROM given
    UNION ALL
    SELECT * FROM (
        WITH pair AS MATERIALIZED (
            SELECT s.w, s.p, s.t, s.next_p, s.next_t, m.merged
            FROM step s LEFT JOIN merges m ON m.pair = s.t::BIGINT * 65536 + s.next_t
            WHERE s.live),
        least AS (
            SELECT w, min(merged::BIGINT * 4294967296 + p) AS best,
                arg_min(next_p, merged::BIGINT * 4294967296 + p) AS gone
            FROM pair GROUP BY w),
        cut AS (
            SELECT least.w, best % 4294967296 AS spot, (best // 4294967296)::INT AS merged, gone,
                pair.next_p AS then_p, pair.next_t AS then_t
            FROM least LEFT JOIN pair ON pair.w = least.w AND pair.p = least.gone)
        SELECT pair.w, pair.p,
            CASE WHEN pair.p = spot THEN cut.merged ELSE pair.t END,
            CASE WHEN pair.p = spot THEN then_p ELSE pair.next_p END,
            CASE WHEN pair.p = spot THEN then_t WHEN pair.next_p = spot THEN cut.merged ELSE pair.next_t END,
            spot IS NOT NULL
        FROM pair JOIN cut ON pair.w = cut.w
        WHERE spot IS NULL OR pair.p <> cut.gone))
SELECT w, p, t FROM step WHERE NOT live ORDER BY w, p
"""

# For long words. All pairs of the least rank are contracted in one step, from the left, unless
# a token could merge on at a lower rank than its own (``alone``): then only the leftmost. The
# rows are keyed by position, so that only the last step of each is kept; -1 marks a token gone.
ENCODE_LONG = """
WITH RECURSIVE step(w, p, t, next_t, live) USING KEY (w, p) AS (
    SELECT w, p, t, next_t, true FROM given
    UNION ALL
    SELECT w, p, t, lead(t) OVER (PARTITION BY w, t >= 0 ORDER BY p), t >= 0 AND live FROM (
        WITH pair AS (
            SELECT s.w, s.p, s.t, m.merged, m.alone
            FROM step s LEFT JOIN merges m ON m.pair = s.t::BIGINT * 65536 + s.next_t
            WHERE s.live),
        least AS (
            SELECT w, min(merged::BIGINT * 4294967296 + p) AS best FROM pair GROUP BY w),
        hit AS (
            SELECT pair.w, p, t, merged, best IS NOT NULL AS live,
                row_number() OVER (PARTITION BY pair.w ORDER BY p) AS i,
                coalesce(merged = best // 4294967296 AND (NOT alone OR p = best % 4294967296), false) AS hit
            FROM pair JOIN least ON pair.w = least.w),
        streak AS (
            SELECT *, i - coalesce(max(CASE WHEN NOT hit THEN i END) OVER (PARTITION BY w ORDER BY p), 0) AS run
            FROM hit),
        chosen AS (SELECT *, hit AND run % 2 = 1 AS take FROM streak)
        SELECT w, p, live,
            CASE WHEN take THEN merged WHEN lag(take) OVER (PARTITION BY w ORDER BY p) THEN -1 ELSE t END AS t
        FROM chosen))
SELECT w, p, t FROM step WHERE t >= 0 ORDER BY w, p
"""

DECODE = """
SELECT w, string_agg(hex(v.bytes), '' ORDER BY p) AS bytes
FROM ids JOIN vocabulary v ON v.id = ids.t GROUP BY w ORDER BY w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token of a vocabulary file, one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merger:
    """The merge table and the vocabulary in a DuckDB of one worker."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        rows = [
            (ranks[a], ranks[b], n)
            for token, n in ranks.items()
            for a, b in ((token[:i], token[i:]) for i in range(1, len(token)))
            if a in ranks and b in ranks
        ]
        early = {x for a, b, n in rows for x in (a, b) if x > n}
        self.con = duckdb.connect(config={"threads": "1", "memory_limit": "200MB"})
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        merges = pa.table({
            "pair": pa.array([a * 65536 + b for a, b, _ in rows], pa.int64()),
            "merged": pa.array([n for *_, n in rows], pa.int32()),
            "alone": pa.array([n in early for *_, n in rows]),
        })
        vocabulary = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.con.register("loading", table)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM loading")
            self.con.unregister("loading")

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids, one word after another."""
        off = np.frombuffer(words.buffers()[1], np.int64)[:len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8)
        lengths, ids = [], []
        for i, j in A.runs(off, GROUP_BYTES):
            size = np.diff(off[i:j + 1])
            w = np.repeat(np.arange(j - i, dtype=np.int32), size)
            p = (np.arange(len(w)) - np.repeat(off[i:j] - off[i], size)).astype(np.int32)
            t = self.byte[data[off[i]:off[j]]]
            next_t = np.append(t[1:], np.int32(-1))
            next_t[off[i + 1:j + 1] - off[i] - 1] = -1
            long = np.repeat(size > LONG_WORD, size)
            got = []
            for part, sql in ((~long, ENCODE), (long, ENCODE_LONG)):
                if part.any():
                    self.con.register("given", pa.table({"w": w[part], "p": p[part], "t": t[part], "next_p": p[part] + 1, "next_t": next_t[part]}))
                    got.append(self.con.sql(sql).to_arrow_table())
                    self.con.unregister("given")
            at, flat = (np.concatenate([g[c].to_numpy() for g in got]) for c in ("w", "t"))
            lengths.append(np.bincount(at, minlength=j - i))
            ids.append((flat if len(got) == 1 else flat[np.argsort(at, kind="stable")]).astype(np.int32))
        return np.concatenate(lengths), np.concatenate(ids)

    def decode(self, lengths: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The bytes of each list of ids, put together in order of position.

        A list is given in pieces of bounded length, so that no row of the query is large.
        """
        pieces = np.maximum(-(-lengths // PIECE), 1)
        of = np.repeat(np.arange(len(lengths)), pieces)
        number = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(lengths[of] - number * PIECE, PIECE)
        off = np.concatenate([[0], np.cumsum(size)])
        out: list[list[bytes]] = [[] for _ in lengths]
        for i, j in A.runs(off, PIECE):
            w = np.repeat(np.arange(j - i, dtype=np.int32), size[i:j])
            p = (np.arange(len(w)) - np.repeat(off[i:j] - off[i], size[i:j])).astype(np.int32)
            self.con.register("ids", pa.table({"w": w, "p": p, "t": ids[off[i]:off[j]].astype(np.int32)}))
            got = self.con.sql(DECODE).to_arrow_table()
            self.con.unregister("ids")
            for k, x in zip(of[i + got["w"].to_numpy()].tolist(), got["bytes"].to_pylist()):
                out[k].append(bytes.fromhex(x))
        return [b"".join(x) for x in out]


@lru_cache(2)
def worker(path: str) -> tuple[Merger, WordIds]:
    merger = Merger(path)
    return merger, WordIds(merger.encode)


def _encoded(batch: pa.RecordBatch, known: WordIds):
    """(first, last, ids) of runs of documents, the ids as one list a document."""
    data, off = A.utf8(batch.column("text"))
    for i, j in A.runs(off):
        own, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
        s, e = A.pretokens(own, o)
        start, length = known.of(own, s, e)
        edge = np.concatenate([[0], np.cumsum(per_document(length, o, s))])
        yield i, j, pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(known.gather(start, length)))


def _decoded(column: pa.ListArray, merger: Merger) -> pa.Array:
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)
    return pa.array(merger.decode(np.diff(off), flat[off[0]:off[-1]]), pa.binary())


def _batches(path: str, with_encode: bool, with_decode: bool):
    def run(batches):
        merger, words = worker(path)
        for batch in batches:
            parts = _encoded(batch, words) if with_encode else [(0, batch.num_rows, batch.column("ids"))]
            for i, j, ids in parts:
                columns = {"doc_id": batch.column("doc_id").slice(i, j - i), "ids": ids}
                if with_decode:
                    columns["decoded"] = _decoded(ids, merger)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text)."""
    return _texts(docs).mapInArrow(_batches(vocabulary, True, False), "doc_id long, ids array<int>")


def decode(rows: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids) with ``decoded``, the bytes the ids stand for. Null ids give no bytes."""
    rows = rows.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(_batches(vocabulary, False, True), "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``decode(encode(docs))`` in one pass, with one merge table a worker."""
    return _texts(docs).mapInArrow(_batches(vocabulary, True, True), "doc_id long, ids array<int>, decoded binary")


def ids_text(ids: str) -> Column:
    """Decimal ids joined by one blank."""
    return F.array_join(F.col(ids).cast("array<string>"), " ")
