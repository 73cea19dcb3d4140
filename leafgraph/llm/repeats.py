"""Passages that stand more than once, by prefix doubling over sampled positions.

Every byte covered by a string of ``LENGTH`` bytes that starts anywhere else too is removed.

Ranks of growing lengths 1, 2, 4, ... are pairs of ranks of half the length, formed where the
text lies: rank(2h, i) is a name of (rank(h, i), rank(h, i + h)), and as a name depends on the
bytes alone, equal strings have equal ranks in the whole corpus. Not all positions are
sorted. Of the ranks of ``KERNEL`` bytes within each window of LENGTH bytes the least one is
its anchor; equal windows have equal anchors at equal places, so only anchors are compared.

1. Spark sorts the anchors by (rank of the kernel, rank of all windows that have this anchor).
   Equal neighbours are repeated whole; neighbours with equal kernels only go on; anchors with
   a unique kernel are done. The sort is by range and ends with the place, so that anchors of
   one frequent passage spread over tasks.
2. What goes on, the edges of repeated passages, is taken from the texts, brought together by
   kernel and ranked window by window. Kernels with very many members are instead ranked by
   window over all tasks.

Names have 64 bits, and two of them decide each comparison. Null texts count as empty and
have nothing to remove; no string runs over the end of a document. Rows with equal doc_id
are told apart by their text, and equal rows count as two places. Texts of any length are
handled whole. Extra columns are ignored, or kept by ``without_repeats``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.functions.durable import scratch_folder
from leafgraph.llm import text_arrays as A
from leafgraph.llm.columns import carried

LENGTH = 200
KERNEL = 64
#: Anchors with one kernel that are compared within one task; more are ranked over all tasks.
TOGETHER = 1000

_PAIR = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 24) - 1)


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return A.finish(left * _PAIR + right)


def ranks(data: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Ranks of the strings of the given lengths at every place; only those that fit mean anything."""
    now, k, out = A._byte_codes()[data], 1, {}
    while True:
        for x in lengths:
            if k <= x < 2 * k:
                y = now.copy()
                d = x - k
                if d:
                    y[:-d] = pair(now[:-d], now[d:])
                out[x] = y
        if 2 * k > max(lengths):
            return out
        nxt = now.copy()
        nxt[:-k] = pair(now[:-k], now[k:])
        now, k = nxt, 2 * k


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, kernel: int = KERNEL):
    """(document, first window, windows - 1, anchor - first window, kernel's rank, windows' rank) of every anchor."""
    n = len(data)
    size = np.diff(off)
    if not (size >= length).any():
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    of = ranks(data, (kernel, length))
    bits = _PLACE if n <= 1 << 24 else np.uint64((1 << 32) - 1)
    least = (of[kernel] & ~bits) | np.arange(n, dtype=np.uint64)
    kernels, k = length - kernel + 1, 1
    while 2 * k <= kernels:
        least[:-k] = np.minimum(least[:-k], least[k:].copy())
        k *= 2
    if rest := kernels - k:
        least[:-rest] = np.minimum(least[:-rest], least[rest:].copy())
    fits = np.maximum(size - length + 1, 0)
    doc = np.repeat(np.arange(len(size)), fits)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(fits) - fits, fits) + off[:-1][doc]
    anchor = (least[at] & bits).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(at)) - 1
    low, high, lead = at[start], at[end], anchor[start] - at[start]
    windows = pair(pair(of[length][low], of[length][high]), (lead * 65536 + high - low).astype(np.uint64))
    return doc[start], low - off[:-1][doc[start]], high - low, lead, of[kernel][anchor[start]], windows


ROW = "d1 long, d2 long, low long, span int, lead int, kernel long, windows long"
NAMES = [x.split()[0] for x in ROW.split(", ")]


def keyed(docs: DataFrame) -> DataFrame:
    """With d1 and d2, which tell rows apart that differ in doc_id or text."""
    text, key = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    d2 = F.when(key.isNull(), F.xxhash64(text)).otherwise(F.hash(text).cast("long"))
    return docs.withColumn("text", text).withColumn("d1", F.coalesce(key, F.lit(-1))).withColumn("d2", d2)


def _anchor_batches(length: int, kernel: int):
    def run(batches):
        for batch in batches:
            data, off = A.utf8(batch.column("text"))
            for i, j in A.runs(off, A.RUN_BYTES // 4):
                doc, low, span, lead, own, windows = anchors(data[off[i]:off[j]], off[i:j + 1] - off[i], length, kernel)
                at = pa.array(i + doc)
                yield pa.RecordBatch.from_arrays([
                    batch.column("d1").take(at), batch.column("d2").take(at), pa.array(low), pa.array(span.astype(np.int32)),
                    pa.array(lead.astype(np.int32)), pa.array(own.view(np.int64)), pa.array(windows.view(np.int64))], names=NAMES)

    return run


def decide(prev_k, prev_w, next_k, next_w):
    """(repeated whole, goes on) from equality of kernel and windows with both neighbours."""
    whole = prev_w | next_w
    return whole, (prev_k & ~prev_w | next_k & ~next_w) & ~(prev_w & next_w)


def _neighbour_batches(batches):
    """Decides sorted rows; the first and last of a partition are left to ``_edges``."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    names = [*NAMES, "whole", "on", "edge"]
    held, held_k, held_w, first = None, False, False, True

    def out(table, whole, on, edge):
        n = table.num_rows
        return pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in NAMES), pa.array(whole), pa.array(on), pa.array(np.full(n, edge, np.int64))], names=names)

    def undecided(table, side, k, w):
        """side: 1 the first, 2 the last, 3 both; k, w: equality with the neighbour in this partition."""
        return out(table, np.array([w]), np.array([k]), task * 4 + side)

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        k, w = (table.column(c).to_numpy() for c in ("kernel", "windows"))
        same_k = np.concatenate([[held_k], k[1:] == k[:-1], [False]])
        same_w = np.concatenate([[held_w], (k[1:] == k[:-1]) & (w[1:] == w[:-1]), [False]])
        n = table.num_rows - 1
        if n:
            a = 0
            if first:
                yield undecided(table.slice(0, 1), 1, bool(same_k[1]), bool(same_w[1]))
                a, first = 1, False
            whole, on = decide(same_k[a:n], same_w[a:n], same_k[a + 1:n + 1], same_w[a + 1:n + 1])
            hit = np.flatnonzero(whole | on)
            yield out(table.slice(a, n - a).take(pa.array(hit)), whole[hit], on[hit], -1)
        held, held_k, held_w = table.slice(n, 1), bool(same_k[n]), bool(same_w[n])
    if held is not None:
        yield undecided(held, 3 if first else 2, held_k, held_w)


def _edges(sorted_rows: DataFrame) -> DataFrame:
    """Decisions for the first and last row of every task; there are two a task at most."""
    rows = sorted(sorted_rows.where("edge >= 0").collect(), key=lambda r: r["edge"])
    found = []
    for i, r in enumerate(rows):
        side = r["edge"] % 4
        k, w = [False, False], [False, False]  # before, after
        inner = 1 if side == 1 else 0
        if side != 3:
            k[inner], w[inner] = r["on"], r["whole"]
        for way, j in ((0, i - 1), (1, i + 1)):
            if (side == 3 or way != inner) and 0 <= j < len(rows):
                k[way] = rows[j]["kernel"] == r["kernel"]
                w[way] = k[way] and rows[j]["windows"] == r["windows"]
        whole, on = decide(*(np.array(x) for x in (k[0], w[0], k[1], w[1])))
        if whole or on:
            found.append((*(r[c] for c in NAMES), bool(whole), bool(on), -1))
    return sorted_rows.sparkSession.createDataFrame(found, sorted_rows.schema)


def _segment_batches(length: int):
    """The bytes under all windows of the anchors that go on."""

    def run(batches):
        for batch in batches:
            for text, d1, d2, asked in zip(*(batch.column(c).to_pylist() for c in ("packed", "d1", "d2", "asked"))):
                data = zstandard.decompress(text)
                rows = [(d1, d2, a["low"], a["span"], a["lead"], a["kernel"], data[a["low"]:a["low"] + a["span"] + length]) for a in asked]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))],
                    names=[*NAMES[:-1], "bytes"])

    return run


def _windows(table: pa.Table, length: int):
    """(row, place from the row's first window, anchor - place, rank) of every window of the rows."""
    data = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8)
    count = table["span"].to_numpy().astype(np.int64) + 1
    first = np.cumsum(count + length - 1) - (count + length - 1)
    row = np.repeat(np.arange(len(count)), count)
    i = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, i, table["lead"].to_numpy()[row] - i, ranks(data, (length,))[length][first[row] + i]


def _spans(table: pa.Table, row: np.ndarray, i: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs of consecutive repeated windows, as spans of bytes."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (i[1:] != i[:-1] + 1)
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(row))[:len(start)] - 1
    at = row[start]
    low = table["low"].to_numpy()[at]
    return pa.RecordBatch.from_arrays(
        [table["d1"].combine_chunks().take(pa.array(at)), table["d2"].combine_chunks().take(pa.array(at)), pa.array(low + i[start]), pa.array(low + i[end] + length)],
        names=["d1", "d2", "start", "end"])


def _compare_batches(length: int):
    """Rows sorted by kernel, each kernel's all in this partition."""

    def spans(table):
        row, i, place, rank = _windows(table, length)
        kernel = table["kernel"].to_numpy()[row].view(np.uint64)
        key = pair(pair(kernel, place.astype(np.uint64)), rank)
        _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
        again = n[inverse] > 1
        return _spans(table, row[again], i[again], length)

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            kernel = table["kernel"].to_numpy()
            if not len(kernel):
                continue
            at = int(np.searchsorted(kernel, kernel[-1]))
            held = table.slice(at)
            for a in _cuts(kernel[:at]):
                yield spans(table.slice(*a))
        if held is not None and held.num_rows:
            yield spans(held)

    return run


def _cuts(kernel: np.ndarray, some: int = 2000):
    """Slices of about ``some`` rows that end with a kernel's last row."""
    a = 0
    while a < len(kernel):
        b = len(kernel) if a + some >= len(kernel) else int(np.searchsorted(kernel, kernel[a + some - 1], "right"))
        yield a, b - a
        a = b


def _spread_batches(length: int):
    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                table = pa.Table.from_batches([part])
                row, i, place, rank = _windows(table, length)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("d1").take(at), part.column("d2").take(at), pa.array(table["low"].to_numpy()[row] + i), part.column("kernel").take(at), pa.array(place), pa.array(rank.view(np.int64))],
                    names=["d1", "d2", "start", "kernel", "place", "rank"])

    return run


def _pack_batches(batches):
    """Texts as compressed bytes, for their way to what is known of them."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data, off = A.utf8(batch.column("text"))
        packed = pa.array([pack.compress(data[a:b].tobytes()) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary())
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), packed], names=[*names, "packed"])


def packed(docs: DataFrame) -> DataFrame:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return docs.mapInArrow(_pack_batches, ", ".join([*fields, "packed binary"]))


def repeated_spans(docs: DataFrame, length: int = LENGTH, kernel: int = KERNEL, together: int = TOGETHER) -> DataFrame:
    """(d1, d2, spans) of the documents with anything to remove; spans may overlap. ``docs`` is keyed."""
    spark = docs.sparkSession
    folder = scratch_folder(spark, "repeats")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    own = docs.select("d1", "d2", "text")
    rows = own.mapInArrow(_anchor_batches(length, kernel), ROW)
    order = ["kernel", "windows", "d1", "d2", "low"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(rows.mapInArrow(_neighbour_batches, ROW + ", whole boolean, on boolean, edge long"), "sorted")
    rows = rows.where("edge < 0").unionByName(_edges(rows))
    whole = rows.where("whole").select("d1", "d2", F.col("low").alias("start"), (F.col("low") + F.col("span") + length).alias("end"))
    on = rows.where("on").groupBy("d1", "d2").agg(F.collect_set(F.struct("low", "span", "lead", "kernel")).alias("asked"))
    schema = ", ".join(ROW.split(", ")[:-1] + ["bytes binary"])
    segments = stored(packed(own).join(stored(on, "on"), ["d1", "d2"]).mapInArrow(_segment_batches(length), schema), "segments")
    many = stored(segments.groupBy("kernel").count().where(F.col("count") > together).select("kernel"), "many")
    few = segments.join(many, "kernel", "left_anti").repartition("kernel").sortWithinPartitions("kernel")
    near = few.mapInArrow(_compare_batches(length), "d1 long, d2 long, start long, end long")
    key = ["kernel", "place", "rank"]
    spread = segments.join(many, "kernel", "left_semi").mapInArrow(_spread_batches(length), "d1 long, d2 long, start long, kernel long, place long, rank long")
    again = stored(spread.groupBy(*key).count().where("count > 1").select(*key), "again")
    far = spread.join(again, key, "left_semi").select("d1", "d2", "start", (F.col("start") + length).alias("end"))
    spans = whole.unionByName(near).unionByName(far)
    return stored(spans.groupBy("d1", "d2").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _left(batch: pa.RecordBatch):
    """(all bytes, maximal removed runs, bytes that are left) of each row."""
    for text, spans in zip(batch.column("packed"), batch.column("spans")):
        data, runs = zstandard.decompress(text.as_py()), merged(spans.as_py())
        parts, at = [], 0
        for a, b in runs:
            parts.append(data[at:a])
            at = b
        yield len(data), runs, b"".join([*parts, data[at:]])


def _others(batch: pa.RecordBatch) -> dict:
    return {c: batch.column(c) for c in batch.schema.names if c not in ("packed", "spans")}


def _kept_batches(batches):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        size, removed, kept = [], [], []
        for n, runs, left in _left(batch):
            size.append(n)
            removed.append([{"start": a, "end": b} for a, b in runs])
            kept.append(left)
        columns = _others(batch) | {"n_bytes": pa.array(size, pa.int64()), "removed": pa.array(removed, kind), "kept": pa.array(kept, pa.binary())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _text_batches(batches):
    for batch in batches:
        columns = _others(batch) | {"text": pa.array([left.decode("utf-8", "ignore") for _, _, left in _left(batch)], pa.string())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _with_spans(docs: DataFrame, keep: tuple[str, ...], length: int, kernel: int, together: int) -> tuple[DataFrame, list[str]]:
    """(the columns ``keep``, packed texts and their spans; the schema of ``keep``)."""
    rows = keyed(docs.select("text", *[c for c in keep if c != "text"]))
    spans = repeated_spans(rows, length, kernel, together)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return packed(rows).join(spans, ["d1", "d2"], "left").select(*keep, "packed", "spans"), fields


def cut_out(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), length: int = LENGTH, kernel: int = KERNEL, together: int = TOGETHER) -> DataFrame:
    """The columns ``keep`` with n_bytes, the maximal removed runs and the bytes that are left."""
    joined, fields = _with_spans(docs, keep, length, kernel, together)
    return joined.mapInArrow(_kept_batches, ", ".join([*fields, "n_bytes long", "removed array<struct<start: long, end: long>>", "kept binary"]))


def without_repeats(docs: DataFrame) -> DataFrame:
    """Texts without repeated passages; a character cut in two goes as a whole.

    ``n_chars`` follows the text, other columns may have any names and stay as they are.
    Texts are cut and decoded in one step: a second one would hold as many Python workers again.
    """
    rows, restored = carried(docs, "doc_id", "text", "n_chars")
    keep = tuple(c for c in rows.columns if c not in ("text", "n_chars"))
    joined, fields = _with_spans(rows, keep, LENGTH, KERNEL, TOGETHER)
    found = joined.mapInArrow(_text_batches, ", ".join([*fields, "text string"]))
    return restored(found, n_chars=F.length("text").cast("long"))
