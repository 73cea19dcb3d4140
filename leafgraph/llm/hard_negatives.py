"""Hard negatives by angular triangle filtering.

Every row keeps its angles to a few reference directions and its norm. Angles are a metric on
directions, so of two rows with angles s and t to a reference the angle between them is at
least |s - t| and at most s + t (or 2 pi - s - t). The tightest of these over all references
gives an interval of the cosine, and times both norms an interval of the score. It is widened
by far more than rounding can be and rounded outwards to whole numbers. Only pairs whose
interval overlaps what is asked for get an integer score: for an anchor's positives what can
still reach the k-th best of its label, for its negatives the window of scores that its
positives set.

Rows lie in blocks of their label, queries come in chunks, and a block and a chunk meet in one
task, so a label that holds a third of all rows is many tasks. A chunk is sent to a block only
if the angles of the block's cluster leave room for a wanted score; clusters are the rows
nearest to the same reference. Pruning never changes the result.

Rows with a null id, label, vector or component, or a component that is not finite, take no
part; neither do vectors of another length than most. Rows with equal ids are one row, of
different ones the least is meant. Zero vectors take part, with score 0. Ties go to the
smaller id, extra columns are ignored, an empty table gives no rows. Scores must fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafgraph.functions.durable import cut
from leafgraph.llm import text_arrays as A
from leafgraph.llm.vector_blocks import matrix

#: Reference directions: bounds what every row keeps, and the number of clusters of a label.
REFERENCES = 16
#: Rows of a block and queries of a chunk; a task holds one of each.
BLOCK_ROWS, CHUNK_ROWS = 16384, 8192
#: Labels of more than this share of all rows have blocks of their own number, at most as many labels.
SHARES = 1024
#: Anchors whose intervals with the rows of a block are worked out at a time.
STEP_ANCHORS = 64
#: Radians added to every angle interval; angles of doubles are off by less than 1e-7.
SLACK = 1e-6

INDEXED = "vec_id long, label int, v array<long>, norm double, angles array<double>, cluster int"


def labelled(rows: DataFrame, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, components as floor(scale * x)."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
    rows = rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct("embedding", "label")).alias("x"))
    rows = rows.select("vec_id", F.col("x.label").cast("int").alias("label"), F.col("x.embedding").alias("embedding"))
    rows = cut(rows.select("vec_id", label.cast("int").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")))
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("v") == (size["size"] if size else 0))


def directions(rows: DataFrame, n: int) -> np.ndarray:
    """``n`` reference directions: rows chosen by a hash of their id, of length one."""
    some = rows.where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("v").collect()
    v = np.array([r["v"] for r in some], np.float64) if some else np.ones((1, 1))
    return v / np.sqrt((v * v).sum(1))[:, None]


def angles_to(v: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms and angles; a zero vector has angle 0 to all, its norm takes every bound to 0."""
    if references.shape[1] != v.shape[1]:  # all vectors are zero
        references = np.ones((1, v.shape[1]))
    norm = np.sqrt((v * v).sum(1))
    cos = (v @ references.T) / np.where(norm > 0, norm, 1)[:, None]
    return norm, np.where(norm[:, None] > 0, np.arccos(np.clip(cos, -1, 1)), 0.0)


def _index_batches(references: np.ndarray):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            norm, angles = angles_to(matrix(batch.column("v")), references)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(norm) + 1, dtype=np.int32) * angles.shape[1]), pa.array(angles.ravel()))
            cluster = pa.array(angles.argmin(1).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("vec_id", "label", "v")), pa.array(norm), flat, cluster],
                names=["vec_id", "label", "v", "norm", "angles", "cluster"])

    return run


def score_bounds(least: np.ndarray, most: np.ndarray, low_norm: np.ndarray, high_norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers below and above every score of an angle in [least, most] and a product of norms in the range."""
    high_cos, low_cos = np.cos(np.maximum(least - SLACK, 0)), np.cos(np.minimum(most + SLACK, np.pi))
    high = np.where(high_cos > 0, high_cos * high_norm, high_cos * low_norm)
    low = np.where(low_cos > 0, low_cos * low_norm, low_cos * high_norm)
    room = 1 + 1e-9 * high_norm
    return np.floor(low - room), np.ceil(high + room)


def pair_bounds(a: np.ndarray, a_norm: np.ndarray, x: np.ndarray, x_norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score bounds of each row of a with each row of x, from their angles to the references."""
    least, most = np.zeros((len(a), len(x))), np.full((len(a), len(x)), np.pi)
    for r in range(a.shape[1]):
        both = a[:, r, None] + x[None, :, r]
        np.maximum(least, np.abs(a[:, r, None] - x[None, :, r]), out=least)
        np.minimum(most, np.minimum(both, 2 * np.pi - both), out=most)
    norms = a_norm[:, None] * x_norm[None, :]
    return score_bounds(least, most, norms, norms)


def cluster_bounds(a: np.ndarray, a_norm: np.ndarray, near: np.ndarray, far: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Score bounds of each row of a with all rows of each cluster, whose angles lie in [near, far], norms in [low, high]."""
    least, most = np.zeros((len(a), len(near))), np.full((len(a), len(near)), np.pi)
    for r in range(a.shape[1]):
        own, n, f = a[:, r, None], near[None, :, r], far[None, :, r]
        np.maximum(least, np.maximum(n - own, own - f), out=least)
        ends = [np.minimum(own + x, 2 * np.pi - own - x) for x in (n, f)]
        straight = (own + n <= np.pi) & (own + f >= np.pi)  # rows between may lie opposite
        np.minimum(most, np.where(straight, np.pi, np.maximum(*ends)), out=most)
    return score_bounds(least, most, a_norm[:, None] * low[None, :], a_norm[:, None] * high[None, :])


NONE = np.iinfo(np.int64).min


def integer_scores(q: np.ndarray, x: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Inner products of the wanted pairs, NONE elsewhere."""
    out = np.full(wanted.shape, NONE, np.int64)
    i, j = np.nonzero(wanted)
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if len(i) * 16 > wanted.size and largest < 2.0**52:  # sums of doubles are exact
        score = q.astype(np.float64) @ x.astype(np.float64).T
        out[i, j] = score[i, j].astype(np.int64)
    else:
        for k in range(0, len(i), 1 << 16):
            at = slice(k, k + (1 << 16))
            out[i[at], j[at]] = np.einsum("ij,ij->i", q[i[at]], x[j[at]])
    return out


def whole_vectors(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


class Shares:
    """Into how many parts each value of a key is cut: its own number for frequent values, one for all others."""

    def __init__(self, of: dict[int, int], rest: int):
        self.keys = np.array(sorted(of), np.int64)
        self.parts = np.array([of[k] for k in sorted(of)] + [rest], np.int64)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, values)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == values[known]
        return self.parts[np.where(known, at, len(self.keys))]


def _mixed(ids: np.ndarray) -> np.ndarray:
    return (A.finish(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)).astype(np.int64)


def _placed(key: str, own: Shares, other: Shares, names: tuple[str, str]):
    """Each row in one part of its key by ``own``, once for each part by ``other``."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            value = batch.column(key).to_numpy()
            part = _mixed(batch.column("vec_id").to_numpy()) % own(value)
            times = other(value)
            row = np.repeat(np.arange(len(value)), times)
            turn = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            out = batch.take(pa.array(row))
            place = [pa.array(x.astype(np.int32)) for x in (part[row], turn)]
            yield pa.RecordBatch.from_arrays([*out.columns, *place], names=[*out.schema.names, *names])

    return run


def _schema(frame: DataFrame, *more: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema] + list(more))


def _meeting(rows: DataFrame, asks: DataFrame, key: str, blocks: Shares, chunks: Shares, meet, result: str) -> DataFrame:
    """``meet`` of every block of a key's rows with every chunk of its asks."""
    held = rows.mapInArrow(_placed(key, blocks, chunks, ("block", "chunk")), _schema(rows, "block int", "chunk int"))
    asking = asks.mapInArrow(_placed(key, chunks, blocks, ("chunk", "block")), _schema(asks, "chunk int", "block int"))
    by = (key, "block", "chunk")
    return asking.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(meet, result)


def _steps(asks: pa.Table, rows: pa.Table):
    """(asks of a step, their vectors, rows by id, the rows' vectors, score bounds) of each step."""
    if not asks.num_rows or not rows.num_rows:
        return
    rows = rows.take(pa.array(np.argsort(rows["vec_id"].to_numpy(), kind="stable")))  # of equal scores the first is then the smaller id
    x, x_norm, x_angles = whole_vectors(rows["v"]), rows["norm"].to_numpy(), matrix(rows["angles"].combine_chunks())
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    for part in asks.combine_chunks().to_batches(max_chunksize=STEP_ANCHORS):
        q = whole_vectors(part.column("v"))
        low, high = pair_bounds(matrix(part.column("angles")), part.column("norm").to_numpy(), x_angles, x_norm)
        yield part, q, ids, labels, x, low, high


def _best_of_label(k: int):
    def run(key: tuple, asks: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        for part, q, ids, _, x, low, high in _steps(asks, rows):
            own = part.column("vec_id").to_numpy()
            other = ids[None, :] != own[:, None]
            low[~other] = -np.inf
            if len(ids) > k:  # k rows are known to reach this
                other &= high >= np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k, None]
            score = integer_scores(q, x, other)
            for i in range(len(own)):
                at = np.flatnonzero(other[i])
                at = at[np.argsort(-score[i, at], kind="stable")][:k]
                out[0].append(np.full(len(at), own[i]))
                out[1].append(ids[at])
                out[2].append(score[i, at])
        empty = [np.zeros(0, np.int64)]
        return pa.table([pa.array(np.concatenate(x or empty)) for x in out], names=["anchor_id", "positive_id", "positive_score"])

    return run


def _in_windows(k: int):
    """The k best rows of other labels in the window of each positive."""
    def run(key: tuple, asks: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        for part, q, ids, labels, x, low, high in _steps(asks, rows):
            positives = part.column("positives").to_pylist()
            floor, top = part.column("floor").to_numpy(), part.column("top").to_numpy()
            wanted = (labels[None, :] != part.column("label").to_numpy()[:, None]) & (high >= floor[:, None]) & (low <= top[:, None])
            score = integer_scores(q, x, wanted)
            wanted &= (score >= floor[:, None]) & (score <= top[:, None])
            for i, own in enumerate(part.column("vec_id").to_pylist()):
                at = np.flatnonzero(wanted[i])
                at = at[np.argsort(-score[i, at], kind="stable")]
                falling = -score[i, at]
                for p in positives[i]:
                    first = np.searchsorted(falling, -p["score"], "left")
                    last = np.searchsorted(falling, -p["least"], "right")
                    hit = at[first:min(last, first + k)]
                    for column, values in zip(out, ([own] * len(hit), [p["id"]] * len(hit), [p["score"]] * len(hit), ids[hit].tolist(), score[i, hit].tolist())):
                        column.extend(values)
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def _window_batches(near: np.ndarray, far: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Each anchor once for each cluster that may hold scores of its windows."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            least, most = cluster_bounds(matrix(batch.column("angles")), batch.column("norm").to_numpy(), near, far, low, high)
            floor, top = batch.column("floor").to_numpy(), batch.column("top").to_numpy()
            row, cluster = np.nonzero((most >= floor[:, None]) & (least <= top[:, None]) & (high >= 0)[None, :])
            out = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cluster.astype(np.int32))], names=[*out.schema.names, "cluster"])

    return run


def _label_shares(index: DataFrame, anchors: DataFrame) -> tuple[Shares, Shares]:
    """Blocks of rows and chunks of anchors of each label; at most SHARES labels have numbers of their own."""
    sizes = index.groupBy("label").count()
    most = max(BLOCK_ROWS, index.count() // SHARES)
    large = {r["label"]: r["count"] for r in sizes.where(F.col("count") > most).collect()}
    asked = anchors.groupBy("label").count()
    frequent = {r["label"]: r["count"] for r in asked.where(F.col("label").isin(list(large))).collect()} if large else {}
    rest = asked.where(~F.col("label").isin(list(large))) if large else asked
    rest = rest.agg(F.max("count").alias("n")).first()["n"] or 1
    up = lambda n, of: max(1, -(-n // of))
    blocks = Shares({x: up(n, BLOCK_ROWS) for x, n in large.items()}, up(most, BLOCK_ROWS))
    return blocks, Shares({x: up(frequent.get(x, 0), CHUNK_ROWS) for x in large}, up(rest, CHUNK_ROWS))


def hard_negatives(
    rows: DataFrame, is_anchor: str, label: Column | None = None, scale: int = 256, positives: int = 5, negatives: int = 5,
    percent: int = 80, references: int = REFERENCES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each row that meets ``is_anchor`` and each of its ``positives`` best others of its
    label, the ``negatives`` best rows of other labels that score at most as the positive
    does and at least ``percent`` of it.
    """
    data = labelled(rows, F.col("label") if label is None else label, scale)
    towards = directions(data, references)
    index = cut(data.mapInArrow(_index_batches(towards), INDEXED))
    anchors = index.where(is_anchor)
    blocks, chunks = _label_shares(index, anchors)
    same = _meeting(
        index.select("vec_id", "label", "v", "norm", "angles"), anchors.select("vec_id", "label", "v", "norm", "angles"), "label", blocks, chunks,
        _best_of_label(positives), "anchor_id long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    same = same.withColumn("r", F.row_number().over(first)).where(F.col("r") <= positives)
    # The least whole number that is ``percent`` of the positive's score or more.
    least = F.expr(f"({percent} * positive_score + pmod(-{percent} * positive_score, 100)) div 100")
    asked = same.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"), least.alias("least"))).alias("positives"),
        F.min(least).alias("floor"), F.max("positive_score").alias("top"))
    asked = anchors.select("vec_id", "label", "v", "norm", "angles").join(asked, "vec_id")
    n = len(towards)
    bounds = [F.min(F.col("angles")[r]).alias(f"near{r}") for r in range(n)] + [F.max(F.col("angles")[r]).alias(f"far{r}") for r in range(n)]
    found = {r["cluster"]: r for r in index.groupBy("cluster").agg(F.count("*").alias("n"), F.min("norm").alias("low"), F.max("norm").alias("high"), *bounds).collect()}
    near, far = np.zeros((n, n)), np.zeros((n, n))
    low, high = np.zeros(n), np.full(n, -1.0)
    for c, r in found.items():
        near[c], far[c] = ([r[f"{side}{i}"] for i in range(n)] for side in ("near", "far"))
        low[c], high[c] = r["low"], r["high"]
    asked = cut(asked.mapInArrow(_window_batches(near, far, low, high), _schema(asked, "cluster int")))
    times = {r["cluster"]: r["count"] for r in asked.groupBy("cluster").count().collect()}
    up = lambda n, of: max(1, -(-n // of))
    blocks = Shares({c: up(r["n"], BLOCK_ROWS) for c, r in found.items()}, 1)
    chunks = Shares({c: up(k, CHUNK_ROWS) for c, k in times.items()}, 1)
    met = _meeting(
        index.select("vec_id", "label", "v", "norm", "angles", "cluster"), asked, "cluster", blocks, chunks, _in_windows(negatives),
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    met = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return met.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
