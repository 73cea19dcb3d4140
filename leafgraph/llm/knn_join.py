"""Exact top-k by inner product: a Voronoi join of queries and data.

Rows are grouped by their nearest pivot. The summary of a group, its size, its radius and
the distances of its rows nearest to the pivot, bounds every score: for a query q and a row
x of the group of pivot p, q.x lies within |q| |x - p| of q.p. The k-th best of the least
scores that the summaries promise is a bound the result cannot fall below; a group whose
highest possible score is lower is not met. Queries, the smaller side, are sent to the
groups that are left, and each block of a group is solved where it lies.

Pruning never changes the result, it only saves work; on data without clusters every query
meets every group. Which rows take part: see ``vector_blocks``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafgraph.functions.durable import cut
from leafgraph.llm.vector_blocks import BLOCK_QUERIES, BLOCK_ROWS, asks, matrix, nearest, vectors

#: Bound of the number of pivots, whatever the size of the data.
PIVOTS = 64


def _group_batches(pivots: np.ndarray):
    def run(batches):
        for batch in batches:
            v = matrix(batch.column("v"))
            if not len(v):
                continue
            d2 = (v * v).sum(1)[:, None] - 2 * v @ pivots.T + (pivots * pivots).sum(1)[None, :]
            group = d2.argmin(1)
            distance = np.sqrt(((v - pivots[group]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(group.astype(np.int32)), pa.array(distance)],
                names=["vec_id", "v", "group", "distance"])

    return run


def _ask_batches(pivots: np.ndarray, of: np.ndarray, near: np.ndarray, radius: np.ndarray, k: int):
    """of, near: the group and distance of each row in the summaries; radius: of every group, -1 if empty."""

    def run(batches):
        for batch in batches:
            q = matrix(batch.column("v"))
            if not len(q):
                continue
            size = np.sqrt((q * q).sum(1))[:, None]
            middle = q @ pivots.T
            # Rounding must not prune: the bounds are widened by far more than it can be.
            slack = 1e-9 * (1 + np.abs(middle).max(1, keepdims=True) + size * (1 + radius.max()))
            promised = middle[:, of] - size * near[None, :] - slack
            most = middle + size * radius[None, :] + slack
            if len(of) > k:
                floor = np.partition(promised, len(of) - k - 1, axis=1)[:, len(of) - k - 1]  # one may be the query itself
            else:
                floor = np.full(len(q), -np.inf)
            yield asks(batch.column("vec_id"), batch.column("v"), (most >= floor[:, None]) & (radius >= 0)[None, :])

    return run


def quantised(rows: DataFrame, scale: int) -> DataFrame:
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def knn_join(rows: DataFrame, is_query: str, k: int = 20, scale: int = 64, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that meets ``is_query``, the k best others.

    Components count as floor(scale * x); scores are whole numbers.
    """
    data = quantised(vectors(rows), scale)
    chosen = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("v").distinct().orderBy("v").collect()
    centre = np.array([r["v"] for r in chosen], np.float64) if chosen else np.zeros((1, 1))
    data = cut(data.mapInArrow(_group_batches(centre), "vec_id long, v array<long>, group int, distance double"))
    first = Window.partitionBy("group").orderBy("distance", "vec_id")
    near = data.select("group", "distance", "vec_id").withColumn("i", F.row_number().over(first)).where(F.col("i") <= k + 1).select("group", "distance").collect()
    sizes = {r["group"]: (r["n"], r["radius"]) for r in data.groupBy("group").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()}
    radius = np.array([sizes.get(g, (0, -1.0))[1] for g in range(len(centre))])
    blocks = {g: -(-n // BLOCK_ROWS) for g, (n, _) in sizes.items()}
    queries = data.where(is_query)
    chunks = max(1, -(-queries.count() // BLOCK_QUERIES))
    ask = _ask_batches(centre, np.array([r["group"] for r in near], np.int64), np.array([r["distance"] for r in near]), radius, k)
    asked = queries.select("vec_id", "v").mapInArrow(ask, "query_id long, q array<long>, group int, mask binary")
    return nearest(asked, data.select("vec_id", "v", "group", F.lit(0).alias("cell")), blocks, chunks, k, True)
