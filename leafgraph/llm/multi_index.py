"""Approximate nearest neighbours by inner product with an inverted multi-index.

Each vector is cut into two halves, and each half has its own codebook, so that few centroids
make many cells: a row lies in the cell of its two nearest centroids. A query orders the
centroids of each half by inner product and walks the pairs from the best sum downwards with
a heap, until the cells it has met hold enough rows; these are ranked by their own vectors.

The codebooks are fitted on at most ``SAMPLE`` rows, those of least hash of the id; every row
is indexed. A cell is met whole, whatever its size. Which rows take part: see
``vector_blocks``; zero vectors take none.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.functions.durable import cut
from leafgraph.llm.vector_blocks import BLOCK_QUERIES, BLOCK_ROWS, asks, matrix, nearest, vectors

SAMPLE = 20_000
CENTROIDS = 128
#: A query meets cells until they hold this share of all rows, and at least so many rows. On
#: vectors without any clusters, the hardest case, this share gives a recall above 0.9.
SHARE = 0.4
LEAST = 1000
#: Cells lie together by first centroid in so many groups, in which queries meet them.
GROUPS = 16


def codebook(half: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """Centroids by repeated averaging, from rows far from each other."""
    points = np.unique(half, axis=0)
    n = min(n, len(points))
    centre = points[:1]
    far = ((points - centre[0]) ** 2).sum(1)
    rng = np.random.default_rng(11)
    for _ in range(n - 1):
        pick = rng.choice(len(points), p=far / far.sum()) if far.sum() else 0
        centre = np.vstack([centre, points[pick]])
        far = np.minimum(far, ((points - points[pick]) ** 2).sum(1))
    for _ in range(rounds):
        own = assign(half, centre)
        for c in np.unique(own):
            centre[c] = half[own == c].mean(0)
    return centre


def assign(half: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre * centre).sum(1)[None, :] - 2 * half @ centre.T).argmin(1)


def _width(books: tuple[np.ndarray, np.ndarray]) -> int:
    """First centroids in a group."""
    return -(-len(books[0]) // GROUPS)


def _cell_batches(books: tuple[np.ndarray, np.ndarray]):
    def run(batches):
        width, n2, h = _width(books), len(books[1]), books[0].shape[1]
        for batch in batches:
            v = matrix(batch.column("v"))
            if not len(v):
                continue
            a, b = assign(v[:, :h], books[0]), assign(v[:, h:], books[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array((a // width).astype(np.int32)), pa.array((a % width * n2 + b).astype(np.int32))],
                names=["vec_id", "v", "group", "cell"])

    return run


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, enough: int) -> np.ndarray:
    """The cells met, by falling sum of the two halves' scores, until they hold enough rows."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    size = sizes[a][:, b].tolist()
    n, rows, stop = len(y), 0, [0] * len(x)
    heap = [(-(x[0] + y[0]), 0, 0)]
    while heap and rows < enough:
        _, i, j = heap[0]
        rows += size[i][j]
        stop[i] = j + 1
        if j + 1 < n:
            heapq.heapreplace(heap, (-(x[i] + y[j + 1]), i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))
    met = np.zeros(sizes.shape, bool)
    met[a[:, None], b[None, :]] = np.arange(n)[None, :] < np.array(stop)[:, None]
    return met & (sizes > 0)


def _ask_batches(books: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, enough: int):
    def run(batches):
        width, h = _width(books), books[0].shape[1]
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                q = matrix(part.column("v"))
                first, second = q[:, :h] @ books[0].T, q[:, h:] @ books[1].T
                met = np.zeros((len(q), GROUPS * width, sizes.shape[1]), bool)
                for i in range(len(q)):
                    met[i, :sizes.shape[0]] = walk(first[i], second[i], sizes, enough)
                met = met.reshape(len(q), GROUPS, -1)
                bits = np.packbits(met, axis=2)
                hits = met.any(2)
                yield asks(part.column("vec_id"), part.column("v"), hits, pa.array([x.tobytes() for x in bits[hits]], pa.binary()))

    return run


def search(rows: DataFrame, is_query: str, k: int = 20, centroids: int = CENTROIDS, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that meets ``is_query``, its k nearest others found."""
    data = vectors(rows, nonzero=True)
    kind = data.schema["v"].dataType.simpleString()
    sample = matrix(data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks())
    h = max(1, sample.shape[1] // 2)
    books = (codebook(sample[:, :h], centroids), codebook(sample[:, h:], centroids)) if len(sample) else (np.zeros((1, 1)), np.zeros((1, 1)))
    data = cut(data.mapInArrow(_cell_batches(books), f"vec_id long, v {kind}, group int, cell int"))
    sizes = np.zeros((len(books[0]), len(books[1])), np.int64)
    width, blocks = _width(books), {}
    for r in data.groupBy("group", "cell").count().collect():
        sizes[r["group"] * width + r["cell"] // len(books[1]), r["cell"] % len(books[1])] = r["count"]
        blocks[r["group"]] = blocks.get(r["group"], 0) + r["count"]
    blocks = {g: -(-n // BLOCK_ROWS) for g, n in blocks.items()}
    queries = data.where(is_query)
    chunks = max(1, -(-queries.count() // BLOCK_QUERIES))
    enough = max(least, int(np.ceil(share * sizes.sum())))
    asked = queries.select("vec_id", "v").mapInArrow(_ask_batches(books, sizes, enough), f"query_id long, q {kind}, group int, mask binary")
    return nearest(asked, data, blocks, chunks, k, False)
