"""What both searches over vectors share: which rows take part, and best rows of blocks.

A row takes part if its id and its vector are not null and no component is null or not
finite. Rows with equal ids are one row; of different vectors under one id the least is
meant. Vectors of another length than most have take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafgraph.functions.durable import cut

#: Rows of one block, and queries that meet it at a time; a task holds one of each.
BLOCK_ROWS = 8192
BLOCK_QUERIES = 8192


def vectors(rows: DataFrame, nonzero: bool = False) -> DataFrame:
    """(vec_id, v) of the rows that take part, written out as it is read several times."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
    if nonzero:
        rows = rows.where(F.exists("embedding", lambda x: x != 0))
    rows = cut(rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("v")))
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("v") == (size["size"] if size else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def block_of(ids: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(ids), blocks).cast("int")


def asks(keys: pa.Array, vectors: pa.Array, hits: np.ndarray, masks: pa.Array | None = None) -> pa.RecordBatch:
    """A row for each (query, group) of the boolean matrix ``hits``; of ``masks`` likewise, in the same order."""
    row, group = np.nonzero(hits)
    at = pa.array(row)
    masks = pa.nulls(len(row), pa.binary()) if masks is None else masks
    return pa.RecordBatch.from_arrays([keys.take(at), vectors.take(at), pa.array(group.astype(np.int32)), masks], names=["query_id", "q", "group", "mask"])


def _best(k: int, exact_int: bool):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names, kind = ["query_id", "vec_id", "score"], pa.int64() if exact_int else pa.float64()
        out: list[list[np.ndarray]] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids = right["vec_id"].to_numpy()
            order = np.argsort(ids)  # of equal scores the first is then the smaller id
            ids, cell = ids[order], right["cell"].to_numpy()[order]
            data = matrix(right["v"].combine_chunks())[order]
            if exact_int and np.abs(data).max() ** 2 * data.shape[1] >= 2.0**52:
                data = data.astype(np.int64)
            for part in left.to_batches(max_chunksize=512):
                own = part.column("query_id").to_numpy()
                score = matrix(part.column("q")).astype(data.dtype) @ data.T
                met = np.ones(score.shape, bool)
                if part.column("mask").null_count == 0:
                    bits = np.unpackbits(np.frombuffer(b"".join(part.column("mask").to_pylist()), np.uint8)).reshape(len(own), -1)
                    met = bits[:, cell] > 0
                met &= ids[None, :] != own[:, None]
                least = np.iinfo(np.int64).min if data.dtype == np.int64 else -np.inf
                score[~met] = least
                m = min(k, len(ids))
                edge = np.partition(score, len(ids) - m, axis=1)[:, len(ids) - m]
                for i in range(len(own)):
                    above = np.flatnonzero(score[i] > edge[i])
                    hit = np.concatenate([above, np.flatnonzero((score[i] == edge[i]) & met[i])[:m - len(above)]])
                    hit = hit[met[i, hit]]
                    out[0].append(np.full(len(hit), own[i]))
                    out[1].append(ids[hit])
                    out[2].append(score[i, hit])
        empty = [np.zeros(0, np.int64)]
        return pa.table([pa.array(np.concatenate(x or empty)).cast(t) for x, t in zip(out, (pa.int64(), pa.int64(), kind))], names=names)

    return run


def nearest(asked: DataFrame, data: DataFrame, blocks: dict[int, int], chunks: int, k: int, exact_int: bool) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of the groups each query asks for.

    ``asked`` (query_id, q, group, mask) and ``data`` (vec_id, v, group, cell) meet in blocks: a
    group of any size has ``blocks[group]`` of them and queries come in ``chunks``, so that a
    task holds a block of rows and a chunk of queries whatever the sizes are. Where a mask is
    given, only rows of the cells whose bits it has are met.
    """
    kind = "long" if exact_int else "double"
    of = F.create_map(*[F.lit(x) for pair in sorted(blocks.items()) for x in pair]) if blocks else F.create_map(F.lit(-1), F.lit(1))
    left = asked.withColumn("chunk", block_of(F.col("query_id"), F.lit(chunks)))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), of[F.col("group")] - 1)))
    right = data.withColumn("block", block_of(F.col("vec_id"), of[F.col("group")]))
    right = right.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    found = left.groupBy("group", "block", "chunk").cogroup(right.groupBy("group", "block", "chunk")).applyInArrow(
        _best(k, exact_int), f"query_id long, vec_id long, score {kind}")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
