"""Ordered scans within a key that may be very large.

A window over ``partitionBy(doc)`` puts a whole document into one task.  Here the
order is cut into blocks that are a pure function of the row (page number divided
by a block size, say).  A window runs inside each block, one summary row per block
is carried along the key, and the two are joined.  The carrying has levels of its
own: summaries of ``GROUP`` blocks are summed up again, so that a task holds one
block of rows, or the summaries of one group, or one row per group of a key.  The
result equals that of the single window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = "_block"
GROUP = 4096
SALTS = 16


def with_block(df: DataFrame, order: str, size: int) -> DataFrame:
    return df.withColumn(BLOCK, F.floor(F.col(order) / F.lit(size)).cast("bigint"))


def by_block(df: DataFrame, keys: list[str]) -> DataFrame:
    """Shuffle by key and block, also where the rows already lie together by key alone.

    A window by (key, block) is content with rows hashed by key, which would leave a
    large key in one task.
    """
    return df.repartition(*keys, BLOCK)


def attach(df: DataFrame, per_key: DataFrame, key: str, spread_by: str, how: str = "inner") -> DataFrame:
    """Join one row per key (``per_key``) to the many rows of that key.

    Rows of a key are divided by ``spread_by`` and the small side is repeated for each
    share, so that a key with a large part of all rows is joined by many tasks.
    """
    left = df.withColumn("_salt", F.pmod(F.col(spread_by), F.lit(SALTS)).cast("int"))
    right = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def _earlier(keys, order):
    return W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)


def _later(keys, order):
    return W.partitionBy(*keys).orderBy(order).rowsBetween(1, W.unboundedFollowing)


def _carry(blocks: DataFrame, keys: list[str], names: list[str], kind: str) -> DataFrame:
    """Replaces the summary of each block by that of the blocks before it (``kind`` sum or
    last) or after it (first): once inside groups of blocks, once over the groups."""
    side = _later if kind == "first" else _earlier
    nearest = {"last": F.last, "first": F.first}

    def over(name):
        return F.sum(name) if kind == "sum" else nearest[kind](name, ignorenulls=True)

    def whole(name):
        if kind == "sum":
            return F.sum(name)
        pick = F.max_by if kind == "last" else F.min_by
        return pick(F.col(name), F.when(F.col(name).isNotNull(), F.col(BLOCK)))

    blocks = blocks.withColumn("_group", F.floor(F.col(BLOCK) / F.lit(GROUP)).cast("bigint"))
    groups = blocks.groupBy(*keys, "_group").agg(*[whole(n).alias(n) for n in names])
    groups = groups.select(*keys, "_group", *[over(n).over(side(keys, "_group")).alias(f"{n}_far") for n in names])
    near = blocks.select(
        *keys, BLOCK, "_group", *[over(n).over(side([*keys, "_group"], BLOCK)).alias(n) for n in names]
    )

    def both(n):
        if kind == "sum":
            return F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"{n}_far"), F.lit(0))
        return F.coalesce(F.col(n), F.col(f"{n}_far"))

    return near.join(groups, [*keys, "_group"]).select(*keys, BLOCK, *[both(n).alias(n) for n in names])


def fold_before(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: Column,
    merge: Callable[[Column, Column], Column],
    state: str,
    name: str,
    sizes: tuple[int, ...] = (1 << 10, 1 << 22, 1 << 42),
) -> DataFrame:
    """For each row ``merge`` over the values of all earlier rows of its key.

    ``value`` and the result are arrays of the type ``state``; ``merge`` is associative and
    the empty array its neutral element.  Rows of one block are folded in order, so are the
    totals of blocks in the next larger one and so on; ``sizes`` are the widths of blocks
    in numbers of ``order``, each a multiple of the one before.  What came before a block is
    then handed down.  A task holds the rows of one block of the first width, or the totals
    of the blocks inside one larger block.
    """
    outs = f"array<{state}>"
    zero = F.struct(F.array().cast(state).alias("total"), F.array().cast(outs).alias("before"))

    def step(acc, row):
        total = merge(acc["total"], row["value"]).cast(state)
        return F.struct(total.alias("total"), F.concat(acc["before"], F.array(acc["total"])).alias("before"))

    def fold(rows, *by):
        listed = rows.groupBy(*keys, *by).agg(F.array_sort(F.collect_list("_item")).alias("_items"))
        return listed.withColumn("_fold", F.aggregate("_items", zero, step))

    def handed(totals, k):
        """What came before each block of width ``sizes[k - 1]``."""
        items = totals.withColumn("_item", F.struct(F.col(BLOCK).alias("at"), F.col("_total").alias("value")))
        if k == len(sizes):
            folded = fold(items)
            outer = F.array().cast(state)
        else:
            ratio = sizes[k] // sizes[k - 1]
            items = items.withColumn(BLOCK, F.floor(F.col(BLOCK) / F.lit(ratio)).cast("bigint"))
            folded = fold(items, BLOCK)
            above = handed(folded.select(*keys, BLOCK, F.col("_fold.total").alias("_total")), k + 1)
            folded = folded.join(above, [*keys, BLOCK])
            outer = F.col("_came")
        pairs = F.arrays_zip(F.col("_items"), F.col("_fold.before").alias("before"))
        return folded.select(*keys, outer.alias("_outer"), F.explode(pairs).alias("_pair")).select(
            *keys, F.col("_pair._items.at").alias(BLOCK), merge(F.col("_outer"), F.col("_pair.before")).alias("_came")
        )

    columns = df.columns
    rows = with_block(df, order, sizes[0]).withColumn(
        "_item",
        F.struct(F.col(order).alias("at"), value.cast(state).alias("value"), F.struct(*columns).alias("row")),
    )
    folded = fold(rows.select(*keys, BLOCK, "_item"), BLOCK)
    came = handed(folded.select(*keys, BLOCK, F.col("_fold.total").alias("_total")), 1)
    pairs = F.arrays_zip(F.col("_items"), F.col("_fold.before").alias("before"))
    return folded.join(came, [*keys, BLOCK]).select("_came", F.explode(pairs).alias("_pair")).select(
        "_pair._items.row.*", merge(F.col("_came"), F.col("_pair.before")).alias(name)
    )


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], size: int, value: Column, name: str
) -> DataFrame:
    """Inclusive running sum of ``value`` within ``keys`` in the given order.

    ``order[0]`` is numeric; blocks are cut along it.
    """
    df = with_block(df, order[0], size)
    totals = _carry(df.groupBy(*keys, BLOCK).agg(F.sum(value).alias("_offset")), keys, ["_offset"], "sum")
    local = W.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        by_block(df, keys).withColumn("_local", F.sum(value).over(local))
        .join(totals, [*keys, BLOCK])
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_local", "_offset", BLOCK)
    )


def ranked(df: DataFrame, keys: list[str], order: list[str], size: int, name: str) -> DataFrame:
    """0-based dense position of each row within ``keys``."""
    out = running_sum(df, keys, order, size, F.lit(1), name)
    return out.withColumn(name, F.col(name) - 1)


def last_before(
    df: DataFrame, keys: list[str], order: list[str], size: int, values: dict[str, Column]
) -> DataFrame:
    """For each name the last non-null value on an earlier row of the key."""
    df = with_block(df, order[0], size)
    position = F.struct(*order)
    carried = df.groupBy(*keys, BLOCK).agg(
        *[
            F.max_by(value, F.when(value.isNotNull(), position)).alias(f"_in_{name}")
            for name, value in values.items()
        ]
    )
    carried = _carry(carried, keys, [f"_in_{n}" for n in values], "last")
    local = W.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = by_block(df, keys).withColumns(
        {f"_at_{n}": F.last(v, ignorenulls=True).over(local) for n, v in values.items()}
    ).join(carried, [*keys, BLOCK])
    out = out.withColumns({n: F.coalesce(F.col(f"_at_{n}"), F.col(f"_in_{n}")) for n in values})
    return out.drop(BLOCK, *[f"_at_{n}" for n in values], *[f"_in_{n}" for n in values])


def next_after(
    df: DataFrame, keys: list[str], order: list[str], size: int, values: dict[str, Column]
) -> DataFrame:
    """For each name the first non-null value on a later row of the key."""
    df = with_block(df, order[0], size)
    position = F.struct(*order)
    carried = df.groupBy(*keys, BLOCK).agg(
        *[
            F.min_by(value, F.when(value.isNotNull(), position)).alias(f"_in_{name}")
            for name, value in values.items()
        ]
    )
    carried = _carry(carried, keys, [f"_in_{n}" for n in values], "first")
    local = W.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    out = by_block(df, keys).withColumns(
        {f"_at_{n}": F.first(v, ignorenulls=True).over(local) for n, v in values.items()}
    ).join(carried, [*keys, BLOCK])
    out = out.withColumns({n: F.coalesce(F.col(f"_at_{n}"), F.col(f"_in_{n}")) for n in values})
    return out.drop(BLOCK, *[f"_at_{n}" for n in values], *[f"_in_{n}" for n in values])
