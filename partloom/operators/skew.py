"""Joins that stay balanced when single keys hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than 1/HOT_PARTS of the rows, so there are fewer than HOT_PARTS hot keys.
HOT_PARTS = 256
#: rows of one key below which no key is worth a way of its own
LEAST = 100_000


def join_unique(left: DataFrame, right: DataFrame, on: str, how: str = "left", hot_parts: int = HOT_PARTS, least: int = LEAST, n: int | None = None) -> DataFrame:
    """Join left (any number of rows per key) to right (at most one row per key) by sort-merge.

    Rows of hot keys don't go through the shuffle: the right rows of hot keys, at most hot_parts, are
    broadcast. The bound holds by construction, whatever the input: each hot key holds more than
    1/hot_parts of the left rows (and at least `least` rows, below which no key is worth it). All other keys are co-partitioned, sorted and merged.
    left is read once more to count its keys, so it should be a stored table; n, its number of rows, saves that where it is small.
    Null keys match nothing; with how="left" their rows stay. An empty side gives the join's usual result.
    """
    if n is not None and n <= least:
        return left.join(right, on, how)
    counts = left.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.where(F.col("_n") > least).orderBy(F.desc("_n")).limit(hot_parts).collect()
    total = (left.count() if n is None else n) if top else 0
    keys = [k for k, c in top if c * hot_parts > total]
    if not keys:
        return left.join(right.hint("merge"), on, how)
    is_hot = F.coalesce(F.col(on).isin(keys), F.lit(False))
    warm = left.where(~is_hot).join(right.where(~is_hot).hint("merge"), on, how)
    burn = left.where(is_hot).join(F.broadcast(right.where(is_hot)), on, how)
    return warm.unionByName(burn)
