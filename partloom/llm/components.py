"""Pairwise matches to groups: connected components over any number of pairs.

Method: union-find runs within partitions of the links and keeps only a spanning forest of each; the forests are
merged through ever fewer partitions, each of bounded size, until one is left. A forest larger than one task may
hold is contracted by rounds over all partitions instead (each part takes the smallest key among its
neighbours; large-star and small-star steps), which ends with the same groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.functions.keys import key
from partloom.operators.stars import stars
from partloom.session import Cuts

#: links that one task may hold
TASK_LINKS = 500_000
#: so many forests are merged into one at a time
FAN_IN = 8


def linking_pairs(judged: DataFrame, a: str, b: str, band: str, at: str, not_linking: tuple[str, ...] = ("UNRESOLVED",)) -> DataFrame:
    """(a, b), a < b: the pairs whose latest judgement links.

    Pairs count in either order; those with a missing or blank id or twice the same id don't count. A null band never
    links. Of judgements at the same time the one with the greatest band counts; a null time is the oldest.
    """
    ids = judged.select(key(a).alias("x"), key(b).alias("y"), key(band).alias("band"), F.col(at).alias("t")).where("x is not null and y is not null and x <> y")
    last = ids.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max(F.struct("t", "band")).alias("m"))
    return last.where(F.col("m.band").isNotNull() & ~F.col("m.band").isin(*not_linking)).select("a", "b")


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the links of one task: every part but the smallest of its group, linked to the smallest."""
    up: dict[str, str] = {}

    def find(x: str) -> str:
        top = x
        while (nxt := up.get(top, top)) != top:
            top = nxt
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    for pdf in batches:
        for x, y in zip(pdf["a"], pdf["b"]):
            rx, ry = find(x), find(y)
            if rx < ry:
                up[ry] = rx
            elif ry < rx:
                up[rx] = ry
    members = list(up)
    tops = [find(x) for x in members]
    yield pd.DataFrame({"a": tops, "b": members}, dtype=object)


def components(pairs: DataFrame, task_links: int = TASK_LINKS, fan_in: int = FAN_IN) -> DataFrame:
    """(group_id, part_id): one row per part of any pair (a, b); group_id is the smallest key of its group.

    No pairs give no rows. task_links bounds what a task holds, whatever the size of the groups.
    """
    cuts = Cuts(pairs.sparkSession, "components")
    table, n, path = cuts.write(pairs.select("a", "b"))
    parts = max(-(-n // task_links), min(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 10_000)), 1)
    while True:
        spread = table.coalesce(1) if parts == 1 else table.repartition(parts, F.xxhash64("a", "b"))
        forest, n_forest, new = cuts.write(spread.mapInPandas(_forest, "a string, b string"))
        cuts.drop(path)
        table, path = forest, new
        if parts == 1:
            break
        fewer = max(-(-parts // fan_in), -(-n_forest // task_links))
        if fewer >= parts:
            table = stars(forest, cuts)
            break
        parts = fewer
    return table.select(F.col("a").alias("group_id"), F.col("b").alias("part_id")).unionByName(table.select(F.col("a").alias("group_id"), F.col("a").alias("part_id")).distinct())
