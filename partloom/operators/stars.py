"""Connected components of links of any number, by rounds over all partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.operators.skew import join_unique
from partloom.session import Cuts


def stars(links: DataFrame, cuts: Cuts) -> DataFrame:
    """(a, b): every part b linked to the smallest key a of its group, by rounds over all partitions.

    The centre of a giant group holds a large part of all links; its rows stay where they are (operators.skew).
    """
    table, n, path = cuts.write(links)
    before = None
    while True:
        both = table.select(F.inline(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))))
        # large star: larger neighbours to the smallest neighbour
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = join_unique(both, low, "x", "inner", n=2 * n).where("y > x").select(F.col("m").alias("a"), F.col("y").alias("b")).where("a <> b").distinct()
        table, n, p1 = cuts.write(large)
        # small star: smaller neighbours and the part itself to the smallest of them
        down = table.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
        low = down.groupBy("x").agg(F.min("y").alias("m"))
        small = join_unique(down, low, "x", "inner", n=n).select(F.col("m").alias("a"), F.col("y").alias("b")).union(low.select("m", "x")).where("a <> b").distinct()
        nxt, n, p2 = cuts.write(small)
        state = tuple(nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        cuts.drop(path)
        cuts.drop(p1)
        if state == before:
            return nxt
        table, path, before = nxt, p2, state


def weak_groups(edges: DataFrame) -> DataFrame:
    """(group_key, part): the parts of the links (parent, child) with the smallest key they are connected to, whatever the direction."""
    links = edges.select(F.least("parent", "child").alias("a"), F.greatest("parent", "child").alias("b"))
    top = stars(links.where("a <> b").distinct(), Cuts(edges.sparkSession, "groups"))
    nodes = edges.select(F.col("parent").alias("part")).union(edges.select(F.col("child").alias("part"))).distinct()
    return nodes.join(top.withColumnRenamed("b", "part"), "part", "left").select(F.coalesce("a", "part").alias("group_key"), "part")
