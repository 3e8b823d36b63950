"""Product structures as graphs: degrees, reach in both directions, depth, cycles, paths, expansion, importance.

Edges are (parent, child, quantity_per); parallel links are one edge, that of the greatest link key. Reach comes from
Hierarchy.places over all parts at once, so it is computed once for whatever is asked of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.operators.hierarchy import Hierarchy
from partloom.session import Cuts


def edges_of(links: DataFrame) -> DataFrame:
    """(parent, child, quantity_per): one edge per pair of parts; a null quantity is 0, links without both ends don't count."""
    ok = links.where("parent_part_key is not null and child_part_key is not null")
    last = ok.groupBy(F.col("parent_part_key").alias("parent"), F.col("child_part_key").alias("child")).agg(F.max(F.struct("bom_rel_key", F.coalesce("quantity_per", F.lit(0)).alias("q"))).alias("m"))
    return last.select("parent", "child", F.col("m.q").alias("quantity_per"))


def degrees(edges: DataFrame) -> DataFrame:
    """(part, n_in, n_out): every part of an edge; both ends are counted in one pass."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("parent").alias("part"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("child").alias("part"), F.lit(1).alias("i"), F.lit(0).alias("o")))))
    return ends.groupBy("part").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def roots(edges: DataFrame) -> DataFrame:
    return degrees(edges).where("n_in = 0 and n_out > 0").select("part")


def leaves(edges: DataFrame) -> DataFrame:
    return degrees(edges).where("n_out = 0").select("part")


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("parent = child").select(F.col("parent").alias("part"))


def unknown_parts(edges: DataFrame, known: DataFrame) -> DataFrame:
    """(part, role): parts of the graph that the master doesn't have, as missing parent or missing child."""
    bad = degrees(edges).join(known.select(F.col("part_key").alias("part")), "part", "left_anti")
    return bad.select("part", F.when(F.col("n_out") > 0, "missing_parent").otherwise("missing_child").alias("role"))


def centrality(edges: DataFrame) -> DataFrame:
    """(part, centrality): degree over the number of other parts, a loop counting twice."""
    d = degrees(edges).withColumn("_1", F.lit(1))
    n = d.groupBy("_1").agg(F.count(F.lit(1)).alias("n"))
    return d.join(F.broadcast(n), "_1").select("part", F.round((F.col("n_in") + F.col("n_out")) / F.greatest(F.col("n") - 1, F.lit(1)), 6).alias("centrality"))


def reach(h: Hierarchy) -> DataFrame:
    """(part, below, level): every pair of a part and another part below it, with the fewest links between."""
    seeds = h.edges.select(F.col("parent").alias("part"))
    return h.places(seeds=seeds).where("root <> part").select(F.col("root").alias("part"), F.col("part").alias("below"), "level")


def reach_counts(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, n_above, n_below): how many parts are above and below each part of the graph."""
    ends = reached.select(F.inline(F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("a"), F.lit(1).alias("b")), F.struct(F.col("below").alias("p"), F.lit(1).alias("a"), F.lit(0).alias("b")))))
    n = ends.groupBy(F.col("p").alias("part")).agg(F.sum("a").alias("n_above"), F.sum("b").alias("n_below"))
    return degrees(edges).select("part").join(n, "part", "left").na.fill(0, ["n_above", "n_below"])


def depths(h: Hierarchy, reached: DataFrame) -> DataFrame:
    """(part, depth, endless): longest chain below; for parts that can reach a cycle the number of parts below instead."""
    ends = h.edges.select(F.col("parent").alias("part")).union(h.edges.select(F.col("child").alias("part"))).distinct()
    chains, endless = h.longest()
    n = reached.join(endless, "part", "left_semi").groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    loops = endless.join(n, "part", "left").select("part", F.coalesce("n", F.lit(0)).alias("n"), F.lit(True).alias("endless"))
    return ends.join(chains, "part", "left").join(loops, "part", "left").select("part", F.coalesce(F.col("n"), F.col("depth").cast("long"), F.lit(0)).alias("depth"), F.coalesce("endless", F.lit(False)).alias("endless"))


def max_depth(h: Hierarchy, reached: DataFrame) -> DataFrame:
    """One row (max_depth): the greatest depth of any part; 0 without links."""
    return depths(h, reached).agg(F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("max_depth"))


def expansion(h: Hierarchy, edges: DataFrame, part: str, most_levels: int | None = None) -> DataFrame:
    """(parent, child, level, quantity_per): all edges below a part, each with the level at which its parent is first met, plus one."""
    seed = h.spark.createDataFrame([(part,)], "part string")
    at = h.places(seeds=seed).select(F.col("part").alias("parent"), (F.col("level") + 1).alias("level"))
    rows = edges.join(at, "parent").select("parent", "child", "level", "quantity_per")
    return rows if most_levels is None else rows.where(F.col("level") <= most_levels)


def closure_of(edges: DataFrame, part: str, down: bool = True) -> DataFrame:
    """(part): a part and all parts below it (above it, with down=False), level by level; for single questions, as every level is a job of its own."""
    cuts = Cuts(edges.sparkSession, "closure")
    src, dst = ("parent", "child") if down else ("child", "parent")
    step = edges.select(F.col(src).alias("part"), F.col(dst).alias("to"))
    seen = front = edges.sparkSession.createDataFrame([(part,)], "part string")
    while True:
        nxt = front.join(step, "part").select(F.col("to").alias("part")).distinct().join(seen, "part", "left_anti")
        front, n, _ = cuts.write(nxt)
        if not n:
            return seen
        seen = seen.union(front)


def simple_paths(edges: DataFrame, start: str, end: str, most: int = 25) -> DataFrame:
    """(path, n_links): up to `most` paths from start to end that meet no part twice, shortest first, then by their keys.

    Only edges below start and above end are walked, until enough paths are found or none is open.
    """
    cuts = Cuts(edges.sparkSession, "paths")
    down = closure_of(edges, start)
    up = closure_of(edges, end, False)
    walk, _, _ = cuts.write(edges.join(down.withColumnRenamed("part", "parent"), "parent", "left_semi").join(up.withColumnRenamed("part", "child"), "child", "left_semi").select("parent", "child"))
    front, n, _ = cuts.write(edges.sparkSession.createDataFrame([([start],)], "path array<string>"))
    found = front.limit(0).select("path", F.lit(0).alias("n_links"))
    links, n_found = 0, 0
    while n and n_found < most:
        links += 1
        step = front.select("path", F.element_at("path", -1).alias("parent")).join(walk, "parent").where(~F.array_contains("path", F.col("child"))).select(F.concat("path", F.array("child")).alias("path"))
        grown, _, _ = cuts.write(step)
        done, n_done, _ = cuts.write(grown.where(F.element_at("path", -1) == end).select("path", F.lit(links).alias("n_links")))
        if n_done:
            found, n_found = found.unionByName(done), n_found + n_done
        front, n, _ = cuts.write(grown.where(F.element_at("path", -1) != end))
    return found.orderBy("n_links", "path").limit(most)


def simple_cycles(h: Hierarchy) -> DataFrame:
    """(cycle, n_links): the cycles of two or more parts that meet no part twice, starting at their smallest key.

    Searched within the groups of parts that reach each other until no path is open, so a path has at most the parts of its
    group. The number of cycles, and with it the work, can grow exponentially with the links of a group.
    """
    cuts = Cuts(h.spark, "cycles")
    groups, _, _ = cuts.write(h.cycles())
    side = lambda c: groups.select(F.col("part").alias(c), F.col("group_key").alias(f"g_{c}"))
    core, _, _ = cuts.write(h.edges.where("parent <> child").join(side("parent"), "parent").join(side("child"), "child").where("g_parent = g_child").select("parent", "child"))
    front, n, _ = cuts.write(core.where("child > parent").select(F.array("parent", "child").alias("path")))
    found = front.limit(0).select(F.col("path").alias("cycle"), F.lit(0).alias("n_links"))
    links = 1
    while n:
        links += 1
        step = front.select("path", F.element_at("path", -1).alias("parent")).join(core, "parent")
        back = step.where(F.col("child") == F.element_at("path", 1)).select(F.col("path").alias("cycle"), F.lit(links).alias("n_links"))
        closed, n_closed, _ = cuts.write(back)
        if n_closed:
            found = found.unionByName(closed)
        on = step.where((F.col("child") > F.element_at("path", 1)) & ~F.array_contains("path", F.col("child"))).select(F.concat("path", F.array("child")).alias("path"))
        front, n, _ = cuts.write(on)
    return found


def page(h: Hierarchy, edges: DataFrame, parts: DataFrame, part: str, most_levels: int = 3) -> tuple[DataFrame, DataFrame]:
    """((id, description, lifecycle_status, category, in_cycle), (parent, child, level, quantity_per)): a part's structure to some levels, with what its parts are.

    Parts that the master doesn't have are shown without attributes.
    """
    shown, _, _ = Cuts(h.spark, "page").write(expansion(h, edges, part, most_levels))
    ids = shown.select(F.inline(F.array(F.struct(F.col("parent").alias("id")), F.struct(F.col("child").alias("id"))))).union(h.spark.createDataFrame([(part,)], "id string")).distinct()
    attributes = parts.select(F.col("part_key").alias("id"), "description", "lifecycle_status", "category")
    looped = h.cycles().select(F.col("part").alias("id"), F.lit(True).alias("in_cycle"))
    nodes = ids.join(attributes, "id", "left").join(looped, "id", "left").withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False)))
    return nodes, shown


def criticality(reached: DataFrame, edges: DataFrame, demand: DataFrame) -> DataFrame:
    """(part, affected_assemblies, direct_parent_count, demand_exposed, criticality_score) of every part of the graph.

    Exposed demand is that of the part and of all parts above it; demand is summed per part before it meets the pairs.
    """
    d = demand.groupBy(F.col("part_key").alias("part")).agg(F.sum("demand_qty").cast("decimal(18,2)").alias("q"))
    own = degrees(edges).select("part", F.col("n_in").alias("direct_parent_count")).join(d, "part", "left")
    above = reached.join(d, "part", "left").groupBy(F.col("below").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q_above"))
    j = own.join(above, "part", "left")
    exposed = (F.coalesce("q", F.lit(0)) + F.coalesce("q_above", F.lit(0))).cast("decimal(18,2)")
    n = F.coalesce("n", F.lit(0))
    return j.select("part", n.alias("affected_assemblies"), "direct_parent_count", exposed.alias("demand_exposed"), F.round(n * 1.0 + F.col("direct_parent_count") * 0.5 + exposed.cast("double") / 100.0, 4).alias("criticality_score"))


def concentration(reached: DataFrame, edges: DataFrame, supplied: DataFrame) -> DataFrame:
    """(part, components_in_tree, components_with_suppliers, single_source_components, single_source_ratio) of each part and what is below it."""
    s = supplied.where("part_id is not null").groupBy(F.col("part_id").alias("below")).agg(F.countDistinct("supplier_id").alias("n")).select("below", F.lit(1).alias("has"), (F.col("n") == 1).cast("int").alias("single"))
    tree = reached.select("part", "below").union(degrees(edges).select("part", "part"))
    g = tree.join(s, "below", "left").groupBy("part").agg(F.count(F.lit(1)).alias("components_in_tree"), F.count("has").alias("components_with_suppliers"), F.coalesce(F.sum("single"), F.lit(0)).alias("single_source_components"))
    return g.withColumn("single_source_ratio", F.coalesce(F.round(F.try_divide("single_source_components", "components_with_suppliers"), 4), F.lit(0.0)))


def validation(edges: DataFrame, known: DataFrame, h: Hierarchy) -> DataFrame:
    """One row: (nodes, edges, self_references, parts_on_cycles, missing_parents, missing_children, components)."""
    from partloom.operators.stars import weak_groups

    one = lambda df, *cols: df.agg(*cols).withColumn("_1", F.lit(1))
    n = F.count(F.lit(1))
    bad = unknown_parts(edges, known)
    parts = [
        one(degrees(edges), n.alias("nodes")), one(edges, n.alias("edges"), F.count(F.when(F.expr("parent = child"), 1)).alias("self_references")), one(h.cycles(), n.alias("parts_on_cycles")),
        one(bad, F.count(F.when(F.expr("role = 'missing_parent'"), 1)).alias("missing_parents"), F.count(F.when(F.expr("role = 'missing_child'"), 1)).alias("missing_children")),
        one(weak_groups(edges), F.countDistinct("group_key").alias("components")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "_1")
    return out.drop("_1")
