"""What a defect of a part affects, for all parts at once, and what-if changes on copies of the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.operators import graph
from partloom.operators.hierarchy import Hierarchy
from partloom.session import Cuts

#: fixed values: weights of the priority
WEIGHTS = {"assemblies": 2.0, "demand": 0.01, "inventory": 0.001, "orders": 0.001, "production": 3.0, "single_source": 10.0}


def blast_radius(reached: DataFrame, edges: DataFrame, depth: DataFrame, parts: DataFrame, demand: DataFrame, inventory: DataFrame, orders: DataFrame, production: DataFrame, supplied: DataFrame) -> DataFrame:
    """One row per part of the graph: what is affected are the part and all parts above it.

    Sums run over all order statuses; missing costs count as 0. Every measure is aggregated per part before it meets the
    pairs, and sets of suppliers and plants travel as bounded distinct rows.
    """
    def money(df: DataFrame, c: str, name: str) -> DataFrame:
        return df.groupBy(F.col("part_key").alias("a")).agg(F.sum(c).cast("decimal(18,2)").alias(name))

    affected = reached.select(F.col("below").alias("part"), F.col("part").alias("a")).union(graph.degrees(edges).select("part", F.col("part").alias("a")))
    per = affected
    cost = parts.select(F.col("part_key").alias("a"), F.col("standard_cost").alias("cost"), "primary_plant")
    made = production.groupBy(F.col("part_key").alias("a")).agg(F.count(F.lit(1)).alias("n_prod"))
    for more in (money(demand, "demand_qty", "dem"), money(inventory, "on_hand_value", "inv"), money(orders, "line_value", "po"), cost, made):
        per = per.join(more, "a", "left")
    sums = per.groupBy("part").agg(
        (F.count(F.lit(1)) - 1).alias("affected_parent_assemblies"), *[F.coalesce(F.sum(c), F.lit(0)).cast("decimal(18,2)").alias(n) for c, n in (("dem", "future_demand_qty_exposed"), ("inv", "inventory_value_exposed"), ("po", "po_value_exposed"), ("cost", "estimated_cost_exposure"))],
        F.coalesce(F.sum("n_prod"), F.lit(0)).alias("production_orders_affected"), F.countDistinct("primary_plant").alias("plants_affected"))
    suppliers = supplied.where("part_id is not null and supplier_id is not null").select(F.col("part_id").alias("a"), "supplier_id").distinct()
    n_sup = affected.join(suppliers, "a").groupBy("part").agg(F.countDistinct("supplier_id").alias("suppliers_affected"))
    below = reached.groupBy("part").agg(F.count(F.lit(1)).alias("downstream_components"))
    single = graph.concentration(reached, edges, supplied).select("part", "single_source_ratio")
    out = sums.join(n_sup, "part", "left").join(below, "part", "left").join(depth.select("part", F.col("depth").alias("dependency_depth")), "part", "left").join(single, "part", "left").na.fill(0, ["suppliers_affected", "downstream_components", "dependency_depth"])
    # in decimals, so that rounding doesn't depend on the order of the terms
    d = lambda c, w: F.col(c).cast("decimal(20,2)") * F.lit(str(w)).cast("decimal(5,3)")
    score = d("affected_parent_assemblies", WEIGHTS["assemblies"]) + d("future_demand_qty_exposed", WEIGHTS["demand"]) + d("inventory_value_exposed", WEIGHTS["inventory"]) + d("po_value_exposed", WEIGHTS["orders"]) + d("production_orders_affected", WEIGHTS["production"])
    return out.withColumn("operational_priority", F.round(score + F.when(F.col("single_source_ratio") > 0.5, F.lit(str(WEIGHTS["single_source"])).cast("decimal(5,3)")).otherwise(F.lit(0).cast("decimal(5,3)")), 2).cast("double"))


def radius_of(part: str, links: DataFrame, parts: DataFrame, demand: DataFrame, inventory: DataFrame, orders: DataFrame, production: DataFrame, supplied: DataFrame) -> DataFrame:
    """The row of blast_radius of one part, from what is above and below it only; no row if no link has the part."""
    edges, _, _ = Cuts(links.sparkSession, "radius").write(graph.edges_of(links))
    above = graph.closure_of(edges, part, False).select(F.col("part").alias("part"), F.lit(part).alias("below"))
    below = graph.closure_of(edges, part).select(F.lit(part).alias("part"), F.col("part").alias("below"))
    reached = above.unionByName(below).where("part <> below").distinct()
    tree = edges.join(below.select(F.col("below").alias("parent")), "parent", "left_semi")
    h = Hierarchy(tree.select("parent", "child"))
    depth = graph.depths(h, reached)
    mine = edges.where((F.col("parent") == part) | (F.col("child") == part))
    return blast_radius(reached, mine, depth, parts, demand, inventory, orders, production, supplied).where(F.col("part") == part)


def merge_impact(duplicate: str, survivor: str, links: DataFrame, supplied: DataFrame, **facts: DataFrame) -> DataFrame:
    """(moment, ...): what the survivor of a merge affects before and after it; facts: parts, demand, inventory, orders, production."""
    new_links, new_supplied = merged(links, supplied, duplicate, survivor)
    at = lambda moment, ls, sup: radius_of(survivor, ls, supplied=sup, **facts).select(F.lit(moment).alias("moment"), "*")
    return at("before", links, supplied).unionByName(at("after", new_links, new_supplied))


def keep_scenario(report: DataFrame, kind: str, parameters: dict[str, str], folder: str) -> str:
    """The report of a what-if change, appended to the table of scenarios in the folder as one row of JSON; gives its id. Approval is always required."""
    scenario = "SCN-" + uuid.uuid4().hex[:12]
    row = report.select(F.to_json(F.struct("*")).alias("result")).agg(F.to_json(F.sort_array(F.collect_list("result"))).alias("result"))
    row.select(F.lit(scenario).alias("scenario_id"), F.lit(kind).alias("scenario_type"), F.to_json(F.create_map(*[F.lit(x) for kv in sorted(parameters.items()) for x in kv])).alias("parameters"), "result", F.lit(True).alias("approval_required")).write.mode("append").parquet(folder)
    return scenario


def kept_scenario(spark: SparkSession, folder: str, scenario_id: str) -> DataFrame:
    """The kept scenario of an id."""
    return spark.read.parquet(folder).where(F.col("scenario_id") == scenario_id)


def merged(links: DataFrame, supplied: DataFrame, duplicate: str, survivor: str) -> tuple[DataFrame, DataFrame]:
    """The tables after a duplicate part's links and suppliers went to the survivor; the given ones stay as they are."""
    swap = lambda c: F.when(F.col(c) == duplicate, survivor).otherwise(F.col(c)).alias(c)
    new_links = links.withColumns({c: swap(c) for c in ("parent_part_key", "child_part_key")})
    return new_links, supplied.withColumn("part_id", swap("part_id"))


def replaced(links: DataFrame, parent: str, old: str, new: str) -> DataFrame:
    """The links after one parent's component was replaced by another."""
    hit = (F.col("parent_part_key") == parent) & (F.col("child_part_key") == old)
    return links.withColumn("child_part_key", F.when(hit, new).otherwise(F.col("child_part_key")))


def has_cycle(links: DataFrame) -> bool:
    """Whether a part contains itself, directly or indirectly: the links between entries that are never processed are not none."""
    return Hierarchy(links.where("parent_part_key is not null and child_part_key is not null").select(F.col("parent_part_key").alias("parent"), F.col("child_part_key").alias("child")).distinct()).has_cycle


def merge_report(links: DataFrame, supplied: DataFrame, parts: DataFrame, duplicate: str, survivor: str) -> DataFrame:
    """One row: (repointed_links, repointed_supplier_links, survivor_status, resolved_rules, warnings) of a merge."""
    new_links, _ = merged(links, supplied, duplicate, survivor)
    cycle = has_cycle(new_links)
    a = links.agg(F.count(F.when(F.col("child_part_key") == duplicate, 1)).alias("c"), F.count(F.when(F.col("parent_part_key") == duplicate, 1)).alias("p")).withColumn("_1", F.lit(1))
    b = supplied.agg(F.count(F.when(F.col("part_id") == duplicate, 1)).alias("repointed_supplier_links")).withColumn("_1", F.lit(1))
    s = parts.agg(F.max(F.when(F.col("part_key") == survivor, F.col("lifecycle_status"))).alias("survivor_status")).withColumn("_1", F.lit(1))
    warn = F.array_compact(F.array(F.when(F.col("survivor_status") != "ACTIVE", "survivor is not active"), F.when(F.lit(cycle), "the structure has a cycle")))
    return a.join(b, "_1").join(s, "_1").select((F.col("c") + F.col("p")).alias("repointed_links"), "repointed_supplier_links", "survivor_status", F.lit("UNIQ-002").alias("resolved_rules"), F.array_join(warn, "; ").alias("warnings"))


def replacement_report(links: DataFrame, parts: DataFrame, parent: str, old: str, new: str) -> DataFrame:
    """One row: (relationships_replaced, resolved_rules, warnings) of a replacement."""
    cycle = has_cycle(replaced(links, parent, old, new))
    a = links.agg(F.count(F.when((F.col("parent_part_key") == parent) & (F.col("child_part_key") == old), 1)).alias("relationships_replaced")).withColumn("_1", F.lit(1))
    is_ = lambda k: F.max(F.when(F.col("part_key") == k, F.coalesce("lifecycle_status", F.lit("?"))))
    s = parts.agg(is_(old).alias("o"), is_(new).alias("n")).withColumn("_1", F.lit(1))
    warn = F.array_compact(F.array(F.when(F.col("n").isNull(), "replacement doesn't exist"), F.when(F.col("n").isin("OBSOLETE", "BLOCKED"), F.concat(F.lit("replacement is "), F.lower("n"))), F.when(F.lit(cycle), "the structure has a cycle")))
    return a.join(s, "_1").select("relationships_replaced", F.when(F.col("o") == "OBSOLETE", "XFLD-004").otherwise("").alias("resolved_rules"), F.array_join(warn, "; ").alias("warnings"))


def correction_report(parts: DataFrame, field: str, corrections: DataFrame, units: list[str]) -> DataFrame:
    """(part_key, old_value, new_value, resolved_rules, warning) for proposed corrections (part_key, new_value) of a unit or a cost."""
    both = corrections.join(parts.select("part_key", F.col(field).cast("string").alias("old_value")), "part_key", "left")
    new = F.col("new_value")
    if field == "uom":
        ok, rule, why = new.isin(units), "VALD-001", F.lit("unit isn't governed")
    elif field == "standard_cost":
        number = new.try_cast("double")
        ok, rule, why = number > 0, "VALD-004", F.when(number.isNull(), "cost isn't a number").otherwise("cost isn't positive")
    else:
        ok, rule, why = F.lit(True), "", F.lit("")
    good = F.coalesce(ok, F.lit(False))
    return both.select("part_key", "old_value", "new_value", F.when(good, rule).otherwise("").alias("resolved_rules"), F.when(good, "").otherwise(why).alias("warning"))
