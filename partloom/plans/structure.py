"""Queries on product structures and impact, each with the same in SQL where it can be said."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.operators import graph, impact
from partloom.operators.hierarchy import Hierarchy
from partloom.operators.stars import weak_groups
from partloom.plans.core_sql import with_tables
from partloom.session import is_written, state_of
from partloom.sources.binding import UOMS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_EDGES = "select parent_part_key parent, child_part_key child, arg_max(coalesce(quantity_per, 0), bom_rel_key) quantity_per from fact_bom where parent_part_key is not null and child_part_key is not null group by 1, 2"
_DEG = "select part, sum(i) n_in, sum(o) n_out from (select parent part, 0 i, 1 o from edges union all select child, 1, 0 from edges) group by 1"
_REACH = {
    "edges": _EDGES,
    "deg": _DEG,
    "walk(part, below)": "select parent, child from edges union select w.part, e.child from walk w join edges e on e.parent = w.below",
    "reached": "select part, below from walk where part <> below",
}


def add(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None, parts: dict[str, str] | None = None, recursive: bool = False) -> None:
    QUERIES[name] = lambda spark, d: build(Tables(spark, d))
    if sql is not None:
        ORACLES[name] = with_tables(sql, parts or {"edges": _EDGES, "deg": _DEG}, recursive)


def _edges(t: Tables) -> DataFrame:
    return t.kept("edges", lambda: graph.edges_of(t.fact_bom))


_built: dict[tuple[str, str, str], Hierarchy] = {}


def _hierarchy(t: Tables) -> Hierarchy:
    """The hierarchy of the folder's links, built once for the session; anew if its files change or its tables are lost."""
    at = (t.spark.sparkContext.applicationId, t.folder, state_of(t.spark, t.folder))
    if at not in _built or not is_written(t.spark, f"{_built[at].cuts.root}/0001"):
        _built[at] = Hierarchy(_edges(t).select("parent", "child"))
    return _built[at]


def _reach(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The edges, and all pairs of a part and one below it, found once for the session."""
    e = _edges(t)
    return e, t.kept("reach", lambda: graph.reach(_hierarchy(t)))


def _depth(t: Tables) -> DataFrame:
    return t.kept("depth", lambda: graph.depths(_hierarchy(t), _reach(t)[1]))


def _first(t: Tables, n: int) -> list[str]:
    """The first keys of parents, to ask single questions about."""
    return [r[0] for r in t.fact_bom.where("parent_part_key is not null").groupBy("parent_part_key").count().orderBy("parent_part_key").limit(n).select("parent_part_key").collect()]


_FIRST = "(select parent from edges group by 1 order by 1 limit 1)"

add("graph_edges", lambda t: _edges(t), "select parent, child, quantity_per from edges")
add("graph_degree", lambda t: graph.degrees(_edges(t)), "select part, cast(n_in as bigint) n_in, cast(n_out as bigint) n_out from deg")
add("graph_roots", lambda t: graph.roots(_edges(t)), "select part from deg where n_in = 0")
add("graph_leaves", lambda t: graph.leaves(_edges(t)), "select part from deg where n_out = 0")
add("graph_self_loops", lambda t: graph.self_loops(_edges(t)), "select parent part from edges where parent = child")
add("graph_orphans", lambda t: graph.unknown_parts(_edges(t), t.dim_part), "select part, case when n_out > 0 then 'missing_parent' else 'missing_child' end as role from deg where part not in (select part_key from dim_part)")
add("graph_centrality", lambda t: graph.centrality(_edges(t)), "select part, round(cast(n_in + n_out as double) / greatest((select count(*) from deg) - 1, 1), 6) centrality from deg")
add("graph_descendants", lambda t: _reach(t)[1].select("part", "below"), "select part, below from reached", _REACH, True)
add("graph_ancestors", lambda t: _reach(t)[1].select(F.col("below").alias("part"), F.col("part").alias("above")), "select below part, part above from reached", _REACH, True)


def _counts(t: Tables) -> DataFrame:
    e, r = _reach(t)
    return graph.reach_counts(r, e)


add("graph_reach_counts", _counts, "select part, cast((select count(*) from reached r where r.below = d.part) as bigint) n_above, cast((select count(*) from reached r where r.part = d.part) as bigint) n_below from deg d", _REACH, True)


_LOOPS = _REACH | {
    "cyc": "select part from walk where part = below",
    "endless": "select part from walk where below in (select part from cyc) union select part from cyc",
    "chain(part, n)": "select part, 0 from deg where part not in (select part from endless) union select e.parent, c.n + 1 from chain c join edges e on e.child = c.part where e.parent not in (select part from endless)",
}
_DEPTH = "select part, cast(max(n) as bigint) depth, false endless from chain group by 1 union all select part, (select count(*) from reached r where r.part = e.part), true from endless e"
add("graph_depth", _depth, _DEPTH, _LOOPS, True)
add("graph_expand", lambda t: (lambda e: graph.expansion(_hierarchy(t), e, _first(t, 1)[0]))(_edges(t)), f"select parent, child, cast(lvl + 1 as bigint) as level, quantity_per from (select part, min(lvl) lvl from tree group by 1) join edges on parent = part", {"edges": _EDGES, "tree(part, lvl)": f"select * from (select x.parent, 0 from {_FIRST} x) union select e.child, lvl + 1 from tree join edges e on e.parent = part where lvl < 60"}, True)
add("graph_weak_groups", lambda t: weak_groups(_edges(t).select("parent", "child")), "select min(other) group_key, part from meet group by 2", {"edges": _EDGES, "ends_": "select parent a, child b from edges union select child, parent from edges", "meet(part, other)": "select a, a from ends_ union select m.part, x.b from meet m join ends_ x on x.a = m.other"}, True)
add("graph_cycles", lambda t: graph.simple_cycles(_hierarchy(t)).select(F.array_join("cycle", ">").alias("cycle"), "n_links"), "select array_to_string(path, '>') as cycle, cast(len(path) as int) n_links from run join edges e on e.parent = path[-1] and e.child = path[1]", {"edges": _EDGES, "run(path)": "select [parent, child] from edges where child > parent union all select list_append(path, e.child) from run join edges e on e.parent = path[-1] where e.child > path[1] and not list_contains(path, e.child) and len(path) < 12"}, True)


def _paths(t: Tables) -> DataFrame:
    e = _edges(t)
    h = _hierarchy(t)
    seed = t.spark.createDataFrame([(_first(t, 1)[0],)], "part string")
    far = h.places(seeds=seed).orderBy(F.desc("level"), "part").first()
    return graph.simple_paths(e.select("parent", "child"), far["root"], far["part"]).select(F.array_join("path", ">").alias("path"), "n_links")


_WAYS = {
    "edges": _EDGES,
    "tree(part, lvl)": f"select * from (select x.parent, 0 from {_FIRST} x) union select e.child, lvl + 1 from tree join edges e on e.parent = part where lvl < 60",
    "far": "select part from (select part, min(lvl) l from tree group by 1) order by l desc, part limit 1",
    "ways(path)": f"select [x.parent] from {_FIRST} x union all select list_append(path, e.child) from ways join edges e on e.parent = path[-1] where not list_contains(path, e.child) and path[-1] <> (select part from far)",
}
add("graph_paths", _paths, "select array_to_string(path, '>') as path, cast(len(path) - 1 as int) n_links from ways where len(path) > 1 and path[-1] = (select part from far) order by len(path), path limit 25", _WAYS, True)


def _criticality(t: Tables) -> DataFrame:
    e, r = _reach(t)
    return graph.criticality(r, e, t.fact_demand)


_DEMAND = _REACH | {"dem": "select part_key part, cast(sum(demand_qty) as decimal(18, 2)) q from fact_demand group by 1", "aff": "select below part, part a from reached union all select part, part from deg"}
add("graph_criticality", _criticality, """select part, cast(n - 1 as bigint) affected_assemblies, cast(n_in as bigint) direct_parent_count, x demand_exposed, round((n - 1) * 1.0e0 + n_in * 0.5e0 + cast(x as double) / 100.0e0, 4) criticality_score from
    (select part, count(*) n, cast(coalesce(sum(q), 0) as decimal(18, 2)) x from aff left join (select part a, q from dem) using (a) group by 1) join deg using (part)""", _DEMAND, True)


def _concentration(t: Tables) -> DataFrame:
    e, r = _reach(t)
    return graph.concentration(r, e, t.supplier_part)


_CONC = "select part, count(*) components_in_tree, count(n) components_with_suppliers, count(*) filter (n = 1) single_source_components, coalesce(round(count(*) filter (n = 1) / nullif(count(n), 0), 4), 0) single_source_ratio from (select part, below from reached union all select part, part from deg) left join (select part_id below, count(distinct supplier_id) n from supplier_part where part_id is not null group by 1) using (below) group by 1"
add("graph_concentration", _concentration, _CONC, _REACH, True)


def _validation(t: Tables) -> DataFrame:
    e = _edges(t)
    return graph.validation(e, t.dim_part, _hierarchy(t))


add("graph_validation", _validation, """select (select count(*) from deg) nodes, (select count(*) from edges) edges, (select count(*) from edges where parent = child) self_references, (select count(*) from walk where part = below) parts_on_cycles,
    (select count(*) from deg where n_out > 0 and part not in (select part_key from dim_part)) missing_parents, (select count(*) from deg where n_out = 0 and part not in (select part_key from dim_part)) missing_children,
    (select count(distinct g) from (select min(other) g from meet group by part)) components""", _REACH | {"ends_": "select parent a, child b from edges union select child, parent from edges", "meet(part, other)": "select a, a from ends_ union select m.part, x.b from meet m join ends_ x on x.a = m.other"}, True)  # fmt: skip


def _production(t: Tables) -> DataFrame:
    """Orders of large quantity stand for production orders."""
    return t.fact_order.where("order_qty >= 40").select("part_key")


def _impact(t: Tables) -> DataFrame:
    e, r = _reach(t)
    return impact.blast_radius(r, e, _depth(t), t.dim_part, t.fact_demand, t.fact_inventory, t.fact_order, _production(t), t.supplier_part)


_SUM = lambda t, c, n: f"(select part_key a, cast(sum({c}) as decimal(18, 2)) {n} from {t} group by 1)"
add("impact_blast_radius", _impact, f"""select *, cast(round(cast(affected_parent_assemblies * 2 as decimal(30, 5)) + cast(future_demand_qty_exposed as decimal(24, 2)) * 0.010 + cast(inventory_value_exposed as decimal(24, 2)) * 0.001 + cast(po_value_exposed as decimal(24, 2)) * 0.001 + cast(production_orders_affected * 3 as decimal(30, 5)) + case when single_source_ratio > 0.5 then 10 else 0 end, 2) as double) operational_priority from
    (select part, count(*) - 1 affected_parent_assemblies, cast(coalesce(sum(dem), 0) as decimal(18, 2)) future_demand_qty_exposed, cast(coalesce(sum(inv), 0) as decimal(18, 2)) inventory_value_exposed, cast(coalesce(sum(po), 0) as decimal(18, 2)) po_value_exposed, cast(coalesce(sum(standard_cost), 0) as decimal(18, 2)) estimated_cost_exposure,
      cast(coalesce(sum(made), 0) as bigint) production_orders_affected, count(distinct primary_plant) plants_affected
     from aff left join {_SUM('fact_demand', 'demand_qty', 'dem')} using (a) left join {_SUM('fact_inventory', 'on_hand_value', 'inv')} using (a) left join {_SUM('fact_order', 'line_value', 'po')} using (a)
     left join (select part_key a, count(*) made from fact_order where order_qty >= 40 group by 1) using (a) left join (select part_key a, standard_cost, primary_plant from dim_part) using (a) group by 1)
    join (select part, count(distinct supplier_id) suppliers_affected from aff left join (select part_id a, supplier_id from supplier_part where part_id is not null) using (a) group by 1) using (part)
    join (select part, (select count(*) from reached r where r.part = d.part) downstream_components from deg d) using (part)
    join (select part, depth dependency_depth from ({_DEPTH})) using (part) join (select part, single_source_ratio from ({_CONC})) using (part)""", _LOOPS | {"aff": _DEMAND["aff"]}, True)  # fmt: skip


def _merge(t: Tables) -> DataFrame:
    a, b = _first(t, 2)
    return impact.merge_report(t.fact_bom, t.supplier_part, t.dim_part, a, b)


_TWO = {"edges": _EDGES, "two": "select min(parent) a, max(parent) b from (select parent from edges group by 1 order by 1 limit 2)"}
add("scenario_merge", _merge, "select (select count(*) filter (child_part_key = a) + count(*) filter (parent_part_key = a) from fact_bom) repointed_links, (select count(*) from supplier_part where part_id = a) repointed_supplier_links, (select max(lifecycle_status) from dim_part where part_key = b) survivor_status, 'UNIQ-002' resolved_rules, concat_ws('; ', case when (select max(lifecycle_status) from dim_part where part_key = b) <> 'ACTIVE' then 'survivor is not active' end, 'the structure has a cycle') warnings from two", _TWO)


def _replace(t: Tables) -> DataFrame:
    p, new = _first(t, 2)
    old = t.fact_bom.where(F.col("parent_part_key") == p).agg(F.min("child_part_key")).first()[0]
    return impact.replacement_report(t.fact_bom, t.dim_part, p, old, new)


_SWAP = _TWO | {
    "old": "select min(child_part_key) o from fact_bom, two where parent_part_key = a",
    "swapped": "select distinct parent_part_key parent, case when parent_part_key = a and child_part_key = o then b else child_part_key end child from fact_bom, two, old where parent_part_key is not null and child_part_key is not null",
    "run(part, below)": "select parent, child from swapped union select r.part, s.child from run r join swapped s on s.parent = r.below",
    "status": "select max(lifecycle_status) filter (part_key = o) os, max(coalesce(lifecycle_status, '?')) filter (part_key = b) ns from dim_part, two, old",
}
add("scenario_replace", _replace, """select (select count(*) from fact_bom, two, old where parent_part_key = a and child_part_key = o) relationships_replaced, case when os = 'OBSOLETE' then 'XFLD-004' else '' end resolved_rules,
    concat_ws('; ', case when ns is null then 'replacement doesn''t exist' end, case when ns in ('OBSOLETE', 'BLOCKED') then 'replacement is ' || lower(ns) end, case when exists (select 1 from run where part = below) then 'the structure has a cycle' end) warnings from status""", _SWAP, True)  # fmt: skip
add("scenario_correct", lambda t: impact.correction_report(t.dim_part, "uom", t.dim_part.where("uom is not null").select("part_key", F.when(F.col("uom") == "PCS", "PC").when(F.col("uom") == "EACH", "EA").otherwise(F.col("uom")).alias("new_value")), UOMS), "select part_key, uom old_value, n new_value, case when n in (select uom_code from uom_codes) then 'VALD-001' else '' end resolved_rules, case when n in (select uom_code from uom_codes) then '' else 'unit isn''t governed' end as warning from (select part_key, uom, case uom when 'PCS' then 'PC' when 'EACH' then 'EA' else uom end n from dim_part where uom is not null)")
