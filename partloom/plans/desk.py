"""Queries on table tests, sources and lineage, single structures, decisions, proposals and reports, each with the same in SQL where it can be said."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.operators import documents, graph, impact, lookups, marts, rules, scoring, staging, workflow
from partloom.plans import structure
from partloom.plans.core_sql import issues_sql, with_tables
from partloom.plans.problems_sql import key as key_sql
from partloom.plans.quality import _BOM, _ENTITY, _IMPACT, CORE, decisions_of, issues_of
from partloom.plans.quality import _D as _WITH_DECISIONS
from partloom.sources.binding import STATUSES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None, parts: dict[str, str] | None = None, recursive: bool = False) -> None:
    QUERIES[name] = lambda spark, d: build(Tables(spark, d).stored(*CORE))
    if sql is not None:
        ORACLES[name] = with_tables(sql, parts, recursive)


# tests of the core tables: model, column, test
_KEYS = {"dim_part": "part_key", "dim_supplier": "supplier_key", "dim_plant": "plant_key", "fact_bom": "bom_rel_key", "fact_inventory": "inventory_key", "fact_demand": "demand_key", "fact_order": "po_line_key", "fact_cost": "cost_key", "fact_lead": "lead_time_key"}
_PARENTS = {("fact_bom", "parent_part_key"), ("fact_bom", "child_part_key"), ("fact_inventory", "part_key")}


def _table_tests(t: Tables) -> DataFrame:
    n = F.count(F.lit(1)).alias("n_failed")
    row = lambda df, model, column, test: df.agg(n).select(F.lit(model).alias("model"), F.lit(column).alias("column_name"), F.lit(test).alias("test"), "n_failed")
    models = {m: (getattr(t, m), k) for m, k in _KEYS.items()} | {"dim_date": (staging.calendar(t.spark), "date_key")}
    out = [row(staging.not_unique(df, k), m, k, "unique") for m, (df, k) in models.items()] + [row(staging.null_values(df, k), m, k, "not_null") for m, (df, k) in models.items()]
    out += [row(staging.null_values(t.dim_part, "uom"), "dim_part", "uom", "not_null"), row(staging.not_accepted(t.dim_part, "lifecycle_status", STATUSES), "dim_part", "lifecycle_status", "accepted_values")]
    out += [row(staging.without_parent(getattr(t, m), c, t.dim_part, "part_key"), m, c, "relationships") for m, c in sorted(_PARENTS)]
    return reduce(DataFrame.unionByName, out)


_TESTS = [f"select '{m}' model, '{k}' column_name, 'unique' test, count(*) n_failed from (select {k} from {m} where {k} is not null group by 1 having count(*) > 1)" for m, k in _KEYS.items()]
_TESTS += [f"select '{m}', '{k}', 'not_null', count(*) from {m} where {k} is null" for m, k in _KEYS.items()]
_TESTS += ["select 'dim_date', 'date_key', 'unique', 0", "select 'dim_date', 'date_key', 'not_null', 0", "select 'dim_part', 'uom', 'not_null', count(*) from dim_part where uom is null"]
_TESTS += ["select 'dim_part', 'lifecycle_status', 'accepted_values', count(distinct lifecycle_status) from dim_part where lifecycle_status not in (" + ", ".join(f"'{s}'" for s in STATUSES) + ")"]
_TESTS += [f"select '{m}', '{c}', 'relationships', count(distinct {c}) from {m} where {c} not in (select part_key from dim_part)" for m, c in sorted(_PARENTS)]
add("table_tests", _table_tests, " union all ".join(_TESTS))

# sources and lineage of parts
add("part_sources", lambda t: lookups.sources(t.raw("part_master")), f"select {key_sql('part_id')} part_key, source_system, source_part_number, min(_ingested_at) first_seen, max(_ingested_at) last_seen, count(*) n_rows from part_master where {key_sql('part_id')} is not null group by 1, 2, 3")
_CLUSTERS = {"mem": "select coalesce('N' || nullif(part_number_normalized, ''), 'K' || part_key) entity_id, part_key part_id, coalesce(source_system, '') source_system, last_updated, source_part_number, description, category, uom, lifecycle_status, manufacturer_part_number, standard_cost, lead_time_days, primary_plant from dim_part"}


def _lineage_sql() -> tuple[str, dict[str, str]]:
    from partloom.plans.records import _CONF, _GOLD

    more = _CLUSTERS | {k: v for k, v in _GOLD.items() if k != "mem"}
    return f"select entity_id, field_name, part_id source_record, source_system, {_CONF} confidence, n_members from best join (select entity_id, count(*) n_members from mem group by 1) using (entity_id) where rn = 1", more


add("part_lineage", lambda t: lookups.lineage(t.dim_part).select("entity_id", "field_name", "source_record", "source_system", "confidence", "n_members"), *_lineage_sql())

# single structures
_FIRST = structure._FIRST
_TREE = {"edges": structure._EDGES, "walk(part, below)": "select parent, child from edges union select w.part, e.child from walk w join edges e on e.parent = w.below", "tree(part, lvl)": f"select x.parent, 0 from {_FIRST} x union select e.child, lvl + 1 from tree join edges e on e.parent = part where lvl < 2",
         "shown": "select parent, child from (select distinct part from tree) join edges on parent = part", "ids": f"select parent id from shown union select child from shown union select parent from {_FIRST}"}
add("graph_page", lambda t: graph.page(structure._hierarchy(t), structure._edges(t), t.dim_part, structure._first(t, 1)[0])[0], "select id, description, lifecycle_status, category, id in (select part from walk where part = below) in_cycle from ids left join dim_part on part_key = id", _TREE, True)
add("graph_max_depth", lambda t: structure._depth(t).agg(F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("max_depth")), f"select max(depth) max_depth from ({structure._DEPTH})", structure._LOOPS, True)


def _merge_impact(t: Tables) -> DataFrame:
    a, b = structure._first(t, 2)
    return impact.merge_impact(a, b, t.fact_bom, t.supplier_part, parts=t.dim_part, demand=t.fact_demand, inventory=t.fact_inventory, orders=t.fact_order, production=structure._production(t))


_LINKS = {"pair": "select min(parent) a, max(parent) b from (select distinct parent_part_key parent from fact_bom where parent_part_key is not null order by 1 limit 2)",
          "ways": "select 'before' moment, parent_part_key parent, child_part_key child from fact_bom, pair union select 'after', case when parent_part_key = a then b else parent_part_key end, case when child_part_key = a then b else child_part_key end from fact_bom, pair",
          "linked": "select * from ways where parent is not null and child is not null",
          "up(moment, part)": "select moment, b from (select distinct moment from linked), pair union select u.moment, l.parent from up u join linked l on l.moment = u.moment and l.child = u.part",
          "down(moment, part)": "select moment, b from (select distinct moment from linked), pair union select u.moment, l.child from down u join linked l on l.moment = u.moment and l.parent = u.part"}
add("scenario_impact", lambda t: _merge_impact(t).select("moment", "part", "affected_parent_assemblies", "downstream_components", "future_demand_qty_exposed", "inventory_value_exposed", "po_value_exposed"), """select moment, b part, count(*) - 1 affected_parent_assemblies, any_value(n) downstream_components,
    cast(coalesce(sum(dem), 0) as decimal(18, 2)) future_demand_qty_exposed, cast(coalesce(sum(inv), 0) as decimal(18, 2)) inventory_value_exposed, cast(coalesce(sum(po), 0) as decimal(18, 2)) po_value_exposed
    from up join (select moment, count(*) - 1 n from down group by 1) using (moment) cross join pair left join (select part_key part, sum(demand_qty) dem from fact_demand group by 1) using (part) left join (select part_key part, sum(on_hand_value) inv from fact_inventory group by 1) using (part)
    left join (select part_key part, sum(line_value) po from fact_order group by 1) using (part) group by moment, b""", _LINKS, True)  # fmt: skip


# decisions
def _requests(t: Tables) -> DataFrame:
    """Two requests on each issue whose id ends in a digit."""
    i = issues_of(t).where("right(issue_id, 1) between '0' and '9'").select("issue_id", "detected_at").distinct()
    d = F.right("issue_id", F.lit(1)).cast("int")
    kinds = F.when(d < 3, "approve").when(d < 6, "request_evidence").when(d < 8, "reject").otherwise("escalate"), F.element_at(F.array(F.lit("approve"), F.lit("reject"), F.lit("request_evidence")), d % 3 + 1)
    cells = [F.struct(F.concat(F.lit(p), "issue_id").alias("decision_id"), k.alias("decision"), F.concat(F.lit("R"), (d % 3).cast("string")).alias("reviewer"), F.date_add("detected_at", d + n).alias("decided_at")) for p, k, n in (("A", kinds[0], 0), ("B", kinds[1], 10))]
    return i.select("issue_id", F.inline(F.array(*cells)))


def _decided(t: Tables) -> DataFrame:
    return workflow.decide(issues_of(t), _requests(t))


_DECIDED = issues_sql() | {
    "asked": """select 'A' || issue_id decision_id, issue_id, case when d < 3 then 'APPROVE' when d < 6 then 'REQUEST_EVIDENCE' when d < 8 then 'REJECT' else 'ESCALATE' end kind, 'R' || (d % 3) reviewer, cast(detected_at + d as date) decided_at from dig
        union all select 'B' || issue_id, issue_id, ['APPROVE', 'REJECT', 'REQUEST_EVIDENCE'][d % 3 + 1], 'R' || (d % 3), cast(detected_at + d + 10 as date) from dig""",
    "state": "select issue_id, min(status) status from issues group by 1",
    "seq": "select *, list(kind) over (partition by issue_id order by decided_at, decision_id rows between unbounded preceding and 1 preceding) prev, status in ('DETECTED', 'ENRICHED', 'PRIORITIZED', 'RECOMMENDATION_GENERATED', 'PENDING_REVIEW') open from asked join state using (issue_id)",
    "sets": "select *, coalesce(list_filter(prev, lambda k: k in ('APPROVE', 'REJECT')), []) ends from seq",
    "was": "select *, case when open and len(ends) > 0 then case ends[1] when 'APPROVE' then 'APPROVED' else 'REJECTED' end when open and list_contains(coalesce(prev, []), 'REQUEST_EVIDENCE') then 'PENDING_REVIEW' else status end before_status from sets",
    "log": "select *, case when kind = 'ESCALATE' then 'unknown decision' when not open or len(ends) > 0 then 'not possible in status ' || before_status end refusal from was",
}
_DECIDED = {k: v for k, v in _DECIDED.items() if k in ("found", "issues")} | {"dig": "select distinct issue_id, detected_at, try_cast(right(issue_id, 1) as int) d from issues where right(issue_id, 1) between '0' and '9'"} | {k: v for k, v in _DECIDED.items() if k not in ("found", "issues")}
_AFTER = "case when refusal is not null then before_status when kind = 'APPROVE' then 'APPROVED' when kind = 'REJECT' then 'REJECTED' else 'PENDING_REVIEW' end"
add("decision_log", _decided, f"select decision_id, issue_id, kind decision, reviewer, decided_at, before_status, {_AFTER} after_status, refusal is null accepted, refusal from log", _DECIDED)


def _history(t: Tables) -> DataFrame:
    """The accepted decisions of the issue of the smallest id that has some."""
    log = _decided(t)
    first = log.where("accepted").agg(F.min("issue_id")).first()[0]
    return workflow.history(log, first).select("decision_id", "decision", "before_status", "after_status")


add("decision_history", _history, f"select decision_id, kind decision, before_status, {_AFTER} after_status from log where refusal is null and issue_id = (select min(issue_id) from log where refusal is null)", _DECIDED)


# proposals
def _bundles(t: Tables) -> DataFrame:
    i = issues_of(t)
    cells = [F.struct(F.concat(F.lit("E"), "issue_id").alias("evidence_id"), "field", "failed_value"), F.when(F.col("failed_value").isNotNull(), F.struct(F.concat(F.lit("V"), "issue_id").alias("evidence_id"), "field", "failed_value"))]
    return documents.evidence_bundles(i, i.select("issue_id", F.inline(F.array_compact(F.array(*cells)))).distinct())


def _audited(t: Tables) -> DataFrame:
    """The rule-made proposals; every fourth refers to evidence of its own making, every fifth is too sure."""
    b = _bundles(t)
    code = F.conv(F.right("issue_id", F.lit(2)), 16, 10).cast("int")
    made = documents.proposals(b).withColumn("refs", F.when(code % 4 == 0, F.array_append("refs", F.lit("X1"))).otherwise(F.col("refs"))).withColumn("confidence", F.when(code % 5 == 0, F.lit(1.5)).otherwise(F.col("confidence")))
    return workflow.audited_proposals(b, made).groupBy("action", "abstained", "validation", "accepted").agg(F.count(F.lit(1)).alias("n"), F.sum("n_items").alias("n_items"))


add("proposal_audit", _audited, """select action, abstained, validation, validation = 'valid' accepted, count(*) n, cast(sum(n_items) as bigint) n_items from (
    select case when failed_value is null then 'insufficient_evidence' else case left(rule_id, 4) when 'UNIQ' then 'merge_records' when 'GRPH' then 'escalate' else 'correct_field' end end as action, failed_value is null abstained,
      case when c % 5 = 0 then 'schema_failed' when failed_value is not null and c % 4 = 0 then 'grounding_failed' else 'valid' end validation, case when failed_value is null then 1 else 2 end n_items
    from (select distinct issue_id, rule_id, failed_value, cast('0x' || right(issue_id, 2) as int) c from issues)) group by 1, 2, 3""", issues_sql())

# lookups, counts and the measures of the reports
_ONE = "(select min(entity_key) from issues where entity_type = 'part')"


def _one(t: Tables) -> str:
    return issues_of(t).where("entity_type = 'part'").agg(F.min("entity_key")).first()[0]


add("lookup_entity_issues", lambda t: lookups.for_entity(issues_of(t), _one(t)), f"select issue_id, rule_id, severity, field, failed_value, status from issues where entity_key = {_ONE}", issues_sql())
add("lookup_failed_rules", lambda t: lookups.failed_rules(issues_of(t), rules.rule_table(t), _one(t)), "select distinct rule_id, name, severity, domain from issues join (values " + ", ".join(f"('{r.rule_id}', '{r.name.replace(chr(39), chr(39) * 2)}')" for r in rules.RULES) + f") r(rule_id, name) using (rule_id) where entity_key = {_ONE}", issues_sql())
add("api_counts", lambda t: lookups.counts(t.dim_part, issues_of(t)), "select 'parts' metric, count(*) n from dim_part union all select 'issues_' || lower(status), count(*) from issues group by 1", issues_sql())


def _measures(t: Tables) -> DataFrame:
    i = issues_of(t)
    return lookups.report_measures(
        marts.executive_quality(i, rules.rule_table(t)), marts.part_quality(t.dim_part, scoring.entity_scores(i, t.dim_part), i), marts.bom_integrity(t.fact_bom, t.dim_part, scoring.bom_scores(i, t.fact_bom)), marts.business_impact(t.dim_part, t.fact_inventory, t.fact_demand, t.fact_order, i),
        marts.supplier_quality(t.dim_supplier, t.supplier_part, i), marts.remediation_performance(decisions_of(t), i), marts.call_governance(t.call_audit))


_OPEN = "status not in ('CLOSED', 'REJECTED')"
_MEASURES = {
    "open_issues": f"(select count(*) from issues where {_OPEN})", "critical_open_issues": f"(select count(*) from issues where {_OPEN} and severity = 'critical')", "high_open_issues": f"(select count(*) from issues where {_OPEN} and severity = 'high')", "issues_detected": "(select count(*) from issues)",
    "issue_resolution_rate": "(select count(*) filter (status in ('APPROVED', 'CLOSED')) / count(*) from issues)", "avg_part_quality_score": "(select avg(cast(q as double)) from pq)", "parts_below_quality_threshold": "(select count(*) from pq where q < 60)", "avg_bom_quality_score": "(select avg(cast(coalesce(bom_quality_score, 100) as double)) from (select distinct parent_part_key p from fact_bom) left join bom_scores on p = parent_part_key)",
    "assemblies_with_obsolete_components": "(select count(distinct coalesce(parent_part_key, '?')) from fact_bom join dim_part on part_key = child_part_key where lifecycle_status = 'OBSOLETE')", "assemblies_with_missing_components": "(select count(distinct coalesce(parent_part_key, '?')) from fact_bom left join dim_part on part_key = child_part_key where part_key is null)", "total_bom_relationships": "(select count(*) from fact_bom)",
    "inventory_value_exposed": "(select sum(inventory_value) from bi where open_issues > 0)", "total_inventory_value": "(select sum(inventory_value) from bi)", "demand_qty_exposed": "(select sum(future_demand_qty) from bi where open_issues > 0)", "open_po_value_exposed": "(select sum(open_po_value) from bi where open_issues > 0)",
    "exposure_share_of_inventory": "(select cast(sum(inventory_value) filter (open_issues > 0) as double) / cast(sum(inventory_value) as double) from bi)", "parts_with_critical_exposure": "(select count(*) from bi where critical_issues > 0)",
    "suppliers_with_open_issues": f"(select count(distinct supplier_key) from dim_supplier join supplier_part on supplier_id = supplier_key join (select entity_key from issues where {_OPEN}) on entity_key = part_id)",
    "avg_supplier_lead_time": f"(select avg(m) from (select supplier_key, round(avg(p.lead_time_days), 6) m from dim_supplier left join supplier_part p on supplier_id = supplier_key left join (select entity_key from issues where {_OPEN}) on entity_key = p.part_id group by 1))",
    "decisions_made": "(select count(*) from decisions)", "approvals": "(select count(*) from decisions where decision = 'approve')", "rejections": "(select count(*) from decisions where decision = 'reject')", "acceptance_rate": "(select count(*) filter (decision = 'approve') / count(*) filter (decision in ('approve', 'reject')) from decisions)",
    "ai_calls": "(select count(*) from call_audit)", "ai_abstention_rate": "(select count(*) filter (abstained) / count(*) from call_audit)", "ai_validation_failure_rate": "(select count(*) filter (validation_result <> 'valid') / count(*) from call_audit)",
    "ai_avg_latency_ms": "(select avg(l) from (select round(cast(sum(latency_ms) as double) / count(*), 3) l from call_audit group by provider, model, prompt_version, cast(called_at as date)))", "ai_avg_confidence": "(select avg(l) from (select round(avg(confidence), 3) l from call_audit group by provider, model, prompt_version, cast(called_at as date)))",
    "enterprise_quality_score": "(select greatest(0, 100 - cast(sum(case severity when 'critical' then 8 when 'high' then 4 when 'medium' then 1.5 else 0.5 end) as double) / (select count(*) from dim_part) * 100 / 8) from issues)",
}
add("bi_report_measures", _measures, " union all ".join(f"select '{k}' measure, round(cast({v} as double), 4) as value" for k, v in _MEASURES.items()), _WITH_DECISIONS["more"] | {"entity_scores": _ENTITY, "bom_scores": _BOM, "pq": "select coalesce(quality_score, 100) q from dim_part left join (select * from entity_scores where entity_type = 'part') s on s.entity_key = part_key", "bi": _IMPACT})
