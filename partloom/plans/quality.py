"""Queries on staged tables, rules, scores, marts and searches, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.operators import lookups, marts, rules, scoring, staging
from partloom.plans.core_sql import issues_sql, rule_sql, with_tables
from partloom.sources.binding import STATUSES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: the tables that many rules read
CORE = ("dim_part", "fact_bom", "supplier_part", "fact_cost")


def add(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None, **more) -> None:
    on_issues = "issues" in more.get("more", {})  # these read the core tables as they were stored for the rules
    QUERIES[name] = lambda spark, d: build(Tables(spark, d).stored(*CORE) if on_issues else Tables(spark, d))
    if sql is not None:
        ORACLES[name] = with_tables(sql, **more)


def violations_of(t: Tables) -> DataFrame:
    """The violations of all enabled rules, found once for the session."""
    return t.kept("violations", lambda: _all_found(t))


def _all_found(t: Tables) -> DataFrame:
    found, failed = rules.run_stored(t.stored(*CORE))
    if failed:
        raise RuntimeError(f"rules failed: {failed}")
    return found


def issues_of(t: Tables, chosen: list[str] | None = None) -> DataFrame:
    """The issues of all enabled rules (or of the chosen ones), that scores and marts are computed on; some closed or rejected, by the last character of their key."""
    if chosen is not None:
        return _with_status(violations_of(t).where(F.col("rule_id").isin(chosen)))
    return t.kept("issues", lambda: _with_status(violations_of(t)))


def _with_status(found: DataFrame) -> DataFrame:
    code = F.ascii(F.right("entity_key", F.lit(1))) % 5
    return rules.issues(found, "run-1").withColumn("status", F.when(code == 0, "CLOSED").when(code == 1, "REJECTED").otherwise("DETECTED"))


def decisions_of(t: Tables) -> DataFrame:
    """A decision on each issue whose id ends in a digit."""
    i = issues_of(t).where("right(issue_id, 1) between '0' and '9'").select("issue_id", "detected_at").distinct()
    d = F.right("issue_id", F.lit(1)).cast("int")
    return i.select(
        F.concat(F.lit("D"), "issue_id").alias("decision_id"), "issue_id", F.concat(F.lit("R"), (d % 3).cast("string")).alias("reviewer"),
        F.when(d < 5, "approve").when(d < 8, "reject").otherwise("request_evidence").alias("decision"),
        F.when(d < 5, "APPROVED").when(d < 8, "REJECTED").otherwise("PENDING_REVIEW").alias("after_status"), F.date_add("detected_at", d).alias("decided_at"))


_I = {"more": issues_sql()}
_D = {"more": issues_sql() | {"decisions": """select 'D' || issue_id decision_id, issue_id, 'R' || (d % 3) reviewer, case when d < 5 then 'approve' when d < 8 then 'reject' else 'request_evidence' end decision,
    case when d < 5 then 'APPROVED' when d < 8 then 'REJECTED' else 'PENDING_REVIEW' end after_status, cast(detected_at + d as date) decided_at
    from (select distinct issue_id, detected_at, try_cast(right(issue_id, 1) as int) d from issues) where d is not null"""}}  # fmt: skip

# staged and core tables
add("stg_parts", lambda t: t.dim_part, "select * from dim_part")
add("stg_bom_links", lambda t: t.fact_bom, "select * from fact_bom")
add("stg_supplier_parts", lambda t: t.supplier_part, "select * from supplier_part")
add("stg_cost_history", lambda t: t.fact_cost, "select * from fact_cost")
add("stg_revisions", lambda t: t.revision, "select * from revision")
add("stg_suppliers", lambda t: t.dim_supplier, "select * from dim_supplier")
add("stg_plants", lambda t: t.dim_plant, "select * from dim_plant")
add("stg_inventory", lambda t: t.fact_inventory, "select * from fact_inventory")
add("stg_demand", lambda t: t.fact_demand, "select * from fact_demand")
add("stg_order_lines", lambda t: t.fact_order, "select * from fact_order")
add("stg_lead_times", lambda t: t.fact_lead, "select * from fact_lead")
add("stg_quotes", lambda t: t.quote, "select * from quote")
add("core_dim_date", lambda t: staging.calendar(t.spark), "select cast(d as date) date_key, cast(extract(year from d) as int) as \"year\", cast(extract(month from d) as int) as \"month\", cast(extract(day from d) as int) as \"day\", cast(extract(quarter from d) as int) as \"quarter\" from generate_series(timestamp '2015-01-01', timestamp '2028-12-31', interval 1 day) x(d)")
add("test_unique", lambda t: staging.not_unique(t.fact_demand, "part_key"), "select part_key as value, count(*) n from fact_demand where part_key is not null group by 1 having count(*) > 1")
add("test_not_null", lambda t: staging.null_values(t.dim_part, "description").select("part_key"), "select part_key from dim_part where description is null")
add("test_accepted_values", lambda t: staging.not_accepted(t.dim_part, "lifecycle_status", STATUSES), "select lifecycle_status as value, count(*) n from dim_part where lifecycle_status not in ('ACTIVE', 'OBSOLETE', 'BLOCKED', 'IN_DEVELOPMENT') group by 1")
add("test_relationships", lambda t: staging.without_parent(t.fact_bom, "child_part_key", t.dim_part, "part_key"), "select child_part_key as value, count(*) n from fact_bom where child_part_key is not null and child_part_key not in (select part_key from dim_part) group by 1")


SNAPSHOT_COLUMNS = ["description", "uom", "lifecycle_status", "standard_cost", "lead_time_days", "primary_plant"]


def _snapshot_versions(t: Tables) -> DataFrame:
    slim = t.raw("part_master_snapshot").select(F.upper(F.trim("part_id")).alias("part_id"), F.col("snapshot_date").cast("date").alias("snapshot_date"), *SNAPSHOT_COLUMNS, "_ingested_at")
    return staging.snapshot_versions(staging.latest(slim, ["part_id", "snapshot_date"], "_ingested_at"), "part_id", SNAPSHOT_COLUMNS, "snapshot_date")


_CHECKED = ", ".join(SNAPSHOT_COLUMNS)
add("snapshot_scd2", _snapshot_versions, f"""select part_id, {", ".join(f"min({c}) {c}" for c in SNAPSHOT_COLUMNS)}, min(d) valid_from, first(nxt order by d desc) valid_to from
    (select *, sum(starts) over (partition by part_id order by d) run from (select *, case when lag(nxt) over w is not distinct from d and lag(row({_CHECKED})) over w is not distinct from row({_CHECKED}) then 0 else 1 end starts from pictures join following using (d) window w as (partition by part_id order by d))) group by part_id, run""",
    more={"pictures": f"select part_id, d, {_CHECKED} from (select upper(trim(part_id)) part_id, cast(snapshot_date as date) d, {_CHECKED}, _ingested_at from part_master_snapshot where part_id is not null and snapshot_date is not null) qualify row_number() over (partition by part_id, d order by _ingested_at desc, {', '.join(f'{c} desc nulls last' for c in SNAPSHOT_COLUMNS)}) = 1",
          "following": "select d, lead(d) over (order by d) nxt from (select distinct d from pictures)"})

# the rules, one by one and together
for _r in rules.RULES:
    add("dq_" + _r.rule_id.lower().replace("-", "_"), lambda t, r=_r: rules.violations(r, t), rule_sql(_r.rule_id))


def _run_counts(t: Tables) -> DataFrame:
    return rules.executions(violations_of(t), [], "run-1")


add("dq_run_executions", _run_counts, "select 'run-1' run_id, r.rule_id, '1.0' rule_version, count(f.rule_id) violations, 'OK' status from (values " + ", ".join(f"('{r.rule_id}')" for r in rules.RULES) + ") r(rule_id) left join found f using (rule_id) group by r.rule_id", **_I)
add("dq_issues", lambda t: issues_of(t).select("issue_id", "rule_id", "run_id", *rules.VIOLATION, "severity", "domain", "rule_sql_version", "status", "detected_at"), "select issue_id, rule_id, 'run-1' run_id, entity_type, entity_key, field, failed_value, severity, domain, '1.0' rule_sql_version, status, detected_at from issues", **_I)
add("dq_rules", lambda t: rules.rule_table(t).drop("threshold"), "select * from (values " + ", ".join(f"('{r.rule_id}', '{r.name.replace(chr(39), chr(39) * 2)}', '{r.severity}', '{r.domain}', '{r.version}', true)" for r in rules.RULES) + ") x(rule_id, name, severity, domain, version, enabled)")

# scores
_PEN = "case severity when 'critical' then 25 when 'high' then 12 when 'medium' then 5 else 2 end"
_WGT = "case severity when 'critical' then 8 when 'high' then 4 when 'medium' then 1.5 else 0.5 end"
_REL = "case regexp_replace(upper(source_system), '[\\s_-]', '', 'g') when 'SAPECC' then 0.92 when 'ORACLEEBS' then 0.85 when 'LEGACYMFG' then 0.65 when 'PLMTEAMCENTER' then 0.88 when 'SUPPLIERPORTAL' then 0.72 else 0.7 end"
_ENTITY = f"""select entity_type, entity_key, cast(penalty as decimal(18, 2)) penalty, cast(round(case when entity_type = 'part' then least(greatest(100 - penalty, 0) * 0.9 + coalesce({_REL}, 0.7) * 10, 100) else greatest(100 - penalty, 0) end, 2) as decimal(18, 2)) quality_score
    from (select entity_type, entity_key, cast(sum({_PEN}) as decimal(10, 2)) penalty from issues where status <> 'CLOSED' and entity_key is not null group by 1, 2) left join dim_part on part_key = entity_key"""
_BOM = f"""select parent_part_key, cast(coalesce(sum(p), 0) as decimal(18, 2)) penalty, cast(greatest(100 - coalesce(sum(p), 0), 0) as decimal(18, 2)) bom_quality_score from fact_bom left join
    (select entity_key bom_rel_key, sum({_PEN}) p from issues where entity_type = 'bom_relationship' and status <> 'CLOSED' group by 1) using (bom_rel_key) where parent_part_key is not null group by 1"""
_E = {"more": issues_sql() | {"entity_scores": _ENTITY}}
_B = {"more": issues_sql() | {"bom_scores": _BOM}}
add("score_entity", lambda t: scoring.entity_scores(issues_of(t), t.dim_part), _ENTITY, **_I)
add("score_bom", lambda t: scoring.bom_scores(issues_of(t), t.fact_bom), _BOM, **_I)
add("score_enterprise", lambda t: scoring.enterprise_score(issues_of(t), t.dim_part), f"select round(greatest(0, 100 - cast(w as double) / greatest(n, 1) * 100 / 8), 2) enterprise_quality_score, cast(round(w, 1) as decimal(18, 1)) weighted_issue_points, o open_issues, n parts_in_scope from (select coalesce(sum({_WGT}), 0) w, count(*) o from issues where status <> 'CLOSED'), (select count(*) n from dim_part)", **_I)

# marts
_OPEN = "status not in ('CLOSED', 'REJECTED')"
_CNT = f"(select entity_key, count(*) open_issues, count(*) filter (severity = 'critical') critical_issues from issues where {_OPEN} group by 1)"
add("mart_executive_quality", lambda t: marts.executive_quality(issues_of(t), rules.rule_table(t)), "select i.rule_id, r.rule_name, severity, domain, status, cast(detected_at as date) detected_date, count(*) issue_count from issues i left join (values " + ", ".join(f"('{r.rule_id}', '{r.name.replace(chr(39), chr(39) * 2)}')" for r in rules.RULES) + ") r(rule_id, rule_name) using (rule_id) group by all", **_I)
add("mart_part_quality", lambda t: marts.part_quality(t.dim_part, scoring.entity_scores(issues_of(t), t.dim_part), issues_of(t)), f"select part_key, source_part_number, source_system, category, lifecycle_status, primary_plant, coalesce(quality_score, 100) quality_score, coalesce(open_issues, 0) open_issues, coalesce(critical_issues, 0) critical_issues from dim_part left join (select * from entity_scores where entity_type = 'part') s on s.entity_key = part_key left join {_CNT} c on c.entity_key = part_key", **_E)
add("mart_bom_integrity", lambda t: marts.bom_integrity(t.fact_bom, t.dim_part, scoring.bom_scores(issues_of(t), t.fact_bom)), "select b.parent_part_key, count(*) component_count, count(*) filter (c.part_key is null) missing_components, count(*) filter (c.lifecycle_status = 'OBSOLETE') obsolete_components, count(*) filter (c.lifecycle_status = 'BLOCKED') blocked_components, count(*) filter (quantity_per <= 0) invalid_quantities, coalesce(max(bom_quality_score), 100) bom_quality_score from fact_bom b left join dim_part c on c.part_key = b.child_part_key left join bom_scores s on s.parent_part_key = b.parent_part_key group by 1", **_B)
add("mart_supplier_quality", lambda t: marts.supplier_quality(t.dim_supplier, t.supplier_part, issues_of(t)), f"select supplier_key, supplier_name, country, s.currency, count(distinct p.part_id) parts_supplied, round(avg(p.lead_time_days), 6) avg_lead_time_days, count(distinct i.issue_id) open_issues_on_parts from dim_supplier s left join supplier_part p on p.supplier_id = supplier_key left join (select * from issues where {_OPEN}) i on i.entity_key = p.part_id group by 1, 2, 3, 4", **_I)
_IMPACT = f"""select part_key, category, primary_plant, lifecycle_status, coalesce(inventory_value, 0) inventory_value, coalesce(future_demand_qty, 0) future_demand_qty, coalesce(open_po_value, 0) open_po_value, coalesce(open_issues, 0) open_issues, coalesce(critical_issues, 0) critical_issues from dim_part
    left join (select part_key, cast(sum(on_hand_value) as decimal(18, 2)) inventory_value from fact_inventory group by 1) using (part_key) left join (select part_key, cast(sum(demand_qty) as decimal(18, 2)) future_demand_qty from fact_demand group by 1) using (part_key)
    left join (select part_key, cast(sum(line_value) as decimal(18, 2)) open_po_value from fact_order where status = 'OPEN' group by 1) using (part_key) left join {_CNT} c on c.entity_key = part_key"""
_impact = lambda t: marts.business_impact(t.dim_part, t.fact_inventory, t.fact_demand, t.fact_order, issues_of(t))
add("mart_business_impact", _impact, _IMPACT, **_I)
add("mart_remediation_performance", lambda t: marts.remediation_performance(decisions_of(t), issues_of(t)), "select cast(decided_at as date) decision_date, decision, reviewer, severity, domain, count(*) decisions from decisions left join (select distinct issue_id, severity, domain from issues) using (issue_id) group by all", **_D)
add("mart_ai_governance", lambda t: marts.call_governance(t.call_audit), "select provider, model, prompt_version, cast(called_at as date) call_date, count(*) calls, round(cast(sum(latency_ms) as double) / count(*), 3) avg_latency_ms, round(avg(confidence), 3) avg_confidence, count(*) filter (abstained) abstentions, count(*) filter (validation_result <> 'valid') validation_failures from call_audit group by all")
add("issues_current_status", lambda t: marts.current_status(issues_of(t), decisions_of(t)).groupBy("status", "severity").agg(F.count(F.lit(1)).alias("n")), "select coalesce(d.after_status, i.status) status, severity, count(*) n from issues i left join decisions d using (issue_id) group by all", **_D)

# searches, pages, top lists, measures
add("api_parts_page", lambda t: lookups.page(lookups.matching(t.dim_part, "valve", ("part_key", "source_part_number", "description"), lifecycle_status="ACTIVE"), "standard_cost", "part_key", 2, 25, True).select("part_key", "description", "standard_cost"), "select part_key, description, standard_cost from dim_part where lifecycle_status = 'ACTIVE' and (upper(part_key) like '%VALVE%' or upper(source_part_number) like '%VALVE%' or upper(description) like '%VALVE%') order by standard_cost desc nulls last, part_key limit 25 offset 25")
add("api_issues_page", lambda t: lookups.page(lookups.matching(issues_of(t), severity="high", status="DETECTED"), "rule_id", "issue_id", 1, 50).select("issue_id", "rule_id", "entity_key"), "select issue_id, rule_id, entity_key from issues where severity = 'high' and status = 'DETECTED' order by rule_id, issue_id limit 50", **_I)
add("api_quality_groups", lambda t: lookups.by_group(issues_of(t)), f"select 'severity' kind, severity as value, count(*) n from issues where {_OPEN} group by 2 union all select 'domain', domain, count(*) from issues where {_OPEN} group by 2", **_I)
add("api_top_rules", lambda t: lookups.top_rules(issues_of(t)), f"select rule_id, count(*) n from issues where {_OPEN} group by 1 order by n desc, rule_id limit 10", **_I)
add("api_business_impact", lambda t: lookups.impact_totals(_impact(t), issues_of(t)), f"select cast(sum(inventory_value) as decimal(18, 2)) inventory_value, cast(sum(future_demand_qty) as decimal(18, 2)) future_demand_qty, cast(sum(open_po_value) as decimal(18, 2)) open_po_value, (select count(distinct entity_key) from issues where {_OPEN} and severity = 'critical') critical_entities from ({_IMPACT})", **_I)
add("api_remediation", lambda t: lookups.decision_totals(decisions_of(t)), "select decision, count(*) n, round(count(*) / sum(count(*)) over (), 6) share from decisions group by 1", **_D)
add("api_governance", lambda t: lookups.call_totals(t.call_audit), "select count(*) calls, round(avg(abstained::int), 6) abstention_rate, round(avg((validation_result = 'valid')::int), 6) valid_rate, round(cast(sum(latency_ms) as double) / count(*), 3) avg_latency_ms, round(avg(confidence), 6) avg_confidence from call_audit")
add("bi_measures", lambda t: lookups.measures(issues_of(t), marts.part_quality(t.dim_part, scoring.entity_scores(issues_of(t), t.dim_part), issues_of(t))), f"select a.*, b.* from (select count(*) filter ({_OPEN}) open_issues, count(*) filter ({_OPEN} and severity = 'critical') critical_open, count(*) filter ({_OPEN} and severity = 'high') high_open, count(*) all_issues, round(count(*) filter (status in ('APPROVED', 'CLOSED')) / count(*), 6) resolution_rate from issues) a, (select round(cast(sum(q) as double) / count(*), 4) avg_part_score, count(*) filter (q < 60) parts_below_60, count(*) parts from (select coalesce(quality_score, 100) q from dim_part left join (select * from entity_scores where entity_type = 'part') s on s.entity_key = part_key)) b", **_E)
add("lookup_obsolete_by_demand", lambda t: lookups.obsolete_by_demand(t.dim_part, t.fact_demand), "select part_key, description, cast(sum(demand_qty) as decimal(18, 2)) demand_qty from dim_part join fact_demand using (part_key) where lifecycle_status = 'OBSOLETE' group by 1, 2 order by 3 desc, 1 limit 10")
add("lookup_supplier_exposure", lambda t: lookups.supplier_exposure(t.supplier_part, issues_of(t)), f"select supplier_id, count(distinct issue_id) issues, count(distinct part_id) parts from supplier_part join (select * from issues where {_OPEN}) on entity_key = part_id where supplier_id is not null group by 1 order by 2 desc, 1 limit 10", **_I)
add("lookup_plant_issues", lambda t: lookups.plant_issues(t.dim_part, issues_of(t), "PL02"), "select entity_key, rule_id, severity, issue_id from issues join dim_part on part_key = entity_key where primary_plant = 'PL02' and severity in ('critical', 'high') order by severity, issue_id limit 15", **_I)
add("lookup_abstentions", lambda t: lookups.latest_abstentions(t.call_audit), "select call_id, provider, model, called_at from call_audit where abstained order by called_at desc, call_id limit 10")
add("lookup_duplicate_evidence", lambda t: lookups.duplicate_evidence(issues_of(t, ["UNIQ-001", "UNIQ-004"])), "select entity_key, rule_id, field, failed_value from issues", more=issues_sql(["UNIQ-001", "UNIQ-004"]))
