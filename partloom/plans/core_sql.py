"""The core tables in plain SQL, and the rules on them."""

from __future__ import annotations

import re

from partloom.operators.rules import RULES
from partloom.plans.problems_sql import key
from partloom.sources.binding import UOMS

_NUM = "[^A-Z0-9]"


def _one(table: str, by: str, columns: str, at: str = "_ingested_at") -> str:
    """The latest row per key; of several such the greatest in the columns' order."""
    names = [re.split(r"\s", c.strip())[-1] for c in re.split(r",\s*\n", columns.strip())]
    order = ", ".join(f"{n} desc nulls last" for n in names if n != by)
    return f"select {', '.join(names)} from (select {columns}, {at} as at_ from {table}) qualify row_number() over (partition by {by} order by at_ desc, {order}) = 1"


TABLES: dict[str, str] = {
    "dim_part": "select * from (" + _one("part_master", "part_key", f"""
        {key('part_id')} part_key,
        source_part_number source_part_number,
        regexp_replace(upper(source_part_number), '{_NUM}', '', 'g') part_number_normalized,
        source_system source_system,
        description description,
        regexp_replace(upper(description), '\\s+', ' ', 'g') description_normalized,
        {key('category')} category,
        {key('uom')} uom,
        {key('lifecycle_status')} lifecycle_status,
        {key('procurement_type')} procurement_type,
        manufacturer_part_number manufacturer_part_number,
        regexp_replace(upper(manufacturer_part_number), '{_NUM}', '', 'g') mpn_normalized,
        try_cast(standard_cost as decimal(18, 4)) standard_cost,
        {key('currency')} currency,
        lead_time_days lead_time_days,
        {key('primary_plant')} primary_plant,
        bom_tier bom_tier,
        created_date created_date,
        last_updated last_updated""") + ") where part_key is not null",
    "fact_bom": _one("fact_bom_relationship", "bom_rel_key", f"""
        bom_rel_key bom_rel_key,
        bom_header_id bom_header_id,
        {key('parent_part_key')} parent_part_key,
        {key('child_part_key')} child_part_key,
        try_cast(quantity_per as decimal(18, 4)) quantity_per,
        {key('uom')} uom,
        {key('revision_label')} revision_label,
        effective_from effective_from,
        effective_to effective_to,
        position_no position_no"""),
    "supplier_part": _one("supplier_parts", "supplier_part_id", f"""
        supplier_part_id supplier_part_id,
        {key('supplier_id')} supplier_id,
        {key('part_id')} part_id,
        regexp_replace(upper(supplier_part_number), '{_NUM}', '', 'g') supplier_part_number,
        try_cast(unit_price as decimal(18, 4)) unit_price,
        {key('currency')} currency,
        lead_time_days lead_time_days,
        min_order_qty min_order_qty,
        is_primary is_primary"""),
    "fact_cost": _one("standard_cost_history", "cost_key", f"""
        cost_history_id cost_key,
        {key('part_id')} part_key,
        {key('plant_code')} plant_key,
        try_cast(standard_cost as decimal(18, 4)) standard_cost,
        effective_from effective_from"""),
    "revision": """select bom_header_id || '-' || revision_label revision_id, bom_header_id, revision_label, min(effective_from) effective_from,
        case when count(effective_to) = count(*) then max(effective_to) end effective_to,
        (case when count(effective_to) = count(*) then max(effective_to) end is null or max(effective_to) > date '2026-07-01') is_current
        from fact_bom where bom_header_id is not null and revision_label is not null group by bom_header_id, revision_label""",
    "dim_supplier": """select 'SUP' || lpad(cast(s_suppkey as varchar), 5, '0') supplier_key, s_name supplier_name, 'SUPPLIER' || (s_suppkey % 97) supplier_name_normalized,
        n_name country, ['USD', 'EUR', 'JPY', 'INR', 'CNY'][n_regionkey + 1] currency from supplier join nation on s_nationkey = n_nationkey""",
    "dim_plant": "select 'PL' || lpad(cast(n_nationkey + 1 as varchar), 2, '0') plant_key, n_name plant_name, n_regionkey region from nation",
    "fact_inventory": """select l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m') inventory_key, 'PRT' || lpad(cast(l_partkey as varchar), 9, '0') part_key,
        cast(sum(cast(case when l_returnflag = 'R' then -l_quantity else l_quantity end as decimal(18, 2))) as decimal(18, 2)) on_hand_qty,
        cast(sum(cast(l_extendedprice as decimal(18, 2))) as decimal(18, 2)) on_hand_value from lineitem group by l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m')""",
    "fact_demand": """select l_orderkey || '-' || l_partkey demand_key, 'PRT' || lpad(cast(l_partkey as varchar), 9, '0') part_key, cast(sum(cast(l_quantity as decimal(18, 2))) as decimal(18, 2)) demand_qty
        from lineitem where l_shipdate >= timestamp '2001-01-01 00:00:00' group by l_orderkey, l_partkey""",
    "fact_order": """select l_orderkey || '-' || l_linenumber || '-' || l_partkey po_line_key, 'PRT' || lpad(cast(l_partkey as varchar), 9, '0') part_key, 'SUP' || lpad(cast(l_suppkey as varchar), 5, '0') supplier_key,
        case o_orderstatus when 'O' then 'OPEN' when 'F' then 'RECEIVED' when 'P' then 'CANCELLED' end status, cast(o_orderdate as date) order_date, cast(l_quantity as decimal(18, 2)) order_qty, cast(l_extendedprice as decimal(18, 2)) line_value
        from lineitem left join orders on l_orderkey = o_orderkey""",
    "fact_lead": """select l_orderkey || '-' || l_partkey || '-' || l_suppkey lead_time_key, 'PRT' || lpad(cast(l_partkey as varchar), 9, '0') part_key, 'SUP' || lpad(cast(l_suppkey as varchar), 5, '0') supplier_key,
        max(cast(cast(l_shipdate as date) - cast(o_orderdate as date) as int)) lead_time_days, cast(o_orderdate as date) effective_from from lineitem join orders on l_orderkey = o_orderkey group by l_orderkey, l_partkey, l_suppkey, o_orderdate""",
    "quote": """select 'QT' || supplier_part_id quote_id, supplier_id, part_id, cast(unit_price * (cast(i % 97 + 52 as decimal(6, 0)) * 0.01) as decimal(18, 4)) quoted_price,
        cast(lead_time_days + i % 41 - 20 as int) quoted_lead_time_days, cast(date '2026-07-01' - cast(i % 400 as int) as date) valid_to from (select *, cast(substring(supplier_part_id, 4) as bigint) i from supplier_part)""",
    "call_audit": """select cast(event_id as varchar) call_id, event_type provider, case when k % 2 = 0 then 'small' else 'large' end model, 'v' || (user_id % 3) prompt_version, cast(value as decimal(18, 4)) latency_ms,
        cast(k % 100 as int) confidence, k % 7 = 0 abstained, case when k % 11 = 0 then 'rejected' else 'valid' end validation_result, ts called_at from (select *, coalesce(cast(json_extract_string(props, '$.k') as int), 0) k from events)""",
    "uom_codes": "select unnest([" + ", ".join(f"'{u}'" for u in UOMS) + "]) uom_code",
}


def needs(sql: str) -> list[str]:
    """The core tables a text reads, each after those it needs itself."""
    found: list[str] = []
    for name, body in TABLES.items():
        if re.search(rf"\b{name}\b", sql) and name not in found:
            for n in needs(body):
                if n not in found:
                    found.append(n)
            if name not in found:
                found.append(name)
    return found


def with_tables(sql: str, more: dict[str, str] | None = None, recursive: bool = False) -> str:
    """sql with the tables it reads before it; more: further named parts, which may read the tables."""
    more = more or {}
    used = needs(sql + " ".join(more.values()))
    parts = [f"{n} as ({TABLES[n]})" for n in used] + [f"{n} as ({b})" for n, b in more.items()]
    return f"with {'recursive ' if recursive else ''}{', '.join(parts)} {sql}" if parts else sql


def _v(entity: str, k: str, field: str, value: str, rest: str) -> str:
    return f"select '{entity}' entity_type, cast({k} as varchar) entity_key, '{field}' field, cast({value} as varchar) failed_value from {rest}"


def _orphan(entity: str, k: str, field: str, table: str, parents: str, parent: str, null_counts: bool = True) -> str:
    return _v(entity, k, field, field, f"{table} x where not exists (select 1 from {parents} y where y.{parent} = x.{field})" + ("" if null_counts else f" and x.{field} is not null"))


def _several(entity: str, k: str, field: str, table: str, by: str, where: str, value: str = "") -> str:
    return _v(entity, k, field, value or field, f"(select *, count(*) over (partition by {by}) n from {table} where {where}) where n > 1")


SET_RULES: dict[str, str] = {
    "COMP-004": _v("part", "part_key", "supplier", "null", "dim_part where procurement_type = 'BUY' and part_key not in (select part_id from supplier_part where part_id is not null)"),
    "UNIQ-001": _several("part", "part_key", "source_part_number", "dim_part", "source_part_number, source_system", "source_part_number is not null and source_system is not null"),
    "UNIQ-002": _several("part", "part_key", "part_number_normalized", "dim_part", "part_number_normalized", "part_number_normalized <> ''"),
    "UNIQ-003": _several("supplier", "supplier_key", "supplier_name_normalized", "dim_supplier", "supplier_name_normalized", "true"),
    "UNIQ-004": _several("part", "part_key", "mpn_normalized", "dim_part", "mpn_normalized", "mpn_normalized <> ''"),
    "UNIQ-005": _several("revision", "revision_id", "is_current", "revision", "bom_header_id", "is_current", "bom_header_id"),
    "VALD-001": _v("part", "part_key", "uom", "uom", "dim_part where uom is not null and uom not in (select uom_code from uom_codes)"),
    "REFI-001": _orphan("bom_relationship", "bom_rel_key", "parent_part_key", "fact_bom", "dim_part", "part_key"),
    "REFI-002": _orphan("bom_relationship", "bom_rel_key", "child_part_key", "fact_bom", "dim_part", "part_key"),
    "REFI-003": _orphan("supplier_part", "supplier_part_id", "supplier_id", "supplier_part", "dim_supplier", "supplier_key"),
    "REFI-004": _orphan("part", "part_key", "primary_plant", "dim_part", "dim_plant", "plant_key", False),
    "REFI-005": _orphan("demand", "demand_key", "part_key", "fact_demand", "dim_part", "part_key"),
    "REFI-006": _orphan("cost", "cost_key", "part_key", "fact_cost", "dim_part", "part_key"),
    "XFLD-001": _v("part", "part_key", "bom", "null", "dim_part where procurement_type = 'MAKE' and bom_tier >= 2 and part_key not in (select parent_part_key from fact_bom where parent_part_key is not null)"),
    "XFLD-002": _v("part", "part_key", "lifecycle_status", "lifecycle_status", "dim_part where lifecycle_status = 'OBSOLETE' and part_key in (select part_key from fact_demand)"),
    "XFLD-003": _v("part", "part_key", "lifecycle_status", "lifecycle_status", "dim_part where lifecycle_status = 'BLOCKED' and part_key in (select part_key from fact_demand)"),
    "XFLD-004": _v("bom_relationship", "bom_rel_key", "child_part_key", "child_part_key", "fact_bom b, dim_part c, dim_part p where c.part_key = b.child_part_key and p.part_key = b.parent_part_key and c.lifecycle_status = 'OBSOLETE' and p.lifecycle_status = 'ACTIVE'"),
    "XFLD-005": _v("bom_relationship", "bom_rel_key", "child_part_key", "child_part_key", "fact_bom b, dim_part c, dim_part p where c.part_key = b.child_part_key and p.part_key = b.parent_part_key and c.lifecycle_status = 'BLOCKED' and p.lifecycle_status = 'ACTIVE'"),
    "XFLD-006": _v("supplier_part", "supplier_part_id", "currency", "x.currency || ' vs ' || s.currency", "supplier_part x join dim_supplier s on s.supplier_key = x.supplier_id where x.currency not in (s.currency, 'USD')"),
    "TEMP-001": _v("revision", "a.revision_id", "effective_from", "'overlaps ' || b.revision_id", "revision a join revision b on a.bom_header_id = b.bom_header_id and a.revision_id < b.revision_id where a.effective_to is not null and a.effective_from < coalesce(b.effective_to, date '2999-12-31') and b.effective_from < a.effective_to"),
    "ANOM-001": _v("cost", "cost_key", "standard_cost", "standard_cost || ' (prev ' || prev || ')'", "(select *, lag(standard_cost) over (partition by part_key order by effective_from, cost_key) prev from fact_cost) where prev > 0 and (cast(standard_cost as double) / cast(prev as double) > 4 or cast(standard_cost as double) / cast(prev as double) < 0.25)"),
    "ANOM-002": _v("lead_time", "lead_time_key", "lead_time_days", "lead_time_days || ' (prev ' || prev || ')'", "(select *, lag(lead_time_days) over (partition by part_key, supplier_key order by effective_from, lead_time_key) prev from fact_lead) where prev > 0 and lead_time_days > 3 * prev"),
    "ANOM-004": _v("supplier_part", "supplier_part_id", "unit_price", "unit_price || ' (min ' || low || ')'", "(select *, min(unit_price) filter (unit_price > 0) over (partition by part_id) low, count(*) filter (unit_price > 0) over (partition by part_id) n from supplier_part where part_id is not null) where n > 1 and unit_price > 2.5 * low"),
    "GRPH-002": _v("bom_relationship", "a.bom_rel_key", "child_part_key", "a.parent_part_key || ' <-> ' || a.child_part_key", "fact_bom a join fact_bom b on a.parent_part_key = b.child_part_key and a.child_part_key = b.parent_part_key where a.parent_part_key <> a.child_part_key"),
    "GRPH-003": _several("bom_relationship", "bom_rel_key", "child_part_key", "fact_bom", "parent_part_key, child_part_key, revision_label", "parent_part_key is not null and child_part_key is not null and revision_label is not null"),
    "DOCR-001": _v("quote", "quote_id", "quoted_price", "quoted_price || ' vs ' || unit_price", "quote q join supplier_part s on s.supplier_id = q.supplier_id and s.part_id = q.part_id where unit_price > 0 and (cast(quoted_price as double) / cast(unit_price as double) > 1.3 or cast(quoted_price as double) / cast(unit_price as double) < 0.7)"),
    "DOCR-002": _v("quote", "quote_id", "quoted_lead_time_days", "quoted_lead_time_days || ' vs ' || s.lead_time_days", "quote q join supplier_part s on s.supplier_id = q.supplier_id and s.part_id = q.part_id where abs(quoted_lead_time_days - s.lead_time_days) > 14"),
}


def rule_sql(rule_id: str) -> str:
    """A rule's violations, to be used behind with_tables."""
    r = next(r for r in RULES if r.rule_id == rule_id)
    if rule_id in SET_RULES:
        return SET_RULES[rule_id]
    return _v(r.entity_type, r.key, r.field, r.value.replace(" as string)", " as varchar)"), f"{r.table} where {r.when}")


def issues_sql(rules: list[str] | None = None) -> dict[str, str]:
    """The named parts found and issues, of all rules or of those named."""
    chosen = [r for r in RULES if rules is None or r.rule_id in rules]
    found = " union all ".join(f"select '{r.rule_id}' rule_id, '{r.severity}' severity, '{r.domain}' domain, v.* from ({rule_sql(r.rule_id)}) v" for r in chosen)
    return {
        "found": found,
        "issues": """select md5('run-1|' || rule_id || '|' || entity_type || '|' || coalesce(entity_key || '|', '') || field || '|' || coalesce(failed_value, '')) issue_id, *,
            case when ascii(right(entity_key, 1)) % 5 = 0 then 'CLOSED' when ascii(right(entity_key, 1)) % 5 = 1 then 'REJECTED' else 'DETECTED' end status, date '2026-07-01' detected_at from found""",
    }
