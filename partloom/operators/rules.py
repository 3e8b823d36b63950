"""Data-quality rules: a registry, one pass per table for row rules, and the run with evidence and execution records.

A row rule is a condition on the columns of one table; all row rules of a table are evaluated in one scan. A set rule is
a function of the tables. Every rule gives one row per violation: (entity_type, entity_key, field, failed_value), with
as many rows as there are violations, also of one key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.operators.staging import AS_OF
from partloom.session import Cuts
from partloom.sources.binding import CURRENCIES, STATUSES, UOMS, Tables

VIOLATION = ["entity_type", "entity_key", "field", "failed_value"]


@dataclass(frozen=True)
class Rule:
    """A rule: either a condition (when) on the rows of a table, or a function (find) of the tables."""

    rule_id: str
    name: str
    severity: str
    domain: str
    entity_type: str
    field: str
    table: str = ""
    key: str = ""
    when: str = ""
    value: str = "null"
    find: Callable[[Tables], DataFrame] | None = None
    threshold: float | None = None
    version: str = "1.0"
    enabled: bool = True


def _quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _rows(rule_id, name, severity, domain, entity, table, key, field, when, value="", threshold=None):
    return Rule(rule_id, name, severity, domain, entity, field, table, key, when, value or f"cast({field} as string)", None, threshold)


def _missing(rule_id: str, name: str, severity: str, field: str) -> Rule:
    return _rows(rule_id, name, severity, "completeness", "part", "dim_part", "part_key", field, f"{field} is null", "cast(null as string)")


# --- set rules -----------------------------------------------------------------------------------------


def _out(df: DataFrame, entity: str, key: str, field: str, value) -> DataFrame:
    return df.select(F.lit(entity).alias("entity_type"), F.col(key).cast("string").alias("entity_key"), F.lit(field).alias("field"), (F.col(value) if isinstance(value, str) else value).cast("string").alias("failed_value"))


def repeated(df: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose key occurs more than once; rows with a null in the key never do.

    Keys are counted before anything is shuffled and only repeated ones are joined back, so a frequent key costs no sort.
    """
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by])
    many = df.where(whole).groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return df.where(whole).join(many, by, "left_semi")


def unmatched(df: DataFrame, column: str, parents: DataFrame, parent: str, null_counts: bool = True) -> DataFrame:
    """Rows whose reference isn't among the parents; null references count unless null_counts is False."""
    some = df if null_counts else df.where(F.col(column).isNotNull())
    return some.join(parents.select(F.col(parent).alias(column)).where(F.col(column).isNotNull()), column, "left_anti")


def _repeats(table: str, by: list[str], entity: str, key: str, field: str, not_empty: bool = False):
    def find(t: Tables) -> DataFrame:
        df = getattr(t, table)
        return _out(repeated(df.where(f"{by[0]} <> ''") if not_empty else df, by), entity, key, field, field)

    return find


def _orphans(table: str, column: str, parents: str, parent: str, entity: str, key: str, null_counts: bool = True):
    return lambda t: _out(unmatched(getattr(t, table), column, getattr(t, parents), parent, null_counts), entity, key, column, column)


def _several_current(t: Tables) -> DataFrame:
    return _out(repeated(t.revision.where("is_current"), ["bom_header_id"]), "revision", "revision_id", "is_current", "bom_header_id")


def overlapping(df: DataFrame, group: str, ident: str, start: str, end: str) -> DataFrame:
    """(ident, other): pairs of a group whose periods overlap, the first with an end; an open second one never ends.

    Equal group, ident order and a range of dates as the rest of the join's condition.
    """
    a = df.where(F.col(end).isNotNull()).select(F.col(group).alias("g"), F.col(ident).alias("ident"), F.col(start).alias("a0"), F.col(end).alias("a1"))
    b = df.select(F.col(group).alias("g"), F.col(ident).alias("other"), F.col(start).alias("b0"), F.coalesce(end, F.lit("2999-12-31").cast("date")).alias("b1"))
    return a.join(b, "g").where("ident < other and a0 < b1 and b0 < a1").select("ident", "other")


def _overlaps(t: Tables) -> DataFrame:
    return _out(overlapping(t.revision, "bom_header_id", "revision_id", "effective_from", "effective_to"), "revision", "ident", "effective_from", F.concat(F.lit("overlaps "), "other"))


def moved(df: DataFrame, by: list[str], at: str, ident: str, value: str) -> DataFrame:
    """df with `prev`, the value of the entry before (by time, then key)."""
    return df.withColumn("prev", F.lag(value).over(Window.partitionBy(*by).orderBy(at, ident)))


def _cost_moves(t: Tables) -> DataFrame:
    m = moved(t.fact_cost, ["part_key"], "effective_from", "cost_key", "standard_cost")
    ratio = F.try_divide(F.col("standard_cost").cast("double"), F.col("prev").cast("double"))
    return _out(m.where(F.col("prev") > 0).where((ratio > 4.0) | (ratio < 0.25)), "cost", "cost_key", "standard_cost", F.concat(F.col("standard_cost").cast("string"), F.lit(" (prev "), F.col("prev").cast("string"), F.lit(")")))


def _lead_moves(t: Tables) -> DataFrame:
    m = moved(t.fact_lead, ["part_key", "supplier_key"], "effective_from", "lead_time_key", "lead_time_days")
    return _out(m.where("prev > 0 and lead_time_days > prev * 3"), "lead_time", "lead_time_key", "lead_time_days", F.concat(F.col("lead_time_days").cast("string"), F.lit(" (prev "), F.col("prev").cast("string"), F.lit(")")))


def _price_spread(t: Tables) -> DataFrame:
    low = t.supplier_part.where("unit_price > 0 and part_id is not null").groupBy("part_id").agg(F.min("unit_price").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return _out(t.supplier_part.join(low, "part_id").where("unit_price > low * 2.5"), "supplier_part", "supplier_part_id", "unit_price", F.concat(F.col("unit_price").cast("string"), F.lit(" (min "), F.col("low").cast("string"), F.lit(")")))


def _two_cycles(t: Tables) -> DataFrame:
    """Each link once per opposite link; opposite links are counted by their ends first, so frequent ends meet once."""
    e = t.fact_bom.where("parent_part_key <> child_part_key")
    back = e.groupBy(F.col("child_part_key").alias("parent_part_key"), F.col("parent_part_key").alias("child_part_key")).agg(F.count(F.lit(1)).alias("n"))
    met = e.join(back, ["parent_part_key", "child_part_key"]).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return _out(met, "bom_relationship", "bom_rel_key", "child_part_key", F.concat_ws(" <-> ", "parent_part_key", "child_part_key"))


def _set(rule_id, name, severity, domain, entity, field, find, threshold=None):
    return Rule(rule_id, name, severity, domain, entity, field, find=find, threshold=threshold)


RULES: list[Rule] = [
    _missing("COMP-001", "Part without description", "high", "description"),
    _missing("COMP-002", "Part without category", "medium", "category"),
    _missing("COMP-003", "Part without unit of measure", "critical", "uom"),
    _rows("COMP-004", "Bought part without supplier", "high", "completeness", "part", "part_uses", "part_key", "supplier", "procurement_type = 'BUY' and supplied is null", "cast(null as string)"),
    _missing("COMP-005", "Part without lead time", "high", "lead_time_days"),
    _missing("COMP-006", "Part without standard cost", "high", "standard_cost"),
    _missing("COMP-007", "Part without plant", "medium", "primary_plant"),
    _missing("COMP-008", "Part without maker number", "low", "manufacturer_part_number"),
    _set("UNIQ-001", "Part number repeated in its source", "critical", "uniqueness", "part", "source_part_number", _repeats("dim_part", ["source_part_number", "source_system"], "part", "part_key", "source_part_number")),
    _set("UNIQ-002", "Part number repeated across sources", "high", "uniqueness", "part", "part_number_normalized", _repeats("dim_part", ["part_number_normalized"], "part", "part_key", "part_number_normalized", True)),
    _set("UNIQ-003", "Supplier name repeated", "critical", "uniqueness", "supplier", "supplier_name_normalized", _repeats("dim_supplier", ["supplier_name_normalized"], "supplier", "supplier_key", "supplier_name_normalized")),
    _set("UNIQ-004", "Maker number repeated", "high", "uniqueness", "part", "mpn_normalized", _repeats("dim_part", ["mpn_normalized"], "part", "part_key", "mpn_normalized", True)),
    _set("UNIQ-005", "Several current revisions", "high", "uniqueness", "revision", "is_current", _several_current),
    _rows("VALD-001", "Unit not governed", "high", "validity", "part", "dim_part", "part_key", "uom", f"uom not in ({_quoted(UOMS)})"),
    _rows("VALD-002", "Currency not governed", "high", "validity", "supplier_part", "supplier_part", "supplier_part_id", "currency", f"currency not in ({_quoted(CURRENCIES)})"),
    _rows("VALD-003", "Status not governed", "medium", "validity", "part", "dim_part", "part_key", "lifecycle_status", f"lifecycle_status not in ({_quoted(STATUSES)})"),
    _rows("VALD-004", "Cost not positive", "high", "validity", "part", "dim_part", "part_key", "standard_cost", "standard_cost <= 0"),
    _rows("VALD-005", "Lead time negative", "high", "validity", "part", "dim_part", "part_key", "lead_time_days", "lead_time_days < 0"),
    _rows("VALD-006", "Quantity zero", "critical", "validity", "bom_relationship", "fact_bom", "bom_rel_key", "quantity_per", "quantity_per = 0"),
    _rows("VALD-007", "Quantity negative", "critical", "validity", "bom_relationship", "fact_bom", "bom_rel_key", "quantity_per", "quantity_per < 0"),
    _rows("VALD-008", "Revision ends before it starts", "high", "validity", "revision", "revision", "revision_id", "effective_to", "effective_to < effective_from"),
    _rows("REFI-001", "Parent not in part master", "critical", "referential", "bom_relationship", "link_ends", "bom_rel_key", "parent_part_key", "parent_known is null"),
    _rows("REFI-002", "Child not in part master", "critical", "referential", "bom_relationship", "link_ends", "bom_rel_key", "child_part_key", "child_known is null"),
    _rows("REFI-003", "Supplier unknown", "high", "referential", "supplier_part", "supplied_by", "supplier_part_id", "supplier_id", "known is null"),
    _set("REFI-004", "Plant unknown", "high", "referential", "part", "primary_plant", _orphans("dim_part", "primary_plant", "dim_plant", "plant_key", "part", "part_key", False)),
    _set("REFI-005", "Demand for unknown part", "high", "referential", "demand", "part_key", _orphans("fact_demand", "part_key", "dim_part", "part_key", "demand", "demand_key")),
    _set("REFI-006", "Cost of unknown part", "medium", "referential", "cost", "part_key", _orphans("fact_cost", "part_key", "dim_part", "part_key", "cost", "cost_key")),
    _rows("XFLD-001", "Made part without components", "high", "consistency", "part", "part_uses", "part_key", "bom", "procurement_type = 'MAKE' and bom_tier >= 2 and built is null", "cast(null as string)"),
    _rows("XFLD-002", "Obsolete part in demand", "critical", "consistency", "part", "part_uses", "part_key", "lifecycle_status", "lifecycle_status = 'OBSOLETE' and demanded"),
    _rows("XFLD-003", "Blocked part in demand", "critical", "consistency", "part", "part_uses", "part_key", "lifecycle_status", "lifecycle_status = 'BLOCKED' and demanded"),
    _rows("XFLD-004", "Obsolete component of active assembly", "critical", "consistency", "bom_relationship", "link_ends", "bom_rel_key", "child_part_key", "child_status = 'OBSOLETE' and parent_status = 'ACTIVE'"),
    _rows("XFLD-005", "Blocked component of active assembly", "high", "consistency", "bom_relationship", "link_ends", "bom_rel_key", "child_part_key", "child_status = 'BLOCKED' and parent_status = 'ACTIVE'"),
    _rows("XFLD-006", "Currency other than the supplier's", "medium", "consistency", "supplier_part", "supplied_by", "supplier_part_id", "currency", "currency <> own_currency and currency <> 'USD'", "concat(currency, ' vs ', own_currency)"),
    _rows("XFLD-007", "Raw material counted in pieces", "low", "consistency", "part", "dim_part", "part_key", "uom", "category = 'RAW_MATERIALS' and uom in ('EA', 'SET', 'PR')"),
    _set("TEMP-001", "Revisions overlap", "high", "temporal", "revision", "effective_from", _overlaps),
    _rows("TEMP-002", "Active part not updated for long", "medium", "temporal", "part", "dim_part", "part_key", "last_updated", f"lifecycle_status = 'ACTIVE' and last_updated < date '{AS_OF}' - interval '1095' day", "", 1095.0),
    _rows("TEMP-003", "Cost starts far ahead", "low", "temporal", "cost", "fact_cost", "cost_key", "effective_from", f"effective_from > date '{AS_OF}' + interval '365' day"),
    _rows("TEMP-004", "Updated before created", "high", "temporal", "part", "dim_part", "part_key", "last_updated", "last_updated < created_date"),
    _set("ANOM-001", "Cost moves extremely", "high", "anomaly", "cost", "standard_cost", _cost_moves, 4.0),
    _set("ANOM-002", "Lead time moves extremely", "high", "anomaly", "lead_time", "lead_time_days", _lead_moves, 3.0),
    _rows("ANOM-003", "Stock negative", "high", "anomaly", "inventory", "fact_inventory", "inventory_key", "on_hand_qty", "on_hand_qty < 0"),
    _set("ANOM-004", "Suppliers' prices diverge", "medium", "anomaly", "supplier_part", "unit_price", _price_spread, 2.5),
    _rows("ANOM-005", "Quantity extreme", "medium", "anomaly", "bom_relationship", "fact_bom", "bom_rel_key", "quantity_per", "quantity_per > 100", "", 100.0),
    _rows("GRPH-001", "Part contains itself", "critical", "graph", "bom_relationship", "fact_bom", "bom_rel_key", "child_part_key", "parent_part_key = child_part_key"),
    _set("GRPH-002", "Two parts contain each other", "critical", "graph", "bom_relationship", "child_part_key", _two_cycles),
    _set("GRPH-003", "Component repeated in a revision", "low", "graph", "bom_relationship", "child_part_key", _repeats("fact_bom", ["parent_part_key", "child_part_key", "revision_label"], "bom_relationship", "bom_rel_key", "child_part_key")),
    _rows("DOCR-001", "Quoted price differs", "high", "reconciliation", "quote", "quoted", "quote_id", "quoted_price", "unit_price > 0 and not try_divide(cast(quoted_price as double), cast(unit_price as double)) between 0.7 and 1.3", "concat(quoted_price, ' vs ', unit_price)", 1.3),
    _rows("DOCR-002", "Quoted lead time differs", "high", "reconciliation", "quote", "quoted", "quote_id", "quoted_lead_time_days", "abs(quoted_lead_time_days - erp_lead) > 14", "concat(quoted_lead_time_days, ' vs ', erp_lead)", 14.0),
    _rows("DOCR-003", "Quote expired", "low", "reconciliation", "quote", "quote", "quote_id", "valid_to", f"valid_to < date '{AS_OF}' - interval '90' day"),
]

BY_ID = {r.rule_id: r for r in RULES}


def enabled_rules(rules: list[Rule] = RULES) -> list[Rule]:
    return [r for r in rules if r.enabled]


def violations(rule: Rule, t: Tables) -> DataFrame:
    """One row per violation of one rule."""
    if rule.find is not None:
        return rule.find(t)
    hit = getattr(t, rule.table).where(rule.when)
    return hit.select(F.lit(rule.entity_type).alias("entity_type"), F.expr(f"cast({rule.key} as string)").alias("entity_key"), F.lit(rule.field).alias("field"), F.expr(rule.value).cast("string").alias("failed_value"))


def table_violations(rules: list[Rule], t: Tables, table: str) -> DataFrame:
    """(rule_id, ...violation) of all row rules of a table, in one scan of it."""
    cells = [F.when(F.expr(r.when), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.entity_type).alias("entity_type"), F.expr(f"cast({r.key} as string)").alias("entity_key"), F.lit(r.field).alias("field"), F.expr(r.value).cast("string").alias("failed_value"))) for r in rules]
    return getattr(t, table).select(F.inline(F.array_compact(F.array(*cells))))


def _frames(t: Tables, rules: list[Rule]) -> tuple[list[tuple[list[Rule], DataFrame]], list[tuple[str, str]]]:
    """([(rules, their violations with rule_id)], [(rule_id, error)] of those that can't be planned): row rules of a table share one frame."""
    by_table: dict[str, list[Rule]] = {}
    frames, failed = [], []
    for r in rules:
        if r.find is None:
            by_table.setdefault(r.table, []).append(r)
        else:
            try:
                frames.append(([r], violations(r, t).select(F.lit(r.rule_id).alias("rule_id"), *VIOLATION)))
            except Exception as e:
                failed.append((r.rule_id, str(e)))
    for name, group in by_table.items():
        try:
            frames.append((group, table_violations(group, t, name)))
        except Exception as e:
            failed += [(r.rule_id, str(e)) for r in group]
    return frames, failed


def run(t: Tables, rules: list[Rule] | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(all violations with their rule_id, [(rule_id, error)]): a rule that can't be planned fails alone and is reported."""
    frames, failed = _frames(t, enabled_rules(RULES if rules is None else rules))
    return reduce(DataFrame.unionByName, [f for _, f in frames]), failed


def run_stored(t: Tables, rules: list[Rule] | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """As run, with the violations written: a rule that fails while it runs fails alone, too.

    All rules are written in one job; only if that fails each rule is written by itself, and those that fail again are reported.
    """
    todo = enabled_rules(RULES if rules is None else rules)
    cuts = Cuts(t.spark, "rules")
    try:
        found, failed = run(t, todo)
        return cuts.write(found)[0], failed
    except Exception:
        frames, failed, done = [], [], []
        for r in todo:
            more, bad = _frames(t, [r])
            frames, failed = frames + more, failed + bad
        for group, df in frames:
            try:
                done.append(cuts.write(df)[0])
            except Exception as e:
                failed += [(r.rule_id, str(e)) for r in group]
        none = t.spark.createDataFrame([], "rule_id string, entity_type string, entity_key string, field string, failed_value string")
        return reduce(DataFrame.unionByName, done, none), failed


def issues(found: DataFrame, run_id: str, at: str = AS_OF, rules: list[Rule] | None = None) -> DataFrame:
    """Issues of violations, each with a key that depends on its content only, its evidence and its first status."""
    known = F.create_map(*[x for r in (rules or RULES) for x in (F.lit(r.rule_id), F.struct(F.lit(r.severity).alias("severity"), F.lit(r.domain).alias("domain"), F.lit(r.version).alias("version")))])
    rule = F.try_element_at(known, F.col("rule_id"))
    ident = F.md5(F.concat_ws("|", F.lit(run_id), "rule_id", "entity_type", "entity_key", "field", F.coalesce("failed_value", F.lit(""))))
    return found.select(ident.alias("issue_id"), "rule_id", F.lit(run_id).alias("run_id"), *VIOLATION, rule["severity"].alias("severity"), rule["domain"].alias("domain"), rule["version"].alias("rule_sql_version"), F.lit("DETECTED").alias("status"), F.lit(at).cast("date").alias("detected_at"))


def executions(found: DataFrame, failed: list[tuple[str, str]], run_id: str, rules: list[Rule] | None = None) -> DataFrame:
    """(run_id, rule_id, rule_version, violations, status): one row per rule, also of those without violations."""
    wrong = {r for r, _ in failed}
    every = found.sparkSession.createDataFrame([(run_id, r.rule_id, r.version, "FAILED" if r.rule_id in wrong else "OK") for r in enabled_rules(rules or RULES)], "run_id string, rule_id string, rule_version string, status string")
    n = found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("violations"))
    return F.broadcast(every).join(n, "rule_id", "left").select("run_id", "rule_id", "rule_version", F.coalesce("violations", F.lit(0).cast("long")).alias("violations"), "status")


def rule_table(t: Tables, rules: list[Rule] = RULES) -> DataFrame:
    """The registry as a table."""
    return t.spark.createDataFrame([(r.rule_id, r.name, r.severity, r.domain, r.threshold, r.version, r.enabled) for r in rules], "rule_id string, name string, severity string, domain string, threshold double, version string, enabled boolean")
