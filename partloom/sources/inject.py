"""Labelled defects in generated data: 25 kinds, each on a share of the rows that could have it.

Rows are chosen by a hash of seed, kind and key, so the same seed gives the same defects in any order of rows.
Kinds are applied one after the other; later ones see what earlier ones left. The given tables stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABEL = "injection_id string, issue_type string, dataset string, record_id string, field string, original_value string, injected_value string, correct_value string, correct_matching_entity string, difficulty string, seed long"
Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class FieldDefect:
    """A wrong value in a field of rows that meet a condition."""

    issue_type: str
    dataset: str
    field: str
    when: str
    value: str
    factor: float = 1.0
    difficulty: str = "easy"
    also: tuple[tuple[str, str], ...] = ()


def _choice(seed: int, kind: str, key: str, rate: float, when: Column) -> Column:
    return when & (F.pmod(F.xxhash64(F.lit(seed), F.lit(kind), F.col(key)), F.lit(1_000_000)) < int(rate * 1_000_000))


def _label(rows: DataFrame, kind: str, dataset: str, record: Column, field: str, old: Column, new: Column, right: Column, match: Column, difficulty: Column, seed: int) -> DataFrame:
    ident = F.concat(F.lit("INJ-"), F.substring(F.sha2(F.concat_ws("|", F.lit(kind), F.lit(field), record), 256), 1, 12))
    text = lambda c: c.cast("string")
    return rows.select(ident.alias("injection_id"), F.lit(kind).alias("issue_type"), F.lit(dataset).alias("dataset"), text(record).alias("record_id"), F.lit(field).alias("field"), text(old).alias("original_value"), text(new).alias("injected_value"), text(right).alias("correct_value"), text(match).alias("correct_matching_entity"), difficulty.alias("difficulty"), F.lit(seed).cast("long").alias("seed"))


def apply_field(tables: Tables, d: FieldDefect, rate: float, seed: int) -> DataFrame:
    """Replaces the dataset in tables by one with the defect; gives the labels."""
    df = tables[d.dataset]
    key = df.columns[0]
    hit = _choice(seed, d.issue_type + d.field, key, rate * d.factor, F.coalesce(F.expr(d.when), F.lit(False)))
    kind = dict(df.dtypes)[d.field]
    new = F.expr(d.value).cast(kind)
    none = F.lit(None)
    labels = _label(df.where(hit), d.issue_type, d.dataset, F.col(key), d.field, F.col(d.field), new, F.col(d.field), none, F.lit(d.difficulty), seed)
    changes = {d.field: F.when(hit, new).otherwise(F.col(d.field))} | {c: F.when(hit, F.expr(e).cast(dict(df.dtypes)[c])).otherwise(F.col(c)) for c, e in d.also}
    tables[d.dataset] = df.withColumns(changes)
    return labels


def _copies(tables: Tables, kind: str, rate: float, seed: int, changes: dict[str, str], prefix: str, dataset: str, difficulty: str = "'easy'") -> DataFrame:
    """Adds changed copies of rows under new keys."""
    df = tables[dataset]
    key = df.columns[0]
    picked = df.where(_choice(seed, kind, key, rate, F.col(key).isNotNull()))
    fresh = F.concat(F.lit(prefix), F.substring(key, len(prefix) + 1, 20))
    labels = _label(picked, kind, dataset, fresh, key, F.col(key), fresh, F.col(key), F.col(key), F.expr(difficulty), seed)
    new = picked.select(*[(fresh if c == key else F.expr(changes[c]) if c in changes else F.col(c)).cast(t).alias(c) for c, t in df.dtypes])
    tables[dataset] = df.unionByName(new)
    return labels


def exact_duplicate_parts(t: Tables, rate: float, seed: int) -> DataFrame:
    return _copies(t, "exact_duplicate_part", rate, seed, {"source_system": "case when source_system = 'SAP_ECC' then 'ORACLE_EBS' else 'SAP_ECC' end"}, "PRT9", "part_master")


def fuzzy_duplicate_parts(t: Tables, rate: float, seed: int) -> DataFrame:
    level = "element_at(array('easy', 'medium', 'hard'), cast(pmod(xxhash64(part_id), 3) as int) + 1)"
    words = f"case {level} when 'easy' then replace(description, ' ', '  ') when 'medium' then concat_ws(' ', reverse(split(description, ' '))) else concat(substring(description, 1, 3), '. ', element_at(split(description, ' '), -1)) end"
    number = f"case {level} when 'hard' then concat('LG', right(source_part_number, 5)) else replace(source_part_number, '-', '') end"
    return _copies(t, "fuzzy_duplicate_part", rate, seed, {"source_system": "'LEGACY_MFG'", "description": words, "source_part_number": number, "standard_cost": "round(standard_cost * 1.03, 4)"}, "PRT8", "part_master", level)


def duplicate_suppliers(t: Tables, rate: float, seed: int) -> DataFrame:
    return _copies(t, "duplicate_supplier", rate * 3, seed, {"supplier_name": "upper(supplier_name)"}, "SUP9", "suppliers")


def circular_boms(t: Tables, rate: float, seed: int) -> DataFrame:
    """Adds a link from a child back to its parent."""
    df = t["bom_components"]
    picked = df.where(_choice(seed, "circular_bom", "bom_component_id", rate * 0.3, F.col("parent_part_id") != F.col("child_part_id")))
    fresh = F.concat(F.lit("BMX"), F.substring("bom_component_id", 4, 30))
    back = picked.withColumns({"bom_component_id": fresh, "parent_part_id": F.col("child_part_id"), "child_part_id": F.col("parent_part_id")})
    t["bom_components"] = df.unionByName(back.select(*df.columns))
    return _label(picked, "circular_bom", "bom_components", fresh, "child_part_id", F.lit(None), F.col("parent_part_id"), F.lit(None), F.lit(None), F.lit("medium"), seed)


def obsolete_components(t: Tables, rate: float, seed: int) -> DataFrame:
    """Components of active assemblies become obsolete parts; labelled by the links."""
    parts, links = t["part_master"], t["bom_components"]
    active = parts.where("lifecycle_status = 'ACTIVE'").select(F.col("part_id").alias("parent_part_id"))
    hit = links.join(active, "parent_part_id", "left_semi").where(_choice(seed, "obsolete_component", "child_part_id", rate * 2, F.col("child_part_id").isNotNull()))
    parents = links.select(F.col("parent_part_id").alias("child_part_id")).distinct()
    leaf = hit.join(parents, "child_part_id", "left_anti")
    ids = leaf.select(F.col("child_part_id").alias("part_id"), F.lit(True).alias("_hit")).distinct()
    t["part_master"] = parts.join(ids, "part_id", "left").withColumn("lifecycle_status", F.when(F.col("_hit"), "OBSOLETE").otherwise(F.col("lifecycle_status"))).select(*parts.columns)
    none = F.lit(None)
    return _label(leaf, "obsolete_component_in_active_bom", "bom_components", F.col("bom_component_id"), "child_part_id", F.lit("ACTIVE"), F.lit("OBSOLETE"), F.lit("ACTIVE"), none, F.lit("medium"), seed)


def blocked_demand(t: Tables, rate: float, seed: int) -> DataFrame:
    parts = t["part_master"]
    wanted = t["future_demand"].select("part_id").distinct().withColumn("_d", F.lit(True))
    df = parts.join(wanted, "part_id", "left")
    hit = _choice(seed, "blocked_part", "part_id", rate, F.coalesce(F.col("_d"), F.lit(False)) & (F.col("lifecycle_status") == "ACTIVE"))
    t["part_master"] = df.withColumn("lifecycle_status", F.when(hit, "BLOCKED").otherwise(F.col("lifecycle_status"))).select(*parts.columns)
    return _label(df.where(hit), "blocked_part_with_future_demand", "part_master", F.col("part_id"), "lifecycle_status", F.col("lifecycle_status"), F.lit("BLOCKED"), F.col("lifecycle_status"), F.lit(None), F.lit("easy"), seed)


_LAST = "cost_history_id like '%-3'"
#: in this order; the rules that find each kind are in operators.detection
STEPS: list[FieldDefect | Callable[[Tables, float, int], DataFrame]] = [
    exact_duplicate_parts, fuzzy_duplicate_parts, duplicate_suppliers,
    FieldDefect("conflicting_part_descriptions", "part_aliases", "alias_type", "true", "concat('CONFLICTS WITH ', part_id)", 2, "medium"),
    FieldDefect("conflicting_mpn", "part_master", "manufacturer_part_number", "manufacturer_part_number is not null and part_id not like 'PRT9%'", "concat('ZZ-', abs(xxhash64(part_id)) % 100000000)", 0.5, "hard"),
    *[FieldDefect("missing_critical_attributes", "part_master", f, f"{f} is not null", "null", 0.4) for f in ("description", "category", "uom", "standard_cost", "lead_time_days")],
    FieldDefect("invalid_uom", "part_master", "uom", "uom is not null", "element_at(array('EACH', 'PCS', 'UNIT', 'KGS', 'XX', '??'), cast(pmod(xxhash64(part_id), 6) as int) + 1)"),
    FieldDefect("zero_component_quantity", "bom_components", "quantity_per", "quantity_per > 0", "0"),
    FieldDefect("negative_component_quantity", "bom_components", "quantity_per", "quantity_per > 0", "-abs(quantity_per)"),
    FieldDefect("extreme_cost_change", "standard_cost_history", "standard_cost", _LAST, "standard_cost * element_at(array(0.01D, 0.1D, 12D, 100D), cast(pmod(xxhash64(part_id), 4) as int) + 1)"),
    FieldDefect("extreme_lead_time_change", "lead_time_history", "lead_time_days", "lead_time_history_id like '%-2'", "lead_time_days * 10 + 100"),
    FieldDefect("supplier_price_conflict", "supplier_parts", "unit_price", "supplier_part_id like '%-2'", "unit_price * (4 + pmod(xxhash64(part_id), 400) / 100)", 1, "medium"),
    FieldDefect("currency_inconsistency", "supplier_parts", "currency", "true", "'JPY'"),
    FieldDefect("stale_record", "part_master", "last_updated", "lifecycle_status = 'ACTIVE'", "date_sub(date '2026-07-01', cast(1500 + pmod(xxhash64(part_id), 1500) as int))", 1, "easy", (("created_date", "least(created_date, date '2017-01-01')"),)),
    FieldDefect("orphan_bom_component", "bom_components", "child_part_id", "bom_component_id not like 'BMX%'", "concat('PRT7', substring(child_part_id, 5, 20))", 0.5),
    FieldDefect("orphan_bom_parent", "bom_components", "parent_part_id", "bom_component_id not like 'BMX%'", "concat('PRT6', substring(parent_part_id, 5, 20))", 0.5),
    circular_boms,
    FieldDefect("self_referencing_bom", "bom_components", "child_part_id", "bom_component_id not like 'BMX%' and child_part_id not like 'PRT7%'", "parent_part_id", 0.3),
    FieldDefect("overlapping_effective_dates", "engineering_revisions", "effective_to", "effective_to is not null", "date_add(effective_to, 45)"),
    FieldDefect("multiple_active_revisions", "engineering_revisions", "is_current", "not is_current", "true"),
    obsolete_components, blocked_demand,
    FieldDefect("invalid_plant_relationship", "part_master", "primary_plant", "primary_plant is not null", "concat('PL', 80 + pmod(xxhash64(part_id), 19))"),
    FieldDefect("invalid_supplier_relationship", "supplier_parts", "supplier_id", "true", "concat('SUP8', right(supplier_id, 4))"),
    FieldDefect("supplier_doc_vs_erp_discrepancy", "supplier_quotes", "quoted_price", "true", "quoted_price * (1.8 + pmod(xxhash64(quote_id), 200) / 100)", 2),
]


def inject(tables: Tables, rate: float = 0.02, seed: int = 20260716) -> tuple[Tables, DataFrame]:
    """(tables with defects, their labels)."""
    out = dict(tables)
    labels = [apply_field(out, s, rate, seed) if isinstance(s, FieldDefect) else s(out, rate, seed) for s in STEPS]
    return out, reduce(DataFrame.unionByName, labels)
