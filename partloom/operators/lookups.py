"""Searches, pages, top lists and measures over parts, issues, decisions and calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions.keys import key
from partloom.operators import survivorship
from partloom.operators.marts import is_open

#: columns by which pages may be sorted, and the largest page
SORTABLE = {"part_key", "source_part_number", "description", "category", "standard_cost", "lead_time_days", "last_updated", "rule_id", "severity", "domain", "status", "detected_at", "entity_key"}
MOST_ROWS = 200


def page(rows: DataFrame, sort_by: str, unique: str, page_no: int = 1, size: int = 50, descending: bool = False) -> DataFrame:
    """One page of rows, sorted by a permitted column and then by the unique one, so pages neither overlap nor miss rows; nulls last."""
    if sort_by not in SORTABLE:
        raise ValueError(f"can't sort by {sort_by}")
    if not 1 <= size <= MOST_ROWS or page_no < 1:
        raise ValueError(f"pages hold 1 to {MOST_ROWS} rows and are counted from 1")
    order = F.desc_nulls_last(sort_by) if descending else F.asc_nulls_last(sort_by)
    return rows.orderBy(order, F.asc_nulls_last(unique)).offset((page_no - 1) * size).limit(size)


def matching(rows: DataFrame, text: str | None = None, within: tuple[str, ...] = (), **equal: str | None) -> DataFrame:
    """Rows with text in one of the columns `within` and with the given values; None asks nothing. % and _ in text are ordinary characters."""
    tests: list[Column] = [F.col(c) == v for c, v in equal.items() if v is not None]
    if text:
        tests.append(reduce(Column.__or__, [F.contains(F.upper(c), F.lit(text.upper())) for c in within]))
    return rows.where(reduce(Column.__and__, tests)) if tests else rows


def for_entity(issues: DataFrame, entity_key: str) -> DataFrame:
    return issues.where(F.col("entity_key") == entity_key).select("issue_id", "rule_id", "severity", "field", "failed_value", "status").orderBy("severity", "issue_id")


def failed_rules(issues: DataFrame, rules: DataFrame, entity_key: str) -> DataFrame:
    mine = issues.where(F.col("entity_key") == entity_key).select("rule_id").distinct()
    return F.broadcast(rules).join(mine, "rule_id").select("rule_id", "name", "severity", "domain")


def duplicate_evidence(issues: DataFrame) -> DataFrame:
    """What the uniqueness rules hold against each entity."""
    return issues.where(F.col("rule_id").startswith("UNIQ-")).select("entity_key", "rule_id", "field", "failed_value")


def obsolete_by_demand(parts: DataFrame, demand: DataFrame, most: int = 10) -> DataFrame:
    """The obsolete parts of greatest demand."""
    d = demand.groupBy("part_key").agg(F.sum("demand_qty").cast("decimal(18,2)").alias("demand_qty"))
    return parts.where("lifecycle_status = 'OBSOLETE'").join(d, "part_key").select("part_key", "description", "demand_qty").orderBy(F.desc("demand_qty"), "part_key").limit(most)


def supplier_exposure(supplied: DataFrame, issues: DataFrame, most: int = 10) -> DataFrame:
    """The suppliers whose parts have most issues, each issue counted once per supplier."""
    n = issues.where(is_open() & F.col("entity_key").isNotNull()).groupBy(F.col("entity_key").alias("part_id")).agg(F.countDistinct("issue_id").alias("n"))
    links = supplied.where("supplier_id is not null").select("supplier_id", "part_id").distinct()
    return links.join(n, "part_id").groupBy("supplier_id").agg(F.sum("n").alias("issues"), F.count(F.lit(1)).alias("parts")).orderBy(F.desc("issues"), "supplier_id").limit(most)


def plant_issues(parts: DataFrame, issues: DataFrame, plant: str, most: int = 15) -> DataFrame:
    """The most severe issues of a plant's parts, in the order of severity names."""
    here = parts.where(F.col("primary_plant") == plant).select(F.col("part_key").alias("entity_key"))
    return issues.where(F.col("severity").isin("critical", "high")).join(here, "entity_key").select("entity_key", "rule_id", "severity", "issue_id").orderBy("severity", "issue_id").limit(most)


def latest_abstentions(calls: DataFrame, most: int = 10) -> DataFrame:
    return calls.where("abstained").select("call_id", "provider", "model", "called_at").orderBy(F.desc("called_at"), "call_id").limit(most)


def by_group(issues: DataFrame) -> DataFrame:
    """Counts of open issues by severity and by domain, in one pass."""
    sets = issues.where(is_open()).select(F.explode(F.array(F.struct(F.lit("severity").alias("kind"), F.col("severity").alias("value")), F.struct(F.lit("domain").alias("kind"), F.col("domain").alias("value")))).alias("g"))
    return sets.groupBy("g.kind", "g.value").agg(F.count(F.lit(1)).alias("n"))


def top_rules(issues: DataFrame, most: int = 10) -> DataFrame:
    return issues.where(is_open()).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_id").limit(most)


def impact_totals(impact: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: sums over all parts and the number of distinct entities with a critical issue."""
    a = impact.agg(*[F.sum(c).cast("decimal(18,2)").alias(c) for c in ("inventory_value", "future_demand_qty", "open_po_value")]).withColumn("_1", F.lit(1))
    b = issues.where(is_open() & (F.col("severity") == "critical")).agg(F.countDistinct("entity_key").alias("critical_entities")).withColumn("_1", F.lit(1))
    return a.join(b, "_1").drop("_1")


def decision_totals(decisions: DataFrame) -> DataFrame:
    """(decision, n, share): decisions by kind."""
    n = decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("n")).withColumn("_1", F.lit(1))
    total = n.groupBy("_1").agg(F.sum("n").alias("total"))
    return n.join(total, "_1").select("decision", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def call_totals(calls: DataFrame) -> DataFrame:
    rate = lambda c: F.round(F.avg(F.expr(c).cast("int")), 6)
    return calls.agg(F.count(F.lit(1)).alias("calls"), rate("abstained").alias("abstention_rate"), rate("validation_result = 'valid'").alias("valid_rate"), F.round(F.sum("latency_ms").cast("double") / F.count("latency_ms"), 3).alias("avg_latency_ms"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


def measures(issues: DataFrame, part_quality: DataFrame) -> DataFrame:
    """One row of report measures over all issues and parts."""
    n_if = lambda c: F.count(F.when(F.expr(c), 1))
    a = issues.agg(
        n_if("status not in ('CLOSED', 'REJECTED')").alias("open_issues"), n_if("status not in ('CLOSED', 'REJECTED') and severity = 'critical'").alias("critical_open"), n_if("status not in ('CLOSED', 'REJECTED') and severity = 'high'").alias("high_open"),
        F.count(F.lit(1)).alias("all_issues"), F.round(F.try_divide(n_if("status in ('APPROVED', 'CLOSED')"), F.count(F.lit(1))), 6).alias("resolution_rate")).withColumn("_1", F.lit(1))
    b = part_quality.agg(F.round(F.avg("quality_score").cast("double"), 4).alias("avg_part_score"), n_if("quality_score < 60").alias("parts_below_60"), F.count(F.lit(1)).alias("parts")).withColumn("_1", F.lit(1))
    return a.join(b, "_1").drop("_1")


def counts(parts: DataFrame, issues: DataFrame) -> DataFrame:
    """(metric, n): the number of parts, and of issues by status."""
    by_status = issues.groupBy(F.concat(F.lit("issues_"), F.lower("status")).alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    return parts.agg(F.lit("parts").alias("metric"), F.count(F.lit(1)).alias("n")).unionByName(by_status)


def sources(raw_parts: DataFrame) -> DataFrame:
    """(part_key, source_system, source_part_number, first_seen, last_seen, n_rows): under which numbers each part came from its sources; null numbers and sources are values of their own."""
    rows = raw_parts.select(key("part_id").alias("part_key"), "source_system", "source_part_number", F.col("_ingested_at").alias("t")).where("part_key is not null")
    return rows.groupBy("part_key", "source_system", "source_part_number").agg(F.min("t").alias("first_seen"), F.max("t").alias("last_seen"), F.count(F.lit(1)).alias("n_rows"))


def clusters(parts: DataFrame) -> DataFrame:
    """parts with entity_id and part_id: all parts of one normal part number are one entity; a part without letter or digit in its number is an entity of its own."""
    number = F.nullif(F.col("part_number_normalized"), F.lit(""))
    return parts.withColumn("entity_id", F.coalesce(F.concat(F.lit("N"), number), F.concat(F.lit("K"), F.col("part_key")))).withColumn("part_id", F.col("part_key"))


def lineage(parts: DataFrame) -> DataFrame:
    """(entity_id, field_name, selected_value, source_record, source_system, reason, confidence, n_members): for each cluster of parts the surviving values and where they come from.

    Ranks are found by aggregates and joined to nothing but their cluster, so a cluster of any size is never one row.
    """
    rows = clusters(parts)
    size = rows.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_members"))
    return survivorship.winners(rows).join(size, "entity_id")


def report_measures(executive: DataFrame, part_quality: DataFrame, bom: DataFrame, impact: DataFrame, suppliers: DataFrame, remediation: DataFrame, governance: DataFrame) -> DataFrame:
    """(measure, value): the measures of the reports over the seven marts; a share of nothing is null, averages weigh every mart row alike."""
    n_if = lambda c: F.count(F.when(F.expr(c), 1))
    total = lambda c, when="true": F.coalesce(F.sum(F.when(F.expr(when), F.col(c))), F.lit(0))
    open_ = "status not in ('CLOSED', 'REJECTED')"
    weight = F.when(F.col("severity") == "critical", 8.0).when(F.col("severity") == "high", 4.0).when(F.col("severity") == "medium", 1.5).otherwise(0.5)
    approve, reject = total("decisions", "upper(decision) = 'APPROVE'"), total("decisions", "upper(decision) = 'REJECT'")
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    sets = [
        (executive, {"open_issues": total("issue_count", open_), "critical_open_issues": total("issue_count", f"{open_} and severity = 'critical'"), "high_open_issues": total("issue_count", f"{open_} and severity = 'high'"), "issues_detected": total("issue_count"),
                     "issue_resolution_rate": ratio(total("issue_count", "status in ('APPROVED', 'CLOSED')"), total("issue_count")), "_points": F.coalesce(F.sum(F.col("issue_count") * weight), F.lit(0.0))}),
        (part_quality, {"avg_part_quality_score": F.avg(F.col("quality_score").cast("double")), "parts_below_quality_threshold": n_if("quality_score < 60"), "_parts": F.count(F.lit(1))}),
        (bom, {"avg_bom_quality_score": F.avg(F.col("bom_quality_score").cast("double")), "assemblies_with_obsolete_components": n_if("obsolete_components > 0"), "assemblies_with_missing_components": n_if("missing_components > 0"), "total_bom_relationships": total("component_count")}),
        (impact, {"inventory_value_exposed": total("inventory_value", "open_issues > 0"), "total_inventory_value": total("inventory_value"), "demand_qty_exposed": total("future_demand_qty", "open_issues > 0"), "open_po_value_exposed": total("open_po_value", "open_issues > 0"),
                  "exposure_share_of_inventory": ratio(total("inventory_value", "open_issues > 0"), total("inventory_value")), "parts_with_critical_exposure": n_if("critical_issues > 0")}),
        (suppliers, {"suppliers_with_open_issues": n_if("open_issues_on_parts > 0"), "avg_supplier_lead_time": F.avg(F.col("avg_lead_time_days").cast("double"))}),
        (remediation, {"decisions_made": total("decisions"), "approvals": approve, "rejections": reject, "acceptance_rate": ratio(approve, approve + reject)}),
        (governance, {"ai_calls": total("calls"), "ai_abstention_rate": ratio(total("abstentions"), total("calls")), "ai_validation_failure_rate": ratio(total("validation_failures"), total("calls")), "ai_avg_latency_ms": F.avg(F.col("avg_latency_ms").cast("double")), "ai_avg_confidence": F.avg(F.col("avg_confidence").cast("double"))}),
    ]
    rows = [df.agg(*[v.cast("double").alias(k) for k, v in cols.items()]).select(F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("value")) for k in cols]))) for df, cols in sets]
    every = reduce(DataFrame.unionByName, rows)
    pick = lambda n: F.max(F.when(F.col("measure") == n, F.col("value")))
    score = every.agg(F.lit("enterprise_quality_score").alias("measure"), F.greatest(F.lit(0.0), 100 - F.try_divide(pick("_points"), pick("_parts")) * 100 / 8).alias("value"))
    return every.where("measure not like '\\_%'").unionByName(score).withColumn("value", F.round("value", 4))
