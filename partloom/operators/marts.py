"""Analytics marts over core tables, issues, decisions and call audits.

Facts are aggregated to the grain of a mart before any join, so joins don't multiply rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_open(status: str = "status") -> Column:
    """Open in the marts: neither closed nor rejected."""
    return ~F.col(status).isin("CLOSED", "REJECTED")


def _count_if(c) -> Column:
    return F.count(F.when(F.expr(c) if isinstance(c, str) else c, 1))


def executive_quality(issues: DataFrame, rules: DataFrame) -> DataFrame:
    n = issues.groupBy("rule_id", "severity", "domain", "status", F.to_date("detected_at").alias("detected_date")).agg(F.count(F.lit(1)).alias("issue_count"))
    return n.join(F.broadcast(rules.select("rule_id", F.col("name").alias("rule_name"))), "rule_id", "left")


def _issue_counts(issues: DataFrame) -> DataFrame:
    return issues.where(is_open()).groupBy("entity_key").agg(F.count(F.lit(1)).alias("open_issues"), _count_if("severity = 'critical'").alias("critical_issues"))


def part_quality(parts: DataFrame, scores: DataFrame, issues: DataFrame) -> DataFrame:
    s = scores.where("entity_type = 'part'").select(F.col("entity_key").alias("part_key"), "quality_score")
    i = _issue_counts(issues).withColumnRenamed("entity_key", "part_key")
    zero = F.lit(0).cast("long")
    return parts.join(s, "part_key", "left").join(i, "part_key", "left").select(
        "part_key", "source_part_number", "source_system", "category", "lifecycle_status", "primary_plant", F.coalesce("quality_score", F.lit(100).cast("decimal(18,2)")).alias("quality_score"),
        F.coalesce("open_issues", zero).alias("open_issues"), F.coalesce("critical_issues", zero).alias("critical_issues"))


def bom_integrity(links: DataFrame, parts: DataFrame, scores: DataFrame) -> DataFrame:
    """Per parent, null included. Links are counted per (parent, child) first, so a child in a tenth of all links is joined once per parent."""
    pairs = links.groupBy("parent_part_key", "child_part_key").agg(F.count(F.lit(1)).alias("n"), _count_if("quantity_per <= 0").alias("bad"))
    known = parts.select(F.col("part_key").alias("child_part_key"), "lifecycle_status", F.lit(1).alias("known"))
    n_if = lambda c: F.sum(F.when(F.expr(c), F.col("n")).otherwise(0))
    per = pairs.join(known, "child_part_key", "left").groupBy("parent_part_key").agg(
        F.sum("n").alias("component_count"), n_if("known is null").alias("missing_components"), n_if("lifecycle_status = 'OBSOLETE'").alias("obsolete_components"),
        n_if("lifecycle_status = 'BLOCKED'").alias("blocked_components"), F.sum("bad").alias("invalid_quantities"))
    return per.join(scores.select("parent_part_key", "bom_quality_score"), "parent_part_key", "left").withColumn("bom_quality_score", F.coalesce("bom_quality_score", F.lit(100).cast("decimal(18,2)")))


def supplier_quality(suppliers: DataFrame, supplied: DataFrame, issues: DataFrame, weighted: bool = True) -> DataFrame:
    """Per supplier. With weighted, the mean lead time counts each link once per open issue of its part (at least once), as the reports do; else once."""
    n = issues.where(is_open()).groupBy(F.col("entity_key").alias("part_id")).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("issue_id").alias("n_issues"))
    links = supplied.join(n, "part_id", "left").withColumn("w", F.coalesce("n_rows", F.lit(1)) if weighted else F.lit(1))
    lead = links.groupBy(F.col("supplier_id").alias("supplier_key")).agg(F.countDistinct("part_id").alias("parts_supplied"), F.sum(F.col("lead_time_days").cast("long") * F.col("w")).alias("lead"), F.sum(F.when(F.col("lead_time_days").isNotNull(), F.col("w"))).alias("w"))
    of_parts = links.where("n_issues is not null").select(F.col("supplier_id").alias("supplier_key"), "part_id", "n_issues").distinct().groupBy("supplier_key").agg(F.sum("n_issues").alias("open_issues_on_parts"))
    zero = F.lit(0).cast("long")
    return suppliers.join(lead, "supplier_key", "left").join(of_parts, "supplier_key", "left").select(
        "supplier_key", "supplier_name", "country", "currency", F.coalesce("parts_supplied", zero).alias("parts_supplied"), F.round(F.try_divide("lead", "w"), 6).alias("avg_lead_time_days"), F.coalesce("open_issues_on_parts", zero).alias("open_issues_on_parts"))


def business_impact(parts: DataFrame, inventory: DataFrame, demand: DataFrame, orders: DataFrame, issues: DataFrame) -> DataFrame:
    money = lambda df, c, name: df.groupBy("part_key").agg(F.sum(c).cast("decimal(18,2)").alias(name))
    out = parts.select("part_key", "category", "primary_plant", "lifecycle_status")
    for more in (money(inventory, "on_hand_value", "inventory_value"), money(demand, "demand_qty", "future_demand_qty"), money(orders.where("status = 'OPEN'"), "line_value", "open_po_value"), _issue_counts(issues).withColumnRenamed("entity_key", "part_key")):
        out = out.join(more, "part_key", "left")
    return out.na.fill(0, ["inventory_value", "future_demand_qty", "open_po_value", "open_issues", "critical_issues"])


def remediation_performance(decisions: DataFrame, issues: DataFrame) -> DataFrame:
    i = issues.select("issue_id", "severity", "domain").distinct()
    return decisions.join(i, "issue_id", "left").groupBy(F.to_date("decided_at").alias("decision_date"), "decision", "reviewer", "severity", "domain").agg(F.count(F.lit(1)).alias("decisions"))


def call_governance(calls: DataFrame) -> DataFrame:
    return calls.groupBy("provider", "model", "prompt_version", F.to_date("called_at").alias("call_date")).agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.sum("latency_ms").cast("double") / F.count("latency_ms"), 3).alias("avg_latency_ms"), F.round(F.avg("confidence"), 3).alias("avg_confidence"),
        _count_if("abstained").alias("abstentions"), _count_if("validation_result <> 'valid'").alias("validation_failures"))


def current_status(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """issues with the status of their latest decision, if any: decisions are only added, never changed."""
    last = decisions.groupBy("issue_id").agg(F.max(F.struct("decided_at", "decision_id", "after_status")).alias("m")).select("issue_id", F.col("m.after_status").alias("after"))
    return issues.join(last, "issue_id", "left").withColumn("status", F.coalesce("after", "status")).drop("after")
