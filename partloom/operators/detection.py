"""How well the rules find labelled defects, and whether clean data stays clean."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.operators import staging
from partloom.sources.binding import Tables

#: fixed values: the rules that should find each kind; kinds not listed aren't found by rules
FINDERS = {
    "exact_duplicate_part": ("UNIQ-002",), "duplicate_supplier": ("UNIQ-003",), "missing_critical_attributes": ("COMP-001", "COMP-002", "COMP-003", "COMP-005", "COMP-006"), "invalid_uom": ("VALD-001",),
    "orphan_bom_component": ("REFI-002",), "orphan_bom_parent": ("REFI-001",), "circular_bom": ("GRPH-002",), "self_referencing_bom": ("GRPH-001",), "zero_component_quantity": ("VALD-006",), "negative_component_quantity": ("VALD-007",),
    "overlapping_effective_dates": ("TEMP-001",), "multiple_active_revisions": ("UNIQ-005",), "obsolete_component_in_active_bom": ("XFLD-004",), "blocked_part_with_future_demand": ("XFLD-003",), "extreme_cost_change": ("ANOM-001",),
    "extreme_lead_time_change": ("ANOM-002",), "supplier_price_conflict": ("ANOM-004",), "currency_inconsistency": ("XFLD-006",), "stale_record": ("TEMP-002",), "invalid_plant_relationship": ("REFI-004",), "invalid_supplier_relationship": ("REFI-003",), "supplier_doc_vs_erp_discrepancy": ("DOCR-001",),
}
#: fixed values: rules that clean generated data may break, as real data does
ORGANIC = ("COMP-008", "XFLD-001", "TEMP-002", "ANOM-001", "ANOM-002", "ANOM-004", "DOCR-001", "DOCR-002", "DOCR-003", "GRPH-003")


class GeneratedTables(Tables):
    """The core tables over generated datasets."""

    def __init__(self, datasets: dict[str, DataFrame]):
        any_df = next(iter(datasets.values()))
        super().__init__(any_df.sparkSession, "")
        self.datasets = datasets

    def raw(self, name: str) -> DataFrame:
        return self.datasets[name].withColumn("_ingested_at", F.lit("2026-07-01").cast("timestamp"))

    @cached_property
    def fact_bom(self) -> DataFrame:
        return staging.bom_links(self.raw("bom_components").withColumnsRenamed({"bom_component_id": "bom_rel_key", "parent_part_id": "parent_part_key", "child_part_id": "child_part_key", "position": "position_no"}))

    @cached_property
    def revision(self) -> DataFrame:
        return self.datasets["engineering_revisions"]

    @cached_property
    def dim_supplier(self) -> DataFrame:
        return self.datasets["suppliers"].select(F.col("supplier_id").alias("supplier_key"), "supplier_name", staging.one_space("supplier_name").alias("supplier_name_normalized"), "country", "currency")

    @cached_property
    def dim_plant(self) -> DataFrame:
        return self.datasets["plants"].select(F.col("plant_code").alias("plant_key"), "plant_name", "region")

    @cached_property
    def fact_inventory(self) -> DataFrame:
        return self.datasets["inventory_snapshots"].select(F.col("inventory_id").alias("inventory_key"), F.col("part_id").alias("part_key"), staging.amount("on_hand_qty", 2).alias("on_hand_qty"), staging.amount("on_hand_value", 2).alias("on_hand_value"))

    @cached_property
    def fact_demand(self) -> DataFrame:
        return self.datasets["future_demand"].select(F.col("demand_id").alias("demand_key"), F.col("part_id").alias("part_key"), staging.amount("demand_qty", 2).alias("demand_qty"))

    @cached_property
    def fact_order(self) -> DataFrame:
        heads = self.datasets["purchase_orders"].select("po_id", "supplier_id", "order_date", "status")
        return staging.order_lines(self.datasets["purchase_order_lines"], heads, "po_id").select(F.col("po_line_id").alias("po_line_key"), F.col("part_id").alias("part_key"), F.col("supplier_id").alias("supplier_key"), "status", "order_date", staging.amount("order_qty", 2).alias("order_qty"), staging.amount("line_value", 2).alias("line_value"))

    @cached_property
    def fact_lead(self) -> DataFrame:
        return self.datasets["lead_time_history"].select(F.col("lead_time_history_id").alias("lead_time_key"), F.col("part_id").alias("part_key"), F.col("supplier_id").alias("supplier_key"), "lead_time_days", "effective_from")

    @cached_property
    def quote(self) -> DataFrame:
        return self.datasets["supplier_quotes"].select("quote_id", "supplier_id", "part_id", staging.amount("quoted_price").alias("quoted_price"), "quoted_lead_time_days", "valid_to")


def new_findings(dirty: DataFrame, clean: DataFrame) -> DataFrame:
    """(rule_id, entity_key) found with defects but not without them."""
    return dirty.select("rule_id", "entity_key").distinct().subtract(clean.select("rule_id", "entity_key"))


def _finders(spark) -> DataFrame:
    return spark.createDataFrame([(k, r) for k, rs in FINDERS.items() for r in rs], "issue_type string, rule_id string")


def recall(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(issue_type, difficulty, labelled, detected, recall) of the kinds that rules can find."""
    hits = F.broadcast(_finders(found.sparkSession)).join(found.select("rule_id", F.col("entity_key").alias("record_id")).distinct(), "rule_id").select("issue_type", "record_id", F.lit(1).alias("hit")).distinct()
    mine = labels.where(F.col("issue_type").isin(*FINDERS)).select("issue_type", "difficulty", "record_id").distinct()
    return mine.join(hits, ["issue_type", "record_id"], "left").groupBy("issue_type", "difficulty").agg(F.count(F.lit(1)).alias("labelled"), F.count("hit").alias("detected")).withColumn("recall", F.round(F.col("detected") / F.col("labelled"), 4))


def precision(new: DataFrame, labels: DataFrame) -> DataFrame:
    """(rule_id, detected, true_positives, collateral, spurious): new findings on records labelled for the rule, on other labelled records, and on none."""
    for_rule = labels.join(F.broadcast(_finders(new.sparkSession)), "issue_type").select("rule_id", F.col("record_id").alias("entity_key"), F.lit(1).alias("mine")).distinct()
    any_ = labels.select(F.col("record_id").alias("entity_key"), F.lit(1).alias("some")).distinct()
    j = new.join(for_rule, ["rule_id", "entity_key"], "left").join(any_, "entity_key", "left")
    return j.groupBy("rule_id").agg(F.count(F.lit(1)).alias("detected"), F.count("mine").alias("true_positives"), F.count(F.when(F.col("mine").isNull() & F.col("some").isNotNull(), 1)).alias("collateral"), F.count(F.when(F.col("mine").isNull() & F.col("some").isNull(), 1)).alias("spurious"))


def rollup(recalls: DataFrame, precisions: DataFrame) -> DataFrame:
    """One row: (labelled, detected, recall, new_findings, spurious, precision)."""
    a = recalls.agg(F.sum("labelled").alias("labelled"), F.sum("detected").alias("found")).withColumn("_1", F.lit(1))
    b = precisions.agg(F.sum("detected").alias("new_findings"), F.sum("spurious").alias("spurious")).withColumn("_1", F.lit(1))
    return a.join(b, "_1").select("labelled", F.col("found").alias("detected"), F.round(F.try_divide("found", "labelled"), 4).alias("recall"), "new_findings", "spurious", F.round(F.try_divide(F.col("new_findings") - F.col("spurious"), F.col("new_findings")), 4).alias("precision"))


def unexpected(clean: DataFrame) -> DataFrame:
    """(rule_id, n): rules that clean data breaks without being allowed to."""
    return clean.where(~F.col("rule_id").isin(*ORGANIC)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
