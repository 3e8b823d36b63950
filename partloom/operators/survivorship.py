"""Weighted survivorship: for each entity and field the value of the best scored record, with reasons and alternatives.

The score of a record's value joins the reliability of its source (with a bonus where the source owns the field),
how recent the record is within its entity, and how many of the entity's values agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.operators.scoring import RELIABILITY

#: fixed values: governed fields, weights, and the sources that own a field
FIELDS = ("source_part_number", "description", "category", "uom", "lifecycle_status", "manufacturer_part_number", "standard_cost", "lead_time_days", "primary_plant")
WEIGHTS = {"reliability": 0.45, "recency": 0.25, "agreement": 0.30}
OWNERS = {("description", "PLM_TEAMCENTER"): 0.10, ("standard_cost", "SAP_ECC"): 0.10, ("standard_cost", "ORACLE_EBS"): 0.05, ("lead_time_days", "SUPPLIER_PORTAL"): 0.25, ("uom", "SAP_ECC"): 0.05}
OTHER_SOURCE, UNKNOWN_DATE, DECAY_DAYS = 0.6, 0.5, 1460.0


def scored(members: DataFrame, numbers_agree: bool = True) -> DataFrame:
    """(entity_id, field_name, value, part_id, source_system, agreement, score): one row per record and field with a value.

    Nulls and empty texts are no values; rows repeated in full are one. With numbers_agree=False agreement of numbers is 0.
    """
    cells = [F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value"), F.lit(f in ("standard_cost", "lead_time_days")).alias("number")) for f in FIELDS]
    rows = members.select("entity_id", "part_id", F.coalesce("source_system", F.lit("")).alias("source_system"), "last_updated", *FIELDS).distinct()
    newest = F.max("last_updated").over(Window.partitionBy("entity_id"))
    behind = F.datediff(newest, "last_updated")
    rows = rows.withColumn("recency", F.coalesce(F.greatest(F.lit(0.0), 1.0 - behind / DECAY_DAYS), F.lit(UNKNOWN_DATE)))
    long = rows.select("entity_id", "part_id", "source_system", "recency", F.inline(F.array(*cells))).where("value is not null and value <> ''")
    w = Window.partitionBy("entity_id", "field_name")
    same = F.count(F.lit(1)).over(Window.partitionBy("entity_id", "field_name", "value"))
    agree = same / F.count(F.lit(1)).over(w)
    if not numbers_agree:
        agree = F.when(F.col("number"), 0.0).otherwise(agree)
    rel = F.create_map(*[x for k, v in RELIABILITY.items() for x in (F.lit(k), F.lit(v))])
    own = F.create_map(*[x for (f, s), v in OWNERS.items() for x in (F.lit(f"{f}|{s}"), F.lit(v))])
    bonus = F.coalesce(F.try_element_at(own, F.concat_ws("|", "field_name", "source_system")), F.lit(0.0))
    base = F.coalesce(F.try_element_at(rel, F.col("source_system")), F.lit(OTHER_SOURCE))
    out = long.withColumn("agreement", agree).withColumn("bonus", bonus)
    score = (WEIGHTS["reliability"] * (base + F.col("bonus")) + WEIGHTS["recency"] * F.col("recency") + WEIGHTS["agreement"] * F.col("agreement")).cast("decimal(12,8)")
    return out.withColumn("score", F.round(score, 4).cast("decimal(8,4)"))


def _confidence(score: Column, margin: Column) -> Column:
    """The confidence in a score with its margin over the next, in decimals so that rounding is exact."""
    d = lambda x: F.lit(x).cast("decimal(8,4)")
    return F.round(F.least(d("1"), score * (d("0.7") + F.least(d("0.3"), margin))), 4).cast("double")


def decide(members: DataFrame, numbers_agree: bool = True) -> DataFrame:
    """(entity_id, field_name, selected_value, source_record, source_system, reason, confidence, alternatives): one row per entity and field.

    The greatest score wins, of equal ones the smallest record id. confidence follows the score and its margin over the
    next record; alternatives are the records of other values with their scores. Fields without any value give no row.
    """
    s = scored(members, numbers_agree)
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "part_id", "value", "source_system", "agreement", "bonus")))
    per = s.groupBy("entity_id", "field_name").agg(ranked.alias("r")).withColumn("best", F.col("r")[0])
    top = -F.col("best.minus")
    margin = F.when(F.size("r") > 1, top + F.get("r", F.lit(1))["minus"]).otherwise(top)
    reason = F.concat_ws(" + ", F.concat(F.lit("source_reliability("), "best.source_system", F.lit(")")), F.when(F.col("best.agreement") > 0.5, F.concat(F.lit("cross_source_agreement("), F.round(F.col("best.agreement") * 100).cast("int").cast("string"), F.lit("%)"))), F.when(F.col("best.bonus") > 0, F.concat(F.lit("domain_preference("), "field_name", F.lit(")"))))
    others = F.transform(F.filter("r", lambda x: x["value"] != F.col("best.value")), lambda x: F.struct(x["value"].alias("value"), x["part_id"].alias("source_record"), x["source_system"].alias("source_system"), (-x["minus"]).alias("score")))
    return per.select("entity_id", "field_name", F.col("best.value").alias("selected_value"), F.col("best.part_id").alias("source_record"), F.col("best.source_system").alias("source_system"), reason.alias("reason"), _confidence(top, margin).alias("confidence"), others.alias("alternatives"))


def winners(members: DataFrame, numbers_agree: bool = True) -> DataFrame:
    """(entity_id, field_name, selected_value, source_record, source_system, reason, confidence): as decide, without the alternatives, by aggregates only, so entities may be of any size."""
    s = scored(members, numbers_agree)
    best = F.min(F.struct((-F.col("score")).alias("minus"), "part_id", "value", "source_system", "agreement", "bonus"))
    top = s.groupBy("entity_id", "field_name").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    mine = -F.col("best.minus")
    rank = s.join(top, ["entity_id", "field_name"]).where(F.struct((-F.col("score")).alias("minus"), "part_id", "value", "source_system", "agreement", "bonus") > F.col("best"))
    second = rank.groupBy("entity_id", "field_name").agg(F.max("score").alias("next"))
    both = top.join(second, ["entity_id", "field_name"], "left")
    margin = F.when(F.col("next").isNotNull(), mine - F.col("next")).otherwise(mine)
    reason = F.concat_ws(" + ", F.concat(F.lit("source_reliability("), "best.source_system", F.lit(")")), F.when(F.col("best.agreement") > 0.5, F.concat(F.lit("cross_source_agreement("), F.round(F.col("best.agreement") * 100).cast("int").cast("string"), F.lit("%)"))), F.when(F.col("best.bonus") > 0, F.concat(F.lit("domain_preference("), "field_name", F.lit(")"))))
    return both.select("entity_id", "field_name", F.col("best.value").alias("selected_value"), F.col("best.part_id").alias("source_record"), F.col("best.source_system").alias("source_system"), reason.alias("reason"), _confidence(mine, margin).alias("confidence"))


def flat(decisions: DataFrame) -> DataFrame:
    """One row per entity with the selected value of every governed field."""
    return decisions.groupBy("entity_id").agg(*[F.max(F.when(F.col("field_name") == f, F.col("selected_value"))).alias(f) for f in FIELDS])
