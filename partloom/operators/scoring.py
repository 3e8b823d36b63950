"""Quality scores of entities, assemblies and the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions.keys import source_key

#: fixed values: penalties and weights by severity (others: the last), reliability by source (others: 0.7)
PENALTY = {"critical": 25.0, "high": 12.0, "medium": 5.0, "low": 2.0}
WEIGHT = {"critical": 8.0, "high": 4.0, "medium": 1.5, "low": 0.5}
RELIABILITY = {"SAP_ECC": 0.92, "ORACLE_EBS": 0.85, "LEGACY_MFG": 0.65, "PLM_TEAMCENTER": 0.88, "SUPPLIER_PORTAL": 0.72}


def lookup(values: dict[str, float], c: Column, default: float) -> Column:
    m = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast("decimal(6,2)"))])
    return F.coalesce(F.try_element_at(m, c), F.lit(default).cast("decimal(6,2)"))


def entity_scores(issues: DataFrame, parts: DataFrame) -> DataFrame:
    """(entity_type, entity_key, penalty, quality_score) of every entity with an issue that isn't closed; null keys don't count.

    Scores of parts are nine tenths issues and one tenth the reliability of their source.
    """
    pen = issues.where("status <> 'CLOSED' and entity_key is not null").groupBy("entity_type", "entity_key").agg(F.sum(lookup(PENALTY, F.col("severity"), 2.0)).alias("penalty"))
    rel = parts.select(F.col("part_key").alias("entity_key"), lookup({k.replace("_", ""): v for k, v in RELIABILITY.items()}, source_key("source_system"), 0.7).alias("rel"))
    base = F.greatest(F.lit(100).cast("decimal(10,2)") - F.col("penalty"), F.lit(0).cast("decimal(10,2)"))
    mixed = F.least(base * F.lit("0.9").cast("decimal(3,1)") + F.coalesce("rel", F.lit("0.7").cast("decimal(6,2)")) * 10, F.lit(100).cast("decimal(10,2)"))
    return pen.join(rel, "entity_key", "left").select("entity_type", "entity_key", F.col("penalty").cast("decimal(18,2)").alias("penalty"), F.round(F.when(F.col("entity_type") == "part", mixed).otherwise(base), 2).cast("decimal(18,2)").alias("quality_score"))


def bom_scores(issues: DataFrame, links: DataFrame) -> DataFrame:
    """(parent_part_key, penalty, bom_quality_score) of every parent; links without parent don't count."""
    pen = issues.where("entity_type = 'bom_relationship' and status <> 'CLOSED'").groupBy(F.col("entity_key").alias("bom_rel_key")).agg(F.sum(lookup(PENALTY, F.col("severity"), 2.0)).alias("p"))
    per = links.where("parent_part_key is not null").join(pen, "bom_rel_key", "left").groupBy("parent_part_key").agg(F.coalesce(F.sum("p"), F.lit(0)).cast("decimal(18,2)").alias("penalty"))
    return per.select("parent_part_key", "penalty", F.greatest(F.lit(100).cast("decimal(18,2)") - F.col("penalty"), F.lit(0).cast("decimal(18,2)")).cast("decimal(18,2)").alias("bom_quality_score"))


def enterprise_score(issues: DataFrame, parts: DataFrame, closed: tuple[str, ...] = ("CLOSED",)) -> DataFrame:
    """One row: (enterprise_quality_score, weighted_issue_points, open_issues, parts_in_scope); two single-row aggregates joined on a constant."""
    a = issues.where(~F.col("status").isin(*closed)).agg(F.coalesce(F.sum(lookup(WEIGHT, F.col("severity"), 0.5)), F.lit(0)).cast("decimal(18,2)").alias("points"), F.count(F.lit(1)).alias("open_issues")).withColumn("_1", F.lit(1))
    b = parts.agg(F.count(F.lit(1)).alias("parts_in_scope")).withColumn("_1", F.lit(1))
    score = 100.0 - F.col("points").cast("double") / F.greatest(F.col("parts_in_scope"), F.lit(1)) * 100.0 / 8.0
    return a.join(b, "_1").select(F.round(F.greatest(F.lit(0.0), score), 2).alias("enterprise_quality_score"), F.round("points", 1).cast("decimal(18,1)").alias("weighted_issue_points"), "open_issues", "parts_in_scope")
