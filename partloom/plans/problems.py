"""The queries pN_ of the general problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.operators import history, profile, references
from partloom.operators.hierarchy import Hierarchy, links
from partloom.session import Cuts
from partloom.sources.tables import small_list, table


def _hierarchy(spark: SparkSession, d: str) -> Hierarchy:
    return Hierarchy(links(table(spark, d, "fact_bom_relationship"), "parent_part_key", "child_part_key"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """below_root: parts below each root with the fewest links; on_cycle: parts on a cycle with the smallest key of it."""
    h = _hierarchy(spark, d)
    below = h.places().where("level > 0").select(F.lit("below_root").alias("kind"), F.col("root").alias("root_part_key"), F.col("part").alias("part_key"), F.col("level").alias("n_levels"))
    loops = h.cycles().select(F.lit("on_cycle").alias("kind"), F.col("group_key").alias("root_part_key"), F.col("part").alias("part_key"), F.lit(0).cast("long").alias("n_levels"))
    return below.unionByName(loops)


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every part's path and level below each of its roots."""
    return _hierarchy(spark, d).places(with_paths=True).select("root", "part", "level", F.array_join("path", ">").alias("path"))


def p2_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The nested-set range, depth and parent of every part with children in the forest of the links."""
    return _hierarchy(spark, d).nodes.select("part", "up", "top", "pre", "last", "depth")


def _dangling(spark: SparkSession, d: str) -> DataFrame:
    bom = references.references(table(spark, d, "fact_bom_relationship"), "fact_bom_relationship", "bom_rel_key", ["parent_part_key", "child_part_key"], "_ingested_at")
    sup = references.references(table(spark, d, "supplier_parts"), "supplier_parts", "supplier_part_id", ["part_id"], "_ingested_at")
    return references.dangling([bom, sup], references.validity(table(spark, d, "part_master"), "part_id", "_ingested_at", "_load_status"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _dangling(spark, d).select("table_name", "record_key", "field_name", "ref_month", "kind").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return references.report(_dangling(spark, d))


def _counts(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    rows = profile.latest_rows(table(spark, d, "dim_part"), "_source_system_file", "load_no", "part_key", "_ingested_at", columns)
    return Cuts(spark, "profile").write(profile.value_counts(rows, columns))[0]


def p5_columns(codes: list[str]) -> list[profile.Column]:
    """The columns of dim_part with a declared form: texts, codes and numbers."""
    listed = ", ".join("'" + c.replace("\\", "\\\\").replace("'", "\\'") + "'" for c in codes)
    return [
        profile.Column("description", "text", r"value rlike '\\A[A-Z0-9]+(?:[ ./-][A-Z0-9]+)*\\z'"),
        profile.Column("category", "code", f"value in ({listed})"),
        profile.Column("lead_time_days", "number", "try_cast(value as int) between 1 and 365"),
    ]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    codes = small_list(table(spark, d, "product_category"), "category_code")
    columns = p5_columns(codes)
    counts = _counts(spark, d, [c.name for c in columns])
    forms = Cuts(spark, "forms").write(profile.agreed_forms(counts, columns))[0]
    return profile.departures(profile.load_profile(profile.conforming(counts, forms), columns, "fits"), profile.mix_shift(counts, "category", codes))


OTHER_COLUMNS = {"source_system": "code", "uom": "code", "lifecycle_status": "code", "procurement_type": "code", "standard_cost": "number", "primary_plant": "code", "bom_tier": "number"}


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """The profile of all columns per feed and load, with the coverage by the induced expression and its change."""
    codes = small_list(table(spark, d, "product_category"), "category_code")
    columns = p5_columns(codes) + [profile.Column(n, k) for n, k in OTHER_COLUMNS.items()]
    counts = _counts(spark, d, [c.name for c in columns])
    forms = profile.induce_forms(counts)
    return profile.load_profile(counts, columns).join(profile.form_coverage(counts, forms), ["feed", "load_no", "column_name"], "left")


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """The induced expression of every column: its level and shapes."""
    return profile.induce_forms(_counts(spark, d, ["description", "category", "lead_time_days", *OTHER_COLUMNS]))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    cost = history.observations(table(spark, d, "standard_cost_history"), "standard_cost", "part_id", "plant_code", "effective_from", "standard_cost", "_ingested_at", False)
    status = history.observations(table(spark, d, "part_master_snapshot"), "lifecycle_status", "part_id", None, "snapshot_date", "lifecycle_status", "_ingested_at", True)
    return history.versions(Cuts(spark, "history").write(cost.unionByName(status))[0])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d).select("field_name", "part_id", "plant_code", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"))


def p7_versions(spark: SparkSession, d: str) -> DataFrame:
    """Every version with its period and the number of rows it covers."""
    return _versions(spark, d).drop("value")


QUERIES = {f.__name__: f for f in (p2_found, p2_paths, p2_ranges, p4_found, p4_report, p5_found, p5_profile, p5_forms, p7_found, p7_versions)}
