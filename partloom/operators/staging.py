"""Staged and core tables: normal forms, safe casts, one row per key, a calendar, changes as versions, and table tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partloom.functions.keys import key, stripped


def part_number(c: Column | str) -> Column:
    """Part numbers as letters and digits in upper case; null stays null, others may become empty."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def one_space(c: Column | str) -> Column:
    return F.regexp_replace(F.upper(c), r"\s+", " ")


def amount(c: Column | str, scale: int = 4) -> Column:
    """decimal(18, scale), null where the value is no such number."""
    return F.expr(f"try_cast({c} as decimal(18, {scale}))") if isinstance(c, str) else c.try_cast(f"decimal(18, {scale})")


def whole(c: str) -> Column:
    """An integer read over double, half to even, so that '14.0' is 14; null where that is none."""
    return F.expr(f"try_cast(bround(try_cast({c} as double)) as int)")


def latest(rows: DataFrame, by: list[str], seen_at: str) -> DataFrame:
    """One row per key: that of the latest time, of several such the greatest in the columns' order. Null keys form one group."""
    rest = [c for c in rows.columns if c not in by and c != seen_at]
    picked = rows.groupBy(*by).agg(F.max(F.struct(seen_at, *rest)).alias("_m"))
    return picked.select(*[F.col(c) if c in by else F.col(f"_m.{c}").alias(c) for c in rows.columns])


def parts(raw: DataFrame) -> DataFrame:
    """The part dimension: one row per part, originals and normal forms side by side."""
    slim = raw.select(
        key("part_id").alias("part_key"), "source_part_number", part_number("source_part_number").alias("part_number_normalized"), "source_system", "description",
        one_space("description").alias("description_normalized"), key("category").alias("category"), key("uom").alias("uom"), key("lifecycle_status").alias("lifecycle_status"),
        key("procurement_type").alias("procurement_type"), "manufacturer_part_number", part_number("manufacturer_part_number").alias("mpn_normalized"),
        amount("standard_cost").alias("standard_cost"), key("currency").alias("currency"), whole("lead_time_days").alias("lead_time_days"), key("primary_plant").alias("primary_plant"),
        whole("bom_tier").alias("bom_tier"), F.expr("try_cast(created_date as date)").alias("created_date"), F.expr("try_cast(last_updated as date)").alias("last_updated"), "_ingested_at",
    ).where("part_key is not null")
    return latest(slim, ["part_key"], "_ingested_at").drop("_ingested_at")


def parts_to_match(raw: DataFrame) -> DataFrame:
    """What of parts() is compared between parts, of the same rows.

    Which of several latest rows is the greatest rests on all columns in their order; those that follow from earlier ones, and those
    behind the last one kept, can't change what is kept and are left out before the shuffle.
    """
    slim = raw.select(
        key("part_id").alias("part_key"), "source_part_number", "source_system", "description", key("category").alias("category"), key("uom").alias("uom"), key("lifecycle_status").alias("lifecycle_status"),
        key("procurement_type").alias("procurement_type"), "manufacturer_part_number", amount("standard_cost").alias("standard_cost"), key("currency").alias("currency"), whole("lead_time_days").alias("lead_time_days"), "_ingested_at",
    ).where("part_key is not null")
    return latest(slim, ["part_key"], "_ingested_at").drop("_ingested_at", "lifecycle_status", "procurement_type", "currency")


def bom_links(raw: DataFrame) -> DataFrame:
    """The link facts: one row per link record."""
    slim = raw.select(
        stripped("bom_rel_key").alias("bom_rel_key"), "bom_header_id", key("parent_part_key").alias("parent_part_key"), key("child_part_key").alias("child_part_key"),
        amount("quantity_per").alias("quantity_per"), key("uom").alias("uom"), key("revision_label").alias("revision_label"), F.col("effective_from").cast("date").alias("effective_from"),
        F.col("effective_to").cast("date").alias("effective_to"), whole("position_no").alias("position_no"), "_ingested_at",
    )
    return latest(slim, ["bom_rel_key"], "_ingested_at").drop("_ingested_at")


def supplier_parts(raw: DataFrame) -> DataFrame:
    slim = raw.select(
        stripped("supplier_part_id").alias("supplier_part_id"), key("supplier_id").alias("supplier_id"), key("part_id").alias("part_id"), part_number("supplier_part_number").alias("supplier_part_number"),
        amount("unit_price").alias("unit_price"), key("currency").alias("currency"), whole("lead_time_days").alias("lead_time_days"), whole("min_order_qty").alias("min_order_qty"), F.col("is_primary").cast("boolean").alias("is_primary"), "_ingested_at",
    )
    return latest(slim, ["supplier_part_id"], "_ingested_at").drop("_ingested_at")


def cost_history(raw: DataFrame) -> DataFrame:
    slim = raw.select(stripped("cost_history_id").alias("cost_key"), key("part_id").alias("part_key"), key("plant_code").alias("plant_key"), amount("standard_cost").alias("standard_cost"), F.col("effective_from").cast("date").alias("effective_from"), "_ingested_at")
    return latest(slim, ["cost_key"], "_ingested_at").drop("_ingested_at")


def revisions(links: DataFrame) -> DataFrame:
    """Revisions of the assemblies: from the first start to the last end of their links, open if a link is; current if not ended on AS_OF."""
    grouped = links.where("bom_header_id is not null and revision_label is not null").groupBy("bom_header_id", "revision_label").agg(
        F.min("effective_from").alias("effective_from"), F.when(F.count("effective_to") == F.count(F.lit(1)), F.max("effective_to")).alias("effective_to"))
    current = F.col("effective_to").isNull() | (F.col("effective_to") > F.lit(AS_OF).cast("date"))
    return grouped.select(F.concat_ws("-", "bom_header_id", "revision_label").alias("revision_id"), "bom_header_id", "revision_label", "effective_from", "effective_to", current.alias("is_current"))


#: the day of the data
AS_OF = "2026-07-01"


def order_lines(lines: DataFrame, headers: DataFrame, on: str) -> DataFrame:
    """Lines with the attributes of their header; lines without header stay."""
    return lines.join(headers, on, "left")


def calendar(spark: SparkSession, first: str = "2015-01-01", last: str = "2028-12-31") -> DataFrame:
    """(date_key, year, month, day, quarter): every day from first to last."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date_key"))
    return days.select("date_key", F.year("date_key").alias("year"), F.month("date_key").alias("month"), F.dayofmonth("date_key").alias("day"), F.quarter("date_key").alias("quarter"))


def snapshot_changes(current: DataFrame, new: DataFrame, on: str, checked: list[str], at: str) -> DataFrame:
    """Versions after a snapshot, by comparing the checked columns: current holds open versions (valid_from, valid_to null).

    Unchanged versions stay, changed and vanished ones are closed at `at`, changed and new keys are opened at `at`. Null equals null.
    """
    old = current.select(F.col(on).alias("_k"), *[F.col(c).alias(f"_o_{c}") for c in checked], F.col("valid_from").alias("_from"))
    both = old.join(new.select(on, *checked), F.col("_k") == F.col(on), "full_outer")
    same = F.lit(True)
    for c in checked:
        same = same & F.col(f"_o_{c}").eqNullSafe(F.col(c))
    had, has = F.col("_k").isNotNull(), F.col(on).isNotNull()
    day = F.lit(at).cast("date")
    closed = F.when(had, F.struct(F.col("_k").alias(on), *[F.col(f"_o_{c}").alias(c) for c in checked], F.col("_from").alias("valid_from"), F.when(~(has & same), day).alias("valid_to")))
    opened = F.when(has & ~(had & same), F.struct(F.col(on), *checked, day.alias("valid_from"), F.lit(None).cast("date").alias("valid_to")))
    return both.select(F.inline(F.array_compact(F.array(closed, opened))))


def snapshot_versions(snapshots: DataFrame, on: str, checked: list[str], day: str) -> DataFrame:
    """(on, checked, valid_from, valid_to): the versions that snapshot_changes gives when folded over all days of snapshots, in one pass.

    snapshots: one row per key and day. A version is closed on the first of all days on which its key is missing or changed;
    those of the last day stay open. Rows without key or day say nothing.
    """
    told = snapshots.where(F.col(on).isNotNull() & F.col(day).isNotNull())
    # a row per day of the calendar at most
    days = told.select(day).distinct().withColumn("_next", F.lead(day).over(Window.orderBy(day)))
    w = Window.partitionBy(on).orderBy(day)
    payload = F.struct(*checked)
    same = F.lag("_next").over(w).eqNullSafe(F.col(day)) & F.lag("_payload").over(w).eqNullSafe(F.col("_payload"))
    runs = told.join(F.broadcast(days), day).withColumn("_payload", payload).withColumn("_new", (~same).cast("int")).withColumn("_run", F.sum("_new").over(w))
    per = runs.groupBy(on, "_run").agg(F.min(day).alias("valid_from"), F.max(F.struct(day, "_next", "_payload")).alias("_m"))
    return per.select(on, *[F.col(f"_m._payload.{c}").alias(c) for c in checked], "valid_from", F.col("_m._next").alias("valid_to"))


# --- table tests: each gives the rows that fail, none if the table is sound ---


def not_unique(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def null_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def not_accepted(df: DataFrame, column: str, accepted: list[str]) -> DataFrame:
    """Values outside the list with their number; null passes."""
    return df.where(~F.col(column).isin(accepted)).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def without_parent(df: DataFrame, column: str, parents: DataFrame, parent_column: str) -> DataFrame:
    """References that lead nowhere with their number; null passes. References are counted before the join."""
    refs = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return refs.join(parents.select(F.col(parent_column).alias("value")), "value", "left_anti")
