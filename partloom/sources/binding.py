"""The core tables over the given test tables.

Parts, links, supplier parts and costs have tables of their own; suppliers, plants, stock, demand, orders and call
audits are read from the trade tables, with keys in the parts' form.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.operators import staging
from partloom.session import Cuts, kept
from partloom.sources.tables import table

#: fixed values: governed units of measure, currencies and statuses
UOMS = ["EA", "PC", "KG", "G", "M", "MM", "L", "ML", "SET", "PR", "BOX", "ROL"]
CURRENCIES = ["USD", "EUR", "GBP", "JPY", "CNY", "INR"]
STATUSES = ["ACTIVE", "OBSOLETE", "BLOCKED", "IN_DEVELOPMENT"]


def _part(c: str):
    return F.concat(F.lit("PRT"), F.lpad(F.col(c).cast("string"), 9, "0"))


def _supplier(c: str):
    return F.concat(F.lit("SUP"), F.lpad(F.col(c).cast("string"), 5, "0"))


class Tables:
    """Core tables of one folder, each built when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.done, self.own = spark, folder, set[str](), dict[str, DataFrame]()

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def stored(self, *names: str) -> Tables:
        """These tables with the named ones written once to the shared folder, for work that reads them many times; those of a folder of files serve the whole session."""
        cuts = Cuts(self.spark, "core")
        for name in names:
            if name not in self.done:
                self.__dict__[name] = kept(self.spark, self.folder, name, lambda: getattr(self, name)) if self.folder else cuts.write(getattr(self, name))[0]
                self.done.add(name)
        return self

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that rests on these, built once for the session; tables that come from no folder of files keep it to themselves."""
        if self.folder:
            return kept(self.spark, self.folder, name, build)
        if name not in self.own:
            self.own[name] = Cuts(self.spark, "kept").write(build())[0]
        return self.own[name]

    @cached_property
    def dim_part(self) -> DataFrame:
        return staging.parts(self.raw("part_master"))

    @cached_property
    def fact_bom(self) -> DataFrame:
        return staging.bom_links(self.raw("fact_bom_relationship"))

    @cached_property
    def supplier_part(self) -> DataFrame:
        return staging.supplier_parts(self.raw("supplier_parts"))

    @cached_property
    def fact_cost(self) -> DataFrame:
        return staging.cost_history(self.raw("standard_cost_history"))

    @cached_property
    def revision(self) -> DataFrame:
        return staging.revisions(self.fact_bom)

    @cached_property
    def dim_supplier(self) -> DataFrame:
        money = F.element_at(F.array(*[F.lit(c) for c in ("USD", "EUR", "JPY", "INR", "CNY")]), F.col("n_regionkey") + 1)
        joined = self.raw("supplier").join(F.broadcast(self.raw("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
        norm = F.concat(F.lit("SUPPLIER"), (F.col("s_suppkey") % 97).cast("string"))
        return joined.select(_supplier("s_suppkey").alias("supplier_key"), F.col("s_name").alias("supplier_name"), norm.alias("supplier_name_normalized"), F.col("n_name").alias("country"), money.alias("currency"))

    @cached_property
    def dim_plant(self) -> DataFrame:
        n = self.raw("nation")
        return n.select(F.concat(F.lit("PL"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0")).alias("plant_key"), F.col("n_name").alias("plant_name"), F.col("n_regionkey").alias("region"))

    @cached_property
    def fact_inventory(self) -> DataFrame:
        li = self.raw("lineitem").select("l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMM").alias("month"), F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).cast("decimal(18,2)").alias("q"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))
        g = li.groupBy("l_partkey", "l_suppkey", "month").agg(F.sum("q").cast("decimal(18,2)").alias("on_hand_qty"), F.sum("v").cast("decimal(18,2)").alias("on_hand_value"))
        return g.select(F.concat_ws("-", "l_partkey", "l_suppkey", "month").alias("inventory_key"), _part("l_partkey").alias("part_key"), "on_hand_qty", "on_hand_value")

    @cached_property
    def fact_demand(self) -> DataFrame:
        g = self.raw("lineitem").where("l_shipdate >= timestamp '2001-01-01 00:00:00'").groupBy("l_orderkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(18,2)").alias("demand_qty"))
        return g.select(F.concat_ws("-", "l_orderkey", "l_partkey").alias("demand_key"), _part("l_partkey").alias("part_key"), "demand_qty")

    @cached_property
    def fact_order(self) -> DataFrame:
        heads = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "O", "OPEN").when(F.col("o_orderstatus") == "F", "RECEIVED").otherwise("CANCELLED").alias("status"), F.col("o_orderdate").cast("date").alias("order_date"))
        lines = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("line_value"), F.col("l_quantity").cast("decimal(18,2)").alias("order_qty"))
        return staging.order_lines(lines, heads, "l_orderkey").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("po_line_key"), _part("l_partkey").alias("part_key"), _supplier("l_suppkey").alias("supplier_key"), "status", "order_date", "order_qty", "line_value")

    @cached_property
    def fact_lead(self) -> DataFrame:
        heads = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("effective_from"))
        g = self.raw("lineitem").join(heads, "l_orderkey").groupBy("l_orderkey", "l_partkey", "l_suppkey", "effective_from").agg(F.max(F.datediff(F.col("l_shipdate").cast("date"), "effective_from")).alias("lead_time_days"))
        return g.select(F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey").alias("lead_time_key"), _part("l_partkey").alias("part_key"), _supplier("l_suppkey").alias("supplier_key"), "lead_time_days", "effective_from")

    @cached_property
    def quote(self) -> DataFrame:
        i = F.expr("cast(substring(supplier_part_id, 4) as bigint)")
        sp = self.supplier_part.where("supplier_part_id is not null").withColumn("i", i)
        price = (F.col("unit_price") * ((F.col("i") % 97 + 52).cast("decimal(6,0)") * F.lit("0.01").cast("decimal(3,2)"))).cast("decimal(18,4)")
        return sp.select(F.concat(F.lit("QT"), "supplier_part_id").alias("quote_id"), "supplier_id", "part_id", price.alias("quoted_price"), (F.col("lead_time_days") + (F.col("i") % 41).cast("int") - 20).alias("quoted_lead_time_days"), F.date_sub(F.lit(staging.AS_OF).cast("date"), (F.col("i") % 400).cast("int")).alias("valid_to"))

    # tables joined once for the rules that ask the same of them

    @cached_property
    def link_ends(self) -> DataFrame:
        """Every link with the status of its parent and of its child; parent_known and child_known are null where the master has no such part."""
        end = lambda c: self.dim_part.select(F.col("part_key").alias(f"{c}_part_key"), F.lit(True).alias(f"{c}_known"), F.col("lifecycle_status").alias(f"{c}_status"))
        return self.fact_bom.select("bom_rel_key", "parent_part_key", "child_part_key").join(end("child"), "child_part_key", "left").join(end("parent"), "parent_part_key", "left")

    @cached_property
    def part_uses(self) -> DataFrame:
        """Every part with supplied, built and demanded: true where a supplier, a structure or a demand has it, else null."""
        flag = lambda df, c, name: df.select(F.col(c).alias("part_key")).where("part_key is not null").distinct().withColumn(name, F.lit(True))
        out = self.dim_part.select("part_key", "procurement_type", "bom_tier", "lifecycle_status")
        for more in (flag(self.supplier_part, "part_id", "supplied"), flag(self.fact_bom, "parent_part_key", "built"), flag(self.fact_demand, "part_key", "demanded")):
            out = out.join(more, "part_key", "left")
        return out

    @cached_property
    def supplied_by(self) -> DataFrame:
        """Every supplier part with its supplier's currency; known is null where there is no such supplier."""
        s = self.dim_supplier.select(F.col("supplier_key").alias("supplier_id"), F.col("currency").alias("own_currency"), F.lit(True).alias("known"))
        return self.supplier_part.select("supplier_part_id", "supplier_id", "currency").join(s, "supplier_id", "left")

    @cached_property
    def quoted(self) -> DataFrame:
        """Every quote with each supplier part of its supplier and part."""
        erp = self.supplier_part.select("supplier_id", "part_id", "unit_price", F.col("lead_time_days").alias("erp_lead"))
        return self.quote.join(erp, ["supplier_id", "part_id"])

    @cached_property
    def call_audit(self) -> DataFrame:
        return calls_of(self.raw("events"))

    @cached_property
    def uom(self) -> DataFrame:
        return self.spark.createDataFrame([(u,) for u in UOMS], "uom_code string")


def calls_of(events: DataFrame) -> DataFrame:
    """Events as an audit of model calls, in batch or stream."""
    e = events.withColumn("k", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)))
    return e.select(F.col("event_id").cast("string").alias("call_id"), F.col("event_type").alias("provider"), F.when(F.col("k") % 2 == 0, "small").otherwise("large").alias("model"), F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("prompt_version"), F.col("value").cast("decimal(18,4)").alias("latency_ms"), (F.col("k") % 100).alias("confidence"), (F.col("k") % 7 == 0).alias("abstained"), F.when(F.col("k") % 11 == 0, "rejected").otherwise("valid").alias("validation_result"), F.col("ts").alias("called_at"))


Build = Callable[[Tables], DataFrame]
