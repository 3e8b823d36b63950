"""Made-up supply-chain data of any size: 22 datasets from a size and a seed, the same for the same seed.

Every value is a hash of seed, row number and a tag, so rows are made where they are needed, in any order and number
of partitions. Structures go from higher to strictly lower tiers and so have no cycles; every reference leads somewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TODAY = "2026-07-01"
#: fixed values: sources with shares, categories with tier, units by category kind
SOURCES = (("SAP_ECC", 0.40), ("ORACLE_EBS", 0.25), ("LEGACY_MFG", 0.15), ("PLM_TEAMCENTER", 0.12), ("SUPPLIER_PORTAL", 0.08))
CATEGORIES = (("FASTENERS", 0), ("ELECTRONIC_COMPONENTS", 0), ("RAW_MATERIALS", 0), ("SEALS_GASKETS", 0), ("BEARINGS", 0), ("CABLES_HARNESSES", 1), ("PCB_ASSEMBLIES", 1), ("MACHINED_PARTS", 1), ("MOTORS_ACTUATORS", 2), ("SUBASSEMBLIES", 2), ("FINISHED_GOODS", 3))
CURRENCIES = ("USD", "EUR", "GBP", "INR", "CNY")
UOMS = ("EA", "PC", "KG", "G", "M", "MM", "L", "ML", "SET", "PR", "BOX", "ROL")
KINDS = ("BOLT", "RESISTOR", "BAR", "GASKET", "BEARING", "HARNESS", "BOARD", "HOUSING", "MOTOR", "FRAME", "UNIT")


@dataclass(frozen=True)
class Profile:
    parts: int = 900
    suppliers: int = 60
    plants: int = 3
    seed: int = 20260716


class Generator:
    """The datasets of a profile, each a DataFrame of plain columns."""

    def __init__(self, spark: SparkSession, profile: Profile = Profile()):
        self.spark, self.p = spark, profile

    # values -------------------------------------------------------------------------------------------
    def u(self, tag: str, *ids: str | Column) -> Column:
        """Evenly spread in [0, 1), by the row's ids."""
        cols = [F.col(i) if isinstance(i, str) else i for i in (ids or ("i",))]
        return F.pmod(F.xxhash64(F.lit(self.p.seed), F.lit(tag), *cols), F.lit(1 << 40)) / float(1 << 40)

    def one(self, values: tuple, tag: str, *ids) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(self.u(tag, *ids) * len(values)) + 1).cast("int"))

    def num(self, tag: str, lo: int, hi: int, *ids) -> Column:
        return (F.floor(self.u(tag, *ids) * (hi - lo + 1)) + lo).cast("int")

    def day(self, tag: str, back_hi: int, back_lo: int = 0, *ids) -> Column:
        return F.date_sub(F.lit(TODAY).cast("date"), self.num(tag, back_lo, back_hi, *ids))

    def rows(self, n: int) -> DataFrame:
        return self.spark.range(1, n + 1).withColumnRenamed("id", "i")

    @staticmethod
    def key(prefix: str, width: int, c: str | Column = "i") -> Column:
        return F.concat(F.lit(prefix), F.lpad((F.col(c) if isinstance(c, str) else c).cast("string"), width, "0"))

    def _source(self, tag: str, *ids) -> Column:
        x, total = self.u(tag, *ids), 0.0
        e = F.when(F.lit(False), "")
        for name, share in SOURCES:
            total += share
            e = e.when(x < total, name)
        return e.otherwise(SOURCES[-1][0])

    # masters ------------------------------------------------------------------------------------------
    def units_of_measure(self) -> DataFrame:
        return self.spark.createDataFrame([(x, x.title()) for x in UOMS], "uom_code string, description string")

    def product_categories(self) -> DataFrame:
        return self.spark.createDataFrame([(c, c.replace("_", " ").title(), t) for c, t in CATEGORIES], "category_code string, category_name string, bom_tier int")

    def plants(self) -> DataFrame:
        return self.rows(self.p.plants).select(self.key("PL", 2).alias("plant_code"), F.concat(F.lit("Plant "), "i").alias("plant_name"), self.one(("US", "DE", "IN", "CN"), "country").alias("country"), self.one(("AMER", "EMEA", "APAC"), "region").alias("region"), self.one(CURRENCIES, "currency").alias("currency"))

    def warehouses(self) -> DataFrame:
        return self.rows(self.p.plants * 2).select(self.key("WH", 3).alias("warehouse_code"), F.concat(F.lit("Store "), "i").alias("warehouse_name"), self.key("PL", 2, (F.col("i") - 1) % self.p.plants + 1).alias("plant_code"))

    def suppliers(self) -> DataFrame:
        names = F.concat_ws(" ", self.one(("Apex", "Nordic", "Summit", "Delta", "Orion", "Vertex"), "n1"), self.one(("Metal", "Precision", "Dynamics", "Components"), "n2"), F.concat(F.lit("No"), F.col("i").cast("string")), self.one(("Inc", "GmbH", "Ltd"), "n3"))
        return self.rows(self.p.suppliers).select(self.key("SUP", 5).alias("supplier_id"), names.alias("supplier_name"), self.one(("US", "DE", "IN", "CN"), "sc").alias("country"), self.one(CURRENCIES, "cur").alias("currency"), self.one(("NET30", "NET60"), "pay").alias("payment_terms"), self._source("src_s").alias("source_system"), F.lit("ACTIVE").alias("status"), self.day("cre_s", 3000, 100).alias("created_date"))

    def part_master(self) -> DataFrame:
        k = (F.floor(F.pow(self.u("cat"), F.lit(1.3)) * len(CATEGORIES)) + 1).cast("int")
        pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("k"))
        d = self.rows(self.p.parts).withColumn("k", k)
        d = d.withColumns({"category": pick([c for c, _ in CATEGORIES]), "bom_tier": pick([t for _, t in CATEGORIES]), "created_date": self.day("cre", 3000, 400)})
        status = F.when(self.u("st") < 0.90, "ACTIVE").when(self.u("st") < 0.94, "IN_DEVELOPMENT").when(self.u("st") < 0.98, "OBSOLETE").otherwise("BLOCKED")
        return d.select(
            self.key("PRT", 9).alias("part_id"), F.concat(F.substring("category", 1, 3), F.lit("-"), self.key("", 7)).alias("source_part_number"), self._source("src").alias("source_system"),
            F.concat_ws(" ", self.one(("STEEL", "BRASS", "NYLON", "COPPER"), "mat"), pick(KINDS), F.concat(F.lit("M"), self.num("d", 3, 60).cast("string"), F.lit("X"), self.num("l", 5, 900).cast("string"))).alias("description"), "category",
            F.when(F.col("category") == "RAW_MATERIALS", self.one(("KG", "M", "L"), "uom")).otherwise(self.one(("EA", "EA", "SET", "PC"), "uom")).alias("uom"), status.alias("lifecycle_status"), F.when(F.col("bom_tier") >= 2, "MAKE").otherwise("BUY").alias("procurement_type"),
            F.when(self.u("mpn0") >= 0.25, F.concat(F.lit("MK-"), self.key("", 8))).alias("manufacturer_part_number"), F.round(F.exp(self.u("cost") * 6 - 1) * F.pow(F.lit(4.0), F.col("bom_tier")), 4).alias("standard_cost"), F.lit("USD").alias("currency"),
            self.num("lead", 3, 120).alias("lead_time_days"), self.key("PL", 2, self.num("plant", 1, self.p.plants)).alias("primary_plant"), "bom_tier", "created_date", F.date_add("created_date", F.least(self.num("upd", 1, 2600), F.datediff(F.lit(TODAY).cast("date"), "created_date"))).alias("last_updated"),
        )

    def _parts(self, where: str, *cols: str) -> DataFrame:
        return self.part_master().where(where).select("part_id", *cols).withColumn("i", F.substring("part_id", 4, 9).cast("long"))

    def part_aliases(self) -> DataFrame:
        d = self._parts("true", "source_part_number").where(self.u("alias") < 0.15)
        return d.select(self.key("ALI", 9).alias("alias_id"), "part_id", F.concat("source_part_number", F.lit("-X")).alias("alias_part_number"), self._source("alias_src").alias("alias_source_system"), F.lit("CROSS_REFERENCE").alias("alias_type"))

    def supplier_parts(self) -> DataFrame:
        d = self._parts("procurement_type = 'BUY'", "standard_cost").withColumn("n", F.explode(F.sequence(F.lit(1), self.num("nsup", 1, 3))))
        s = F.pmod(F.floor(F.pow(self.u("sup"), F.lit(2.0)) * self.p.suppliers) + (F.col("n") - 1) * 7, F.lit(self.p.suppliers)) + 1
        return d.select(F.concat(self.key("SPR", 9), F.lit("-"), F.col("n").cast("string")).alias("supplier_part_id"), self.key("SUP", 5, s.cast("int")).alias("supplier_id"), "part_id", F.concat(F.lit("V"), self.key("", 7), F.col("n").cast("string")).alias("supplier_part_number"), F.round(F.col("standard_cost") * (0.9 + self.u("price", "i", "n") * 0.4), 4).alias("unit_price"), F.lit("USD").alias("currency"), self.num("slead", 5, 120, "i", "n").alias("lead_time_days"), self.one((1, 10, 100), "moq", "i", "n").alias("min_order_qty"), (F.col("n") == 1).alias("is_primary"))

    # structures ---------------------------------------------------------------------------------------
    def bom_headers(self) -> DataFrame:
        d = self._parts("procurement_type = 'MAKE'", "primary_plant")
        return d.select(self.key("BOM", 9).alias("bom_header_id"), F.col("part_id").alias("parent_part_id"), F.col("primary_plant").alias("plant_code"), F.lit("PRODUCTION").alias("bom_usage"), F.lit("ACTIVE").alias("status"), self.day("cre_b", 2000, 300).alias("created_date"))

    def bom_components(self) -> DataFrame:
        """Each child is the first active part of a lower tier from a place on that a hash names."""
        heads = self._parts("procurement_type = 'MAKE'", "bom_tier").withColumn("n", F.explode(F.sequence(F.lit(1), self.num("ncomp", 4, 12))))
        heads = heads.withColumn("tier", F.floor(self.u("tier", "i", "n") * F.col("bom_tier")).cast("int"))
        pool = self._parts("lifecycle_status = 'ACTIVE'", "bom_tier").select(F.col("part_id").alias("child_part_id"), F.col("bom_tier").alias("tier"), F.pmod(F.xxhash64(F.lit("pool"), "i"), F.lit(max(1, self.p.parts // 60))).alias("slot"), "i")
        pool = pool.groupBy("tier", "slot").agg(F.min(F.struct("i", "child_part_id")).alias("m")).select("tier", "slot", "m.child_part_id")
        d = heads.withColumn("slot", F.pmod(F.xxhash64(F.lit(self.p.seed), F.lit("slot"), "i", "n"), F.lit(max(1, self.p.parts // 60)))).join(pool, ["tier", "slot"])
        first = d.groupBy("i", "part_id", "child_part_id").agg(F.min("n").alias("n"))
        return first.select(F.concat(self.key("BMC", 9), F.lit("-"), F.col("n").cast("string")).alias("bom_component_id"), self.key("BOM", 9).alias("bom_header_id"), F.col("part_id").alias("parent_part_id"), "child_part_id", self.num("qty", 1, 12, "i", "n").cast("double").alias("quantity_per"), F.lit("EA").alias("uom"), F.lit("B").alias("revision_label"), self.day("eff", 900, 100, "i").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), (F.col("n") * 10).alias("position"))

    def engineering_revisions(self) -> DataFrame:
        d = self._parts("procurement_type = 'MAKE'").withColumn("start", self.day("eff", 900, 100, "i"))
        r = F.array(F.struct(F.lit("A").alias("l"), F.date_sub("start", 400).alias("f"), F.col("start").alias("t"), F.lit(False).alias("c")), F.struct(F.lit("B").alias("l"), F.col("start").alias("f"), F.lit(None).cast("date").alias("t"), F.lit(True).alias("c")))
        return d.select("i", "part_id", F.inline(r)).select(F.concat(self.key("REV", 9), F.lit("-"), F.col("l")).alias("revision_id"), self.key("BOM", 9).alias("bom_header_id"), "part_id", F.col("l").alias("revision_label"), F.col("f").alias("effective_from"), F.col("t").alias("effective_to"), F.col("c").alias("is_current"))

    def engineering_change_orders(self) -> DataFrame:
        d = self.engineering_revisions().where("is_current").withColumn("i", F.substring("part_id", 4, 9).cast("long")).where(self.u("eco") < 0.4)
        return d.select(self.key("ECO", 9).alias("eco_id"), "part_id", "revision_id", self.one(("DESIGN", "COST", "QUALITY"), "ecot").alias("change_type"), F.lit("RELEASED").alias("status"), self.day("cre_e", 700).alias("created_date"))

    def _other(self, tag: str, share: float) -> DataFrame:
        o = F.pmod(F.col("i") + self.num(tag, 1, max(1, self.p.parts // 2)) - 1, F.lit(self.p.parts)) + 1
        return self._parts("true").where(self.u(tag + "s") < share).withColumn("other", self.key("PRT", 9, o)).where("other <> part_id")

    def part_substitutions(self) -> DataFrame:
        return self._other("sub", 0.05).select(self.key("SUB", 9).alias("substitution_id"), "part_id", F.col("other").alias("substitute_part_id"), F.lit("FORM_FIT_FUNCTION").alias("substitution_type"), self.day("subd", 900).alias("valid_from"))

    def part_supersessions(self) -> DataFrame:
        return self._other("sup", 0.03).select(self.key("SSN", 9).alias("supersession_id"), F.col("part_id").alias("old_part_id"), F.col("other").alias("new_part_id"), self.day("supd", 900).alias("effective_date"))

    # operations ---------------------------------------------------------------------------------------
    def inventory_snapshots(self) -> DataFrame:
        d = self._parts("true", "standard_cost").withColumn("w", F.explode(F.sequence(F.lit(1), self.num("nwh", 1, 3)))).withColumn("s", F.explode(F.array(F.lit(0), F.lit(30))))
        q = F.round(F.exp(self.u("oh", "i", "w", "s") * 6), 2)
        return d.select(F.concat_ws("-", self.key("INV", 9), "w", "s").alias("inventory_id"), "part_id", self.key("WH", 3, F.pmod(F.col("i") + F.col("w"), F.lit(self.p.plants * 2)) + 1).alias("warehouse_code"), F.date_sub(F.lit(TODAY).cast("date"), F.col("s")).alias("snapshot_date"), q.alias("on_hand_qty"), F.round(q * F.col("standard_cost"), 2).alias("on_hand_value"), F.round(q * 0.2, 2).alias("safety_stock_qty"))

    def purchase_orders(self) -> DataFrame:
        d = self.rows(self.p.suppliers).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(6))))
        return d.select(F.concat(self.key("PO", 7), F.lit("-"), F.col("n").cast("string")).alias("po_id"), self.key("SUP", 5).alias("supplier_id"), self.key("PL", 2, self.num("poplant", 1, self.p.plants, "i", "n")).alias("plant_code"), self.day("podate", 360, 0, "i", "n").alias("order_date"), F.lit("USD").alias("currency"), self.one(("OPEN", "RECEIVED", "RECEIVED", "CANCELLED"), "post", "i", "n").alias("status"))

    def purchase_order_lines(self) -> DataFrame:
        s = self.supplier_parts().withColumn("n", F.pmod(F.xxhash64(F.lit("pol"), "supplier_part_id"), F.lit(6)) + 1)
        q = F.round(1 + self.u("poq", "supplier_part_id") * 500)
        return s.select(F.concat(F.lit("POL"), "supplier_part_id").alias("po_line_id"), F.concat(self.key("PO", 7, F.substring("supplier_id", 4, 5).cast("int")), F.lit("-"), F.col("n").cast("string")).alias("po_id"), F.lit(1).alias("line_number"), "part_id", q.alias("order_qty"), "unit_price", F.round(q * F.col("unit_price"), 2).alias("line_value"), F.date_add(F.lit(TODAY).cast("date"), F.col("lead_time_days")).alias("promised_date"))

    def future_demand(self) -> DataFrame:
        d = self._parts("lifecycle_status = 'ACTIVE'", "bom_tier", "primary_plant").where((F.col("bom_tier") >= 2) | (self.u("dem") < 0.3)).withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(3))))
        return d.select(F.concat_ws("-", self.key("DEM", 9), "m").alias("demand_id"), "part_id", F.col("primary_plant").alias("plant_code"), F.add_months(F.lit(TODAY).cast("date"), F.col("m")).alias("demand_date"), F.round(1 + self.u("dq", "i", "m") * 300).alias("demand_qty"), F.lit("FORECAST").alias("demand_type"))

    def production_orders(self) -> DataFrame:
        d = self._parts("procurement_type = 'MAKE'", "primary_plant").where(self.u("prod") < 0.25)
        return d.select(self.key("PRD", 9).alias("production_order_id"), "part_id", F.col("primary_plant").alias("plant_code"), self.num("prq", 1, 200).cast("double").alias("order_qty"), self.day("prs", 60).alias("start_date"), F.date_add(F.lit(TODAY).cast("date"), self.num("prd", 5, 90)).alias("due_date"), F.lit("RELEASED").alias("status"))

    def standard_cost_history(self) -> DataFrame:
        d = self._parts("true", "standard_cost", "primary_plant").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3))))
        walk = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(1.0), lambda a, k: a * (0.9 + self.u("walk", F.col("i"), k) * 0.2))
        return d.select(F.concat_ws("-", self.key("CST", 9), "n").alias("cost_history_id"), "part_id", F.col("primary_plant").alias("plant_code"), F.round(F.col("standard_cost") * walk, 4).alias("standard_cost"), F.lit("USD").alias("currency"), F.date_sub(F.lit(TODAY).cast("date"), (F.lit(4) - F.col("n")) * 180).alias("effective_from"))

    def lead_time_history(self) -> DataFrame:
        d = self.supplier_parts().where(self.u("lth", "supplier_part_id") < 0.8).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(2))))
        return d.select(F.concat_ws("-", F.lit("LTH"), "supplier_part_id", "n").alias("lead_time_history_id"), "part_id", "supplier_id", F.greatest(F.lit(1), F.round(F.col("lead_time_days") * (0.8 + self.u("ltv", "supplier_part_id", "n") * 0.4))).cast("int").alias("lead_time_days"), F.date_sub(F.lit(TODAY).cast("date"), (F.lit(3) - F.col("n")) * 200).alias("effective_from"))

    def supplier_quotes(self) -> DataFrame:
        d = self.supplier_parts().where(self.u("quo", "supplier_part_id") < 0.3)
        return d.select(F.concat(F.lit("QUO"), "supplier_part_id").alias("quote_id"), "supplier_id", "part_id", F.round(F.col("unit_price") * (0.9 + self.u("qp", "supplier_part_id") * 0.2), 4).alias("quoted_price"), F.lit("USD").alias("currency"), (F.col("lead_time_days") + self.num("ql", -5, 5, "supplier_part_id")).alias("quoted_lead_time_days"), "min_order_qty", self.day("qf", 200, 100, "supplier_part_id").alias("valid_from"), F.date_add(F.lit(TODAY).cast("date"), self.num("qt", 0, 200, "supplier_part_id")).alias("valid_to"))

    NAMES = ("units_of_measure", "product_categories", "plants", "warehouses", "suppliers", "part_master", "part_aliases", "supplier_parts", "bom_headers", "bom_components", "engineering_revisions", "engineering_change_orders", "part_substitutions", "part_supersessions", "inventory_snapshots", "purchase_orders", "purchase_order_lines", "future_demand", "production_orders", "standard_cost_history", "lead_time_history", "supplier_quotes")

    def all(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n)() for n in self.NAMES}


#: fixed values: every reference as (table, column, parent table, parent column)
REFERENCES = [
    ("warehouses", "plant_code", "plants", "plant_code"), ("part_master", "category", "product_categories", "category_code"), ("part_master", "uom", "units_of_measure", "uom_code"), ("part_master", "primary_plant", "plants", "plant_code"),
    ("part_aliases", "part_id", "part_master", "part_id"), ("supplier_parts", "supplier_id", "suppliers", "supplier_id"), ("supplier_parts", "part_id", "part_master", "part_id"), ("bom_headers", "parent_part_id", "part_master", "part_id"), ("bom_headers", "plant_code", "plants", "plant_code"),
    ("bom_components", "bom_header_id", "bom_headers", "bom_header_id"), ("bom_components", "parent_part_id", "part_master", "part_id"), ("bom_components", "child_part_id", "part_master", "part_id"), ("engineering_revisions", "bom_header_id", "bom_headers", "bom_header_id"), ("engineering_revisions", "part_id", "part_master", "part_id"),
    ("engineering_change_orders", "part_id", "part_master", "part_id"), ("engineering_change_orders", "revision_id", "engineering_revisions", "revision_id"), ("part_substitutions", "part_id", "part_master", "part_id"), ("part_substitutions", "substitute_part_id", "part_master", "part_id"), ("part_supersessions", "old_part_id", "part_master", "part_id"), ("part_supersessions", "new_part_id", "part_master", "part_id"),
    ("inventory_snapshots", "part_id", "part_master", "part_id"), ("inventory_snapshots", "warehouse_code", "warehouses", "warehouse_code"), ("purchase_orders", "supplier_id", "suppliers", "supplier_id"), ("purchase_order_lines", "po_id", "purchase_orders", "po_id"), ("purchase_order_lines", "part_id", "part_master", "part_id"), ("future_demand", "part_id", "part_master", "part_id"),
    ("production_orders", "part_id", "part_master", "part_id"), ("standard_cost_history", "part_id", "part_master", "part_id"), ("lead_time_history", "part_id", "part_master", "part_id"), ("supplier_quotes", "part_id", "part_master", "part_id"),
]


def broken_references(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, value, n) of references that lead nowhere; none for generated data."""
    from partloom.operators.staging import without_parent

    out = None
    for t, c, pt, pc in REFERENCES:
        bad = without_parent(tables[t], c, tables[pt], pc).select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), "value", "n")
        out = bad if out is None else out.unionByName(bad)
    return out


def write_csv(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Each dataset as CSV with a header below the folder; gives the manifest (dataset, n_files, n_bytes, hash of all file hashes)."""
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{folder}/{name}", header=True)
    spark = next(iter(tables.values())).sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder)
    each = files.select(F.element_at(F.split("path", "/"), -2).alias("dataset"), F.sha2("content", 256).alias("h"), "length")
    return each.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"), F.sha2(F.concat_ws("", F.sort_array(F.collect_list("h"))), 256).alias("content_hash"))
