"""Ingestion of CSV folders with a full audit trail, and the layered catalogue the tables live in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.session import Cuts

LAYERS = ("raw", "staging", "core", "quality", "marts", "ground_truth", "ops")
#: fixed values: texts of a CSV that mean null
NULL_TEXTS = ("", "NULL", "None")
#: fixed values: columns added to every ingested row
AUDIT = ("_source_system_file", "_ingestion_batch_id", "_ingested_at", "_file_hash", "_schema_version", "_record_seq", "_row_hash", "_load_status")


class Catalogue:
    """Tables in the seven layers, each a database of the session; prefix keeps several catalogues apart."""

    def __init__(self, spark: SparkSession, prefix: str = ""):
        self.spark, self.prefix = spark, prefix
        for layer in LAYERS:
            spark.sql(f"create database if not exists {self._db(layer)}")

    def _db(self, layer: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"unknown layer {layer}")
        return self.prefix + layer

    def name(self, layer: str, table: str) -> str:
        return f"{self._db(layer)}.{table}"

    def load(self, layer: str, table: str, df: DataFrame, replace: bool = True) -> int:
        """Write a table anew, or add rows by the columns' names; gives the rows it then holds."""
        name = self.name(layer, table)
        if replace or not self.exists(layer, table):
            df.write.mode("overwrite").saveAsTable(name)
        else:
            # columns meet by their names, in any case; those that the rows lack are null
            have = {c.lower(): c for c in df.columns}
            df.select(*[(F.col(have[c.lower()]) if c.lower() in have else F.lit(None)).cast(t).alias(c) for c, t in self.spark.table(name).dtypes]).write.insertInto(name)
        return self.count(layer, table)

    def table(self, layer: str, table: str) -> DataFrame:
        return self.spark.table(self.name(layer, table))

    def query(self, sql: str, args: dict | list | None = None) -> DataFrame:
        return self.spark.sql(sql, args=args)

    def execute(self, sql: str, args: dict | list | None = None) -> None:
        """A statement that defines or changes tables, run at once."""
        self.spark.sql(sql, args=args).collect()

    def update(self, layer: str, table: str, where: str, **values: Column) -> int:
        """Set columns of the rows that a condition names; gives the number of these rows. The table is written anew, from a copy, as its files can't be changed."""
        now = self.table(layer, table)
        hit = F.coalesce(F.expr(where), F.lit(False))
        n = now.where(hit).count()
        changed = now.select(*[F.when(hit, values[c]).otherwise(F.col(c)).cast(t).alias(c) if c in values else F.col(c) for c, t in now.dtypes])
        self.load(layer, table, Cuts(self.spark, "update").write(changed)[0])
        return n

    def count(self, layer: str, table: str) -> int:
        return self.table(layer, table).count()

    def tables(self, layer: str) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self._db(layer)))

    def exists(self, layer: str, table: str) -> bool:
        return self.spark.catalog.tableExists(self.name(layer, table))

    def validate(self) -> dict[str, list[str]]:
        """The tables of every layer; an error if a layer is missing."""
        missing = [layer for layer in LAYERS if not self.spark.catalog.databaseExists(self._db(layer))]
        if missing:
            raise RuntimeError(f"layers are missing: {missing}")
        return {layer: self.tables(layer) for layer in LAYERS}

    def drop(self) -> None:
        for layer in LAYERS:
            self.spark.sql(f"drop database if exists {self._db(layer)} cascade")


def row_hash(columns: list[str]) -> Column:
    """16 hex digits over the values as text, null as '': equal content has equal hashes, whenever it was loaded."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256), 1, 16)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, stem, file_hash): the CSV files directly in the folder, with the SHA-256 of their bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    return files.select("path", F.regexp_extract("path", r"([^/]+)\.csv$", 1).alias("stem"), F.sha2("content", 256).alias("file_hash"))


def audited(rows: DataFrame, file: str, batch: str, file_hash: str, at: str) -> DataFrame:
    """rows (all text) with the audit columns; the sequence follows the lines of the file's splits."""
    cols = rows.columns
    return rows.select("*", F.lit(file).alias("_source_system_file"), F.lit(batch).alias("_ingestion_batch_id"), F.lit(at).cast("timestamp").alias("_ingested_at"), F.lit(file_hash).alias("_file_hash"), F.lit("1").alias("_schema_version"), F.monotonically_increasing_id().alias("_record_seq"), row_hash(cols).alias("_row_hash"), F.lit("LOADED").alias("_load_status"))


def split_rejects(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a key, rejects as (record_seq, reason, record_json)): rows whose key is null or blank are set aside, not lost."""
    bad = F.col(key).isNull() | (F.trim(key) == "")
    plain = [c for c in rows.columns if c not in AUDIT]
    rejects = rows.where(bad).select(F.col("_record_seq").alias("record_seq") if "_record_seq" in rows.columns else F.lit(None).cast("long").alias("record_seq"), F.lit(f"null {key}").alias("reason"), F.to_json(F.struct(*plain)).alias("record_json"))
    return rows.where(~bad), rejects


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows as text, rejects): a CSV with a header. NULL_TEXTS are null; lines that don't have the header's columns are rejected, and the others go on."""
    plain = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    schema = ", ".join(f"`{c}` string" for c in plain.columns) + ", `_broken` string"
    lines = spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_broken")
    lines = Cuts(spark, "csv").write(lines)[0]
    null = lambda c: F.when(~F.col(f"`{c}`").isin(*NULL_TEXTS), F.col(f"`{c}`")).alias(c)
    rejects = lines.where("_broken is not null").select(F.lit(None).cast("long").alias("record_seq"), F.lit("wrong number of columns").alias("reason"), F.to_json(F.struct(F.col("_broken").alias("line"))).alias("record_json"))
    return lines.where("_broken is null").select(*[null(c) for c in plain.columns]), rejects


def keep_evaluation(result: DataFrame, folder: str, name: str) -> None:
    """An evaluation's rows as one JSON file per run below the folder."""
    result.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}")


def ingest_folder(cat: Catalogue, folder: str, batch: str, at: str) -> dict[str, dict[str, int | str]]:
    """Load every CSV of a folder into raw, once per content: {stem: {status, rows_loaded, rows_rejected}}.

    A file whose content was loaded before is skipped. The loop runs over files, of which only name and hash reach the driver.
    """
    spark, out = cat.spark, {}
    found = manifest(spark, folder)
    if cat.exists("ops", "load_files"):
        found = found.withColumn("done", F.lit(False)).join(cat.table("ops", "load_files").where("status = 'LOADED'").select("file_hash", F.lit(True).alias("known")).distinct(), "file_hash", "left")
    else:
        found = found.withColumn("known", F.lit(None).cast("boolean"))
    files, log = found.orderBy("stem").select("path", "stem", "file_hash", "known").collect(), []
    for f in files:
        if f["known"]:
            out[f["stem"]] = {"status": "SKIPPED", "rows_loaded": 0, "rows_rejected": 0}
            continue
        raw, broken = read_csv(spark, f["path"])
        good, bad = split_rejects(audited(raw, f["stem"] + ".csv", batch, f["file_hash"], at), raw.columns[0])
        bad = bad.unionByName(broken)
        had = cat.count("raw", f["stem"]) if cat.exists("raw", f["stem"]) else 0
        loaded = cat.load("raw", f["stem"], good, replace=False) - had
        rejected = bad.select(F.lit(batch).alias("batch_id"), F.lit(f["stem"]).alias("dataset"), "*")
        n_bad = rejected.count()
        if n_bad:
            cat.load("ops", "rejected_records", rejected, replace=False)
        out[f["stem"]] = {"status": "LOADED", "rows_loaded": loaded, "rows_rejected": n_bad}
        log.append((f["file_hash"], batch, f["stem"] + ".csv", loaded, n_bad, "LOADED"))
    if log:
        cat.load("ops", "load_files", spark.createDataFrame(log, "file_hash string, batch_id string, file_name string, rows_loaded long, rows_rejected long, status string"), replace=False)
    done = (batch, at, len(files), len(log), sum(r[3] for r in log), sum(r[4] for r in log))
    cat.load("ops", "load_batches", spark.createDataFrame([done], "batch_id string, started_at string, files_seen long, files_loaded long, rows_loaded long, rows_rejected long"), replace=False)
    return out


def export_csv(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as one folder of CSV with a header."""
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{folder}/{name}", header=True)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
