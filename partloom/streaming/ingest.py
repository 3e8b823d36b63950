"""Streams: files as they arrive, audit windows, sessions, and the latest state of issues.

An extension: the same operators as in batch, on unbounded tables. Checkpoints lie in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from partloom.session import shared_folder
from partloom.sources.ingest import row_hash


def file_stream(spark: SparkSession, folder: str, schema: str, per_batch: int = 100) -> DataFrame:
    """CSV files of a folder as they appear, with row hash and file name; every path once."""
    rows = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", per_batch).csv(folder)
    columns = [f.strip().split()[0] for f in schema.split(",")]
    return rows.select("*", F.input_file_name().alias("_source_system_file"), row_hash(columns).alias("_row_hash"), F.current_timestamp().alias("_ingested_at"))


def once_per_content(rows: DataFrame, seen_at: str = "_ingested_at", late: str = "7 days") -> DataFrame:
    """Rows whose content didn't come before within the watermark, also from other files."""
    return rows.withWatermark(seen_at, late).dropDuplicatesWithinWatermark(["_row_hash"])


def call_windows(calls: DataFrame, at: str = "called_at", size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Calls per provider and window: count, mean latency, abstentions; rows later than the watermark are left out."""
    w = calls.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), "provider")
    return w.agg(F.count(F.lit(1)).alias("calls"), F.avg("latency_ms").alias("avg_latency_ms"), F.count(F.when(F.col("abstained"), 1)).alias("abstentions")).select(F.col("w.start").alias("window_start"), "provider", "calls", "avg_latency_ms", "abstentions")


def sessions(events: DataFrame, user: str = "user_id", at: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users: events less than gap apart."""
    return events.withWatermark(at, late).groupBy(user, F.session_window(at, gap).alias("s")).agg(F.count(F.lit(1)).alias("events")).select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


def latest_status(decisions: DataFrame) -> DataFrame:
    """The latest status of each issue, updated as decisions come."""
    return decisions.groupBy("issue_id").agg(F.max_by("after_status", F.struct("decided_at", "decision_id")).alias("status"))


def run_once(stream: DataFrame, name: str, mode: str = "append", target: str | None = None) -> StreamingQuery:
    """Process what is there and stop: into a parquet folder, or into a table in memory of that name for tests."""
    w = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{shared_folder(stream.sparkSession)}/streams/{name}")
    q = w.format("parquet").option("path", target).start() if target else w.format("memory").queryName(name).start()
    q.awaitTermination()
    return q
