"""Queries on ingestion, generated data, detection of defects, and streams."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.operators import detection, rules
from partloom.plans.core_sql import with_tables
from partloom.session import Cuts
from partloom.sources.binding import Tables, calls_of
from partloom.sources.generate import Generator, Profile, broken_references
from partloom.sources.ingest import row_hash, split_rejects
from partloom.sources.inject import inject
from partloom.streaming import ingest as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql is not None:
        ORACLES[name] = with_tables(sql)


_HASHED = ["supplier_part_id", "supplier_id", "part_id", "currency", "lead_time_days", "min_order_qty"]
add("ingest_rowhash", lambda s, d: Tables(s, d).raw("supplier_parts").select("supplier_part_id", row_hash(_HASHED).alias("row_hash")), "select supplier_part_id, left(sha256(" + " || '|' || ".join(f"coalesce(cast({c} as varchar), '')" for c in _HASHED) + "), 16) row_hash from supplier_parts")
add("ingest_rejects", lambda s, d: split_rejects(Tables(s, d).raw("supplier_parts").select("part_id", "supplier_id", "supplier_part_id"), "part_id")[1].select("reason", "record_json"), "select 'null part_id' reason, '{' || case when part_id is not null then '\"part_id\":\"' || replace(part_id, chr(9), '\\t') || '\",' else '' end || coalesce('\"supplier_id\":\"' || supplier_id || '\",', '') || '\"supplier_part_id\":\"' || supplier_part_id || '\"}' record_json from supplier_parts where part_id is null or trim(part_id) = ''")


def _profile(spark: SparkSession, d: str, **more: int) -> Profile:
    """Made-up data of as many parts as the input's part_master has rows, and of the default profile at least; suppliers in proportion."""
    least = Profile(**more)
    parts = max(least.parts, Tables(spark, d).raw("part_master").count())
    return Profile(parts=parts, suppliers=parts * least.suppliers // least.parts, **more)


def _made(spark: SparkSession, d: str, rate: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(violations of the clean data, those of the same data with defects, the labels)."""
    cuts = Cuts(spark, "detection")
    keep = lambda tables: {k: cuts.write(v)[0] for k, v in tables.items()}
    clean = keep(Generator(spark, _profile(spark, d, seed=11)).all())
    dirty, labels = inject(clean, rate, 11)
    labels, dirty = cuts.write(labels)[0], keep(dirty)
    found = [cuts.write(rules.run(detection.GeneratedTables(t))[0])[0] for t in (clean, dirty)]
    return found[0], found[1], labels


def _rollup(spark: SparkSession, d: str) -> DataFrame:
    clean, dirty, labels = _made(spark, d, 0.05)
    return detection.rollup(detection.recall(dirty, labels), detection.precision(detection.new_findings(dirty, clean), labels))


def _recall(spark: SparkSession, d: str) -> DataFrame:
    _, dirty, labels = _made(spark, d, 0.05)
    return detection.recall(dirty, labels)


def _clean(spark: SparkSession, d: str) -> DataFrame:
    t = Generator(spark, _profile(spark, d, seed=11)).all()
    return detection.unexpected(rules.run(detection.GeneratedTables(t))[0])


add("detection_rollup", _rollup)
add("detection_recall", _recall)
add("detection_clean_baseline", _clean)
add("generate_broken_references", lambda s, d: broken_references(Generator(s, _profile(s, d)).all()))
add("generate_counts", lambda s, d: reduce(DataFrame.unionByName, [v.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("table_name"), "n") for k, v in Generator(s, _profile(s, d)).all().items()]))


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def _streamed(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    root = Cuts(spark, name).root
    streams.run_once(stream, root.rsplit("/", 1)[-1], "append", root)
    out = spark.read.schema(stream.schema).parquet(root)
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in out.dtypes if t == "timestamp"})


add("stream_call_windows", lambda s, d: _streamed(s, streams.call_windows(calls_of(_events(s, d))), "windows").select("window_start", "provider", "calls", "abstentions"), "select date_trunc('day', called_at) window_start, provider, count(*) calls, count(*) filter (abstained) abstentions from call_audit group by 1, 2 having date_trunc('day', called_at) + interval 1 day <= (select max(called_at) - interval 2 day from call_audit)")
add("stream_sessions", lambda s, d: _streamed(s, streams.sessions(_events(s, d)), "sessions"), """select user_id, min(ts) session_start, max(ts) + interval 30 minute session_end, count(*) events from (select *, sum(fresh) over (partition by user_id order by ts, event_id) nr from
    (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end fresh from events)) group by user_id, nr having max(ts) + interval 30 minute <= (select max(ts) - interval 1 hour from events)""")
