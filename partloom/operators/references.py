"""References to records that do not exist: missing, deleted or late parents.

Method: references and parents are partitioned alike by key, sorted and merged in one linear pass; a parent
comes with its validity interval (first row, and whether its latest row withdraws it). Keys that hold a
large part of the references bypass the shuffle (operators.skew).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.functions.keys import key, stripped
from partloom.operators.skew import join_unique
from partloom.session import Cuts


def validity(parents: DataFrame, parent_key: str, seen_at: str, status: str) -> DataFrame:
    """(ref_key, first_seen, last_status): one row per parent key.

    Rows without a key are ignored. Of rows with the same latest time the one with the greatest status
    counts; a null time is the oldest.
    """
    return (
        parents.select(key(parent_key).alias("ref_key"), F.col(seen_at).alias("t"), key(status).alias("s"))
        .where("ref_key is not null")
        .groupBy("ref_key")
        .agg(F.min("t").alias("first_seen"), F.max(F.struct("t", "s")).alias("last"))
        .select("ref_key", "first_seen", F.col("last.s").alias("last_status"))
    )


def references(rows: DataFrame, table_name: str, record_key: str, fields: list[str], seen_at: str) -> DataFrame:
    """(table_name, record_key, field_name, ref_key, seen): one row per record, field and distinct key referred to.

    seen is the record's earliest time over all its rows. Null and blank references are no references. A row
    without a record key is a record of its own.
    """
    rid = stripped(record_key)
    own = F.when(rid.isNull(), F.xxhash64(*[F.col(f) for f in fields], F.col(seen_at))).otherwise(F.lit(0))
    slim = rows.select(rid.alias("record_key"), own.alias("own"), F.col(seen_at).alias("t"), *[key(f).alias(f"k{i}") for i, f in enumerate(fields)])
    per_record = slim.groupBy("record_key", "own").agg(F.min("t").alias("seen"), *[F.collect_set(f"k{i}").alias(f"k{i}") for i in range(len(fields))])
    named = lambda i, f: F.transform(f"k{i}", lambda k: F.struct(F.lit(f).alias("field_name"), k.alias("ref_key")))
    pairs = F.flatten(F.array(*[named(i, f) for i, f in enumerate(fields)]))
    return per_record.select(F.lit(table_name).alias("table_name"), "record_key", "seen", F.inline(pairs)).select("table_name", "record_key", "field_name", "ref_key", "seen")


def dangling(refs: list[DataFrame], parents: DataFrame) -> DataFrame:
    """(table_name, record_key, field_name, ref_key, ref_month, kind) of every reference without a valid parent.

    kind: missing (no row of the parent), deleted (its latest row withdraws it), late (its first row came
    after the record). ref_month is the yyyy-MM of the record's earliest time, null if it has none; such a
    record is never late. Empty references give no rows; with empty parents every reference is missing.
    """
    all_refs, n, _ = Cuts(parents.sparkSession, "references").write(reduce(DataFrame.unionByName, refs))
    judged = join_unique(all_refs, parents.withColumn("known", F.lit(True)), "ref_key", n=n)
    kind = F.when(F.col("known").isNull(), "missing").when(F.col("last_status") == "DELETED", "deleted").when(F.col("first_seen") > F.col("seen"), "late")
    return judged.withColumn("kind", kind).where("kind is not null").select("table_name", "record_key", "field_name", "ref_key", F.date_format("seen", "yyyy-MM").alias("ref_month"), "kind")


def report(found: DataFrame) -> DataFrame:
    """Counts of dangling references per table, field, month and kind, with the number of distinct keys."""
    return found.groupBy("table_name", "field_name", "ref_month", "kind").agg(F.count(F.lit(1)).alias("n_refs"), F.countDistinct("ref_key").alias("n_keys"))
