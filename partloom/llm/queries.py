"""The queries pN_ of the problems solved in this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.llm import components, entity_match, golden, leakage, packing, spans
from partloom.sources.tables import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The values of greatest posterior with the stated order (declared reliability, date, id) as prior; p1_fused has the posterior alone."""
    return golden.by_prior(table(spark, d, "golden_record_member"), table(spark, d, "source_trust")).select("entity_id", "field_name", "part_id")


def p1_fused(spark: SparkSession, d: str) -> DataFrame:
    """The values of greatest posterior, whatever their sources' declared reliability says alone."""
    return golden.survivors(table(spark, d, "golden_record_member"), table(spark, d, "source_trust"), "posterior")


def p1_golden_records(spark: SparkSession, d: str) -> DataFrame:
    """One row per entity: the list of its members and its decisions, written as JSON."""
    g = golden.golden_records(table(spark, d, "golden_record_member"), table(spark, d, "source_trust"))
    return g.select("entity_id", F.to_json("fields").alias("fields"), F.array_join("member_record_ids", ",").alias("member_record_ids"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return entity_match.matches(table(spark, d, "part_master")).where("same_item").select("part_id_a", "part_id_b")


def p3_matches(spark: SparkSession, d: str) -> DataFrame:
    """All matches with their confidence: pairs of one item, and the nearest of those that have none. p3_found needs the former only, so its near pairs stay between representatives."""
    return entity_match.matches(table(spark, d, "part_master"), every=True)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return components.linking_pairs(table(spark, d, "match_candidate"), "part_id_a", "part_id_b", "band", "scored_at")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return components.components(_pairs(spark, d))


def p6_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = components.components(_pairs(spark, d)).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_parts"))
    return sizes.groupBy("n_parts").agg(F.count(F.lit(1)).alias("n_groups"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document's pieces with their containers of 2,048 tokens."""
    return packing.pack(packing.token_counts(table(spark, d, "documents"), VOCABULARY))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """How full every container is."""
    return packing.containers(p8_packed(spark, d))


def _met(spark: SparkSession, d: str) -> DataFrame:
    return leakage.meetings(table(spark, d, "eval_item"), table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_met(spark, d))


def p9_meetings(spark: SparkSession, d: str) -> DataFrame:
    """Every passage and document that share a template window, with how much is verbatim and how much changed."""
    return _met(spark, d).drop("places")


def p9_reworked(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage with other numbers or names."""
    return leakage.reworked(_met(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.sharing_records(table(spark, d, "documents"))


def p10_spans(spark: SparkSession, d: str) -> DataFrame:
    """For every document how much of it stands in others, and where."""
    s = spans.spans(table(spark, d, "documents"))
    return s.select("doc_id", "n_chars", "n_shared", "share", F.size("spans").alias("n_spans"), F.to_json("spans").alias("spans"))


QUERIES = {f.__name__: f for f in (p1_found, p1_fused, p1_golden_records, p3_found, p3_matches, p6_found, p6_sizes, p8_packed, p8_containers, p9_found, p9_meetings, p9_reworked, p10_found, p10_spans)}
