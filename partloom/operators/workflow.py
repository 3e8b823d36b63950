"""The workflow of issues: guarded decisions with their log and history, and proposals with their validation and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.operators import documents

#: fixed values: statuses that may still be decided, and the status each decision leads to
DECIDABLE = ("DETECTED", "ENRICHED", "PRIORITIZED", "RECOMMENDATION_GENERATED", "PENDING_REVIEW")
LEADS_TO = {"APPROVE": "APPROVED", "REJECT": "REJECTED", "REQUEST_EVIDENCE": "PENDING_REVIEW"}


def decide(issues: DataFrame, requests: DataFrame) -> DataFrame:
    """(decision_id, issue_id, decision, reviewer, decided_at, before_status, after_status, accepted, refusal): one row per requested decision.

    issues: (issue_id, status); requests: (decision_id, issue_id, decision, reviewer, decided_at). Decisions of an issue follow each other
    by time, then id; a request for evidence keeps an issue decidable, the first approval or rejection ends it. What comes later, or
    meets a closed, unknown or undecidable issue, or is no known decision, is refused with its reason and changes nothing. As only the first ending
    counts, it is found by an aggregate: an issue with any number of requests is never gathered.
    """
    kind = F.upper(F.trim("decision"))
    asked = requests.withColumn("kind", kind).withColumn("at", F.struct("decided_at", "decision_id"))
    state = issues.groupBy("issue_id").agg(F.min("status").alias("status"))
    judged = asked.join(state, "issue_id", "left").withColumn("open", F.coalesce(F.col("status").isin(*DECIDABLE), F.lit(False)))
    ends = judged.where(F.col("open") & F.col("kind").isin("APPROVE", "REJECT")).groupBy("issue_id").agg(F.min("at").alias("end"), F.min_by("kind", "at").alias("end_kind"))
    first_ask = judged.where(F.col("open") & (F.col("kind") == "REQUEST_EVIDENCE")).groupBy("issue_id").agg(F.min("at").alias("ask"))
    both = judged.join(ends, "issue_id", "left").join(first_ask, "issue_id", "left")
    to = F.create_map(*[x for k, v in LEADS_TO.items() for x in (F.lit(k), F.lit(v))])
    over = F.col("end").isNotNull() & (F.col("at") > F.col("end"))
    before = F.when(over, F.try_element_at(to, F.col("end_kind"))).when(F.col("ask").isNotNull() & (F.col("ask") < F.col("at")), "PENDING_REVIEW").otherwise(F.col("status"))
    after = F.try_element_at(to, F.col("kind"))
    refusal = F.when(F.col("status").isNull(), "unknown issue").when(after.isNull(), "unknown decision").when(~F.col("open") | over, F.concat(F.lit("not possible in status "), before))
    return both.select("decision_id", "issue_id", F.col("kind").alias("decision"), "reviewer", "decided_at", before.alias("before_status"), F.when(refusal.isNull(), after).otherwise(before).alias("after_status"), refusal.isNull().alias("accepted"), refusal.alias("refusal"))


def history(log: DataFrame, issue_id: str) -> DataFrame:
    """The accepted decisions of one issue in their order."""
    return log.where((F.col("issue_id") == issue_id) & F.col("accepted")).orderBy("decided_at", "decision_id")


def audited_proposals(bundles: DataFrame, made: DataFrame | None = None, provider: str = "rules", model: str = "deterministic", prompt_version: str = "1") -> DataFrame:
    """(call_id, issue_id, provider, model, prompt_version, n_items, action, confidence, abstained, validation, accepted): one audit row per proposal.

    made: proposals (issue_id, action, confidence, refs, abstained), of the rules where none are given. A proposal is valid if its fields have the
    form they must have (an action, a confidence from 0 to 1) and refer to evidence of its bundle only; abstentions need none. Others are rejected, and
    logged all the same. A proposal for an issue without a bundle refers to nothing there is.
    """
    offered = documents.proposals(bundles) if made is None else made
    held = bundles.select("issue_id", F.size("items").alias("n_items"), F.transform("items", lambda i: i["evidence_id"]).alias("held"))
    foreign = F.array_except("refs", F.coalesce("held", F.expr("cast(array() as array<string>)")))
    formed = F.col("action").isNotNull() & F.col("confidence").between(0.0, 1.0) & F.col("refs").isNotNull()
    grounded = (F.size(foreign) == 0) & F.col("held").isNotNull()
    validation = F.when(~F.coalesce(formed, F.lit(False)), "schema_failed").when(~F.coalesce(F.col("abstained"), F.lit(False)) & ~F.coalesce(grounded, F.lit(False)), "grounding_failed").otherwise("valid")
    call = F.concat(F.lit("AIC-"), F.left(F.md5(F.concat_ws("|", F.lit(provider), F.lit(model), F.lit(prompt_version), "issue_id", "action")), F.lit(12)))
    return offered.join(held, "issue_id", "left").select(call.alias("call_id"), "issue_id", F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.lit(prompt_version).alias("prompt_version"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "action", "confidence", "abstained", validation.alias("validation"), (validation == "valid").alias("accepted"))


def accepted_proposals(audit: DataFrame) -> DataFrame:
    """Of the audited proposals those that are valid."""
    return audit.where("accepted").drop("validation", "accepted")
