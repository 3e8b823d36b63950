from datetime import date, datetime

import pytest

from partloom.operators import graph, impact, lookups, resolve, workflow
from partloom.operators.hierarchy import Hierarchy

from .conftest import rows


def test_decisions_follow_each_other(spark):
    issues = spark.createDataFrame([("i1", "DETECTED"), ("i2", "CLOSED"), ("i3", "PENDING_REVIEW"), ("i4", None)], "issue_id string, status string")
    ask = [("d1", "i1", "request_evidence", 1), ("d2", "i1", " approve ", 2), ("d3", "i1", "reject", 3), ("d4", "i2", "approve", 1), ("d5", "i3", "ESCALATE", 1), ("d6", "i3", "reject", 2), ("d7", "none", "approve", 1), ("d8", "i4", "approve", 1), ("d0", "i1", "request_evidence", 3)]
    requests = spark.createDataFrame([(d, i, k, "R", date(2026, 1, n)) for d, i, k, n in ask], "decision_id string, issue_id string, decision string, reviewer string, decided_at date")
    got = {r["decision_id"]: (r["before_status"], r["after_status"], r["accepted"], r["refusal"]) for r in workflow.decide(issues, requests).collect()}
    assert got["d1"] == ("DETECTED", "PENDING_REVIEW", True, None) and got["d2"] == ("PENDING_REVIEW", "APPROVED", True, None)
    assert got["d3"] == got["d0"] == ("APPROVED", "APPROVED", False, "not possible in status APPROVED")
    assert got["d4"] == ("CLOSED", "CLOSED", False, "not possible in status CLOSED") and got["d5"][2:] == (False, "unknown decision")
    assert got["d6"] == ("PENDING_REVIEW", "REJECTED", True, None) and got["d7"][3] == got["d8"][3] == "unknown issue"
    assert rows(workflow.history(workflow.decide(issues, requests), "i1"), "decision_id") == [("d1",), ("d2",)]
    assert workflow.decide(issues, requests.limit(0)).count() == 0 and workflow.decide(issues.limit(0), requests).where("accepted").count() == 0


def test_proposals_are_validated_and_logged(spark):
    item = "array<struct<evidence_id: string, field: string, failed_value: string>>"
    bundles = spark.createDataFrame([("i1", "VALD-1", [("E1", "f", "x"), ("E2", "f", "y")]), ("i2", "UNIQ-1", []), ("i3", "VALD-2", [("E3", "f", "z")])], f"issue_id string, rule_id string, items {item}")
    own = {r["issue_id"]: r for r in workflow.audited_proposals(bundles).collect()}
    assert own["i1"]["accepted"] and own["i1"]["n_items"] == 2 and own["i2"]["abstained"] and own["i2"]["accepted"]
    made = spark.createDataFrame([("i1", "correct_field", 0.7, ["E1", "X"], False), ("i1", None, 0.7, ["E1"], False), ("i1", "a", 1.7, ["E1"], False), ("i9", "a", 0.5, [], False), ("i2", "insufficient_evidence", 0.2, ["Z"], True), ("i3", "a", 0.5, ["E3"], False), ("i3", "b", 0.5, None, False)], "issue_id string, action string, confidence double, refs array<string>, abstained boolean")
    got = sorted((r["issue_id"], r["action"] or "", r["validation"]) for r in workflow.audited_proposals(bundles, made).collect())
    assert got == [("i1", "", "schema_failed"), ("i1", "a", "schema_failed"), ("i1", "correct_field", "grounding_failed"), ("i2", "insufficient_evidence", "valid"), ("i3", "a", "valid"), ("i3", "b", "schema_failed"), ("i9", "a", "grounding_failed")]
    assert workflow.accepted_proposals(workflow.audited_proposals(bundles, made)).count() == 2


def test_sources_and_lineage_of_clusters_of_any_size(spark):
    raw = spark.createDataFrame([(" p1 ", "SAP", "N-1", datetime(2025, 1, 1)), ("P1", "SAP", "N-1", datetime(2025, 2, 1)), ("P1", "PLM", None, datetime(2025, 3, 1)), (None, "PLM", "N", None)], "part_id string, source_system string, source_part_number string, _ingested_at timestamp")
    assert rows(lookups.sources(raw), "part_key", "source_system", "n_rows") == [("P1", "PLM", 1), ("P1", "SAP", 2)]
    cols = "part_key string, part_number_normalized string, source_system string, source_part_number string, description string, category string, uom string, lifecycle_status string, manufacturer_part_number string, standard_cost double, lead_time_days int, primary_plant string, last_updated date"
    one = lambda k, n, s, d: (k, n, s, n, d, None, None, None, None, None, None, None, date(2026, 1, 1))
    df = spark.createDataFrame([one(f"P{i:03d}", "SAME", "SAP_ECC", "bolt") for i in range(120)] + [one("Q1", "", "SAP_ECC", "nut"), one("Q2", None, "PLM_TEAMCENTER", None)], cols)
    got = {(r["entity_id"], r["field_name"]): r for r in lookups.lineage(df).collect()}
    assert got["NSAME", "description"]["source_record"] == "P000" and got["NSAME", "description"]["n_members"] == 120 and got["KQ1", "description"]["selected_value"] == "nut" and ("KQ2", "description") not in got
    assert lookups.lineage(df.limit(0)).count() == 0


def test_winners_are_those_of_the_full_decision(spark):
    from partloom.operators import survivorship

    fields = [f for f in survivorship.FIELDS]
    types = {"standard_cost": "double", "lead_time_days": "int"}
    rs = [(f"E{i % 7}", f"P{i:02d}", ("SAP_ECC", "PLM_TEAMCENTER", "X", None)[i % 4], date(2026, 1, 1 + i % 9) if i % 5 else None, *[None if (i + k) % 4 == 0 else 1.0 * (i % 3) if f == "standard_cost" else i % 3 if f == "lead_time_days" else f"v{i % 3}" for k, f in enumerate(fields)]) for i in range(40)]
    df = spark.createDataFrame(rs, "entity_id string, part_id string, source_system string, last_updated date, " + ", ".join(f"{f} {types.get(f, 'string')}" for f in fields))
    cols = ("entity_id", "field_name", "selected_value", "source_record", "source_system", "reason", "confidence")
    assert rows(survivorship.winners(df), *cols) == rows(survivorship.decide(df), *cols)


def test_structure_pages_and_merge_impact(spark, tmp_path):
    links = spark.createDataFrame([("1", "A", "B", 2.0), ("2", "B", "C", 1.0), ("3", "C", "B", 1.0), ("4", "X", "B2", 1.0)], "bom_rel_key string, parent_part_key string, child_part_key string, quantity_per double")
    parts = spark.createDataFrame([("A", "top", "ACTIVE", "Z", 5.0, "PL1"), ("B", "mid", "ACTIVE", "Z", 2.0, "PL1")], "part_key string, description string, lifecycle_status string, category string, standard_cost double, primary_plant string")
    e = graph.edges_of(links)
    nodes, shown = graph.page(Hierarchy(e.select("parent", "child")), e, parts, "A")
    assert rows(nodes, "id", "description", "in_cycle") == [("A", "top", False), ("B", "mid", True), ("C", None, True)] and shown.count() == 3
    facts = {"demand": spark.createDataFrame([("A", 10.0), ("X", 5.0)], "part_key string, demand_qty double"), "inventory": spark.createDataFrame([], "part_key string, on_hand_value double"), "orders": spark.createDataFrame([], "part_key string, line_value double"), "production": spark.createDataFrame([], "part_key string")}
    report = impact.merge_impact("B2", "B", links, spark.createDataFrame([], "part_id string, supplier_id string"), parts=parts, **facts)
    got = {r["moment"]: (r["affected_parent_assemblies"], float(r["future_demand_qty_exposed"]), r["downstream_components"]) for r in report.collect()}
    assert got == {"before": (2, 10.0, 1), "after": (3, 15.0, 1)}
    at = impact.keep_scenario(report, "merge", {"survivor": "B", "duplicate": "B2"}, str(tmp_path / "scenarios"))
    kept = impact.kept_scenario(spark, str(tmp_path / "scenarios"), at).first()
    assert kept["approval_required"] and '"survivor":"B"' in kept["parameters"] and "before" in kept["result"]


def test_candidate_recall_and_difficulty(spark):
    truth = spark.createDataFrame([("a", "b", "easy"), ("c", "d", "hard")], "a string, b string, difficulty string")
    assert rows(resolve.candidate_recall(spark.createDataFrame([("a", "b"), ("x", "y")], "a string, b string"), truth)) == [(2, 1, 0.5)]
    assert rows(resolve.candidate_recall(truth, truth.limit(0))) == [(0, 0, 0.0)]
    judged = spark.createDataFrame([("a", "b", True), ("c", "d", False)], "a string, b string, hit boolean")
    assert rows(resolve.recall_by_difficulty(judged, truth)) == [("easy", 1, 1, 1.0), ("hard", 1, 0, 0.0)]


@pytest.mark.parametrize("question, refused", [("please approve PRT0001", True), ("merge now", True), ("change the unit", True), ("is it set to change?", False), ("which parts merge?", False)])
def test_refusals(spark, question, refused):
    from partloom.operators import documents

    assert documents.classify(spark.createDataFrame([(question,)], "q string"), "q").first()["refused"] is refused


def test_training_metrics_and_kept_models(spark, tmp_path):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    names = list(resolve.WEIGHTS)
    data = spark.createDataFrame([(f"a{i}", f"b{i}", ("train", "train", "train", "validation", "test")[i % 5], int(i % 3 == 0), *[0.9 - 0.01 * (i % 7) if i % 3 == 0 else 0.1 + 0.01 * (i % 5) for _ in names]) for i in range(300)], "a string, b string, part string, label int, " + ", ".join(f"{n} double" for n in names))
    runs = []
    for model in ("logistic", "boosted"):
        fitted, cut, metrics = resolve.train(data, model)
        m = metrics.first()
        assert (m["precision"], m["recall"], m["false_positive_rate"], m["false_negative_rate"]) == (1.0, 1.0, 0.0, 0.0) and 0 < cut <= 1
        resolve.save_model(fitted, cut, str(tmp_path / model))
        again, kept_cut, features = resolve.load_model(spark, str(tmp_path / model))
        assert kept_cut == cut and features == names and type(again) is type(fitted)
        one = spark.newSession().createDataFrame([([0.9] * len(names),)], "v array<double>").select(array_to_vector("v").alias("features"))
        assert again.transform(one).first()["prediction"] == 1.0
        runs.append(metrics)
    spread = resolve.dispersion(runs[0].union(runs[0]).withColumn("f1", F.lit(0.5)))
    assert rows(spread, "model", "precision_mean", "f1_std", "f1_min") == [("logistic", 1.0, 0.0, 0.5)]
    with pytest.raises(ValueError):
        resolve.train(data.withColumn("label", F.lit(0)))
