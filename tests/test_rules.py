from datetime import date

import pytest

from partloom.operators import detection, rules, staging
from partloom.operators.detection import GeneratedTables
from partloom.plans import quality
from partloom.sources.generate import Generator, Profile, broken_references
from partloom.sources.inject import inject
from partloom.session import Cuts

from .conftest import rows


@pytest.fixture(scope="module")
def made(spark):
    cuts = Cuts(spark, "test")
    clean = {k: cuts.write(v)[0] for k, v in Generator(spark, Profile(parts=250, suppliers=25, plants=2, seed=11)).all().items()}
    dirty, labels = inject(clean, 0.05, 11)
    labels, dirty = cuts.write(labels)[0], {k: cuts.write(v)[0] for k, v in dirty.items()}
    found = [rules.run(GeneratedTables(t)) for t in (clean, dirty)]
    assert found[0][1] == found[1][1] == []
    return clean, cuts.write(found[0][0])[0], cuts.write(found[1][0])[0], labels


def test_there_are_49_rules():
    assert len(rules.RULES) == len(rules.BY_ID) == 49 and len(rules.enabled_rules()) == 49


def test_generated_data_is_sound_and_repeatable(spark, made):
    again = Generator(spark, Profile(parts=250, suppliers=25, plants=2, seed=11))
    assert broken_references(made[0]).count() == 0
    assert rows(again.bom_components()) == rows(made[0]["bom_components"])


def test_clean_data_breaks_only_what_it_may(made):
    assert detection.unexpected(made[1]).count() == 0


def test_labelled_defects_are_found(made):
    """Few are hidden by a later defect of the same record."""
    missed = detection.recall(made[2], made[3]).where("recall < 0.9 and issue_type <> 'supplier_doc_vs_erp_discrepancy'")
    assert rows(missed) == []
    r = detection.rollup(detection.recall(made[2], made[3]), detection.precision(detection.new_findings(made[2], made[1]), made[3])).first()
    assert r["recall"] > 0.95 and r["precision"] > 0.7


def test_a_failing_rule_fails_alone(made):
    broken = rules.Rule("X-1", "broken", "low", "validity", "part", "f", "no_such_table", "k", "true")
    found, failed = rules.run(GeneratedTables(made[0]), [broken, rules.BY_ID["COMP-008"]])
    assert [r for r, _ in failed] == ["X-1"] and found.count() > 0


def test_a_rule_that_fails_while_it_runs_fails_alone(made):
    broken = rules.Rule("X-2", "broken", "low", "validity", "part", "description", "dim_part", "part_key", "cast(part_key as int) > 0", "description")
    found, failed = rules.run_stored(GeneratedTables(made[0]), [broken, rules.BY_ID["COMP-008"], rules.BY_ID["REFI-002"]])
    assert [r for r, _ in failed] == ["X-2"] and rows(found.select("rule_id").distinct()) == [("COMP-008",)]
    assert dict(rows(rules.executions(found, failed, "run", [broken, rules.BY_ID["COMP-008"]]), "rule_id", "status")) == {"X-2": "FAILED", "COMP-008": "OK"}


def test_executions_list_rules_without_violations(made):
    ex = rules.executions(made[1], [], "run")
    assert ex.count() == 49 and ex.where("violations = 0").count() > 30


def test_overlaps_touching_and_open(spark):
    df = spark.createDataFrame([("h", "a", date(2024, 1, 1), date(2024, 2, 1)), ("h", "b", date(2024, 2, 1), None), ("h", "c", date(2024, 1, 15), None), ("g", "d", date(2024, 1, 1), None)], "h string, i string, f date, t date")
    assert rows(rules.overlapping(df, "h", "i", "f", "t")) == [("a", "c")]


def test_repeated_ignores_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5)], "k string, i int")
    assert rows(rules.repeated(df, ["k"]), "i") == [(1,), (2,)]


def test_casts(spark):
    df = spark.createDataFrame([("14.0",), ("2.5",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(staging.whole("v")).collect()] == [14, 2, None, None]


def test_snapshot_changes(spark):
    old = spark.createDataFrame([("a", "x", date(2024, 1, 1)), ("b", None, date(2024, 1, 1)), ("c", "y", date(2024, 1, 1))], "k string, v string, valid_from date")
    new = spark.createDataFrame([("a", "z"), ("b", None), ("d", "n")], "k string, v string")
    got = rows(staging.snapshot_changes(old, new, "k", ["v"], "2024-02-01"), "k", "v", "valid_to")
    assert got == sorted([("a", "x", date(2024, 2, 1)), ("a", "z", None), ("b", None, None), ("c", "y", date(2024, 2, 1)), ("d", "n", None)], key=repr)
    assert staging.calendar(spark).count() == 5114


def test_issues_are_those_of_all_rules(spark, made):
    class Stored(GeneratedTables):
        def stored(self, *names):
            return self

    t = Stored(made[0])
    t.spark = spark
    got, want = quality.issues_of(t), made[1]
    count = lambda df: {r[0]: r[1] for r in df.groupBy("rule_id").count().collect()}
    assert count(got) == count(want) and set(count(got)) - {"COMP-001", "COMP-002", "COMP-003", "COMP-004", "COMP-006"}


def test_snapshot_versions_of_all_days(spark, tmp_path):
    days = [date(2024, 1, 1), date(2024, 2, 1), date(2024, 3, 1), date(2024, 5, 1)]
    seen = {"a": "xxyy", "b": "x..x", "c": ".nnz", "d": "xxxx", "e": "x...", "f": "nxnn"}
    data = [(k.upper() + " ", days[i], None if v == "n" else v, 3, None, date(2024, 6, 1)) for k, vs in seen.items() for i, v in enumerate(vs) if v != "."]
    df = spark.createDataFrame([*data, ("A", days[0], "old", 3, None, date(2024, 5, 1)), (None, days[0], "x", 3, None, date(2024, 5, 1))], "part_id string, snapshot_date date, lifecycle_status string, lead_time_days int, primary_plant string, _ingested_at date")
    df = df.selectExpr("*", "cast(null as string) description", "'EA' uom", "1.5 standard_cost")
    df.write.parquet(f"{tmp_path}/part_master_snapshot.parquet")
    got = quality.QUERIES["snapshot_scd2"](spark, str(tmp_path))
    assert got.columns == ["part_id", "description", "uom", "lifecycle_status", "standard_cost", "lead_time_days", "primary_plant", "valid_from", "valid_to"]
    folded = spark.createDataFrame([], "k string, v string, valid_from date")
    closed = []
    for i, day in enumerate(days):
        new = spark.createDataFrame([(k.upper(), None if vs[i] == "n" else vs[i]) for k, vs in seen.items() if vs[i] != "."], "k string, v string")
        step = staging.snapshot_changes(folded, new, "k", ["v"], str(day)).collect()
        closed += [r for r in step if r["valid_to"]]
        folded = spark.createDataFrame([(r["k"], r["v"], r["valid_from"]) for r in step if not r["valid_to"]], "k string, v string, valid_from date")
    want = [(r["k"], r["v"], r["valid_from"], r["valid_to"]) for r in closed] + [(*r, None) for r in folded.collect()]
    assert rows(got, "part_id", "lifecycle_status", "valid_from", "valid_to") == sorted(want, key=repr)
