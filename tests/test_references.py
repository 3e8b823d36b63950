from datetime import datetime as dt

from partloom.operators.references import dangling, references, report, validity
from partloom.operators.skew import join_unique

from .conftest import rows


def test_kinds_ties_and_nulls(spark):
    parents = spark.createDataFrame(
        [("p1 ", dt(2025, 1, 1), "LOADED"), ("P2", dt(2025, 1, 1), "LOADED"), ("P2", dt(2025, 2, 1), "deleted"), ("P3", dt(2025, 6, 1), "LOADED"), ("P4", dt(2025, 1, 1), "DELETED"), ("P4", dt(2025, 3, 1), "LOADED"), (None, None, None)],
        "part_id string, at timestamp, st string",
    )
    refs = spark.createDataFrame(
        [("r1", "P1", "P2", dt(2025, 3, 5)), ("r1", "P1", "P2", dt(2025, 4, 5)), ("r2", "p3", None, dt(2025, 3, 5)), ("r3", "", "GONE", None), ("r4", "P4", "P4", dt(2025, 3, 5)), (None, "GONE", "P1", dt(2025, 3, 5))],
        "id string, a string, known string, at timestamp",
    )
    found = dangling([references(refs, "t", "id", ["a", "known"], "at")], validity(parents, "part_id", "at", "st"))
    assert rows(found, "record_key", "field_name", "ref_month", "kind") == sorted([("r1", "known", "2025-03", "deleted"), ("r2", "a", "2025-03", "late"), ("r3", "known", None, "missing"), (None, "a", "2025-03", "missing")], key=repr)
    assert report(found).count() == 4
    none = parents.limit(0)
    assert dangling([references(refs, "t", "id", ["a"], "at")], validity(none, "part_id", "at", "st")).where("kind <> 'missing'").count() == 0
    assert dangling([references(refs.limit(0), "t", "id", ["a"], "at")], validity(parents, "part_id", "at", "st")).count() == 0


def test_hot_keys_bypass_the_shuffle(spark):
    left = spark.range(5000).selectExpr("case when id % 3 = 0 then 'HOT' when id % 7 = 0 then null else cast(id as string) end as k", "id")
    right = spark.createDataFrame([("HOT", 1), ("5", 2)], "k string, v int")
    plain = left.join(right, "k", "left")
    assert rows(join_unique(left, right, "k", least=10)) == rows(plain)
    assert rows(join_unique(left, right, "k", "inner", least=10)) == rows(left.join(right, "k"))
