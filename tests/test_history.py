import random
from datetime import date, timedelta

from partloom.operators.history import observations, versions

from .conftest import rows


def test_versions_against_a_plain_pass(spark):
    rnd = random.Random(1)
    raw = []
    for p in ("a", "b ", "C", None):
        for i in range(40):
            day = date(2024, 1, 1) + timedelta(days=rnd.randrange(60))
            raw.append((p, "x", day, rnd.choice(["on", " ON", "off", None, ""]), i))
    df = spark.createDataFrame(raw, "part string, plant string, day date, value string, t int")
    want = {}
    for p, _, day, v, t in raw:
        if p and v and v.strip():
            s = want.setdefault(p.strip().upper(), {})
            if day not in s or t > s[day][0]:
                s[day] = (t, v.strip().upper())
    expected = []
    for p, s in want.items():
        last = None
        for day in sorted(s):
            if s[day][1] != last:
                expected.append((p, day, s[day][1]))
            last = s[day][1]
    got = versions(observations(df, "f", "part", "plant", "day", "value", "t", True)).cache()
    assert rows(got, "part_id", "valid_from", "value") == sorted(expected, key=repr)
    one = got.where("part_id = 'A'").orderBy("valid_from").collect()
    assert all(a["valid_to"] + timedelta(days=1) == b["valid_from"] for a, b in zip(one, one[1:])) and one[-1]["valid_to"] is None
    assert got.agg({"n_rows": "sum"}).first()[0] == sum(len(s) for s in want.values())


def test_empty_nulls_and_long_series(spark):
    df = spark.createDataFrame([("A", None, date(2024, 1, 1), 1.0, 1), ("A", None, None, 2.0, 1), ("A", None, date(2024, 1, 2), None, 1)], "part string, plant string, day date, value double, t int")
    assert rows(versions(observations(df, "f", "part", "plant", "day", "value", "t", False)), "plant_code", "value") == [(None, "1.0")]
    assert versions(observations(df.limit(0), "f", "part", "plant", "day", "value", "t", False)).count() == 0
    long = spark.range(3000).selectExpr("'A' part", "'P' plant", "date_add(date '2010-01-01', cast(id as int)) day", "cast(id div 7 as double) value", "1 t")
    assert versions(observations(long, "f", "part", "plant", "day", "value", "t", False)).count() == 429
