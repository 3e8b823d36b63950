from partloom.operators import profile
from partloom.operators.profile import Column, departures, form_coverage, induce_forms, latest_rows, load_profile, mix_shift, value_counts

from .conftest import rows

COLUMNS = [Column("description", "text", r"value rlike '\\A[A-Z0-9]+(?:[ ./-][A-Z0-9]+)*\\z'"), Column("category", "code", "value in ('A', 'B')"), Column("lead", "number", "try_cast(value as int) between 1 and 365")]


def loads(spark, bad=()):
    """Five loads of ten parts; in load 5 the columns named are spoilt."""
    out = []
    for n in range(1, 6):
        for p in range(10):
            spoilt = n == 5
            d = None if spoilt and "nulls" in bad and p < 3 else f"x_{p}" if spoilt and "pattern" in bad and p < 3 else "SAME" if spoilt and "distinct" in bad else f"BOLT M{p}"
            c = "B" if spoilt and "mix" in bad else "A" if p < 8 else "B"
            out.append(("f", n, f"P{p}", d, c, 200 if spoilt and "shift" in bad else 10 + p, n))
    return spark.createDataFrame(out, "feed string, load int, part string, description string, category string, lead int, t int")


def found(spark, df):
    names = [c.name for c in COLUMNS]
    counts = value_counts(latest_rows(df, "feed", "load", "part", "t", names), names)
    return rows(departures(load_profile(counts, COLUMNS), mix_shift(counts, "category", ["A", "B"])))


def test_findings(spark):
    assert found(spark, loads(spark)) == []
    assert found(spark, loads(spark, ("nulls",))) == [("f", 5, "description", "nulls")]
    assert found(spark, loads(spark, ("pattern",))) == [("f", 5, "description", "pattern")]
    assert ("f", 5, "description", "distinct") in found(spark, loads(spark, ("distinct",)))
    assert found(spark, loads(spark, ("mix",))) == [("f", 5, "category", "shift")]
    assert ("f", 5, "lead", "shift") in found(spark, loads(spark, ("shift",)))


def test_sent_twice_blank_and_empty(spark):
    df = spark.createDataFrame([("f", 1, " p1", "OLD", "A", 5, 1), ("f", 1, "P1", "NEW", "A", 5, 2), ("f", 1, None, " ", None, None, 1)], loads(spark).schema)
    latest = latest_rows(df, "feed", "load", "part", "t", ["description", "lead"])
    assert rows(latest, "description", "lead") == [(" ", None), ("NEW", "5")]
    p = load_profile(value_counts(latest, ["description", "lead"]), COLUMNS)
    assert rows(p, "column_name", "n", "nulls") == [("description", 2, 0.5), ("lead", 2, 0.5)]
    assert found(spark, df.limit(0)) == []


def test_induced_forms(spark):
    df = spark.createDataFrame([("f", n, f"P{i}", f"AB-{i:05d}" if i < 58 else "?!", "A", 1, n) for n in (1, 2) for i in range(60)], loads(spark).schema)
    counts = value_counts(latest_rows(df, "feed", "load", "part", "t", ["description"]), ["description"])
    forms = induce_forms(counts)
    assert rows(forms, "level", "shape", "n_values") == [("fixed", "UU-DDDDD", 58)]
    assert rows(form_coverage(counts, forms), "load_no", "n_conforming", "n_nonconforming", "change") == [(1, 58, 2, None), (2, 58, 2, 0.0)]
    assert induce_forms(counts.limit(0)).count() == 0


def test_weighted_median_against_plain_sorting(spark):
    import random
    from statistics import median

    rnd = random.Random(2)
    data = [(rnd.randrange(4), rnd.choice((rnd.uniform(-50, 50), rnd.randrange(-3, 9) * 1.0, 10 ** rnd.uniform(-3, 9))), rnd.randrange(1, 5)) for _ in range(300)] + [(9, 2.5, 2), (8, 1.0, 1), (8, 4.0, 1)]
    got = dict(rows(profile.weighted_median(spark.createDataFrame(data, "g int, x double, w long"), ["g"], "x", "w", "m")))
    for g in {d[0] for d in data}:
        assert abs(got[g] - median([x for k, x, w in data if k == g for _ in range(w)])) < 1e-9


def test_induced_expressions_can_be_run(spark):
    """Each expression is true for just the values of its shape."""
    values = ["AB-12", "CD-34", "EF-567", "x.y", "A (B)", "a+b", "Z9", "ZZ"] + [f"Q{chr(65 + i)}-{i:02d}" for i in range(26)]
    counts = spark.createDataFrame([("f", 1, "c", v, 1) for v in values], "feed string, load_no long, column_name string, value string, n long")
    shaped = profile._shaped(counts.select("column_name", "value"), ["column_name"]).withColumn("expression", profile._expression()).cache()
    pairs = shaped.select("level", "value", "shape").alias("v").join(shaped.select("level", "shape", "expression").distinct().alias("e"), "level").selectExpr("level", "value", "v.shape = e.shape own", "value rlike expression hit", "expression")
    bad = pairs.where("level <> 'any' and own <> hit").collect()
    assert bad == []
    assert profile.induce_forms(counts).where("expression is null").count() == 0


def test_agreed_forms_tell_right_from_wrong(spark):
    """Run on values, the expressions are true for just those of the declared form, and they are more than a list of them."""
    values = {
        "description": [f"BOLT M{i}-{i * 7}" for i in range(40)] + [f"bolt m{i}-{i}" for i in range(40)] + ["BOLT_M1", "NUT ", "RARE.(X)", "Q/R.7", "A+B"],
        "category": ["A", "B", "C", "a", "AA"],
        "lead": [str(i) for i in (*range(-3, 40), *range(300, 420), 999)],
        "free": ["x", "", "Y1"],
    }
    counts = spark.createDataFrame([("f", 1, c, v, 1) for c in values for v in values[c]] + [("f", 1, "lead", None, 4)], "feed string, load_no long, column_name string, value string, n long")
    columns = [*COLUMNS, Column("free", "text")]
    forms = profile.agreed_forms(counts, columns).cache()
    judged = profile.conforming(counts, forms).withColumn("right", profile._right(columns)).cache()
    assert judged.count() == counts.count() and judged.where("fits <> right").count() == 0
    hits = counts.join(forms.select("column_name", "expression"), "column_name").where("value rlike expression").select("column_name", "value").distinct()
    assert rows(hits) == rows(judged.where("right").select("column_name", "value"))
    assert rows(forms.where("column_name = 'lead' and fixed is not null"), "expression") == [("\\A[0-9][0-9]\\z",)]
    assert forms.where("column_name = 'description' and level <> 'constant'").count() > 0
    assert profile.agreed_forms(counts.limit(0), columns).count() == 0


def test_p5_found_counts_by_the_induced_expressions(spark, tmp_path, monkeypatch):
    """Values are of right form by the expressions only: without the one that NUT-12 fits, load 5 departs."""
    from partloom.plans import problems

    parts = [("f", n, f"P{d}", f"NUT-{d}" if n == 5 and d % 2 else f"BOLT M{d}", "A", d, n) for n in range(1, 6) for d in range(10, 70)]
    spark.createDataFrame(parts, "_source_system_file string, load_no int, part_key string, description string, category string, lead_time_days int, _ingested_at int").write.parquet(str(tmp_path / "dim_part.parquet"))
    spark.createDataFrame([("A",), ("B",)], "category_code string").write.parquet(str(tmp_path / "product_category.parquet"))
    assert rows(problems.p5_found(spark, str(tmp_path))) == []
    whole = profile.agreed_forms
    monkeypatch.setattr(profile, "agreed_forms", lambda counts, columns: whole(counts, columns).where("not 'NUT-12' rlike expression"))
    assert rows(problems.p5_found(spark, str(tmp_path))) == [("f", 5, "description", "pattern")]
