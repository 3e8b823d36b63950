from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from partloom.functions.keys import key, source_key
from partloom.sources.ingest import Catalogue, ingest_folder
from partloom.streaming import ingest as streams

from .conftest import rows


def test_keys(spark):
    df = spark.createDataFrame([(" a\t",), (" B ",), ("",), (" ",), (None,)], "k string")
    assert [r[0] for r in df.select(key("k")).collect()] == ["A", "B", None, None, None]
    src = spark.createDataFrame([("sap-ecc",), ("SAP ECC ",), ("Sap_Ecc",), (" - ",)], "s string")
    assert [r[0] for r in src.select(source_key("s")).collect()] == ["SAPECC"] * 3 + [None]


def test_ingest_once_per_content(spark, tmp_path):
    cat = Catalogue(spark, "t1_")
    try:
        (tmp_path / "suppliers.csv").write_text('id,name\nS1,"A, b"\n,no key\nS2,\n')
        (tmp_path / "sub").mkdir()
        (tmp_path / "sub" / "hidden.csv").write_text("id\n1\n")
        first = ingest_folder(cat, str(tmp_path), "b1", "2026-07-01")
        assert first == {"suppliers": {"status": "LOADED", "rows_loaded": 2, "rows_rejected": 1}}
        assert ingest_folder(cat, str(tmp_path), "b2", "2026-07-01")["suppliers"]["status"] == "SKIPPED"
        raw = cat.table("raw", "suppliers")
        assert rows(raw, "id", "name", "_ingestion_batch_id") == sorted([("S1", "A, b", "b1"), ("S2", None, "b1")], key=repr)
        assert rows(cat.table("ops", "rejected_records"), "reason", "record_json") == [("null id", '{"name":"no key"}')]
        assert cat.count("ops", "load_batches") == 2 and cat.validate()["raw"] == ["suppliers"]
        with pytest.raises(ValueError):
            cat.load("nowhere", "x", raw)
        assert cat.load("core", "x", raw.select("id")) == 2 and cat.load("core", "x", raw.select("id"), replace=False) == 4
        assert cat.query("select count(*) from t1_core.x where id = :i", {"i": "S1"}).first()[0] == 2
    finally:
        cat.drop()


def test_null_texts_broken_lines_and_changes(spark, tmp_path):
    cat = Catalogue(spark, "t2_")
    try:
        (tmp_path / "parts.csv").write_text('id,name,unit\nP1,None,EA\nP2,NULL,KG\nP3,too,many,columns\nP4,"a ""b""",\n')
        assert ingest_folder(cat, str(tmp_path), "b1", "2026-07-01")["parts"] == {"status": "LOADED", "rows_loaded": 3, "rows_rejected": 1}
        assert rows(cat.table("raw", "parts"), "id", "name", "unit") == [("P1", None, "EA"), ("P2", None, "KG"), ("P4", 'a "b"', None)]
        assert cat.update("raw", "parts", "unit = 'EA'", unit=F.lit("PC")) == 1 and cat.table("raw", "parts").where("unit = 'PC'").count() == 1
        assert cat.load("core", "p", cat.table("raw", "parts").select("id", "unit")) == 3
        assert cat.load("core", "p", spark.createDataFrame([("KG", "P9")], "UNIT string, ID string"), replace=False) == 4
        assert rows(cat.table("core", "p").where("id = 'P9'"), "unit") == [("KG",)]
        cat.execute(f"create table {cat.name('ops', 'seen')} (n int) using parquet")
        assert cat.exists("ops", "seen")
    finally:
        cat.drop()


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a", "b"):
        (tmp_path / "in" / f"{n}.csv").write_text("id,v\n1,x\n2,y\n")
    s = streams.once_per_content(streams.file_stream(spark, str(tmp_path / "in"), "id string, v string"))
    streams.run_once(s, f"files-{uuid4().hex}", "append", str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out")), "id", "v") == [("1", "x"), ("2", "y")]
    d = spark.createDataFrame([("i", "d1", 1, "APPROVED"), ("i", "d2", 2, "CLOSED")], "issue_id string, decision_id string, decided_at int, after_status string")
    assert rows(streams.latest_status(d)) == [("i", "CLOSED")]


def test_made_up_data_follows_the_input(spark, tmp_path):
    from partloom.plans import extras

    spark.range(950).selectExpr("concat('P', id) part_id").write.parquet(f"{tmp_path}/part_master.parquet")
    n = dict(rows(extras.QUERIES["generate_counts"](spark, str(tmp_path))))
    assert n["part_master"] >= 950 and n["suppliers"] == 63
    spark.range(5).selectExpr("concat('P', id) part_id").write.mode("overwrite").parquet(f"{tmp_path}/part_master.parquet")
    assert extras._profile(spark, str(tmp_path), seed=11) == extras.Profile(seed=11)


def test_kept_tables_follow_the_files(spark, tmp_path):
    from partloom import session

    folder, built = str(tmp_path), []

    def build():
        built.append(1)
        return spark.range(len(built))

    spark.range(3).write.parquet(f"{folder}/t.parquet")
    assert session.kept(spark, folder, "x", build).count() == session.kept(spark, folder, "x", build).count() == 1
    spark.range(4).write.mode("overwrite").parquet(f"{folder}/t.parquet")
    assert session.kept(spark, folder, "x", build).count() == 2
    lost = [p for (a, f, _, n), p in session._kept.items() if f == folder]
    session.Cuts(spark, "drop").drop(lost[-1])
    assert session.kept(spark, folder, "x", build).count() == 3 and len(built) == 3
