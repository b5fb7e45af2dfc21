"""CSV, JSON, store and request checks."""

import json

import pytest
from pyspark.sql import functions as F

from latelane import schemas as S
from latelane.errors import SourceError, StoreError
from latelane.sources import readers, requests, store, writers

HEADER = "vendor_id,shipments,avg_delay_days,on_time_rate,avg_cost\n"
VENDOR_CSV = HEADER + 'VX9,12,0.5,0.25,99.5\nV002,,NA,NaN,\nNone,5.0,null,abc,1e3\n'
GOOD_CSV = HEADER + 'VX9,12,0.5,0.25,99.5\n"A ""x"", B",1,1.0,0.5,2\n"two\nlines",5.0,null,,1e3\n'


def test_csv_missing_texts_become_null(spark, tmp_path):
    (tmp_path / "v.csv").write_text(VENDOR_CSV)
    rows = [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "v.csv"), S.VENDOR_STATS).collect()]
    assert rows == [("VX9", 12, 0.5, 0.25, 99.5), ("V002", None, None, None, None), (None, 5, None, None, 1000.0)]
    bad = readers.malformed(spark, str(tmp_path / "v.csv"), S.VENDOR_STATS).collect()
    assert {r["column_name"]: r["malformed_cells"] for r in bad} == {
        "(row)": 0, "shipments": 0, "avg_delay_days": 0, "on_time_rate": 1, "avg_cost": 0}


def test_quotes_line_breaks_and_surplus_cells(spark, tmp_path):
    (tmp_path / "v.csv").write_text(GOOD_CSV)
    rows = [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "v.csv"), S.VENDOR_STATS, strict=True).collect()]
    assert rows == [("VX9", 12, 0.5, 0.25, 99.5), ('A "x", B', 1, 1.0, 0.5, 2.0), ("two\nlines", 5, None, None, 1000.0)]
    (tmp_path / "w.csv").write_text(HEADER + "a,1,1,1,1,6,7\nb,x,1,1,1\nc,1\n")
    bad = {r["column_name"]: r["malformed_cells"] for r in readers.malformed(spark, str(tmp_path / "w.csv"), S.VENDOR_STATS).collect()}
    assert bad["(row)"] == 2 and bad["shipments"] == 1
    with pytest.raises(SourceError, match=r"2 malformed in \(row\), 1 malformed in shipments"):
        readers.read_csv(spark, str(tmp_path / "w.csv"), S.VENDOR_STATS, strict=True)


def test_store_round_trip_and_health(spark, tmp_path):
    kept = store.FeatureStore(spark, str(tmp_path / "store"))
    with pytest.raises(StoreError):
        kept.table("vendor_stats")
    (tmp_path / "v.csv").write_text(GOOD_CSV)
    (tmp_path / "p.csv").write_text(",".join(S.SHIPMENTS.fieldNames()) + "\n" + "s1,2024-05-01,NA" + "," * 22 + "\n")
    (tmp_path / "r.csv").write_text(",".join(S.ROUTE_STATS.fieldNames()) + "\n")
    kept.load_raw_tables(*[str(tmp_path / f"{n}.csv") for n in "pvr"])
    assert str(kept.table("primary_shipments").first()["order_date"]) == "2024-05-01"
    assert tuple(kept.health().first()) == (1, 3, 0, False) and not kept.is_healthy()
    kept.register("vendor_stats")
    assert spark.sql("select count(*) from vendor_stats").first()[0] == 3
    assert "vendor_stats" in store.list_tables(spark)
    (tmp_path / "bad.csv").write_text(VENDOR_CSV)
    with pytest.raises(SourceError, match="1 malformed in on_time_rate"):
        kept.load_raw_tables(str(tmp_path / "p.csv"), str(tmp_path / "bad.csv"), str(tmp_path / "r.csv"))
    assert kept.table("vendor_stats").count() == 3
    kept.save(kept.table("vendor_stats").limit(2), "vendor_stats")  # a table rebuilt from itself
    assert kept.table("vendor_stats").count() == 2
    with pytest.raises(SourceError):
        kept.load_raw_tables(str(tmp_path / "absent.csv"), str(tmp_path / "v.csv"), str(tmp_path / "r.csv"))


def test_training_frame_reader_rejects_empty(spark, tmp_path):
    names = ["quantity", "weight_kg", "value_inr", "gst_rate", "risk_score", *S.REQUEST_TEXT, "will_delay", "delay_days", "delay_reason"]
    spark.range(2).select(*[F.lit(1).alias(n) for n in names], "id").write.parquet(str(tmp_path / "f"))
    assert readers.read_training_frame(spark, str(tmp_path / "f")).columns == names
    spark.range(0).select(*[F.lit(1).alias(n) for n in names]).write.parquet(str(tmp_path / "e"))
    with pytest.raises(SourceError):
        readers.read_training_frame(spark, str(tmp_path / "e"))


REQUEST = {
    **{c: "x" for c in S.REQUEST_TEXT}, "quantity": 100, "weight_kg": 500.0, "value_inr": 50000.0, "risk_score": 0.6,
}


def test_requests_are_checked_and_completed(spark, tmp_path):
    cases = [
        REQUEST, {**REQUEST, "month": None}, {**REQUEST, "quantity": 0}, {**REQUEST, "weight_kg": -1.0},
        {**REQUEST, "risk_score": 1.2}, {**REQUEST, "apply_enrichment": False, "explain": True},
    ]
    (tmp_path / "r.json").write_text("\n".join(json.dumps(c) for c in cases))
    df = readers.read_requests(spark, str(tmp_path / "r.json"))
    valid, rejected = requests.split_valid(df)
    assert sorted(v for r in rejected.collect() for v in r["violations"]) == [
        "month: field required", "quantity: must be greater than 0", "risk_score: must be between 0 and 1",
        "weight_kg: must be greater than 0"]
    got = {(r["apply_enrichment"], r["explain"]) for r in requests.with_defaults(valid).collect()}
    assert valid.count() == 2 and got == {(True, False), (False, True)}
    assert requests.split_valid(df, S.FORM_CHOICES)[0].count() == 0


def test_wrong_types_are_named(spark, tmp_path):
    cases = [{**REQUEST, "quantity": 1.5}, {**REQUEST, "quantity": "12", "explain": "true"}, {**REQUEST, "weight_kg": "heavy", "risk_score": None}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, cases)) + '\n{"quantity": 3,')
    valid, rejected = requests.split_valid(readers.read_requests(spark, str(tmp_path / "r.json")))
    row = valid.first()
    assert valid.count() == 1 and row["quantity"] == 12 and row["explain"] is True
    assert sorted(map(str, (list(r["violations"]) for r in rejected.collect()))) == sorted(map(str, [
        ["quantity: not a valid int"], ["weight_kg: not a valid double", "risk_score: field required"], ["record: not valid JSON"]]))
    assert rejected.filter("broken_record is not null").first()["broken_record"] == '{"quantity": 3,'


def test_training_log(spark, tmp_path):
    log = spark.createDataFrame([(0, 0.19, 2.27), (1, 0.34, 2.2), (2, 0.34, 2.1), (3, 0.3, 2.0)], S.TRAINING_LOG)
    writers.write_training_log(log, str(tmp_path / "log"))
    best = readers.best_iteration(readers.read_training_log(spark, str(tmp_path / "log"))).first()
    assert tuple(best) == (1, 0.34, 3, 2)


def test_bucketed_tables_join_without_shuffle(spark, tmp_path):
    kept = store.FeatureStore(spark, str(tmp_path))
    for name in ("left_rows", "right_rows"):
        kept.save_bucketed(spark.range(100).withColumn("v", F.lit(name)), name, "id", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("left_rows").join(spark.table("right_rows"), "id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and joined.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table left_rows")
        spark.sql("drop table right_rows")


def test_json_records_are_packed(spark, tmp_path):
    records = spark.range(2000).select("id", F.lit("a name that every record repeats").alias("name"), F.lit(None).cast("string").alias("gap"))
    writers.write_json(records, str(tmp_path / "j"))
    files = [f for f in (tmp_path / "j").iterdir() if f.name.startswith("part-")]
    assert files and all(f.name.endswith(".json.gz") for f in files)
    back = spark.read.schema(records.schema).json(str(tmp_path / "j"))
    assert back.exceptAll(records).isEmpty() and back.count() == 2000


def test_valid_requests_are_told_as_by_the_list_of_rules(spark):
    values = {"quantity": (1, 0, None), "weight_kg": (1.0, float("nan"), -1.0, None), "risk_score": (0.0, 1.5, None, float("nan"))}
    rows = [
        tuple({"quantity": 1, "weight_kg": 2.0, "value_inr": 3.0, "risk_score": 0.5, "month": m, c: v, "type_errors": errors}.values())
        for c, several in values.items() for v in several for m in ("May", "x", None)
        for errors in ([], ["quantity: not a valid int"], ["record: not valid JSON"])
    ]
    df = spark.createDataFrame(rows, "quantity int, weight_kg double, value_inr double, risk_score double, month string, type_errors array<string>")
    df = df.withColumns({c: F.lit("x") for c in S.REQUEST_TEXT if c != "month"})
    for choices in (None, {"month": ("May",)}):
        both = df.withColumn("ok", requests.is_valid(choices, F.col("type_errors"))).withColumn("listed", requests.violations(choices, F.col("type_errors")))
        assert both.filter(~F.col("ok").eqNullSafe(F.size("listed") == 0)).isEmpty()
        valid, rejected = requests.split_valid(df, choices)
        assert valid.count() > 0 and valid.count() + rejected.count() == len(rows) and rejected.filter(F.size("violations") == 0).isEmpty()
    assert tuple(requests.counted(df).first()) == (requests.split_valid(df)[0].count(), requests.split_valid(df)[1].count())


def test_a_filter_for_valid_requests_holds_no_list_of_rules(spark):
    df = spark.createDataFrame([], S.REQUESTS)
    plan = requests.split_valid(df)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "field required" not in plan and "array" not in plan


def test_raw_tables_are_read_once(spark, tmp_path, monkeypatch):
    (tmp_path / "v.csv").write_text(GOOD_CSV)
    (tmp_path / "bad.csv").write_text(VENDOR_CSV)
    (tmp_path / "p.csv").write_text(",".join(S.SHIPMENTS.fieldNames()) + "\n")
    (tmp_path / "r.csv").write_text(",".join(S.ROUTE_STATS.fieldNames()) + "\n")
    kept = store.FeatureStore(spark, str(tmp_path / "store"))
    monkeypatch.setattr(readers, "malformed", None)  # a pass of its own
    kept.load_raw_tables(*[str(tmp_path / f"{n}.csv") for n in "pvr"])
    with pytest.raises(SourceError, match="1 malformed in on_time_rate"):
        kept.load_raw_tables(str(tmp_path / "p.csv"), str(tmp_path / "bad.csv"), str(tmp_path / "r.csv"))
    assert kept.table("vendor_stats").count() == 3 and kept.versions("vendor_stats").count() == 1
    assert len([f for f in (tmp_path / "store" / "vendor_stats").iterdir() if f.name.startswith("version=")]) == 1
