"""Versions of the store: retention, one log file, two writers, groups; lookups replaced while a stream runs."""

import json

import pytest
from pyspark.sql import functions as F

from latelane import schemas as S
from latelane.errors import StoreError
from latelane.plans.lookups import StoredLookups
from latelane.plans.scoring import Lookups
from latelane.sources import folders, readers
from latelane.sources.store import FeatureStore
from latelane.streaming import scoring as stream
from registry import queries
from tests.conftest import SF


def test_many_saves_leave_few_versions_and_one_log(spark, tmp_path):
    kept = FeatureStore(spark, str(tmp_path), kept=3)
    for i in range(100):
        kept._save({"rows": spark.range(i + 1).coalesce(1)}, "t")
    assert kept.table("t").count() == 100 and kept.table("t", version=98).count() == 98
    assert [r["version"] for r in kept.versions("t").orderBy("version").collect()] == [98, 99, 100]
    assert [r["is_last"] for r in kept.versions("t").orderBy("version").collect()] == [False, False, True]
    assert folders.names(spark, f"{tmp_path}/t/log") == ["000000000100.json"]
    assert len([n for n in folders.names(spark, f"{tmp_path}/t") if n.startswith("version=")]) == 3
    with pytest.raises(StoreError, match="version 97"):
        kept.table("t", version=97)
    with pytest.raises(StoreError, match="no table 'other'"):
        kept.table("other")


def test_the_second_of_two_writers_is_told(spark, tmp_path, monkeypatch):
    first, second = FeatureStore(spark, str(tmp_path)), FeatureStore(spark, str(tmp_path))
    first.save(spark.range(1), "t")
    seen = second._log("t")
    first.save(spark.range(2), "t")
    monkeypatch.setattr(second, "_log", lambda name: seen)  # as if its write had begun before the other one's end
    with pytest.raises(StoreError, match="another writer"):
        second._save({"rows": spark.range(3)}, "t")
    assert first.table("t").count() == 2
    assert len([n for n in folders.names(spark, f"{tmp_path}/t") if n.startswith("version=")]) == 2


def test_a_failed_write_changes_nothing(spark, tmp_path):
    kept = FeatureStore(spark, str(tmp_path))
    kept.save(spark.range(4), "t")
    with pytest.raises(Exception, match="broken"):
        kept.save(spark.range(4).select(F.raise_error(F.lit("broken")).alias("id")), "t")
    assert kept.table("t").count() == 4 and kept.versions("t").count() == 1


def test_groups_are_replaced_together(spark, tmp_path):
    kept = FeatureStore(spark, str(tmp_path))
    assert kept.save_together({"a": spark.range(1), "b": spark.range(2)}, "g") == 1
    assert kept.save_together({"a": spark.range(3), "b": spark.range(4)}, "g") == 2
    counts = {v: {n: df.count() for n, df in kept.together("g", v)[1].items()} for v in (1, 2)}
    assert counts == {1: {"a": 1, "b": 2}, 2: {"a": 3, "b": 4}} and kept.together("g")[0] == 2


def test_partitioned_tables(spark, tmp_path):
    kept = FeatureStore(spark, str(tmp_path))
    got = kept.save(spark.range(6).withColumn("p", F.col("id") % 2), "t", partition_by=["p"])
    assert got.filter("p = 1").count() == 3


def test_small_files(spark, tmp_path):
    path = f"{tmp_path}/new/f.txt"
    assert folders.names(spark, f"{tmp_path}/new") == [] and folders.read_text(spark, path) is None
    assert folders.create(spark, path, "é\n") and not folders.create(spark, path, "other")
    assert folders.read_text(spark, path) == "é\n" and folders.names(spark, f"{tmp_path}/new") == ["f.txt"]
    folders.delete(spark, path)
    folders.delete(spark, path)
    assert folders.names(spark, f"{tmp_path}/new") == []


def test_stored_training_frame_needs_rows(spark, tmp_path):
    kept = FeatureStore(spark, str(tmp_path))
    schema = S.T.StructType([*S.SHIPMENTS.fields, S.T.StructField("will_delay", S.T.IntegerType())])
    stored = kept.save(spark.createDataFrame([], schema), "training_frame")
    with pytest.raises(readers.SourceError, match="no rows"):
        readers.prepared_frame(stored, "training_frame")


def _lookups(spark, rate):
    vendors = spark.createDataFrame([("V", 3, 1.0, rate, 2.0)], S.VENDOR_STATS)
    columns = ("avg_delay_prob", "std_delay_prob", "avg_distance", "avg_reliability", "actual_delay_rate")
    routes = spark.createDataFrame([("A", "B", 0.4, 0.1, 10.0, 0.5, 0.4, 60)], "origin string, destination string, " + ", ".join(
        f"{c} double" for c in columns) + ", sample_count long")
    return Lookups(vendors, routes)


def test_a_running_stream_takes_up_new_lookups(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    stored = StoredLookups(FeatureStore(spark, str(tmp_path / "store")))

    def outputs(df):
        reasons = F.array(F.struct(F.lit("a").alias("reason"), F.lit(1.0).alias("probability")))
        return df.withColumns({"raw_probability": F.lit(0.5), "model_days": F.lit(2.0), "reason_probabilities": reasons})

    def arrive(name):
        record = {c: "x" for c in S.REQUEST_TEXT} | {"supplier_name": "V", "origin_city": "A", "destination_city": "B"}
        (folder / name).write_text(json.dumps(record | {"quantity": 1, "weight_kg": 1.0, "value_inr": 1.0, "risk_score": 0.5}) + "\n")

    assert stored.publish(_lookups(spark, 0.7)) == 1
    arrive("a.json")
    query = stream.write_answers(
        stream.read_requests(spark, str(folder)), outputs, stored, out, str(tmp_path / "no"), str(tmp_path / "state"), ("quantity",)
    )
    try:
        query.processAllAvailable()
        assert stored.publish(_lookups(spark, 0.4)) == 2
        arrive("b.json")
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.read.parquet(f"{out}/run=*").select("lookup_version", "enrichment.vendor_tier").collect()
    assert sorted(map(tuple, got)) == [(1, "EXCELLENT"), (2, "POOR")]


def test_bucketed_rows_are_finished_after_they_are_dealt(spark, tmp_path):
    kept, seen = FeatureStore(spark, str(tmp_path)), []
    finish = lambda df: seen.append((df.columns, df.rdd.getNumPartitions())) or df.withColumn("name", F.concat(F.lit("n"), "id"))
    saved = kept.save_bucketed(spark.range(50), "finished", "id", 4, finish)
    assert seen == [(["id"], 4)] and sorted(r.name for r in saved.collect()) == sorted(f"n{i}" for i in range(50))


def test_colocated_shipments_are_dealt_without_names_and_stored_as_declared(spark, monkeypatch):
    dealt, save = {}, FeatureStore.save_bucketed

    def saved(self, df, name, key, buckets, *finish):
        out = save(self, df, name, key, buckets, *finish)
        dealt[name.split("_")[0]] = (df.columns, out.columns)
        return out

    monkeypatch.setattr(FeatureStore, "save_bucketed", saved)
    queries.colocated_frame(spark, SF)
    travelled, stored = dealt["shipments"]
    assert not {"origin_city", "destination_state", "month", "on_time", "row_key"} & set(travelled) and stored == S.SHIPMENTS.fieldNames()
