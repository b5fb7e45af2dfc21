"""The metrics report reads its tables once."""

from registry import queries, standin
from tests.conftest import SF


def test_report_builds_shipments_and_vendors_once(spark, monkeypatch):
    built = []

    def counting(name, build):
        return lambda *args: built.append(name) or build(*args)

    for name in ("shipments", "known_vendors", "known_routes"):
        monkeypatch.setattr(standin, name, counting(name, getattr(standin, name)))
    fields = {(r["section"], r["field"]) for r in queries.metrics_report(spark, SF).collect()}
    assert sorted(built) == ["known_routes", "known_vendors", "shipments"]
    assert {("dataset_info", "rows"), ("enrichment_impact", "routes_validated"), ("members", "vote.auc")} <= fields
