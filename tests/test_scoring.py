"""Scoring against a plain re-calculation, prompts, explanations, stream equals batch."""

import json
import math

import pytest
from pyspark.sql import functions as F

from latelane import schemas as S
from latelane.operators import explain as X
from latelane.plans import scoring
from latelane.plans.service import answer
from latelane.sources.readers import read_requests
from latelane.streaming import scoring as stream

VENDORS = {"V001": 0.548, "V025": 0.477, "V050": 0.551, "GOOD": 0.9}
ROUTES = {("Mumbai", "Delhi"): (0.64, 50, 0.12), ("Kolkata", "Chennai"): (0.3, 1, None)}
REASONS = [{"reason": r, "probability": p} for r, p in (("b", 0.3), ("a", 0.3), ("c", 0.25), ("d", 0.15))]


@pytest.fixture(scope="module")
def lookups(spark):
    vendors = spark.createDataFrame([(v, 100, 1.5, r, 2500.0) for v, r in VENDORS.items()], S.VENDOR_STATS)
    routes = spark.createDataFrame(
        [(o, d, 0.35, spread, n, 1400.0, 0.7, rate) for (o, d), (rate, n, spread) in ROUTES.items()],
        "origin string, destination string, avg_delay_prob double, std_delay_prob double, sample_count long, "
        "avg_distance double, avg_reliability double, actual_delay_rate double",
    )
    return scoring.Lookups(vendors, routes)


CASES = [
    (p, v, o, d, on)
    for p in (0.05, 0.42, 0.55, 0.6, 0.97)
    for v in ("V001", "V025", "V050", "GOOD", "other", None)
    for o, d in (("Mumbai", "Delhi"), ("Kolkata", "Chennai"), ("Mumbai", "Nowhere"), (None, "Delhi"))
    for on in (True, False)
]


@pytest.fixture(scope="module")
def inputs(spark):
    rows = [
        (i, p, v, o, d, on, 3.456 if p < 0.9 else -1.0, REASONS, "Electronics", 500.5, 50000.0 + i)
        for i, (p, v, o, d, on) in enumerate(CASES)
    ]
    return spark.createDataFrame(
        rows, "id int, raw_probability double, supplier_name string, origin_city string, destination_city string, "
        "apply_enrichment boolean, model_days double, reason_probabilities array<struct<reason:string,probability:double>>, "
        "product_category string, weight_kg double, value_inr double",
    )


def expected(p, vendor, origin, destination, on):
    """The record's numbers, calculated one at a time."""
    q = p
    if vendor in VENDORS:
        r = VENDORS[vendor]
        shift = -0.10 if r >= 0.65 else 0.15 if r <= 0.5 else 0.15 + (r - 0.5) / (0.65 - 0.5) * (-0.1 - 0.15)
        q = min(1.0, max(0.0, q + shift))
    confidence, rate = 0.0, 0.0
    if (origin, destination) in ROUTES:
        rate, n, spread = ROUTES[origin, destination]
        part = 0.0 if spread is None else max(0.0, 1 - spread / 0.3)
        confidence = min(1.0, max(0.0, (1 / (1 + math.exp(-0.1 * (n - 50))) + part) / 2))
        w = 0.8 if confidence >= 0.7 else 0.5 if confidence <= 0.4 else 0.5 + (confidence - 0.4) / (0.7 - 0.4) * 0.3
        q = min(1.0, max(0.0, w * q + (1 - w) * rate))
    return (q if on else p), confidence, rate


def test_response_records(spark, inputs, lookups):
    got = {r["id"]: r for r in scoring.respond(scoring.score(inputs, lookups), ("id",)).collect()}
    assert len(got) == len(CASES)
    for i, case in enumerate(CASES):
        p, vendor, origin, destination, on = case
        final, confidence, rate = expected(*case)
        pred, enr, meta = got[i]["prediction"], got[i]["enrichment"], got[i]["metadata"]
        late = final >= 0.5
        assert pred["will_delay"] == late
        assert pred["delay_probability"] == pytest.approx(round(final, 3), abs=1e-9)
        assert pred["estimated_delay_days"] == ((3.46 if p < 0.9 else 0.0) if late else 0.0)
        assert pred["delay_reason"] == ("a" if late else "No Delay Expected")
        assert pred["confidence"] == (0.3 if late else 0.0)
        assert [t["reason"] for t in got[i]["reason_top3"]] == (["a", "b", "c"] if late else [])
        assert enr["vendor_adjustment"] == pytest.approx(round(final - p, 3), abs=1e-9)
        assert enr["route_confidence"] == round(confidence, 3) and enr["route_historical_delay"] == rate
        assert enr["vendor_on_time_rate"] == VENDORS.get(vendor, 0.0)
        assert (enr["vendor_tier"] == "UNKNOWN") == (vendor not in VENDORS)
        assert meta["route"] == f"{origin}->{destination}" and meta["vendor"] == str(vendor)
        assert meta["enrichment_applied"] == on and meta["model_version"] == "v2.0"
        assert enr["vendor_delta"] + enr["route_delta"] == pytest.approx(expected(p, vendor, origin, destination, True)[0] - p)


def test_lookups_beyond_the_bound_give_the_same(spark, inputs, lookups):
    columns = ["id", "enriched_probability", "route_confidence", "vendor_found", "route_found"]
    large = scoring.Lookups(lookups.vendors, lookups.routes, limit_bytes=0)
    a, b = (sorted(map(tuple, scoring.score(inputs, x).select(*columns).collect())) for x in (lookups, large))
    assert a == b


def test_context_messages(inputs, lookups):
    rows = scoring.score(inputs, lookups).transform(scoring.with_context).filter("supplier_name = 'other'").collect()
    assert {r["vendor_context"]["message"] for r in rows} == {"Unknown vendor - no historical data"}
    known = [r["route_context"] for r in rows if r["destination_city"] == "Chennai"][0]
    assert known["found"] and known["consistency"] == 0.0 and known["sample_size"] == 1


def test_prompt_and_answers(inputs, lookups):
    kept = ("id", "origin_city", "destination_city", "supplier_name", "product_category", "weight_kg", "value_inr")
    df = scoring.respond(scoring.score(inputs, lookups), kept).drop("explanation").transform(X.with_prompt)
    df = df.withColumn("ask", F.col("id") % 2 == 0)
    for r in df.collect():
        p, e = r["prediction"], r["enrichment"]
        assert r["prompt"] == X.PROMPT.format(
            route=f"{r['origin_city']}→{r['destination_city']}", vendor=r["supplier_name"], vendor_tier=e["vendor_tier"],
            vendor_rate=f"{e['vendor_on_time_rate']:.1%}", product=r["product_category"], weight=f"{r['weight_kg']:.0f}",
            value=f"{r['value_inr']:,.0f}", expected="YES" if p["will_delay"] else "NO",
            probability=f"{p['delay_probability']:.1%}", days=f"{p['estimated_delay_days']:.1f}", reason=p["delay_reason"],
            raw=f"{e['raw_model_probability']:.1%}", adjustment=f"{e['vendor_adjustment']:+.1%}",
            history=f"{e['route_historical_delay']:.1%}",
        )
    assert {(r["ask"], r["explanation"]) for r in X.explain(df, "prompt", wanted="ask").collect()} == {
        (True, X.NO_CLIENT_BATCH_TEXT), (False, None)}

    def factory():
        def client(system, text):
            assert system == "Be brief."
            if "Nowhere" in text:
                raise ValueError("busy")
            return f" {len(text)} "
        return client

    for r in X.explain(df, "prompt", "Be brief.", factory, wanted="ask").collect():
        want = None if not r["ask"] else "Explanation generation failed: busy" if r["destination_city"] == "Nowhere" else str(len(r["prompt"]))
        assert r["explanation"] == want

    def closed():
        raise OSError("no key")

    got = {(r["ask"], r["explanation"]) for r in X.explain(df, "prompt", "", closed, wanted="ask").collect()}
    assert got == {(True, "Explanation generation failed: no key"), (False, None)}
    plan = X.explain(df, "prompt", "", factory, wanted="ask")._jdf.queryExecution().optimizedPlan().toString()
    sent = plan[plan.index("answers("):].split(")#")[0]
    assert "CASE WHEN" in plan or "if" in sent  # an unwanted row sends a NULL


def test_bands_and_waterfall(inputs, lookups):
    scored = scoring.score(inputs, lookups)
    assert sum(r["n"] for r in scoring.band_counts(scored).collect()) == len(CASES)
    steps = scoring.waterfall(scored, ["id"])
    wide = steps.groupBy("id").pivot("step").sum("value").collect()
    assert all(r["Base Model"] + r["Vendor Adjustment"] == pytest.approx(r["Final Prediction"]) for r in wide)


REQUEST = {**{c: "x" for c in S.REQUEST_TEXT}, "quantity": 10, "weight_kg": 5.0, "value_inr": 500.0, "risk_score": 0.6}


def test_stream_equals_batch_and_counts_rejects(spark, lookups, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(4):
        rows = [{**REQUEST, "supplier_name": v, "quantity": q, "apply_enrichment": q != 7} for v in ("V001", "none") for q in (0, 5, 7)]
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))

    def outputs(df):
        return df.withColumns({
            "raw_probability": F.col("quantity") / 10, "model_days": F.lit(2.0),
            "reason_probabilities": scoring.named_probabilities(["a", "b"], F.array(F.lit(0.4), F.lit(0.6))),
        })

    (folder / "broken.json").write_text('{"quantity": \n' + json.dumps({**REQUEST, "quantity": 1.5, "month": None}))
    arriving = stream.read_requests(spark, str(folder), max_files=2)
    out, refused, counters = (str(tmp_path / n) for n in ("out", "refused", "counters"))
    keep = ("quantity", "supplier_name")
    stream.write_answers(arriving, outputs, lookups, out, refused, str(tmp_path / "c1"), keep, once=True).awaitTermination()
    stream.write_counters(arriving, lookups, counters, str(tmp_path / "c2"), once=True).awaitTermination()
    batch, rejected = answer(read_requests(spark, str(folder)), outputs, lookups, keep)
    pick = lambda df: sorted(map(str, df.select("quantity", "supplier_name", "prediction", "enrichment", "explanation", "reason_top3").collect()))
    assert pick(spark.read.parquet(f"{out}/run=*")) == pick(batch) and batch.count() == 16
    why = lambda df: sorted(str(list(r["violations"])) for r in df.collect())
    assert why(spark.read.parquet(f"{refused}/run=*")) == why(rejected) == sorted(
        [str(["quantity: must be greater than 0"])] * 8 + [str(["record: not valid JSON"]), str(["quantity: not a valid int", "month: field required"])])
    totals = spark.read.parquet(f"{counters}/run=*").agg(F.sum("valid_rows"), F.sum("rejected_rows"), F.count("*")).first()
    assert tuple(totals) == (16, 10, 3)
