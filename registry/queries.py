"""Registered queries.  Every result is flat, with rounded doubles and 64-bit integers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latelane import schemas as S
from latelane.errors import StoreError
from latelane.functions import enrichment as E
from latelane.functions import numbers as N
from latelane.functions import texts
from latelane.operators import explain as X
from latelane.operators import features, metrics, profiles, scaling, splits
from latelane.operators.joins import lookup_join
from latelane.operators.ranks import percentiles
from latelane.plans import reports, scoring, service
from latelane.session import materialise, new_path
from latelane.sources import folders, readers, requests, store, writers
from registry import standin


def tidy(df: DataFrame) -> DataFrame:
    """Comparable columns: doubles to 6 decimals without -0.0, integers 64-bit, dates as text.

    Doubles are first moved up by a hair: a mean that lies exactly on a rounding
    tie has last bits that depend on the order of summing, and must still round one way.
    """
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.rint((c + standin.HAIR) * 1e6) / 1e6 + 0.0
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        columns.append(c.alias(f.name))
    return df.select(*columns)


# --- Training frame, profiles, keys ------------------------------------------------


def training_frame(spark: SparkSession, sf: str) -> DataFrame:
    vendors = materialise(standin.known_vendors(spark, sf), "vendors")
    return tidy(features.training_frame(standin.shipments(spark, sf), vendors, standin.route_rows(spark, sf)))


def colocated_frame(spark: SparkSession, sf: str) -> DataFrame:
    """The training frame from shipments and routes stored in the same buckets; an error if the plan shuffles either of them."""
    kept, tag = store.FeatureStore(spark, new_path(spark, "store")), uuid.uuid4().hex
    ships = kept.save_bucketed(
        standin.shipment_lines(spark, sf), f"shipments_{tag}", "shipment_id", 16,
        lambda lines: standin.shipments(spark, sf, lines).select(*S.SHIPMENTS.fieldNames()),
    )
    routes = kept.save_bucketed(standin.route_rows(spark, sf), f"routes_{tag}", "shipment_id", 16)
    vendors = materialise(standin.known_vendors(spark, sf), "vendors")
    frame = features.training_frame(ships, vendors, routes.hint("merge"))
    if "Exchange hashpartitioning" in frame._jdf.queryExecution().executedPlan().toString():
        raise StoreError("the stored buckets are not used")
    return tidy(frame)


def prepared_frame(spark: SparkSession, sf: str) -> DataFrame:
    """The training frame as a table of the store, read back with the columns of the multi-task preparation."""
    kept = store.FeatureStore(spark, new_path(spark, "store"))
    kept.save(_frame(spark, sf).select(*readers.PREPARED_COLUMNS), "training_frame")
    return tidy(readers.prepared_frame(kept.table("training_frame"), "training_frame"))


def _frame(spark: SparkSession, sf: str, vendors: DataFrame | None = None) -> DataFrame:
    """One training row per shipment row: route columns come with the shipment itself.  ``vendors`` may be given as stored."""
    ships = standin.shipments(spark, sf)
    vendors = (materialise(standin.known_vendors(spark, sf), "vendors") if vendors is None else vendors).select(
        F.col("vendor_id").alias("supplier_name"), F.col("avg_delay_days").alias("vendor_avg_delay_days"),
        F.col("on_time_rate").alias("vendor_on_time_rate"),
    )
    joined = lookup_join(ships, vendors, ["supplier_name"]).withColumns({
        "will_delay": features.will_delay(F.col("on_time")),
        "route_distance_km": F.col("value_inr") / 50,
        "route_delay_probability_sim": F.col("risk_score") / 2,
    })
    return features.with_derived(joined)


def route_profile(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(profiles.route_profile(standin.routes(spark, sf)))


def vendor_profile(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(profiles.vendor_profile(standin.vendor_rows(spark, sf)))


def vendor_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Vendor rows per return flag are duplicates of a vendor; one of them is kept."""
    lines = standin.table(spark, sf, "lineitem")
    per_flag = lines.groupBy(F.col("l_suppkey").cast("string").alias("vendor_id"), "l_returnflag").agg(
        F.count(F.lit(1)).alias("shipments"), F.avg("l_quantity").alias("avg_delay_days"),
        F.avg((F.col("l_quantity") < 25).cast("double")).alias("on_time_rate"), F.avg("l_extendedprice").alias("avg_cost"),
    ).drop("l_returnflag")
    return tidy(profiles.unique_vendors(per_flag))


def unknown_keys(spark: SparkSession, sf: str) -> DataFrame:
    look = standin.lookups(spark, sf)
    ends = standin.routes(spark, sf)
    vendors = profiles.unmatched_keys(
        standin.vendor_rows(spark, sf), look.vendors, {"supplier_name": "vendor_id"}
    ).select(F.lit("vendor").alias("kind"), F.col("supplier_name").alias("key"), "rows")
    pairs = profiles.unmatched_keys(ends, look.routes, {"origin": "origin", "destination": "destination"}).select(
        F.lit("route").alias("kind"), texts.route_pair(F.col("origin"), F.col("destination")).alias("key"), "rows"
    )
    return tidy(vendors.unionByName(pairs))


def autofill(spark: SparkSession, sf: str) -> DataFrame:
    look = standin.lookups(spark, sf)
    given = F.col("l_linenumber") % 2 == 0
    asked = standin.shipments(spark, sf).select(
        "row_key", "supplier_name", "origin_city", "destination_city",
        F.lit(None).cast("double").alias("vendor_avg_delay_days"),
        F.when(given, F.lit(0.5)).alias("vendor_on_time_rate"),
        F.lit(None).cast("double").alias("route_distance_km"),
        F.when(given, F.col("route_vendor_reliability_sim")).alias("route_vendor_reliability_sim"),
        F.lit(None).cast("double").alias("route_delay_probability_sim"),
    )
    return tidy(features.fill_from_lookups(asked, look.vendors, look.routes))


def health(spark: SparkSession, sf: str) -> DataFrame:
    vendors = standin.known_vendors(spark, sf)
    return tidy(store.health(standin.shipments(spark, sf), vendors, standin.routes(spark, sf)))


def service_health(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(store.lookup_health(standin.known_vendors(spark, sf), standin.known_routes(spark, sf)))


def _late_frame(spark: SparkSession, sf: str) -> DataFrame:
    return standin.shipments(spark, sf).withColumn("will_delay", features.will_delay(F.col("on_time")))


def reason_distribution(spark: SparkSession, sf: str) -> DataFrame:
    late = features.delayed_with_reason(_late_frame(spark, sf))
    return tidy(profiles.top_shares(late, "delay_reason"))


def rare_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Rare values at a 16 % bound, as none of the six reasons is below 1 %."""
    late = features.delayed_with_reason(_late_frame(spark, sf))
    return tidy(profiles.rare_values(late, "delay_reason", 0.16))


def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    frame = standin.shipments(spark, sf).withColumn("reason", features.reason_any_row(F.col("delay_reason")))
    return tidy(profiles.class_weights(frame, "reason"))


def dataset_facts(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(profiles.dataset_facts(_frame(spark, sf), materialise(standin.known_vendors(spark, sf), "vendors")))


# --- Enrichment and scoring ---------------------------------------------------------


def vendor_adjust(spark: SparkSession, sf: str) -> DataFrame:
    """The vendor step of the scoring plan, at full and at half weight."""
    df = scoring.with_history(standin.scored_inputs(spark, sf), standin.lookups(spark, sf))
    half = scoring.with_enrichment(df, vendor_weight=0.5).withColumnRenamed("vendor_probability", "half_adjusted")
    whole = scoring.with_enrichment(half.drop("model_weight", "enriched_probability", "vendor_delta", "route_delta"))
    rate = F.col("vendor_rate")
    return tidy(whole.select(
        "row_key", "vendor_found",
        F.when(F.col("vendor_found"), E.vendor_shift(rate)).otherwise(F.lit(0.0)).alias("shift"),
        F.col("vendor_probability").alias("adjusted"), "half_adjusted",
        F.when(F.col("vendor_found"), E.vendor_tier(rate)).otherwise(S.VENDOR_NO_TIER).alias("tier"),
    ))


def route_blend(spark: SparkSession, sf: str) -> DataFrame:
    """The route step of the scoring plan alone: the vendor step has no weight."""
    df = scoring.with_history(standin.scored_inputs(spark, sf), standin.lookups(spark, sf))
    df = scoring.with_enrichment(df, vendor_weight=0.0)
    return tidy(df.select(
        "row_key", "route_found", "route_confidence",
        F.when(F.col("route_found"), F.col("model_weight")).otherwise(F.lit(1.0)).alias("model_weight"),
        F.col("enriched_probability").alias("blended"),
    ))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score(standin.scored_inputs(spark, sf), standin.lookups(spark, sf))


def enriched_score(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(_scored(spark, sf).select(
        "row_key", "shipment_id", "raw_probability", "vendor_probability", "enriched_probability", "route_confidence",
        "delay_probability", "will_delay", "estimated_delay_days", "delay_reason", "vendor_delta", "route_delta",
    ))


def contexts(spark: SparkSession, sf: str) -> DataFrame:
    df = scoring.with_history(standin.scored_inputs(spark, sf), standin.lookups(spark, sf)).transform(scoring.with_context)
    v, r = "vendor_context", "route_context"
    return tidy(df.select(
        "row_key", F.col(f"{v}.found").alias("vendor_found"), F.col(f"{v}.vendor_id").alias("vendor_id"),
        F.col(f"{v}.on_time_rate").alias("on_time_rate"), F.col(f"{v}.avg_delay_days").alias("avg_delay_days"),
        F.coalesce(f"{v}.total_shipments", F.lit(0)).alias("total_shipments"), F.col(f"{v}.reliability_tier").alias("tier"),
        F.col(f"{v}.message").alias("vendor_message"), F.col(f"{r}.found").alias("route_found"),
        F.col(f"{r}.route").alias("route"), F.col(f"{r}.historical_delay_rate").alias("historical_delay_rate"),
        F.coalesce(f"{r}.sample_size", F.lit(0)).alias("sample_size"), F.col(f"{r}.consistency").alias("consistency"),
        F.col(f"{r}.confidence").alias("confidence"), F.col(f"{r}.avg_distance_km").alias("avg_distance_km"),
        F.col(f"{r}.message").alias("route_message"),
    ))


def flat_response(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(
        *keep, *[F.col(f"prediction.{c}").alias(c) for c in (
            "will_delay", "delay_probability", "estimated_delay_days", "delay_reason", "confidence")],
        *[F.col(f"enrichment.{c}").alias(c) for c in (
            "raw_model_probability", "vendor_adjustment", "route_adjustment", "vendor_tier", "route_confidence",
            "vendor_on_time_rate", "route_historical_delay", "vendor_delta", "route_delta")],
        *[F.col(f"metadata.{c}").alias(c) for c in ("model_version", "enrichment_applied", "route", "vendor")],
        F.date_format("metadata.timestamp", "yyyy-MM-dd HH:mm:ss").alias("scored_at"), "explanation",
        F.array_join(F.transform("reason_top3", lambda r: r["reason"]), ">").alias("reason_top3"),
        F.aggregate("reason_top3", F.lit(0.0), lambda t, r: t + r["probability"]).alias("top3_probability"),
    )


def score_response(spark: SparkSession, sf: str) -> DataFrame:
    at = F.lit(SCORED_AT).cast("timestamp")
    return tidy(flat_response(scoring.respond(_scored(spark, sf), ("row_key",), at), "row_key"))


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    kept = ("row_key", "origin_city", "destination_city", "supplier_name", "product_category", "weight_kg", "value_inr")
    answered = scoring.respond(_scored(spark, sf), kept)
    return X.with_prompt(answered).select("row_key", "prompt")


def explain_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Without a client every wanted row gets the fixed text."""
    kept = ("row_key", "explain", "origin_city", "destination_city", "supplier_name", "product_category", "weight_kg", "value_inr")
    answered = scoring.respond(_scored(spark, sf), kept).drop("explanation").transform(X.with_prompt)
    return X.explain(answered, "prompt", wanted="explain", unavailable=X.NO_CLIENT_TEXT).select("row_key", "explanation")


def _upper_client():
    return lambda system, text: f"{len(text)} characters"


def explain_with_client(spark: SparkSession, sf: str) -> DataFrame:
    """A client that answers with the length of the prompt it was given."""
    kept = ("row_key", "explain", "origin_city", "destination_city", "supplier_name", "product_category", "weight_kg", "value_inr")
    answered = scoring.respond(_scored(spark, sf), kept).drop("explanation").transform(X.with_prompt)
    return X.explain(answered, "prompt", "Answer briefly.", _upper_client, wanted="explain").select("row_key", "explanation")


def top3_reasons(spark: SparkSession, sf: str) -> DataFrame:
    named = scoring.named_probabilities(standin.REASONS, standin.reason_probabilities())
    df = standin.shipments(spark, sf).select("row_key", scoring.top_reasons(named).alias("top"))
    return tidy(df.select("row_key", F.posexplode("top").alias("place", "r")).select(
        "row_key", "place", F.col("r.reason").alias("reason"), F.col("r.probability").alias("probability")
    ))


def risk_bands(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(scoring.band_counts(_scored(spark, sf)))


def waterfall(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(scoring.waterfall(_scored(spark, sf), ["row_key"]))


def enrichment_impact(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(reports.enrichment_impact(_scored_labels(_scored(spark, sf)), "label"))


def _scored_labels(scored: DataFrame) -> DataFrame:
    """Scored columns the impact report reads, stored for its three passes."""
    return materialise(scored.withColumn("label", features.will_delay(F.col("on_time"))).select(
        "label", "raw_probability", "enriched_probability", "vendor_found", "route_found", "supplier_name",
        "origin_city", "destination_city",
    ), "scored_labels")


def route_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels where every third line has no destination."""
    end = F.when(F.col("l_linenumber") % 3 != 0, F.col("destination_city"))
    return standin.shipments(spark, sf).select(
        "row_key", texts.route_pair(F.col("origin_city"), end).alias("route_pair"),
        texts.route_label(F.col("origin_city"), end).alias("route_label"),
    )


# --- Requests -----------------------------------------------------------------------


REQUIRED = (*S.REQUEST_TEXT, *S.REQUEST_NUMBERS)
#: Beside a missing field each: value out of range, value of another type, broken line, explanation asked for.
DEFECTS = 24


def _case() -> Column:
    """0-12 a missing field, 13-16 out of range, 17-19 another type, 20 broken, 21 explained, beyond: in order."""
    return F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber"), F.lit(2 * DEFECTS))


def request_files(spark: SparkSession, sf: str) -> str:
    """Every shipment as a line of JSON, half of them with one of the defects."""
    n = _case()
    ships = standin.shipments(spark, sf)
    given = {c: F.when(n != i, F.col(c)) for i, c in enumerate(REQUIRED)}
    given["quantity"] = F.when(n == 13, F.lit(0)).when(~n.isin(9, 17), F.col("quantity"))
    given["weight_kg"] = F.when(n == 14, -F.col("weight_kg") - 1).when(~n.isin(10, 18), F.col("weight_kg"))
    given["value_inr"] = F.when(n == 15, F.lit(0.0)).when(n != 11, F.col("value_inr"))
    given["risk_score"] = F.when(n == 16, F.col("risk_score") + 1.5).when(n != 12, F.col("risk_score"))
    record = F.to_json(F.struct(
        "row_key", "l_linenumber", *[c.alias(name) for name, c in given.items()], "route_vendor_reliability_sim",
        F.when(n != 19, F.col("l_linenumber") != 7).alias("apply_enrichment"), F.when(n == 21, F.lit(True)).alias("explain"),
    ), {"ignoreNullFields": "false"})
    line = (
        F.when(n == 17, F.replace(record, F.lit('"quantity":null'), F.lit('"quantity":1.5')))
        .when(n == 18, F.replace(record, F.lit('"weight_kg":null'), F.lit('"weight_kg":"heavy"')))
        .when(n == 19, F.replace(record, F.lit('"apply_enrichment":null'), F.lit('"apply_enrichment":"maybe"')))
        .when(n == 20, F.concat(F.lit('{"row_key":"'), F.col("row_key"), F.lit('","quantity":')))
        .otherwise(record)
    )
    path = new_path(spark, "request_files")
    writers.compressed(ships.select(line.alias("value")).write).text(path)
    return path


REQUEST_EXTRA = T.StructType([T.StructField("row_key", T.StringType()), T.StructField("l_linenumber", T.IntegerType())])


def validate_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule broken in turn, by missing values, ranges, types and broken lines."""
    checked = requests.check(readers.read_requests(spark, request_files(spark, sf), REQUEST_EXTRA))
    broken = F.col(readers.BROKEN).isNotNull()
    return checked.select(
        F.when(~broken, F.col("row_key")).alias("row_key"), F.array_join("violations", "; ").alias("violations"), readers.BROKEN
    )


def model_outputs(df: DataFrame) -> DataFrame:
    """The fixed formulas in place of trained models."""
    return df.withColumns({
        "raw_probability": standin.probability(), "model_days": standin.model_days(),
        "reason_probabilities": scoring.named_probabilities(standin.REASONS, standin.reason_probabilities()),
    })


SCORED_AT = "2025-01-31 12:00:00"


def request_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The whole call for the valid requests: records written as nested JSON, read back, every field."""
    arrived = readers.read_requests(spark, request_files(spark, sf), REQUEST_EXTRA)
    records, _ = service.answer(
        arrived, model_outputs, standin.lookups(spark, sf), ("row_key",), scored_at=F.lit(SCORED_AT).cast("timestamp")
    )
    path = new_path(spark, "answers")
    writers.write_json(records, path)
    return tidy(flat_response(spark.read.schema(records.schema).json(path), "row_key"))


def rejected_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The requests that the same call refuses, with the rules they break."""
    arrived = readers.read_requests(spark, request_files(spark, sf), REQUEST_EXTRA)
    _, refused = service.answer(arrived, model_outputs, standin.lookups(spark, sf))
    return flat_rejected(refused)


def flat_rejected(refused: DataFrame) -> DataFrame:
    return refused.select(
        F.when(F.col(readers.BROKEN).isNull(), F.col("row_key")).alias("row_key"),
        F.array_join("violations", "; ").alias("violations"), readers.BROKEN,
    )


def request_choices(spark: SparkSession, sf: str) -> DataFrame:
    """Optional lists of allowed values, counted per violation."""
    choices = {"truck_type": ("BUILDING", "MACHINERY", "FURNITURE"), "month": S.FORM_CHOICES["month"]}
    _, rejected = requests.split_valid(standin.shipments(spark, sf), choices)
    return tidy(rejected.select(F.explode("violations").alias("violation")).groupBy("violation").agg(
        F.count(F.lit(1)).alias("n")
    ))


def request_defaults(spark: SparkSession, sf: str) -> DataFrame:
    given = standin.shipments(spark, sf).select(
        "row_key", F.when(F.col("l_linenumber") == 7, F.lit(False)).alias("apply_enrichment"),
        F.when(F.col("l_linenumber") == 1, F.lit(True)).alias("explain"),
    )
    return requests.with_defaults(given).select("row_key", "apply_enrichment", "explain")


def json_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests written as JSON records and read back with the declared schema, every field."""
    path = new_path(spark, "requests_json")
    names = [c for c in S.REQUESTS.fieldNames() if c not in S.REQUEST_OPTIONAL and c not in ("apply_enrichment", "explain")]
    writers.write_json(standin.shipments(spark, sf).select("row_key", *names, "route_vendor_reliability_sim"), path)
    back = requests.with_defaults(readers.read_requests(spark, path, REQUEST_EXTRA))
    return tidy(back.select("row_key", *S.REQUESTS.fieldNames()))


# --- Store ----------------------------------------------------------------------------


def _csv_files(spark: SparkSession, sf: str) -> dict[str, str]:
    """The three tables as CSV, with quotes, commas and line breaks in the notes."""
    folder = new_path(spark, "raw_csv")
    awkward = F.concat("notes", F.lit(' "fragile", \n keep dry'))
    tables = {
        "primary_shipments": standin.shipments(spark, sf).withColumn(
            "notes", F.when(F.col("l_linenumber") % 3 == 0, awkward).otherwise(F.col("notes"))
        ).select(*S.SHIPMENTS.fieldNames()),
        "vendor_stats": standin.known_vendors(spark, sf).withColumn("shipments", F.col("shipments").cast("int")),
        "route_stats": standin.routes(spark, sf).select(*S.ROUTE_STATS.fieldNames()),
    }
    for name, df in tables.items():
        writers.compressed(df.write).option("header", True).option("nullValue", "NA").option("escape", '"').csv(f"{folder}/{name}")
    return {name: f"{folder}/{name}" for name in tables}


def _csv_loaded(spark: SparkSession, sf: str) -> store.FeatureStore:
    files = _csv_files(spark, sf)
    kept = store.FeatureStore(spark, new_path(spark, "store"))
    kept.load_raw_tables(*files.values())
    return kept


def csv_store(spark: SparkSession, sf: str) -> DataFrame:
    """The shipments written as CSV, loaded into a store and read from it, every field."""
    return tidy(_csv_loaded(spark, sf).table("primary_shipments"))


def csv_store_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The three tables written as CSV, loaded into a store and counted from it."""
    kept = _csv_loaded(spark, sf)
    parts = [
        kept.table(name).agg(F.count(F.lit(1)).alias("rows"), F.sum(total).alias("total"), F.count(some).alias("filled"))
        .select(F.lit(name).alias("table_name"), "rows", F.round("total", 2).alias("total"), "filled")
        for name, total, some in (
            ("primary_shipments", "weight_kg", "delay_reason"), ("vendor_stats", "avg_delay_days", "on_time_rate"),
            ("route_stats", "distance_km", "destination"),
        )
    ]
    return tidy(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def store_lookups(spark: SparkSession, sf: str) -> DataFrame:
    """The lookups built from the stored vendor and route tables, vendors and routes one under the other."""
    kept = _csv_loaded(spark, sf)
    look = scoring.build_lookups(kept.table("vendor_stats"), kept.table("route_stats"))
    vendors = look.vendors.select(F.col("vendor_id").alias("key"), F.col("shipments").cast("long").alias("n"), F.col("on_time_rate").alias("rate"))
    routes = look.routes.select(
        texts.route_pair(F.col("origin"), F.col("destination")).alias("key"), F.col("sample_count").alias("n"),
        F.col("actual_delay_rate").alias("rate"),
    )
    return tidy(vendors.unionByName(routes))


def registered_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Stored tables under their own names in SQL."""
    kept = store.FeatureStore(spark, new_path(spark, "store"))
    kept.save(standin.known_vendors(spark, sf), "vendor_stats")
    kept.register("vendor_stats")
    return tidy(spark.sql("SELECT vendor_id, shipments, on_time_rate FROM vendor_stats WHERE on_time_rate >= 0.5"))


def store_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Vendors saved seven times, each time with more of them; an older version, and what the store still holds."""
    kept = store.FeatureStore(spark, new_path(spark, "store"), kept=3)
    vendors = materialise(standin.known_vendors(spark, sf), "vendors")
    for i in range(7):
        kept.save(vendors.filter(F.col("vendor_id").cast("int") % 7 <= i), "vendor_stats")
    log = kept.versions("vendor_stats")
    return tidy(kept.table("vendor_stats", version=5).select(
        "vendor_id", "shipments", log.agg(F.count(F.lit(1))).scalar().alias("versions_left"), log.agg(F.min("version")).scalar().alias("oldest"),
        F.lit(len(folders.names(spark, f"{kept.path('vendor_stats')}/log"))).alias("log_files"),
    ))


def malformed_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that do not fit: a word as a quantity, a thirteenth month."""
    path = new_path(spark, "bad_csv")
    n = F.col("l_linenumber")
    ships = standin.shipments(spark, sf).withColumns({
        "quantity": F.when(n == 2, F.lit("many")).when(n != 3, F.col("quantity").cast("string")),
        "order_date": F.when(n == 4, F.lit("2024-13-01")).otherwise(F.col("order_date").cast("string")),
    })
    ships.select(*S.SHIPMENTS.fieldNames()).write.option("header", True).option("nullValue", "NA").option("escape", '"').csv(path)
    return readers.malformed(spark, path, S.SHIPMENTS)


def table_profile(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(store.describe(standin.shipments(spark, sf).select(*S.SHIPMENTS.fieldNames())))


def table_preview(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(store.preview(standin.routes(spark, sf).select(*S.ROUTE_STATS.fieldNames()), ["distance_km", "shipment_id"]))


# --- Preparation and splits -----------------------------------------------------------


def clean_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """Clipped days, logs and filled numbers; a column without values is dropped."""
    ships = standin.shipments(spark, sf)
    rate = F.col("value_inr") / F.when(F.col("risk_score") > 0, F.col("risk_score"))
    endless = F.when(F.col("risk_score") > 0.9, F.lit(float("inf"))).otherwise(rate)
    df = features.with_logs(ships).select(
        "row_key", features.clipped_days(F.col("delay_days")).alias("days_clipped"),
        "log_value_inr", "log_weight_kg", "log_quantity", features.filled(endless).alias("filled"),
        F.lit(None).cast("double").alias("empty"), features.reason_any_row(F.col("delay_reason")).alias("reason"),
    )
    return tidy(scaling.drop_entirely_missing(df, ["days_clipped", "filled", "empty"]))


def scaled_features(spark: SparkSession, sf: str) -> DataFrame:
    names = ["quantity", "weight_kg", "value_inr", "risk_score", "vendor_on_time_rate"]
    df = _frame(spark, sf).select("row_key", *[F.col(c).cast("double").alias(c) for c in names])
    df = materialise(df, "to_scale")
    return tidy(scaling.scale(df, names, scaling.scale_statistics(df, names)))


def label_index(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct route pair and month with its alphabetical number."""
    df = _frame(spark, sf).select("route_pair", "month")
    return tidy(scaling.label_numbers(df, ["route_pair", "month"]))


def multitask_features(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(scaling.multitask_features(_frame(spark, sf)))


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Row keys and targets, stored once for the passes of a split."""
    ships = standin.shipments(spark, sf)
    return materialise(ships.select(
        "row_key", features.will_delay(F.col("on_time")).alias("will_delay"), "product_category"
    ), "labelled")


def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(splits.stratified_split(_labelled(spark, sf), "row_key", "will_delay"))


def folds(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(splits.stratified_folds(_labelled(spark, sf), "row_key", "product_category"))


def hash_split_missing_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A missing key is placed like any other: no row is on neither side."""
    keys = standin.table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") != 1, standin._row_key()).alias("row_key"))
    return splits.hash_split(keys, "row_key")


def finite_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Values that are not finite, per column, before and after they are filled."""
    ships = standin.shipments(spark, sf)
    endless = F.when(F.col("risk_score") > 0.9, F.lit(float("inf"))).when(F.col("quantity") == 1, F.lit(float("nan"))).otherwise(F.col("value_inr"))
    return scaling.not_finite(ships.select(endless.alias("raw"), features.filled(endless).alias("filled")), ["raw", "filled"])


def some_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The feature columns that a frame without some of them has."""
    frame = _frame(spark, sf).drop("risk_score", "truck_type", "route_pair")
    numeric, categorical = S.DEFAULT_FEATURES.present_in(frame.columns)
    return tidy(frame.select("row_key", *numeric, *categorical))


def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    keys = standin.table(spark, sf, "lineitem").select(standin._row_key().alias("row_key"))
    return splits.hash_split(keys, "row_key")


# --- Metrics ----------------------------------------------------------------------------


def _with_members(ships: DataFrame) -> DataFrame:
    df = ships.withColumn("will_delay", features.will_delay(F.col("on_time")))
    df = df.withColumns({name: standin.probability(model) for name, model in standin.MEMBERS.items()})
    df = df.withColumn("vote", N.mean_of(*[F.col(m) for m in standin.MEMBERS]))
    # Few decimals give tied scores, and the same ties in every engine.
    return df.withColumns({c: F.round(c, 4) for c in (*standin.MEMBERS, "vote")})


def soft_vote(spark: SparkSession, sf: str) -> DataFrame:
    ships = standin.shipments(spark, sf)
    vote = N.mean_of(*[standin.probability(m) for m in standin.MEMBERS.values()])
    mean = N.mean_of_arrays(*[standin.reason_probabilities(shift) for shift in range(5)])
    df = ships.select("row_key", vote.alias("vote"), E.is_delayed(vote).alias("will_delay"), mean.alias("mean"))
    return tidy(df.select(
        "row_key", "vote", "will_delay", N.argmax_index(F.transform("mean", lambda x: F.round(x, 9))).alias("best"),
        *[F.col("mean")[i].alias(f"p{i}") for i in range(len(standin.REASONS))],
    ))


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """Sigmoid of a logit and the class of the largest of three logits."""
    models = list(standin.MEMBERS.values())
    df = standin.shipments(spark, sf)
    votes = F.array(*[F.round(standin.logit(m), 9) for m in models])
    return tidy(df.select("row_key", N.sigmoid(standin.logit(models[0])).alias("p"), N.argmax_index(votes).alias("best")))


def binary_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(metrics.binary_metrics(_with_members(standin.shipments(spark, sf)).select("will_delay", "vote"), "will_delay", "vote"))


def member_metrics(spark: SparkSession, sf: str) -> DataFrame:
    names = [*standin.MEMBERS, "vote"]
    return tidy(metrics.member_metrics(materialise(_with_members(standin.shipments(spark, sf)).select("will_delay", *names), "members"), "will_delay", names))


def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    late = features.delayed_by_days(standin.shipments(spark, sf))
    df = late.select("delay_days", F.round(N.at_least(standin.model_days() + 4, 0.0), 6).alias("days_hat"))
    return tidy(metrics.regression_metrics(df, "delay_days", "days_hat"))


def _with_predicted_reason(frame: DataFrame) -> DataFrame:
    """A reason predicted right for odd quantities; one reason is never predicted."""
    late = features.delayed_with_reason(frame)
    guess = F.when(F.col("quantity") % 2 == 1, F.col("delay_reason")).otherwise(F.col("product_category"))
    return late.withColumn("predicted", F.when(guess == "PROMO", "SMALL").otherwise(guess))


def confusion_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(metrics.confusion(_with_predicted_reason(_late_frame(spark, sf)), "delay_reason", "predicted"))


def class_report(spark: SparkSession, sf: str) -> DataFrame:
    return tidy(metrics.class_report(metrics.confusion(_with_predicted_reason(_late_frame(spark, sf)), "delay_reason", "predicted")))


def report_averages(spark: SparkSession, sf: str) -> DataFrame:
    counts = metrics.confusion(_with_predicted_reason(_late_frame(spark, sf)), "delay_reason", "predicted")
    return tidy(metrics.report_averages(metrics.class_report(counts)))


def cv_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Macro F1 per fold of a five-fold split, then mean, spread and the pass flag."""
    late = materialise(
        _with_predicted_reason(_late_frame(spark, sf)).select("row_key", "delay_reason", "predicted"), "cv_rows"
    )
    folded = splits.stratified_folds(late, "row_key", "delay_reason")
    return tidy(metrics.cv_summary(metrics.macro_f1(folded, "delay_reason", "predicted", ("fold",))))


def best_fold(spark: SparkSession, sf: str) -> DataFrame:
    """The fold with the best macro F1 as the kept candidate."""
    late = materialise(
        _with_predicted_reason(_late_frame(spark, sf)).select("row_key", "delay_reason", "predicted"), "cv_rows"
    )
    folded = splits.stratified_folds(late, "row_key", "delay_reason")
    scores = metrics.macro_f1(folded, "delay_reason", "predicted", ("fold",))
    named = scores.withColumn("candidate", F.concat(F.lit("fold-"), F.col("fold")))
    return tidy(metrics.best_candidate(named, "candidate", "macro_f1", "fold"))


def task_losses(spark: SparkSession, sf: str) -> DataFrame:
    frame = standin.shipments(spark, sf).withColumns({
        "will_delay": features.will_delay(F.col("on_time")),
        "reason": features.reason_any_row(F.col("delay_reason")),
        "logit": standin.logit(standin.BASE_MODEL), "days_hat": standin.model_days(),
    })
    weights = materialise(profiles.class_weights(frame, "reason"), "class_weights").select("reason", "inverse_weight")
    df = lookup_join(frame, weights, ["reason"]).withColumn("p_reason", (F.col("quantity") + 1) / 60.0)
    return tidy(metrics.task_losses(df, "will_delay", "logit", "delay_days", "days_hat", "p_reason", "inverse_weight"))


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Average and upper percentiles of the event values, as of a latency log."""
    events = standin.table(spark, sf, "events").select("value")
    points = percentiles(events, "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return tidy(points.withColumn("average", events.agg(F.avg("value").alias("a")).scalar()))


#: What the report reads of a shipment.
REPORT_COLUMNS = (
    "supplier_name", "origin_city", "destination_city", "route_pair", "product_category", "quantity", "risk_score", "on_time",
    "will_delay", "delay_days", "delay_reason", "route_vendor_reliability_sim", "l_linenumber",
)


def metrics_report(spark: SparkSession, sf: str) -> DataFrame:
    """The report document, written as JSON and read back, with every field on a row of its own."""
    look, names = standin.lookups(spark, sf), [*standin.MEMBERS, "vote"]
    frame = materialise(_frame(spark, sf, look.vendors).select(*REPORT_COLUMNS), "report_frame")  # the shipments are built once
    votes = materialise(_with_members(frame).select("will_delay", *names), "votes")
    late = features.delayed_by_days(frame).withColumn("days_hat", F.round(N.at_least(standin.model_days() + 4, 0.0), 6))
    classes = materialise(metrics.class_report(metrics.confusion(_with_predicted_reason(frame), "delay_reason", "predicted")), "classes")
    scored = _scored_labels(scoring.score(standin.with_model_outputs(frame), look))
    document = reports.metrics_document(
        profiles.dataset_facts(frame, look.vendors), metrics.binary_metrics(votes.select("will_delay", "vote"), "will_delay", "vote"),
        metrics.regression_metrics(late, "delay_days", "days_hat"), metrics.report_averages(classes),
        reports.enrichment_impact(scored, "label"), metrics.member_metrics(votes, "will_delay", names),
        classes, latency_percentiles(spark, sf),
    )
    path = new_path(spark, "metrics_report")
    writers.write_json(document, path)
    back = spark.read.schema(document.schema).json(path)
    fields = []
    for section in document.schema.fields:
        if isinstance(section.dataType, T.StructType):
            fields += [F.struct(
                F.lit(section.name).alias("section"), F.lit(f.name).alias("field"), F.col(f"{section.name}.{f.name}").cast("string").alias("text"),
            ) for f in section.dataType.fields]
    single = back.select(F.explode(F.array(*fields)).alias("f")).select("f.*")
    many = [
        back.select(F.explode(name).alias("r")).select(
            F.lit(name).alias("section"), F.explode(F.array(*[
                F.struct(F.concat_ws(".", F.col(f"r.{key}"), F.lit(c)).alias("field"), F.col(f"r.{c}").cast("string").alias("text")) for c in values
            ])).alias("f")).select("section", "f.field", "f.text")
        for name, key, values in (("members", "member", ("accuracy", "auc")), ("classes", "label", ("support", "precision", "recall", "f1")))
    ]
    every = single.unionByName(many[0]).unionByName(many[1])
    number = F.col("text").try_cast("double")
    return tidy(every.select("section", "field", number.alias("value"), F.when(number.isNull(), F.col("text")).alias("text")))


QUERIES = [
    enriched_score, training_frame, route_profile, vendor_profile, vendor_dedup, unknown_keys, autofill, health, service_health,
    reason_distribution, rare_reasons, class_weights, dataset_facts, vendor_adjust, route_blend, contexts,
    score_response, prompts, explain_batch, explain_with_client, top3_reasons, risk_bands, waterfall,
    enrichment_impact, route_labels, validate_requests, request_answers, rejected_requests, request_choices, request_defaults,
    json_requests, csv_store, csv_store_counts, store_lookups, registered_tables, malformed_cells,
    store_versions, colocated_frame, prepared_frame, table_profile, table_preview, clean_numeric, finite_guard, some_columns, scaled_features, label_index,
    multitask_features, stratified_split, folds, hash_split, hash_split_missing_keys, soft_vote, logits, binary_metrics,
    member_metrics, regression_metrics, confusion_counts, class_report, report_averages, cv_summary, best_fold, task_losses,
    latency_percentiles, metrics_report,
]
