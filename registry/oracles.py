"""The same results as SQL over the given tables, for DuckDB."""

from __future__ import annotations

from registry.standin import BASE_MODEL, HAIR, MEMBERS, REASON_SHARES, REASONS

_DAYS = "greatest(CAST(0 AS DOUBLE), l_quantity - (18 + l_suppkey % 20))"
_KEY = (
    "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "CAST(round(l_extendedprice * 100) AS BIGINT), strftime(l_shipdate, '%Y-%m-%d'))"
)

SHIPS = f"""
lines AS (
  SELECT concat(l_orderkey, '-', l_linenumber) AS shipment_id, {_KEY} AS row_key,
    CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date,
    CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS expected_delivery_date,
    CAST(CAST(l_shipdate AS DATE) + CAST({_DAYS} AS INTEGER) AS VARCHAR) AS actual_delivery_date,
    sn.n_name AS origin_city, cn.n_name AS destination_city, sr.r_name AS origin_state, cr.r_name AS destination_state,
    p_type AS product_category, CAST(l_suppkey AS VARCHAR) AS supplier_name, o_orderpriority AS carrier_name,
    c_mktsegment AS truck_type, CAST(l_quantity AS BIGINT) AS quantity, p_size * l_quantity / 50 AS weight_kg,
    l_extendedprice AS value_inr, abs(l_tax) AS gst_rate, {_DAYS} AS delay_days,
    CASE WHEN {_DAYS} > 0 THEN 'No' ELSE 'Yes' END AS on_time,
    CASE WHEN {_DAYS} > 0 AND l_tax > 0 THEN p_type END AS delay_reason,
    l_returnflag AS weather_impact, l_linestatus AS festival_impact, abs(l_discount) * 10 AS risk_score,
    o_orderstatus AS status, p_name AS notes, monthname(l_shipdate) AS month,
    1 - l_tax * 10 AS reliability, l_extendedprice / 50 AS distance_km, abs(l_discount) * 5 AS delay_probability_sim,
    CASE WHEN {_DAYS} > 0 THEN 1 ELSE 0 END AS lateness_flag,
    l_suppkey, l_orderkey, l_linenumber, s_nationkey, c_nationkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region sr ON sn.n_regionkey = sr.r_regionkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region cr ON cn.n_regionkey = cr.r_regionkey
)"""

VENDORS = """
vendors AS (
  SELECT supplier_name AS vendor_id, count(*) AS shipments, avg(delay_days) AS avg_delay_days,
    avg(CASE WHEN on_time = 'Yes' THEN 1.0 ELSE 0.0 END::DOUBLE) AS on_time_rate, avg(value_inr) AS avg_cost
  FROM lines WHERE l_suppkey % 17 <> 0 GROUP BY supplier_name
)"""

_ROUTE_AGG = """
  SELECT origin_city AS origin, destination_city AS destination, avg(delay_probability_sim) AS avg_delay_prob,
    stddev_samp(delay_probability_sim) AS std_delay_prob, count(delay_probability_sim) AS sample_count,
    avg(distance_km) AS avg_distance, avg(reliability) AS avg_reliability,
    avg(CAST(lateness_flag AS DOUBLE)) AS actual_delay_rate
  FROM lines"""

ROUTES = f"""
routes AS ({_ROUTE_AGG} WHERE (s_nationkey + c_nationkey) % 11 <> 0 GROUP BY ALL
)"""


def _logit(model: tuple[float, ...]) -> str:
    b, q, r, v = (f"CAST({x!r} AS DOUBLE)" for x in model)
    return f"({b} + quantity * {q} + risk_score * {r} + reliability * {v})"


def _p(model: tuple[float, ...]) -> str:
    return f"1 / (1 + exp(-{_logit(model)}))"


_SHIFT = (
    f"CASE WHEN on_time_rate >= 0.65::DOUBLE THEN -0.10::DOUBLE WHEN on_time_rate <= 0.50::DOUBLE THEN 0.15::DOUBLE "
    f"ELSE 0.15::DOUBLE + (on_time_rate - 0.50::DOUBLE) / 0.15::DOUBLE * (-0.25)::DOUBLE END"
)
_TIER = (
    "CASE WHEN on_time_rate >= 0.65::DOUBLE THEN 'EXCELLENT' WHEN on_time_rate >= 0.55::DOUBLE THEN 'GOOD' "
    "WHEN on_time_rate >= 0.45::DOUBLE THEN 'AVERAGE' ELSE 'POOR' END"
)

HISTORY = f"""
history AS (
  SELECT lines.*, v.vendor_id IS NOT NULL AS vendor_found, v.on_time_rate, v.avg_delay_days, v.shipments,
    r.origin IS NOT NULL AS route_found, r.actual_delay_rate, r.sample_count, r.std_delay_prob, r.avg_distance,
    CASE WHEN r.origin IS NULL THEN 0::DOUBLE ELSE
      least(1, greatest(0, (1 / (1 + exp(-0.1::DOUBLE * (r.sample_count - 50)))
        + coalesce(greatest(0, 1 - r.std_delay_prob / 0.3::DOUBLE), 0)) / 2)) END AS confidence,
    {_p(BASE_MODEL)} AS raw
  FROM lines LEFT JOIN vendors v ON supplier_name = v.vendor_id
  LEFT JOIN routes r ON origin_city = r.origin AND destination_city = r.destination
)"""

_W = (
    "CASE WHEN confidence >= 0.7::DOUBLE THEN 0.8::DOUBLE WHEN confidence <= 0.4::DOUBLE THEN 0.5::DOUBLE "
    "ELSE 0.5::DOUBLE + (confidence - 0.4::DOUBLE) / 0.3::DOUBLE * 0.3::DOUBLE END"
)

SCORED = f"""
shifted AS (
  SELECT *, CASE WHEN vendor_found THEN least(1, greatest(0, raw + ({_SHIFT}))) ELSE raw END AS vendor_p,
    {_W} AS w FROM history
),
enriched AS (
  SELECT *, CASE WHEN route_found THEN least(1, greatest(0, w * vendor_p + (1 - w) * actual_delay_rate))
    ELSE vendor_p END AS enriched_p FROM shifted
),
decided AS (
  SELECT *, CASE WHEN l_linenumber <> 7 THEN enriched_p ELSE raw END AS final_p FROM enriched
),
scored AS (
  SELECT *, final_p >= 0.5::DOUBLE AS late,
    CASE WHEN final_p >= 0.5::DOUBLE THEN greatest(0, (quantity - 25) * 0.22::DOUBLE + risk_score) ELSE 0 END AS days
  FROM decided
)"""


def _reason_p(shift: int = 0) -> list[str]:
    shares = ", ".join(f"{p}::DOUBLE" for p in REASON_SHARES)
    return [
        f"[{shares}][(quantity + l_linenumber * {shift + 1} + {k}) % {len(REASONS)} + 1]" for k in range(len(REASONS))
    ]


TOP = "top AS (SELECT row_key, reason, p, row_number() OVER (PARTITION BY row_key ORDER BY p DESC, reason) - 1 AS place FROM (" + " UNION ALL ".join(
    f"SELECT row_key, '{name}' AS reason, {p} AS p FROM lines" for name, p in zip(REASONS, _reason_p())
) + "))"

FRAME = """
frame AS (
  SELECT lines.*, CASE WHEN on_time = 'Yes' THEN 0 ELSE 1 END AS will_delay, v.avg_delay_days AS vendor_avg_delay_days,
    v.on_time_rate AS vendor_on_time_rate, concat(origin_city, '->', destination_city) AS route_pair
  FROM lines LEFT JOIN vendors v ON supplier_name = v.vendor_id
)"""


def rounded(expression: str) -> str:
    """6 decimals, up by a hair first (see ``queries.tidy``), and no -0.0."""
    return f"round(({expression}) + CAST({HAIR!r} AS DOUBLE), 6) + 0::DOUBLE"


def r6(*columns: str) -> str:
    """Columns rounded to 6 decimals; ``x AS name`` rounds the expression."""
    out = []
    for c in columns:
        expression, _, name = c.rpartition(" AS ") if " AS " in c else (c, "", c)
        out.append(f"{rounded(expression)} AS {name}")
    return ", ".join(out)


def sql(*parts: str) -> str:
    """CTEs followed by the final SELECT."""
    *ctes, last = parts
    return "WITH " + ",".join(ctes) + " " + last


_HIST = (SHIPS, VENDORS, ROUTES, HISTORY)
_SCORE = (*_HIST, SCORED)
_FIX = "CAST(format('{{:.{1}f}}', {0}) AS DOUBLE)".format
_PREDICTED = """
guessed AS (
  SELECT row_key, coalesce(delay_reason, 'Unknown') AS actual,
    CASE WHEN quantity % 2 = 1 THEN coalesce(delay_reason, 'Unknown') ELSE product_category END AS g
  FROM frame WHERE will_delay = 1
),
pred AS (SELECT row_key, actual, CASE WHEN g = 'PROMO' THEN 'SMALL' ELSE g END AS predicted FROM guessed)"""


def _report(by: str = "") -> str:
    b, on, using = (f"{by}, ", f"a.{by} = c.{by} AND ", "") if by else ("", "", "")
    return f"""
labels AS (SELECT {b}actual AS label FROM cases UNION SELECT {b}predicted FROM cases),
report AS (
  SELECT {'a.' + by + ', ' if by else ''}a.label, count(*) FILTER (c.actual = a.label) AS support,
    count(*) FILTER (c.predicted = a.label) AS said,
    count(*) FILTER (c.actual = a.label AND c.predicted = a.label) AS tp
  FROM labels a JOIN cases c ON {on}(c.actual = a.label OR c.predicted = a.label) GROUP BY ALL
),
rated AS (
  SELECT {b}label, support, CASE WHEN said = 0 THEN 0 ELSE tp / said END AS precision,
    CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall, 2 * tp / (said + support) AS f1 FROM report
)"""


_FOLDS = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5(concat(row_key, '|42'))) AS rn,
    count(*) OVER (PARTITION BY {label}) AS total FROM {source}
),
folded AS (
  SELECT *, CAST(CASE WHEN rn <= total * 1 // 5 THEN 0 WHEN rn <= total * 2 // 5 THEN 1 WHEN rn <= total * 3 // 5 THEN 2
    WHEN rn <= total * 4 // 5 THEN 3 ELSE 4 END AS BIGINT) AS fold FROM ranked
)"""

_VOTE = " + ".join(f"({_p(m)})" for m in MEMBERS.values())
_MEMBERS = (
    "members AS (SELECT lateness_flag AS y, "
    + ", ".join(f"round({_p(m)}, 4) AS {n}" for n, m in MEMBERS.items())
    + f", round(({_VOTE}) / 3, 4) AS vote FROM lines)"
)


def _auc(score: str) -> str:
    return (
        f"(SELECT (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE)"
        f" / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) FROM (SELECT y, rank() OVER (ORDER BY {score})"
        f" + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0::DOUBLE AS r FROM members))"
    )


_REQUIRED = (
    "origin_city", "destination_city", "origin_state", "destination_state", "product_category", "supplier_name", "carrier_name",
    "truck_type", "month", "quantity", "weight_kg", "value_inr", "risk_score",
)
_DEFECTS = f"""
asked AS (
  SELECT *, (l_orderkey * 7 + l_linenumber) % 48 AS n, CASE (l_orderkey * 7 + l_linenumber) % 48
    {' '.join(f"WHEN {i} THEN '{c}: field required'" for i, c in enumerate(_REQUIRED))}
    WHEN 13 THEN 'quantity: must be greater than 0' WHEN 14 THEN 'weight_kg: must be greater than 0'
    WHEN 15 THEN 'value_inr: must be greater than 0' WHEN 16 THEN 'risk_score: must be between 0 and 1'
    WHEN 17 THEN 'quantity: not a valid int' WHEN 18 THEN 'weight_kg: not a valid double'
    WHEN 19 THEN 'apply_enrichment: not a valid boolean' WHEN 20 THEN 'record: not valid JSON' ELSE '' END AS violations,
    CASE WHEN (l_orderkey * 7 + l_linenumber) % 48 = 20 THEN concat('{{"row_key":"', row_key, '","quantity":') END AS broken_record
  FROM lines
)"""
_CHECKED = "SELECT CASE WHEN broken_record IS NULL THEN row_key END AS row_key, violations, broken_record FROM asked"

_COLUMNS = [
    ("shipment_id", "string"), ("order_date", "date"), ("expected_delivery_date", "date"),
    ("actual_delivery_date", "date"), ("origin_city", "string"), ("destination_city", "string"),
    ("origin_state", "string"), ("destination_state", "string"), ("product_category", "string"),
    ("supplier_name", "string"), ("carrier_name", "string"), ("truck_type", "string"), ("quantity", "int"),
    ("weight_kg", "double"), ("value_inr", "double"), ("gst_rate", "double"), ("on_time", "string"),
    ("delay_days", "double"), ("delay_reason", "string"), ("weather_impact", "string"), ("festival_impact", "string"),
    ("risk_score", "double"), ("status", "string"), ("notes", "string"), ("month", "string"),
]

_RESPONSE = f"""
answered AS (
  SELECT row_key, late AS will_delay, {_FIX('final_p', 3)} AS delay_probability,
    {_FIX('days', 2)} AS estimated_delay_days, CASE WHEN late THEN t.reason ELSE 'No Delay Expected' END AS delay_reason,
    CASE WHEN late THEN t.p ELSE 0 END AS confidence_reason, {_FIX('raw', 3)} AS raw_model_probability,
    {_FIX('final_p - raw', 3)} AS vendor_adjustment,
    CASE WHEN vendor_found THEN {_TIER} ELSE 'UNKNOWN' END AS vendor_tier, {_FIX('confidence', 3)} AS route_confidence,
    CASE WHEN vendor_found THEN {_FIX('on_time_rate', 3)} ELSE 0 END AS vendor_on_time_rate,
    CASE WHEN route_found THEN {_FIX('actual_delay_rate', 3)} ELSE 0 END AS route_historical_delay,
    l_linenumber <> 7 AS enrichment_applied, l_linenumber = 1 AS explain, (l_orderkey * 7 + l_linenumber) % 48 AS n,
    vendor_p - raw AS vendor_delta, enriched_p - vendor_p AS route_delta, CASE WHEN late THEN t.names ELSE '' END AS reason_top3,
    CASE WHEN late THEN t.total ELSE 0 END AS top3_probability,
    concat(origin_city, '->', destination_city) AS route, supplier_name AS vendor,
    origin_city, destination_city, product_category, weight_kg, value_inr
  FROM scored JOIN (SELECT row_key, first(reason ORDER BY place) AS reason, first(p ORDER BY place) AS p,
    string_agg(reason, '>' ORDER BY place) AS names, sum(p) AS total FROM (SELECT DISTINCT * FROM top WHERE place < 3) GROUP BY row_key) t USING (row_key)
)"""

_FIELDS = """row_key, will_delay, {0}, delay_reason, {1}, vendor_tier, {2}, 'v2.0' AS model_version, enrichment_applied, route, vendor,
  reason_top3, '2025-01-31 12:00:00' AS scored_at"""

_PCT = "format('{{:.1f}}%', {0} * 100)".format
_PROMPT = "concat(" + ", ".join([
    "'Explain this shipment delay prediction:\n\n**SHIPMENT:**\n- Route: '", "origin_city", "'→'", "destination_city",
    "'\n- Vendor: '", "vendor", "' (Tier: '", "vendor_tier", "', On-time Rate: '", _PCT("vendor_on_time_rate"),
    "')\n- Product: '", "product_category", "', Weight: '", "format('{:.0f}', weight_kg)", "'kg, Value: ₹'",
    "format('{:,.0f}', value_inr)", "'\n\n**PREDICTION:**\n- Delay Expected: '",
    "CASE WHEN will_delay THEN 'YES' ELSE 'NO' END", "'\n- Delay Probability: '", _PCT("delay_probability"),
    "'\n- Estimated Delay: '", "format('{:.1f}', estimated_delay_days)", "' days\n- Primary Reason: '", "delay_reason",
    "'\n\n**ANALYSIS:**\n- Base Model: '", _PCT("raw_model_probability"), "' delay probability\n- Vendor Impact: '",
    "format('{:+.1f}%', vendor_adjustment * 100)", "' adjustment\n- Route History: '", _PCT("route_historical_delay"),
    "' past delay rate\n\nGenerate a professional 3-4 sentence explanation for the logistics manager.'",
]) + ")"

_SCALED = ("quantity", "weight_kg", "value_inr", "risk_score", "vendor_on_time_rate")


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["training_frame"] = sql(SHIPS, VENDORS, f"""
      SELECT l.shipment_id, l.order_date, l.expected_delivery_date, l.actual_delivery_date, l.origin_city,
        l.destination_city, l.origin_state, l.destination_state, l.product_category, l.supplier_name, l.carrier_name,
        l.truck_type, l.quantity, {r6('l.weight_kg AS weight_kg', 'l.value_inr AS value_inr', 'l.gst_rate AS gst_rate')},
        l.on_time, {r6('l.delay_days AS delay_days')}, l.delay_reason, l.weather_impact, l.festival_impact,
        {r6('l.risk_score AS risk_score')}, l.status, l.notes, l.month,
        CAST(CASE WHEN l.on_time = 'Yes' THEN 0 ELSE 1 END AS BIGINT) AS will_delay,
        {r6('v.avg_delay_days AS vendor_avg_delay_days', 'v.on_time_rate AS vendor_on_time_rate',
            'r.l_extendedprice / 50 AS route_distance_km', '1 - r.l_tax * 10 AS route_vendor_reliability_sim',
            'abs(r.l_discount) * 5 AS route_delay_probability_sim',
            'l.value_inr / greatest(l.weight_kg, 1) AS value_per_kg')},
        concat(l.origin_city, '->', l.destination_city) AS route_pair
      FROM lines l LEFT JOIN vendors v ON l.supplier_name = v.vendor_id
      LEFT JOIN lineitem r ON l.shipment_id = concat(r.l_orderkey, '-', r.l_linenumber)""")
    q["route_profile"] = sql(SHIPS, f"routes AS ({_ROUTE_AGG} GROUP BY ALL)", f"""
      SELECT origin, destination, {r6('avg_delay_prob', 'std_delay_prob')}, sample_count,
        {r6('avg_distance', 'avg_reliability', 'actual_delay_rate')} FROM routes""")
    q["vendor_profile"] = f"""
      SELECT CAST(l_suppkey AS VARCHAR) AS vendor_id, count(*) AS shipments,
        {r6(f'avg({_DAYS}) AS avg_delay_days', f'avg(CASE WHEN {_DAYS} = 0 THEN 1.0 ELSE 0.0 END::DOUBLE) AS on_time_rate',
            'avg(l_extendedprice) AS avg_cost')}
      FROM lineitem GROUP BY l_suppkey"""
    q["vendor_dedup"] = f"""
      WITH f AS (SELECT CAST(l_suppkey AS VARCHAR) AS vendor_id, count(*) AS shipments, avg(l_quantity) AS avg_delay_days,
        avg(CASE WHEN l_quantity < 25 THEN 1.0 ELSE 0.0 END::DOUBLE) AS on_time_rate, avg(l_extendedprice) AS avg_cost
        FROM lineitem GROUP BY l_suppkey, l_returnflag)
      SELECT vendor_id, shipments, {r6('avg_delay_days', 'on_time_rate', 'avg_cost')} FROM f
      QUALIFY row_number() OVER (PARTITION BY vendor_id
        ORDER BY shipments DESC, on_time_rate DESC, avg_delay_days DESC, avg_cost DESC) = 1"""
    q["unknown_keys"] = sql(SHIPS, """
      SELECT 'vendor' AS kind, supplier_name AS key, count(*) AS rows FROM lines WHERE l_suppkey % 17 = 0 GROUP BY ALL
      UNION ALL SELECT 'route', concat(origin_city, '->', destination_city), count(*) FROM lines
      WHERE (s_nationkey + c_nationkey) % 11 = 0 GROUP BY ALL""")
    q["autofill"] = sql(SHIPS, VENDORS, ROUTES, f"""
      SELECT row_key, supplier_name, origin_city, destination_city,
        {r6('v.avg_delay_days AS vendor_avg_delay_days',
            'CASE WHEN l_linenumber % 2 = 0 THEN 0.5 ELSE v.on_time_rate END AS vendor_on_time_rate',
            'r.avg_distance AS route_distance_km',
            'CASE WHEN l_linenumber % 2 = 0 THEN reliability ELSE r.avg_reliability END AS route_vendor_reliability_sim',
            'r.avg_delay_prob AS route_delay_probability_sim')}
      FROM lines LEFT JOIN vendors v ON supplier_name = vendor_id
      LEFT JOIN routes r ON origin_city = origin AND destination_city = destination""")
    q["health"] = sql(SHIPS, VENDORS, """
      SELECT *, primary_rows > 0 AND vendor_rows > 0 AND route_rows > 0 AS healthy FROM (
        SELECT (SELECT count(*) FROM lines) AS primary_rows, (SELECT count(*) FROM vendors) AS vendor_rows,
          (SELECT count(*) FROM lines) AS route_rows)""")
    q["service_health"] = sql(SHIPS, VENDORS, ROUTES, """
      SELECT 'healthy' AS status, true AS enrichment_enabled, (SELECT count(*) FROM vendors) AS vendor_count,
        (SELECT count(*) FROM routes) AS route_count""")
    late = "late AS (SELECT coalesce(delay_reason, 'Unknown') AS delay_reason FROM frame WHERE will_delay = 1)"
    share = f"SELECT delay_reason, count(*) AS n, {r6('count(*) / sum(count(*)) OVER () AS share')} FROM late GROUP BY ALL"
    q["reason_distribution"] = sql(SHIPS, VENDORS, FRAME, late, f"{share} ORDER BY n DESC, delay_reason LIMIT 10")
    q["rare_reasons"] = sql(SHIPS, VENDORS, FRAME, late, f"SELECT * FROM ({share}) WHERE share < 0.16::DOUBLE")
    counts = "counts AS (SELECT coalesce(delay_reason, 'None') AS reason, count(*) AS n FROM lines GROUP BY ALL)"
    q["class_weights"] = sql(SHIPS, counts, f"""
      SELECT reason, n, {r6('(1 / n) / avg(1 / n) OVER () AS inverse_weight', 'max(n) OVER () / n AS balanced_weight')}
      FROM counts""")
    q["dataset_facts"] = sql(SHIPS, VENDORS, FRAME, f"""
      SELECT (SELECT count(*) FROM frame) AS rows, {r6('(SELECT avg(CAST(will_delay AS DOUBLE)) FROM frame) AS delay_rate',
        '(SELECT min(on_time_rate) FROM vendors) AS vendor_on_time_min',
        '(SELECT max(on_time_rate) FROM vendors) AS vendor_on_time_max')}, route_pair AS busiest_route,
        n AS busiest_route_rows FROM (SELECT route_pair, count(*) AS n FROM frame GROUP BY ALL) ORDER BY n DESC, route_pair LIMIT 1""")
    half = f"least(1, greatest(0, raw + ({_SHIFT}) * 0.5::DOUBLE))"
    q["vendor_adjust"] = sql(*_HIST, f"""
      SELECT row_key, vendor_found, {r6(f'CASE WHEN vendor_found THEN {_SHIFT} ELSE 0 END AS shift',
        f'CASE WHEN vendor_found THEN least(1, greatest(0, raw + ({_SHIFT}))) ELSE raw END AS adjusted',
        f'CASE WHEN vendor_found THEN {half} ELSE raw END AS half_adjusted')},
        CASE WHEN vendor_found THEN {_TIER} ELSE 'UNKNOWN' END AS tier FROM history""")
    blend = f"CASE WHEN route_found THEN least(1, greatest(0, ({_W}) * raw + (1 - ({_W})) * actual_delay_rate)) ELSE raw END"
    q["route_blend"] = sql(*_HIST, f"""
      SELECT row_key, route_found, {r6('confidence AS route_confidence',
        f'CASE WHEN route_found THEN {_W} ELSE 1 END AS model_weight', f'{blend} AS blended')} FROM history""")
    q["enriched_score"] = sql(*_SCORE, TOP, f"""
      SELECT row_key, shipment_id, {r6('raw AS raw_probability', 'vendor_p AS vendor_probability',
        'enriched_p AS enriched_probability', 'confidence AS route_confidence', 'final_p AS delay_probability')},
        late AS will_delay, {r6('days AS estimated_delay_days')},
        CASE WHEN late THEN reason ELSE 'No Delay Expected' END AS delay_reason,
        {r6('vendor_p - raw AS vendor_delta', 'enriched_p - vendor_p AS route_delta')}
      FROM scored JOIN (SELECT row_key, reason FROM top WHERE place = 0) USING (row_key)""")
    found = "CASE WHEN {0} THEN {1} END".format
    q["contexts"] = sql(*_HIST, f"""
      SELECT row_key, vendor_found, supplier_name AS vendor_id, {r6('on_time_rate', 'avg_delay_days')},
        coalesce(shipments, 0) AS total_shipments, {found('vendor_found', _TIER)} AS tier,
        {found('NOT vendor_found', "'Unknown vendor - no historical data'")} AS vendor_message, route_found,
        concat(origin_city, '->', destination_city) AS route, {r6('actual_delay_rate AS historical_delay_rate')},
        coalesce(sample_count, 0) AS sample_size,
        {r6(found('route_found', 'coalesce(greatest(0, 1 - std_delay_prob), 0)') + ' AS consistency',
            found('route_found', 'confidence') + ' AS confidence', 'avg_distance AS avg_distance_km')},
        {found('NOT route_found', "'Unknown route - no historical data'")} AS route_message FROM history""")
    answered = (*_SCORE, TOP, _RESPONSE)
    fields = _FIELDS.format(r6("delay_probability", "estimated_delay_days"), r6(
        "confidence_reason AS confidence", "raw_model_probability", "vendor_adjustment", "0 AS route_adjustment"),
        r6("route_confidence", "vendor_on_time_rate", "route_historical_delay", "vendor_delta", "route_delta", "top3_probability"))
    q["score_response"] = sql(*answered, f"SELECT {fields}, NULL::VARCHAR AS explanation FROM answered")
    valid = "n > 20"
    q["request_answers"] = sql(*answered, f"""
      SELECT {fields}, CASE WHEN n = 21 THEN 'LLM explanations unavailable - API key not configured' END AS explanation
      FROM answered WHERE {valid}""")
    q["stream_score"] = q["request_answers"]
    q["rejected_requests"] = sql(SHIPS, _DEFECTS, f"{_CHECKED} WHERE NOT {valid}")
    q["stream_rejected"] = q["rejected_requests"]
    q["stream_counters"] = sql(SHIPS, VENDORS, ROUTES, _DEFECTS, f"""
      SELECT count(*) FILTER ({valid}) AS valid_rows, count(*) FILTER (NOT {valid}) AS rejected_rows,
        (SELECT count(*) FROM vendors) AS vendor_count, (SELECT count(*) FROM routes) AS route_count FROM asked""")
    q["ml_stream"] = sql(SHIPS, _DEFECTS, f"SELECT row_key, true AS gated, true AS is_probability FROM asked WHERE {valid}")
    sides = """
      SELECT CAST({0} AS VARCHAR) AS label, is_test, count(*) AS rows{2} FROM (
        SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY md5(concat(row_key, '|42')))
          <= floor(count(*) OVER (PARTITION BY {0}) * 0.2::DOUBLE + 0.5::DOUBLE) AS is_test FROM {1}) GROUP BY ALL""".format
    q["ml_binary"] = sql(SHIPS, sides("lateness_flag", "lines", "".join(
        f", true AS {c}" for c in ("four_members", "whole_size", "half_the_error", "scores_are_kept", "logged_rounds"))))
    q["ml_days"] = sql(SHIPS, f"""
      SELECT 'late' AS label, CAST(concat('0x', substr(md5(concat(row_key, '|42')), 1, 8)) AS BIGINT) < {int(0.2 * 2**32)} AS is_test,
        count(*) AS rows, true AS whole_size, true AS explains_most, true AS scores_are_kept FROM lines WHERE delay_days > 0 GROUP BY ALL""")
    named = "named AS (SELECT row_key, coalesce(delay_reason, 'Unknown') AS reason FROM lines WHERE lateness_flag = 1)"
    supported = "SELECT *, (SELECT max(rows) FROM parts t WHERE t.label = parts.label AND t.is_test) AS support FROM parts"
    for name, holds in (("ml_reason", ("boosted_at_least_forest", "best_is_kept", "stopped_early")), ("ml_seed_ensemble", ())):
        true = "".join(f", true AS {c}" for c in ("classes_in_order", "far_above_majority", "whole_size", *holds))
        q[name] = sql(SHIPS, named, f"parts AS ({sides('reason', 'named', true)})", supported)
    q["training_log"] = """
      SELECT 'reasons' AS model, true AS best_is_kept, 10::BIGINT AS rounds_after_best, true AS every_round, true AS has_loss
      FROM lineitem LIMIT 1"""
    q["ml_cv"] = sql(SHIPS, named, _FOLDS.format(label="reason", source="named"), """
      SELECT fold, count(*) AS rows, true AS far_above_majority, true AS passed FROM folded GROUP BY fold""")
    q["ml_score"] = sql(SHIPS, "SELECT row_key, " + ", ".join(
        f"true AS {c}" for c in ("decision_follows", "gated", "enriched", "shares_sum", "loaded_equals_saved")) + " FROM lines")
    q["prompts"] = sql(*answered, f"SELECT row_key, {_PROMPT} AS prompt FROM answered")
    q["explain_batch"] = sql(SHIPS, """
      SELECT row_key, CASE WHEN l_linenumber = 1 THEN 'LLM explanations unavailable - API key not configured' END
        AS explanation FROM lines""")
    q["explain_with_client"] = sql(*answered, f"""
      SELECT row_key, CASE WHEN explain THEN concat(length({_PROMPT}), ' characters') END AS explanation FROM answered""")
    q["top3_reasons"] = sql(SHIPS, TOP, f"SELECT row_key, place, reason, {r6('p AS probability')} FROM top WHERE place < 3")
    q["risk_bands"] = sql(*_SCORE, """
      SELECT CASE WHEN final_p * 100 < 30 THEN 'low' WHEN final_p * 100 < 60 THEN 'medium' ELSE 'high' END AS risk_band,
        late AS above_threshold, count(*) AS n FROM scored GROUP BY ALL""")
    q["waterfall"] = sql(*_SCORE, " UNION ALL ".join(
        f"SELECT row_key, '{step}' AS step, {r6(f'{x} AS value')} FROM scored" for step, x in (
            ("Base Model", "raw * 100"), ("Vendor Adjustment", "(final_p - raw) * 100"), ("Final Prediction", "final_p * 100"))))
    right = "avg(CASE WHEN ({0} >= 0.5::DOUBLE) = (lateness_flag = 1) THEN 1 ELSE 0 END::DOUBLE)".format
    q["enrichment_impact"] = sql(*_SCORE, f"""
      SELECT {r6('avg(abs(enriched_p - raw)) AS avg_adjustment', right('raw') + ' AS accuracy_without_enrichment',
        right('enriched_p') + ' AS accuracy_with_enrichment',
        right('enriched_p') + ' - ' + right('raw') + ' AS improved_accuracy')},
        count(DISTINCT supplier_name) FILTER (vendor_found) AS vendors_adjusted,
        count(DISTINCT (origin_city, destination_city)) FILTER (route_found) AS routes_validated FROM scored""")
    q["route_labels"] = sql(SHIPS, """
      SELECT row_key, CASE WHEN l_linenumber % 3 <> 0 THEN origin_city || '->' || destination_city END AS route_pair,
        concat(origin_city, '->', CASE WHEN l_linenumber % 3 <> 0 THEN destination_city ELSE 'None' END) AS route_label
      FROM lines""")
    q["validate_requests"] = sql(SHIPS, _DEFECTS, _CHECKED)
    q["request_choices"] = sql(SHIPS, """
      SELECT 'truck_type: not an allowed value' AS violation, count(*) AS n FROM lines
      WHERE truck_type NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE') HAVING count(*) > 0""")
    q["request_defaults"] = sql(SHIPS, "SELECT row_key, l_linenumber <> 7 AS apply_enrichment, l_linenumber = 1 AS explain FROM lines")
    nothing = ", ".join(f"NULL::DOUBLE AS {c}" for c in (
        "vendor_avg_delay_days", "vendor_on_time_rate", "route_distance_km", "route_delay_probability_sim"))
    q["json_requests"] = sql(SHIPS, f"""
      SELECT row_key, {', '.join(_REQUIRED[:10])}, {r6('weight_kg', 'value_inr', 'risk_score', 'reliability AS route_vendor_reliability_sim')},
        {nothing}, true AS apply_enrichment, false AS explain FROM lines""")
    awkward = "CASE WHEN l_linenumber % 3 = 0 THEN concat(notes, ' \"fragile\", \n keep dry') ELSE notes END AS notes"
    q["csv_store"] = sql(SHIPS, "SELECT " + ", ".join(
        awkward if c == "notes" else r6(c) if t == "double" else c for c, t in _COLUMNS) + " FROM lines")
    q["csv_store_counts"] = sql(SHIPS, VENDORS, f"""
      SELECT 'primary_shipments' AS table_name, count(*) AS rows, {rounded('round(sum(weight_kg), 2)')} AS total,
        count(delay_reason) AS filled FROM lines
      UNION ALL SELECT 'vendor_stats', count(*), {rounded('round(sum(avg_delay_days), 2)')}, count(on_time_rate) FROM vendors
      UNION ALL SELECT 'route_stats', count(*), {rounded('round(sum(distance_km), 2)')}, count(destination_city) FROM lines""")
    q["store_lookups"] = sql(SHIPS, VENDORS, f"routes AS ({_ROUTE_AGG} GROUP BY ALL)", f"""
      SELECT vendor_id AS key, shipments AS n, {r6('on_time_rate AS rate')} FROM vendors
      UNION ALL SELECT concat(origin, '->', destination), sample_count, {rounded('actual_delay_rate')} FROM routes""")
    q["registered_tables"] = sql(SHIPS, VENDORS, f"""
      SELECT vendor_id, shipments, {r6('on_time_rate')} FROM vendors WHERE on_time_rate >= 0.5::DOUBLE""")
    typed = [c for c, t in _COLUMNS if t != "string"]
    q["malformed_cells"] = sql(SHIPS, "SELECT '(row)' AS column_name, 0::BIGINT AS malformed_cells" + "".join(
        f" UNION ALL SELECT '{c}', " + (f"(SELECT count(*) FROM lines WHERE l_linenumber = {2 if c == 'quantity' else 4})"
        if c in ("quantity", "order_date") else "0") for c in typed))
    q["table_profile"] = sql(SHIPS, " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS column_name, '{t}' AS column_type, count({c}) AS filled, "
        f"count(*) - count({c}) AS missing FROM lines" for i, (c, t) in enumerate(_COLUMNS)))
    q["table_preview"] = sql(SHIPS, f"""
      SELECT shipment_id, origin_city AS origin, destination_city AS destination, {r6('lines.distance_km AS distance_km',
        'delay_probability_sim', 'reliability AS vendor_reliability_sim')}, CAST(lateness_flag AS BIGINT) AS lateness_flag
      FROM lines ORDER BY lines.distance_km, shipment_id LIMIT 3""")
    q["colocated_frame"] = q["training_frame"]
    q["prepared_frame"] = sql(SHIPS, f"""
      SELECT quantity, {r6('weight_kg', 'value_inr', 'gst_rate', 'risk_score')}, origin_city, destination_city, origin_state,
        destination_state, product_category, supplier_name, carrier_name, truck_type, month, CAST(lateness_flag AS BIGINT) AS will_delay,
        {r6('delay_days')}, delay_reason FROM lines""")
    q["store_versions"] = sql(SHIPS, VENDORS, """
      SELECT vendor_id, shipments, 3::BIGINT AS versions_left, 5::BIGINT AS oldest, 1::BIGINT AS log_files
      FROM vendors WHERE CAST(vendor_id AS BIGINT) % 7 <= 4""")
    q["stream_lookup_versions"] = sql(*_HIST, f"""
      SELECT row_key, CASE WHEN l_linenumber = 1 THEN 1 ELSE 2 END::BIGINT AS lookup_version,
        CASE WHEN vendor_found AND (l_linenumber = 1 OR l_suppkey % 2 = 0) THEN {_TIER} ELSE 'UNKNOWN' END AS vendor_tier
      FROM history WHERE (l_orderkey * 7 + l_linenumber) % 48 > 20""")
    q["clean_numeric"] = sql(SHIPS, f"""
      SELECT row_key, {r6('least(delay_days, 12) AS days_clipped', 'ln(1 + value_inr) AS log_value_inr',
        'ln(1 + weight_kg) AS log_weight_kg', 'ln(1 + quantity) AS log_quantity',
        'CASE WHEN risk_score > 0.9::DOUBLE OR risk_score = 0 THEN 0 ELSE value_inr / risk_score END AS filled')},
        coalesce(delay_reason, 'None') AS reason FROM lines""")
    q["scaled_features"] = sql(SHIPS, VENDORS, FRAME, "SELECT row_key, " + ", ".join(
        f"{rounded(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()')} AS {c}" for c in _SCALED) + " FROM frame")
    q["label_index"] = sql(SHIPS, VENDORS, FRAME, """
      SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY value) - 1 AS index
      FROM (SELECT DISTINCT 'route_pair' AS column_name, route_pair AS value FROM frame
        UNION ALL SELECT DISTINCT 'month', month FROM frame)""")
    numeric = {
        "quantity": "quantity", "weight_kg": "weight_kg", "value_inr": "value_inr", "risk_score": "risk_score",
        "vendor_avg_delay_days": "vendor_avg_delay_days", "vendor_on_time_rate": "vendor_on_time_rate",
        "route_distance_km": "distance_km", "route_vendor_reliability_sim": "reliability",
        "route_delay_probability_sim": "delay_probability_sim", "log_value_inr": "ln(1 + value_inr)",
        "log_weight_kg": "ln(1 + weight_kg)", "log_quantity": "ln(1 + quantity)",
    }
    index = "CAST(dense_rank() OVER (ORDER BY {0}) - 1 AS BIGINT) AS {1}_index".format
    q["multitask_features"] = sql(SHIPS, VENDORS, FRAME, "SELECT CAST(will_delay AS BIGINT) AS will_delay, "
      + r6("least(delay_days, 12) AS delay_days") + ", " + index("coalesce(delay_reason, 'None')", "delay_reason") + ", "
      + ", ".join(f"{rounded(f'({x} - avg({x}) OVER ()) / stddev_pop({x}) OVER ()')} AS {n}" for n, x in numeric.items())
      + ", " + ", ".join(index(c, c) for c in (
          "origin_city", "destination_city", "origin_state", "destination_state", "product_category", "supplier_name",
          "carrier_name", "truck_type", "month")) + " FROM frame")
    q["stratified_split"] = sql(SHIPS, """
      SELECT row_key, CAST(lateness_flag AS BIGINT) AS will_delay, product_category,
        row_number() OVER (PARTITION BY lateness_flag ORDER BY md5(concat(row_key, '|42')))
          <= floor(count(*) OVER (PARTITION BY lateness_flag) * 0.2::DOUBLE + 0.5::DOUBLE) AS is_test FROM lines""")
    q["folds"] = sql(SHIPS, _FOLDS.format(label="product_category", source="lines"),
      "SELECT row_key, CAST(lateness_flag AS BIGINT) AS will_delay, product_category, fold FROM folded")
    q["hash_split_missing_keys"] = f"""
      SELECT row_key, CAST(concat('0x', substr(md5(concat(coalesce(row_key, ''), '|42')), 1, 8)) AS BIGINT)
        < {int(0.2 * 2**32)} AS is_test FROM (SELECT CASE WHEN l_linenumber <> 1 THEN {_KEY} END AS row_key FROM lineitem)"""
    q["finite_guard"] = sql(SHIPS, """
      SELECT 'raw' AS column_name, count(*) FILTER (risk_score > 0.9::DOUBLE OR quantity = 1) AS not_finite FROM lines
      UNION ALL SELECT 'filled', 0""")
    q["some_columns"] = sql(SHIPS, VENDORS, FRAME, f"""
      SELECT row_key, quantity, {r6('weight_kg', 'value_inr', 'vendor_avg_delay_days', 'vendor_on_time_rate',
        'distance_km AS route_distance_km', 'reliability AS route_vendor_reliability_sim',
        'delay_probability_sim AS route_delay_probability_sim', 'value_inr / greatest(weight_kg, 1) AS value_per_kg')},
        origin_city, destination_city, origin_state, destination_state, product_category, supplier_name, carrier_name, month FROM frame""")
    q["hash_split"] = f"""
      SELECT {_KEY} AS row_key, CAST(concat('0x', substr(md5(concat({_KEY}, '|42')), 1, 8)) AS BIGINT)
        < {int(0.2 * 2**32)} AS is_test FROM lineitem"""
    means = [" + ".join(f"({_reason_p(s)[k]})" for s in range(5)) for k in range(len(REASONS))]
    q["soft_vote"] = sql(SHIPS, f"voted AS (SELECT row_key, ({_VOTE}) / 3 AS vote, " + ", ".join(
      f"({m}) / 5 AS p{k}" for k, m in enumerate(means)) + " FROM lines)", f"""
      SELECT row_key, {r6('vote')}, vote >= 0.5::DOUBLE AS will_delay,
        CAST(list_position(ps, list_max(ps)) - 1 AS BIGINT) AS best, {r6(*[f'p{k}' for k in range(len(REASONS))])}
      FROM (SELECT *, [{', '.join(f'round(p{k}, 9)' for k in range(len(REASONS)))}] AS ps FROM voted)""")
    models = list(MEMBERS.values())
    q["logits"] = sql(SHIPS, f"""
      SELECT row_key, {r6(_p(models[0]) + ' AS p')}, CAST(list_position(ls, list_max(ls)) - 1 AS BIGINT) AS best
      FROM (SELECT *, [{', '.join(f'round({_logit(m)}, 9)' for m in models)}] AS ls FROM lines)""")
    said = "(vote >= 0.5::DOUBLE)"
    q["binary_metrics"] = sql(SHIPS, _MEMBERS, f"""
      SELECT tp + fp + fn + tn AS rows, {r6('(tp + tn) / (tp + fp + fn + tn) AS accuracy', 'tp / (tp + fp) AS precision',
        'tp / (tp + fn) AS recall', '2 * tp / (2 * tp + fp + fn) AS f1', _auc('vote') + ' AS auc')}
      FROM (SELECT count(*) FILTER (y = 1 AND {said}) AS tp, count(*) FILTER (y = 0 AND {said}) AS fp,
        count(*) FILTER (y = 1 AND NOT {said}) AS fn, count(*) FILTER (y = 0 AND NOT {said}) AS tn FROM members)""")
    q["member_metrics"] = sql(SHIPS, _MEMBERS, " UNION ALL ".join(
        f"SELECT '{m}' AS member, "
        + r6(f"(SELECT avg(CASE WHEN ({m} >= 0.5::DOUBLE) = (y = 1) THEN 1 ELSE 0 END::DOUBLE) FROM members) AS accuracy",
             _auc(m) + " AS auc") for m in (*MEMBERS, "vote")))
    errors = ("errors AS (SELECT delay_days AS y, round(greatest(0, (quantity - 25) * 0.22::DOUBLE + risk_score + 4), 6) AS f"
              " FROM lines WHERE delay_days > 0)")
    q["regression_metrics"] = sql(SHIPS, errors, f"""
      SELECT count(*) AS rows, {r6('avg(abs(y - f)) AS mae', 'sqrt(avg((y - f) * (y - f))) AS rmse',
        '1 - avg((y - f) * (y - f)) / var_pop(y) AS r2', 'quantile_cont(abs(y - f), 0.5) AS median_error')} FROM errors""")
    guessed = (SHIPS, VENDORS, FRAME, _PREDICTED)
    cases = "cases AS (SELECT * FROM pred)"
    q["confusion_counts"] = sql(*guessed, "SELECT actual, predicted, count(*) AS n FROM pred GROUP BY ALL")
    q["class_report"] = sql(*guessed, cases, _report(),
      f"SELECT label, support, {r6('precision', 'recall', 'f1')} FROM rated")
    q["report_averages"] = sql(*guessed, cases, _report(), "SELECT " + r6(
      *[f"avg({c}) AS macro_{c}" for c in ("precision", "recall", "f1")],
      *[f"sum({c} * support) / sum(support) AS weighted_{c}" for c in ("precision", "recall", "f1")])
      + ", CAST(sum(support) AS BIGINT) AS support FROM rated")
    in_folds = (*guessed, _FOLDS.format(label="actual", source="pred"), "cases AS (SELECT * FROM folded)", _report("fold"),
      "f1s AS (SELECT fold, avg(f1) AS macro_f1 FROM rated GROUP BY fold)")
    q["cv_summary"] = sql(*in_folds, f"""
      SELECT {r6('avg(macro_f1) AS cv_mean', 'stddev_pop(macro_f1) AS cv_std', '2 * stddev_pop(macro_f1) AS cv_spread')},
        avg(macro_f1) > 0.45::DOUBLE AS passed FROM f1s""")
    q["best_fold"] = sql(*in_folds, f"""
      SELECT concat('fold-', fold) AS candidate, {r6('macro_f1')} FROM f1s ORDER BY f1s.macro_f1 DESC, fold LIMIT 1""")
    logit = _logit(BASE_MODEL)
    err = "abs(delay_days - ((quantity - 25) * 0.22::DOUBLE + risk_score))"
    q["task_losses"] = sql(SHIPS, counts, f"""
      weighed AS (SELECT reason, (1 / n) / avg(1 / n) OVER () AS w FROM counts),
      losses AS (
        SELECT avg(greatest({logit}, 0) - {logit} * lateness_flag + ln(1 + exp(-abs({logit})))) AS b,
          avg(CASE WHEN {err} <= 1 THEN {err} * {err} * 0.5::DOUBLE ELSE {err} - 0.5::DOUBLE END) AS d,
          sum(-ln((quantity + 1) / 60) * w) / sum(w) AS c
        FROM lines JOIN weighed ON reason = coalesce(delay_reason, 'None'))""", f"""
      SELECT {r6('b AS binary_loss', 'd AS days_loss', 'c AS reason_loss', 'b + d + 0.7::DOUBLE * c AS total_loss')} FROM losses""")
    q["latency_percentiles"] = f"""
      SELECT {r6(*[f'quantile_cont(value, {p}) AS {n}' for n, p in (('p50', 0.5), ('p95', 0.95), ('p99', 0.99))],
        'avg(value) AS average')} FROM events"""
    # The document's sections are the results of other queries; each field becomes a row.
    report = [("dataset_info", "dataset_facts", ("rows", "delay_rate", "vendor_on_time_min", "vendor_on_time_max", "busiest_route_rows"))]
    report += [("ensemble_binary_classifier", "binary_metrics", ("rows", "accuracy", "precision", "recall", "f1", "auc"))]
    report += [("delay_days_regressor", "regression_metrics", ("rows", "mae", "rmse", "r2", "median_error"))]
    report += [("delay_reason_classifier", "report_averages", (
        *(f"{a}_{m}" for a in ("macro", "weighted") for m in ("precision", "recall", "f1")), "support"))]
    report += [("enrichment_impact", "enrichment_impact", (
        "avg_adjustment", "accuracy_without_enrichment", "accuracy_with_enrichment", "improved_accuracy", "vendors_adjusted", "routes_validated"))]
    report += [("latency", "latency_percentiles", ("p50", "p95", "p99", "average"))]
    rows = [
        f"SELECT '{section}' AS section, '{f}' AS field, CAST({f} AS DOUBLE) AS value, NULL::VARCHAR AS text FROM ({q[name]})"
        for section, name, names in report for f in names
    ]
    rows += [f"SELECT 'dataset_info', 'busiest_route', NULL, busiest_route FROM ({q['dataset_facts']})"]
    rows += [f"SELECT 'members', concat(member, '.{f}'), {f}, NULL FROM ({q['member_metrics']})" for f in ("accuracy", "auc")]
    rows += [
        f"SELECT 'classes', concat(label, '.{f}'), CAST({f} AS DOUBLE), NULL FROM ({q['class_report']})"
        for f in ("support", "precision", "recall", "f1")
    ]
    q["metrics_report"] = " UNION ALL ".join(rows)
    return q
