"""The same queries as plain SQL, for a row-by-row check against another engine.

Written for clarity, not scale: pairs are joined out and windows span whole
series. Only the checks use this; no operator does.
"""

from levelcast.functions import wire
from levelcast.metrics import KINDS
from levelcast.plans import catalog
from levelcast.sources.events import EPOCH_US, HOUR_US

_EARLIER = "TIMESTAMP '2024-01-20 00:00:00'"
_FIRST_HOURS = "TIMESTAMP '2024-01-01 06:00:00'"
_WINDOW = "BETWEEN TIMESTAMP '2024-01-06 07:30:00' AND TIMESTAMP '2024-01-19 18:00:00'"
_STAMPS = ("TIMESTAMP '2024-02-01 00:00:00'", "TIMESTAMP '2024-02-02 00:00:00'")
_ROOT = f"{wire.TOPIC_ROOT}/{wire.TOPIC_VERSION}"

_BASE = f"""
levels AS (
  SELECT event_id, user_id, ts, 'dev-' || user_id::VARCHAR AS device_id,
         1000 - ((epoch_us(ts) - {EPOCH_US}) * (2 + user_id % 5) // {HOUR_US} + user_id * 37) % 900
           AS tenths,
         4200 - ((epoch_us(ts) - {EPOCH_US}) * (8 + user_id % 5) // {HOUR_US * 10}
                 + user_id * 11) % 900 AS millis,
         ts + CASE WHEN event_id % 33 = 0 THEN INTERVAL 36 HOUR ELSE INTERVAL 1 SECOND END
           AS received_at
  FROM events
),
readings AS (
  SELECT device_id, ts AS measured_at, tenths::DOUBLE / 10 AS water_level,
         millis::DOUBLE / 1000 AS battery_voltage, 1::SMALLINT AS schema_version, received_at
  FROM levels
)
"""

_WIRE = f"""
whole AS (
  SELECT *, event_id % 50 AS damage,
    '{{"schema_version":1,' || CASE WHEN event_id % 50 = 3 THEN ''
      ELSE '"device_id":"' || device_id || '",' END
    || '"measured_at":"' || CASE event_id % 50 WHEN 10 THEN '0000-01-01T00:00:00' WHEN 11 THEN '0001-01-01T00:00:00'
         ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END
    || CASE event_id % 50 WHEN 6 THEN '' WHEN 11 THEN '+05:00' ELSE 'Z' END || '","water_level":'
    || CASE event_id % 50 WHEN 2 THEN '"high"' WHEN 7 THEN '150'
         WHEN 12 THEN '"' || (tenths // 10)::VARCHAR || '.' || (tenths % 10)::VARCHAR || '\\t\\u00a0"'
         WHEN 13 THEN '"' || left((tenths // 10)::VARCHAR, 1) || '_' || substr((tenths // 10)::VARCHAR, 2)
           || '.' || (tenths % 10)::VARCHAR || '"'
       ELSE (tenths // 10)::VARCHAR || '.' || (tenths % 10)::VARCHAR END
    || ',"battery_voltage":' || (millis // 1000)::VARCHAR || '.'
    || lpad((millis % 1000)::VARCHAR, 3, '0') || '}}' AS body
  FROM levels
),
wire AS (
  SELECT event_id, damage, device_id, ts AS measured_at, tenths, millis,
    CASE damage WHEN 4 THEN '{_ROOT}/' || device_id || 'x/{wire.TOPIC_LEAF}'
                WHEN 5 THEN '{_ROOT}/' || device_id || '/status'
                ELSE '{_ROOT}/' || device_id || '/{wire.TOPIC_LEAF}' END AS topic,
    CASE damage WHEN 1 THEN left(body, length(body) // 2) WHEN 8 THEN body || ',"q":1'
                WHEN 9 THEN '{{}},"p":' || body ELSE body END AS payload,
    received_at + copy * INTERVAL 1 SECOND AS received_at,
    event_id * 2 + copy AS arrival_seq
  FROM whole, (VALUES (0), (1)) c(copy)
  WHERE copy = 0 OR event_id % 20 = 0
),
judged AS (
  SELECT *,
    CASE damage
      WHEN 1 THEN 'payload: Invalid JSON'
      WHEN 8 THEN 'payload: Invalid JSON'
      WHEN 9 THEN 'payload: Invalid JSON'
      WHEN 2 THEN 'water_level: Input should be a valid number, unable to parse string as a number'
      WHEN 3 THEN 'device_id: Field required'
      WHEN 6 THEN 'measured_at: Input should have timezone info'
      WHEN 7 THEN 'water_level: Input should be less than or equal to 100'
      WHEN 10 THEN 'measured_at: Input should be a valid datetime'
      WHEN 11 THEN 'measured_at: Input should be a valid datetime'
    END AS payload_error
  FROM wire
),
classified AS (
  SELECT *,
    CASE WHEN damage = 5 THEN 'topic does not match {_ROOT}/{{device_id}}/{wire.TOPIC_LEAF}'
         WHEN damage = 4 THEN 'device_id mismatch: topic=''' || device_id || 'x'' payload='''
                              || device_id || ''''
         ELSE 'invalid payload: ' || payload_error END AS reason
  FROM judged
),
valid AS (
  SELECT device_id, measured_at, tenths::DOUBLE / 10 AS water_level,
         millis::DOUBLE / 1000 AS battery_voltage, 1::SMALLINT AS schema_version,
         received_at, arrival_seq
  FROM classified WHERE reason IS NULL
),
dead AS (SELECT topic, payload, reason, received_at FROM classified WHERE reason IS NOT NULL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY device_id, measured_at
                               ORDER BY received_at, arrival_seq) AS rn
  FROM valid
),
accepted AS (SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1),
dedupes AS (
  SELECT 'deduplicated' AS event, device_id, measured_at, received_at AS occurred_at
  FROM ranked WHERE rn > 1
),
moved AS (
  SELECT *, max(measured_at) OVER (PARTITION BY device_id ORDER BY received_at, arrival_seq
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest_before
  FROM valid
)
"""

_DEVICES = """
devices AS (
  SELECT device_id, min(measured_at) AS first_seen, max(measured_at) AS last_seen
  FROM readings GROUP BY 1
)
"""


def _rollup(unit, source="readings"):
    return f"""
    SELECT device_id, date_trunc('{unit}', measured_at)::TIMESTAMP AS bucket,
           round(avg(water_level), 6) AS water_avg, min(water_level) AS water_min,
           max(water_level) AS water_max, round(avg(battery_voltage), 6) AS battery_avg,
           min(battery_voltage) AS battery_min, count(*) AS sample_count
    FROM {source} GROUP BY 1, 2
    """


_HOURLY = f"hourly AS ({_rollup('hour')})"


def _metric_rows(metrics):
    rows = []
    for m in metrics:
        numbers = (
            m.target,
            m.refill_jump,
            m.min_points,
            m.min_span_seconds,
            m.max_fit_points,
            m.lookback_seconds,
            m.gap_factor,
            m.stale_after_seconds,
            m.max_horizon_seconds,
            m.alert_horizon_seconds,
        )
        values = ", ".join(f"{n!r}::DOUBLE" for n in numbers)
        rows.append(f"('{m.kind}', '{m.noun}', {values})")
    return ", ".join(rows)


def _metrics(metrics):
    return f"""
metrics(kind, noun, target, refill_jump, min_points, min_span, max_fit_points, lookback,
        gap_factor, stale_after, max_horizon, alert_horizon) AS (VALUES {_metric_rows(metrics)})
"""


_METRICS = _metrics(catalog.METRICS)


def _median(sorted_list):
    return (
        f"(({sorted_list})[(len({sorted_list}) + 1) // 2] + ({sorted_list})[len({sorted_list}) // 2 + 1]) / 2"
    )


def _crossing(slope):
    hours = f"greatest((intercept - target) / -({slope}), 0)"
    micros = (
        f"epoch_us(as_of) + floor({hours})::BIGINT * 3600000000"
        f" + round_even(({hours} - floor({hours})) * 3.6e9, 0)::BIGINT"
    )
    return f"CASE WHEN {slope} < 0 THEN make_timestamp({micros}) END"


def _samples(prefix="", until=None):
    where = f"WHERE measured_at <= {until}" if until else ""
    p = prefix
    return f"""
{p}source AS (SELECT * FROM readings {where}),
{p}clock AS (SELECT max(measured_at) AS now FROM {p}source),
{p}samples AS (
  SELECT r.device_id, m.kind, r.measured_at AS "at",
         CASE m.kind WHEN 'water' THEN r.water_level ELSE r.battery_voltage END AS value
  FROM {p}source r, metrics m, {p}clock c
  WHERE epoch_us(r.measured_at) > epoch_us(c.now) - (m.lookback * 1e6)::BIGINT
),
{p}lagged AS (
  SELECT *, lag("at") OVER w AS prev_at, lag(value) OVER w AS prev_value,
         (epoch_us("at") - epoch_us(lag("at") OVER w)) / 1e6 AS gap
  FROM {p}samples WINDOW w AS (PARTITION BY device_id, kind ORDER BY "at")
),
{p}gaps AS (
  SELECT device_id, kind, list_sort(list(gap)) AS gaps FROM {p}lagged WHERE gap > 0 GROUP BY 1, 2
),
{p}cadences AS (SELECT device_id, kind, {_median('gaps')} AS cadence FROM {p}gaps),
{p}flagged AS (
  SELECT l.*, c.cadence,
         CASE WHEN coalesce(l.value - l.prev_value >= m.refill_jump, false)
                OR coalesce(l.gap > c.cadence * m.gap_factor, false) THEN 1 ELSE 0 END AS starts
  FROM {p}lagged l JOIN metrics m USING (kind) LEFT JOIN {p}cadences c USING (device_id, kind)
),
{p}segmented AS (
  SELECT *, (sum(starts) OVER (PARTITION BY device_id, kind ORDER BY "at"
                ROWS UNBOUNDED PRECEDING))::BIGINT AS segment_id
  FROM {p}flagged
),
{p}newest AS (
  SELECT *, row_number() OVER (PARTITION BY device_id, kind ORDER BY "at" DESC) AS back
  FROM (SELECT *, max(segment_id) OVER (PARTITION BY device_id, kind) AS last_id FROM {p}segmented)
  WHERE segment_id = last_id
)
"""


def _forecasts(prefix="", until=None):
    p = prefix
    return f"""{_samples(prefix, until)},
{p}ends AS (
  SELECT device_id, kind, max("at") AS as_of, arg_max(value, "at") AS latest_value,
         min("at") AS segment_start, max(segment_id) AS last_id, max(cadence) AS cadence,
         count(*)::INTEGER AS segment_points
  FROM {p}newest GROUP BY 1, 2
),
{p}points AS (
  SELECT n.device_id, n.kind, n.value AS y,
         (epoch_us(n."at") - epoch_us(e.as_of)) / 1e6 / 3600.0::DOUBLE AS x, n."at"
  FROM {p}newest n JOIN {p}ends e USING (device_id, kind) JOIN metrics m USING (kind)
  WHERE n.back <= m.max_fit_points
),
{p}spans AS (
  SELECT device_id, kind, count(*)::INTEGER AS n,
         (epoch_us(max("at")) - epoch_us(min("at"))) / 1e6 AS span
  FROM {p}points GROUP BY 1, 2
),
{p}gated AS (
  SELECT e.*, m.*  EXCLUDE (kind), s.n, s.span,
    CASE WHEN (epoch_us(c.now) - epoch_us(e.as_of)) / 1e6
              > greatest(m.stale_after, e.cadence * m.gap_factor) THEN 'stale'
         WHEN e.latest_value <= m.target THEN 'at_or_below_target'
         WHEN e.segment_points < m.min_points THEN 'insufficient_points'
         WHEN s.span < m.min_span THEN 'insufficient_span' END AS gate
  FROM {p}ends e JOIN metrics m USING (kind) JOIN {p}spans s USING (device_id, kind), {p}clock c
),
{p}slopes AS (
  SELECT a.device_id, a.kind, list_sort(list((b.y - a.y) / (b.x - a.x))) AS slopes
  FROM {p}points a JOIN {p}points b
    ON a.device_id = b.device_id AND a.kind = b.kind AND a."at" < b."at"
  WHERE a.x <> b.x GROUP BY 1, 2
),
{p}fits AS (
  SELECT device_id, kind, len(slopes) AS pairs, {_median('slopes')} AS slope,
    slopes[least(greatest(floor((len(slopes) - spread) / 2), 0), len(slopes) - 1)::BIGINT + 1] AS low,
    slopes[least(greatest(ceil((len(slopes) + spread) / 2), 0), len(slopes) - 1)::BIGINT + 1] AS high
  FROM (
    SELECT f.*, 1.959963984540054::DOUBLE * sqrt(s.n * (s.n - 1) * (2 * s.n + 5) / 18.0::DOUBLE) AS spread
    FROM {p}slopes f JOIN {p}spans s USING (device_id, kind) WHERE s.n >= 3
  )
),
{p}offsets AS (
  SELECT device_id, kind, {_median('o')} AS intercept FROM (
    SELECT p.device_id, p.kind, list_sort(list(p.y - f.slope * p.x)) AS o
    FROM {p}points p JOIN {p}fits f USING (device_id, kind) GROUP BY 1, 2)
),
{p}residuals AS (
  SELECT device_id, kind, {_median('o')} AS mad FROM (
    SELECT p.device_id, p.kind, list_sort(list(abs(p.y - (f.slope * p.x + i.intercept)))) AS o
    FROM {p}points p JOIN {p}fits f USING (device_id, kind)
    JOIN {p}offsets i USING (device_id, kind) GROUP BY 1, 2)
),
{p}joined AS (
  SELECT g.*, f.pairs, f.slope, f.low, f.high, i.intercept, r.mad
  FROM {p}gated g
  LEFT JOIN {p}fits f ON g.gate IS NULL AND f.device_id = g.device_id AND f.kind = g.kind
  LEFT JOIN {p}offsets i ON g.gate IS NULL AND i.device_id = g.device_id AND i.kind = g.kind
  LEFT JOIN {p}residuals r ON g.gate IS NULL AND r.device_id = g.device_id AND r.kind = g.kind
),
{p}crossed AS (
  SELECT *, {_crossing('slope')} AS mid,
         CASE WHEN slope < 0 THEN {_crossing('low')} END AS early,
         CASE WHEN slope < 0 THEN {_crossing('high')} END AS late
  FROM {p}joined
),
{p}decided AS (
  SELECT *,
    CASE WHEN gate IS NOT NULL THEN gate
         WHEN slope IS NULL THEN 'insufficient_points'
         WHEN slope >= 0 THEN 'not_depleting'
         WHEN (epoch_us(mid) - epoch_us(as_of)) / 1e6 > max_horizon THEN 'beyond_horizon'
         ELSE 'ok' END AS status
  FROM {p}crossed
),
{p}forecasts AS (
  SELECT d.device_id, d.kind, d.as_of, d.status, d.target AS target_value, d.latest_value,
    CASE WHEN d.gate = 'at_or_below_target' THEN d.as_of ELSE d.mid END AS crosses_at,
    CASE WHEN d.gate = 'at_or_below_target' THEN d.as_of ELSE d.early END AS crosses_at_earliest,
    CASE WHEN d.gate = 'at_or_below_target' THEN d.as_of ELSE d.late END AS crosses_at_latest,
    d.slope AS slope_per_hour, d.low AS slope_low_per_hour, d.high AS slope_high_per_hour,
    d.intercept AS value_at_anchor, d.mad AS residual_mad, d.pairs,
    CASE WHEN d.slope IS NOT NULL THEN d.n END AS fit_points,
    CASE WHEN d.slope IS NOT NULL THEN d.segment_points END AS segment_points,
    CASE WHEN d.slope IS NOT NULL THEN d.span END AS fit_span_seconds,
    coalesce(d.slope IS NOT NULL AND d.last_id = 0
      AND (epoch_us(d.segment_start) - (epoch_us(c.now) - (d.lookback * 1e6)::BIGINT)) / 1e6
          <= coalesce(d.cadence * d.gap_factor, 0), false) AS truncated,
    d.cadence AS cadence_seconds, d.alert_horizon, d.noun
  FROM {p}decided d, {p}clock c
)"""


def _horizon(alias="f"):
    a = alias
    return (
        f"CASE WHEN {a}.crosses_at IS NOT NULL THEN "
        f"greatest((epoch_us({a}.crosses_at) - epoch_us({a}.as_of)) / 1e6, 0) END"
    )


def _transition(previous):
    return f"""
  SELECT f.*, {_horizon()} AS horizon_seconds,
    CASE WHEN f.crosses_at IS NULL THEN NULL
         WHEN {_horizon()} <= f.alert_horizon THEN
           CASE WHEN p.state IS NULL OR p.state = 'cleared'
                  OR (epoch_us(f.as_of) - epoch_us(p.as_of)) / 1e6 >= 86400 THEN 'firing' END
         WHEN p.state = 'firing' AND {_horizon()} > f.alert_horizon * 1.5 THEN 'cleared'
    END AS transition
  FROM {{forecasts}} f LEFT JOIN {previous} p USING (device_id, kind)
"""


_NO_STATES = (
    "(SELECT NULL::VARCHAR AS device_id, NULL::VARCHAR AS kind, NULL::VARCHAR AS state, "
    "NULL::TIMESTAMP AS as_of WHERE false)"
)

_LATEST = f"""
latest AS (
  SELECT f.*, {_horizon()} AS horizon_seconds
  FROM devices d JOIN forecasts f USING (device_id)
)
"""

_TWO_PASSES = f"""{_forecasts('a_', _EARLIER)}, {_forecasts('b_')},
a_alerts AS (SELECT * FROM ({_transition(_NO_STATES).format(forecasts='a_forecasts')})
             WHERE transition IS NOT NULL),
a_states AS (SELECT device_id, kind, transition AS state, as_of FROM a_alerts),
b_alerts AS (
  SELECT b.* FROM ({_transition('a_states').format(forecasts='b_forecasts')}) b
  WHERE transition IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM a_alerts a WHERE a.device_id = b.device_id AND a.kind = b.kind
      AND a.as_of = b.as_of AND a.transition = b.transition)
),
alert_rows AS (
  SELECT *, 1 AS pass FROM a_alerts UNION ALL SELECT *, 2 AS pass FROM b_alerts
),
history AS (
  SELECT a.*, {_STAMPS[0]} AS computed_at FROM a_forecasts a
  LEFT JOIN b_forecasts b USING (device_id, kind, as_of)
  WHERE b.status IS NULL OR b.status = a.status
  UNION ALL
  SELECT b.*, {_STAMPS[1]} AS computed_at FROM b_forecasts b
  LEFT JOIN a_forecasts a USING (device_id, kind, as_of)
  WHERE a.status IS NULL OR a.status <> b.status
)
"""


def _with(*parts):
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


def _r(column, digits=6):
    return f"round({column}, {digits}) AS {column}"


_HALF_UP = "round(printf('%.14e', {0}::DOUBLE)::DECIMAL(38,15), {1})::DOUBLE"


def _half_up(expression, digits):
    return _HALF_UP.format(f"({expression})", digits)


def oracle_sql():
    base = _with(_BASE)
    wired = _with(_BASE, _WIRE)
    hourly = _with(_BASE, _HOURLY)
    fleet = _with(_BASE, _DEVICES)
    windowed = _with(_BASE, _METRICS, _samples())
    forecasts = _with(_BASE, _METRICS, _forecasts())
    latest = _with(_BASE, _DEVICES, _METRICS, _forecasts(), _LATEST)
    two = _with(_BASE, _METRICS, _TWO_PASSES)
    first_alerts = forecasts + (
        f", decided_alerts AS (SELECT * FROM ({_transition(_NO_STATES).format(forecasts='forecasts')})"
        " WHERE transition IS NOT NULL)\n"
    )
    message_rows = "topic, payload, received_at, arrival_seq"
    fit = forecasts + "SELECT device_id, kind, {} FROM forecasts WHERE pairs IS NOT NULL"
    kinds = ", ".join(f"('{k}')" for k in KINDS)
    band = "CASE {}" + " END"
    staleness = "WHEN {0} < 600 THEN 'green' WHEN {0} < 1800 THEN 'amber' ELSE 'red'"
    attention = "WHEN {0} < 1 THEN 'red' WHEN {0} < 3 THEN 'amber' ELSE 'green'"
    days = "min(l.horizon_seconds) / 86400.0"
    hex15 = "('0x' || substr(h, {}, 15))::BIGINT::HUGEINT"
    return {
        # sources and sinks
        "message_stream": wired
        + f"SELECT {message_rows} FROM wire WHERE topic LIKE '{_ROOT}/%/{wire.TOPIC_LEAF}'",
        "read_capture": wired + "SELECT topic, received_at AS captured_at, payload FROM wire",
        "write_capture": wired
        + """SELECT '{"topic":"' || topic || '","captured_at":"'
          || strftime(received_at, '%Y-%m-%dT%H:%M:%S')
          || CASE WHEN epoch_us(received_at) % 1000000 = 0 THEN ''
             ELSE strftime(received_at, '.%f') END
          || '+00:00","payload":"' || replace(replace(payload, '\\', '\\\\'), '"', '\\"') || '"}' AS line FROM wire""",
        "capture_bounds": wired
        + """SELECT topic, payload, received_at AS captured_at, arrival_seq FROM wire
          WHERE received_at <= (SELECT min(received_at) FROM wire) + INTERVAL 20 DAY""",
        "capture_first": wired
        + f"""SELECT topic, payload, received_at AS captured_at, arrival_seq FROM wire
          ORDER BY received_at, arrival_seq LIMIT {catalog.FIRST_MESSAGES}""",
        "telemetry_insert_if_absent": wired
        + f"SELECT * FROM accepted WHERE measured_at > {_EARLIER}",
        "dead_letter_append": wired + "SELECT * FROM dead",
        "ingest_event_append": wired + "SELECT * FROM dedupes",
        "device_registry_upsert": wired
        + """SELECT device_id, min(measured_at) AS first_seen, max(measured_at) AS last_seen
          FROM valid GROUP BY 1""",
        "telemetry_window_scan": base
        + """SELECT device_id, measured_at, water_level, battery_voltage FROM readings
          WHERE measured_at > (SELECT max(measured_at) FROM readings) - INTERVAL 35 DAY""",
        "day_partitioned_layout": base
        + """SELECT measured_at::DATE AS measured_date, count(*) AS readings
          FROM readings GROUP BY 1""",
        "age_out_compacted": base
        + """SELECT device_id, measured_at, water_level, battery_voltage,
          measured_at::DATE AS measured_date FROM readings""",
        "forecast_upsert": two + "SELECT device_id, kind, as_of, status, computed_at FROM history",
        "alert_insert_if_absent": two
        + f"""SELECT device_id, kind, transition AS state, as_of, {_r('horizon_seconds', 3)},
          alert_horizon AS threshold_seconds FROM alert_rows""",
        "mark_notified": first_alerts
        + """SELECT device_id, kind, transition AS state, as_of, kind <> 'battery' AS notified,
          CASE WHEN kind = 'battery' THEN 'TimeoutError' END AS notify_error FROM decided_alerts""",
        # the validator
        "topic_device_id": wired
        + f"""SELECT topic, CASE WHEN topic LIKE '{_ROOT}/%/{wire.TOPIC_LEAF}'
          THEN split_part(topic, '/', 3) END AS device_id, arrival_seq FROM wire""",
        "telemetry_topic": base
        + f"""SELECT device_id, measured_at,
          '{_ROOT}/' || device_id || '/{wire.TOPIC_LEAF}' AS topic FROM readings""",
        "device_id_format": """SELECT p_partkey,
          regexp_full_match(p_brand, '[a-z0-9][a-z0-9_-]{0,31}') AS raw_ok,
          regexp_full_match(lower(replace(p_brand, '#', '-')), '[a-z0-9][a-z0-9_-]{0,31}') AS lower_ok,
          regexp_full_match(lower(replace(p_brand, '#', '-')) || '-' || p_name,
            '[a-z0-9][a-z0-9_-]{0,31}') AS name_ok FROM part""",
        "utc_canonical": base
        + """SELECT device_id, measured_at, measured_at AS canonical,
          NULL::TIMESTAMP AS offsetless FROM readings""",
        "range_checks": """SELECT event_id, value BETWEEN 0 AND 100 AS water_ok,
          value / 100.0 BETWEEN 2.5 AND 4.4 AS battery_ok FROM events""",
        "payload_validate": wired
        + """SELECT arrival_seq,
          CASE WHEN payload_error IS NULL THEN device_id END AS device_id,
          CASE WHEN payload_error IS NULL THEN measured_at END AS measured_at,
          CASE WHEN payload_error IS NULL THEN tenths::DOUBLE / 10 END AS water_level,
          CASE WHEN payload_error IS NULL THEN millis::DOUBLE / 1000 END AS battery_voltage,
          payload_error FROM judged""",
        "device_cross_check": wired
        + "SELECT arrival_seq, topic, reason FROM classified WHERE damage = 4",
        "reason_condense": """SELECT event_id, CASE event_id % 3
          WHEN 0 THEN 'device_id: Field required; measured_at: Field required; '
            || 'water_level: Field required; (+1 more)'
          WHEN 1 THEN 'device_id: String should match pattern ''^[a-z0-9][a-z0-9_-]{0,31}$''; '
            || 'measured_at: Input should be a valid datetime; battery_voltage: Field required'
          ELSE 'water_level: Input should be greater than or equal to 0; '
            || 'battery_voltage: Input should be less than or equal to 4.4' END AS reason
          FROM events""",
        "classify_messages": wired
        + """SELECT arrival_seq,
          CASE WHEN reason IS NULL THEN 'reading' ELSE 'dead_letter' END AS outcome, reason,
          CASE WHEN reason IS NULL THEN device_id END AS device_id,
          CASE WHEN reason IS NULL THEN measured_at END AS measured_at,
          CASE WHEN reason IS NULL THEN tenths::DOUBLE / 10 END AS water_level,
          CASE WHEN reason IS NULL THEN millis::DOUBLE / 1000 END AS battery_voltage,
          received_at FROM classified""",
        "melt_metrics": base
        + """SELECT device_id, 'water' AS kind, measured_at AS "at", water_level AS value FROM readings
          UNION ALL SELECT device_id, 'battery', measured_at, battery_voltage FROM readings""",
        # ingestion
        "ingest_batch": wired
        + """SELECT device_id, measured_at, water_level, battery_voltage, received_at,
          'first' AS batch_id FROM accepted""",
        "dedupe_first_arrival": wired + "SELECT * FROM accepted",
        "dedupe_events": wired + "SELECT device_id, count(*) AS absorbed FROM dedupes GROUP BY 1",
        "arrival_out_of_order": wired
        + """SELECT arrival_seq, device_id, measured_at, newest_before,
          coalesce(measured_at < newest_before, false) AS out_of_order FROM moved""",
        "ingest_counters": wired
        + """SELECT (SELECT count(*) FROM accepted) AS ingested,
          (SELECT count(*) FROM dedupes) AS deduplicated,
          (SELECT count(*) FROM dead) AS dead_lettered,
          (SELECT count(*) FROM moved WHERE measured_at < newest_before) AS out_of_order""",
        "replay_window": wired
        + """, last_seen AS (SELECT device_id, max(measured_at) AS m FROM valid GROUP BY 1)
          SELECT (SELECT count(*) FROM accepted) AS ingested,
          (SELECT count(*) FROM dedupes) AS deduplicated,
          (SELECT count(*) FROM dead) AS dead_lettered,
          (SELECT count(*) FROM moved WHERE measured_at < newest_before) AS out_of_order,
          'replay-1' AS batch
          UNION ALL
          SELECT 0, (SELECT count(*) FROM valid), (SELECT count(*) FROM dead),
          (SELECT count(*) FROM valid JOIN last_seen USING (device_id) WHERE measured_at < m),
          'replay-2'""",
        "replay_offsets": wired
        + """SELECT split_part(topic, '/', 3) AS file, arrival_seq, received_at AS captured_at,
          coalesce(sum(greatest(gap, 0)) OVER (PARTITION BY split_part(topic, '/', 3)
            ORDER BY received_at, arrival_seq ROWS UNBOUNDED PRECEDING), 0)::BIGINT::DOUBLE
            / 1e6::DOUBLE / 100.0::DOUBLE AS offset_seconds
          FROM (SELECT *, epoch_us(received_at) - lag(epoch_us(received_at)) OVER (
                  PARTITION BY split_part(topic, '/', 3) ORDER BY received_at, arrival_seq) AS gap
                FROM wire)""",
        "streaming_ingest": wired + _rollup("hour", "accepted"),
        # aggregates and rollups
        "telemetry_hourly": base + _rollup("hour"),
        "telemetry_daily": base + _rollup("day"),
        "rollup_states_daily": base + _rollup("day"),
        "envelope_of_states": hourly
        + f"SELECT bucket AS time, device_id, water_avg, water_min, water_max FROM hourly WHERE bucket {_WINDOW}",
        "missed_checkins_of_states": hourly
        + f"""SELECT bucket AS time, device_id, greatest(12 - sample_count, 0) AS missed FROM hourly
          WHERE bucket {_WINDOW} AND bucket > (SELECT date_trunc('hour', min(measured_at)) FROM readings)
            AND bucket < (SELECT date_trunc('hour', max(measured_at)) FROM readings)""",
        "time_bucket": base
        + """SELECT device_id, measured_at, date_trunc('hour', measured_at)::TIMESTAMP AS hour,
          date_trunc('day', measured_at)::TIMESTAMP AS day,
          time_bucket(INTERVAL 15 MINUTE, measured_at) AS quarter FROM readings""",
        "rollup_realtime": base + _rollup("hour"),
        "rollup_refresh": base + _rollup("day"),
        "fleet_watermark": base + "SELECT max(measured_at) AS data_now FROM readings",
        "last_value": base
        + """SELECT device_id, arg_max(water_level, measured_at) AS last_water_level
          FROM readings GROUP BY 1""",
        "exact_median": base
        + f"""SELECT device_id, {_median('v')} AS median FROM (
          SELECT device_id, list_sort(list(water_level)) AS v FROM readings GROUP BY 1)""",
        "window_checksum": base
        + f"""SELECT count(*) AS readings,
          md5(count(*)::VARCHAR || '|' || sum({hex15.format(1)})::VARCHAR || '|'
              || sum({hex15.format(16)})::VARCHAR) AS checksum
          FROM (SELECT md5(concat_ws('|', device_id, epoch_us(measured_at)::VARCHAR,
                 water_level::VARCHAR, battery_voltage::VARCHAR)) AS h FROM readings
                WHERE measured_at {_WINDOW})""",
        # windows
        "out_of_order_arrivals": base
        + """SELECT count(*) AS out_of_order FROM (
          SELECT measured_at, max(measured_at) OVER (PARTITION BY device_id
            ORDER BY received_at, measured_at
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM readings)
          WHERE measured_at < newest""",
        "latest_alert_states": two
        + """SELECT device_id, kind, transition AS state, as_of FROM (
          SELECT *, row_number() OVER (PARTITION BY device_id, kind
            ORDER BY as_of DESC, pass DESC) AS rn FROM alert_rows) WHERE rn = 1""",
        "forecasts_latest": latest
        + f"SELECT device_id, kind, as_of, status, {_r('horizon_seconds', 3)} FROM latest",
        "segment_split": windowed + 'SELECT device_id, kind, "at", value, segment_id FROM segmented',
        "newest_segment": windowed + 'SELECT device_id, kind, "at", value, segment_id FROM newest',
        "cap_recent": windowed
        + f"""SELECT device_id, kind, "at", value FROM (SELECT *, row_number() OVER (
          PARTITION BY device_id, kind ORDER BY "at" DESC) AS back FROM samples)
          WHERE back <= {catalog.SHORT_FIT}""",
        "gap_breaks": base
        + """SELECT device_id, measured_at, gap AS gap_seconds,
          coalesce(gap > 450, false) AS starts_new_line FROM (
            SELECT *, (epoch_us(measured_at) - lag(epoch_us(measured_at)) OVER (
              PARTITION BY device_id ORDER BY measured_at)) / 1e6 AS gap FROM readings)""",
        # reports
        "water_raw": base
        + f"SELECT measured_at AS time, device_id, water_level FROM readings WHERE measured_at {_WINDOW}",
        "battery_raw": base
        + f"SELECT measured_at AS time, device_id, battery_voltage FROM readings WHERE measured_at {_WINDOW}",
        "checkin_staleness": fleet
        + f""", behind AS (SELECT device_id, round(((epoch_us((SELECT max(measured_at) FROM readings))
            - epoch_us(last_seen))::DECIMAL(38,6) / 1000000)::DECIMAL(38,6))::BIGINT AS behind_seconds
          FROM devices)
          SELECT *, {band.format(staleness.format('behind_seconds'))} AS band FROM behind""",
        "water_hourly": hourly
        + f"SELECT bucket AS time, device_id, water_avg FROM hourly WHERE bucket {_WINDOW}",
        "water_hourly_envelope": hourly
        + f"SELECT bucket AS time, device_id, water_avg, water_min, water_max FROM hourly WHERE bucket {_WINDOW}",
        "dead_letter_total": wired + "SELECT count(*) AS dead_lettered FROM dead",
        "dead_letter_rate": wired
        + f""", clock AS (SELECT TIMESTAMP '2024-01-15 12:00:00' AS now),
          opened AS (SELECT now, now - INTERVAL 15 MINUTE AS start FROM clock)
          SELECT {_half_up(
            "(SELECT count(*) FROM dead WHERE received_at > start)::DOUBLE * 60.0::DOUBLE"
            " / greatest((epoch_us(now) - epoch_us(greatest((SELECT min(received_at)"
            " FROM readings), start))) / 1e6, 60)", 2)} AS per_minute FROM opened""",
        "deduplicated_total": wired + "SELECT count(*) AS deduplicated FROM dedupes",
        "missed_checkins": hourly
        + """SELECT bucket AS time, device_id, greatest(12 - sample_count, 0) AS missed FROM hourly
          WHERE bucket > (SELECT date_trunc('hour', min(measured_at)) FROM readings)
            AND bucket < (SELECT date_trunc('hour', max(measured_at)) FROM readings)""",
        "recent_dead_letters": wired
        + """SELECT received_at, topic, reason, left(payload, 80) AS payload_prefix FROM dead
          ORDER BY received_at DESC, topic, payload LIMIT 10""",
        "last_dead_letters": wired
        + """SELECT topic, reason, received_at FROM dead
          ORDER BY received_at DESC, topic, payload LIMIT 3""",
        "recent_hourly": base
        + f"""SELECT device_id, date_trunc('hour', measured_at)::TIMESTAMP AS bucket,
          {_half_up('avg(water_level)', 1)} AS water_avg, count(*) AS sample_count
          FROM readings GROUP BY 1, 2 ORDER BY bucket DESC, device_id LIMIT 8""",
        "device_last_readings": base
        + f"""SELECT * FROM readings WHERE device_id = '{catalog.DEVICE}'
          ORDER BY measured_at DESC LIMIT 5""",
        "attention_needed": latest
        + f""", soonest AS (
            SELECT d.device_id, {days} AS days_left FROM devices d
            LEFT JOIN latest l ON l.device_id = d.device_id
              AND l.status IN ('ok', 'at_or_below_target') GROUP BY 1)
          SELECT device_id, {_r('days_left')}, CASE WHEN days_left IS NULL THEN 'warming up'
            {attention.format('days_left')} END AS label FROM soonest""",
        "device_list": fleet + "SELECT device_id FROM devices",
        "forecast_history": two
        + f"""SELECT as_of AS time, 'days until empty' AS metric,
          round(({_horizon('h')}) / 86400.0, 6) AS value FROM history h
          WHERE device_id = '{catalog.DEVICE}' AND kind = 'water'
            AND status IN ('ok', 'at_or_below_target')""",
        "actual_level": base
        + f"""SELECT measured_at AS time, 'water level' AS metric, water_level AS value
          FROM readings WHERE device_id = '{catalog.DEVICE}' AND measured_at {_WINDOW}""",
        "forecast_detail": latest
        + f"""SELECT device_id, kind, status, {_half_up('latest_value', 2)} AS latest,
          {_half_up('target_value', 2)} AS target,
          {_half_up('slope_per_hour * 24.0', 3)} AS change_per_day,
          {_half_up('horizon_seconds / 86400.0', 2)} AS days_left,
          crosses_at, crosses_at_earliest, crosses_at_latest, fit_points,
          {_half_up('fit_span_seconds / 3600.0', 1)} AS fit_hours, as_of FROM latest""",
        "threshold_band": f"""SELECT event_id,
          {band.format(staleness.format('(value * 10)'))} AS staleness,
          {band.format(attention.format('(value / 100)'))} AS attention FROM events""",
        "fleet_snapshot": fleet
        + f"""SELECT d.device_id,
          {_half_up('arg_max(r.water_level, r.measured_at)', 1)} AS water_pct,
          {_half_up('arg_max(r.battery_voltage, r.measured_at)', 2)} AS battery_v,
          max(r.measured_at) AS last_reading, d.first_seen
          FROM devices d JOIN readings r USING (device_id) GROUP BY d.device_id, d.first_seen""",
        "daily_water_consumption": base
        + f"""SELECT device_id, day, {_half_up('used', 1)} AS pct_consumed FROM (
            SELECT device_id, measured_at::DATE AS day,
                   round(sum(greatest(coalesce(prev - water_level, 0), 0)), 9) AS used
            FROM (SELECT *, lag(water_level) OVER (PARTITION BY device_id ORDER BY measured_at)
                    AS prev FROM readings) GROUP BY 1, 2)""",
        "checkin_health": hourly
        + """SELECT device_id, bucket, sample_count FROM hourly WHERE sample_count < 12
          AND bucket < (SELECT date_trunc('hour', max(measured_at)) FROM readings)
          ORDER BY bucket DESC, device_id LIMIT 20""",
        "window_counts": wired
        + f"""SELECT (SELECT count(*) FROM accepted WHERE measured_at {_WINDOW}) AS readings,
          (SELECT count(*) FROM dedupes WHERE measured_at {_WINDOW}) AS dedupe_events""",
        # forecasting
        "metric_window": windowed + 'SELECT device_id, kind, "at", value FROM samples',
        "series_valid": """WITH s AS (
            SELECT 'dev-' || user_id::VARCHAR AS device_id, ts AS "at",
              CASE WHEN event_id % 1000 = 7 THEN NULL ELSE value END AS value,
              CASE WHEN user_id % 10 = 0 THEN -event_id ELSE event_id END AS seq FROM events),
          o AS (SELECT *, lag("at") OVER (PARTITION BY device_id ORDER BY seq) AS prev FROM s)
          SELECT device_id, arg_max("at", seq) AS as_of,
            bool_or(value IS NULL OR coalesce("at" <= prev, false)) AS invalid FROM o GROUP BY 1""",
        "cadence": windowed
        + """SELECT device_id, kind, cadence AS cadence_seconds FROM cadences""",
        "stale_rule": forecasts
        + f"""SELECT device_id, kind, as_of, cadence_seconds, status = 'stale' AS stale
          FROM forecasts""",
        "long_fits": base
        + f""", t AS (SELECT date_trunc('minute', measured_at) AS ts, water_level AS y FROM readings),
        n AS (SELECT * FROM t ORDER BY ts DESC, y DESC LIMIT {catalog.LONG_FIT}),
        p AS (SELECT (epoch_us(ts) - max(epoch_us(ts)) OVER ()) / 1000000::DOUBLE / 3600 AS x, y FROM n),
        s AS (SELECT list_sort(list((b.y - a.y) / (b.x - a.x))) AS o FROM p a JOIN p b ON a.x < b.x),
        c AS (SELECT count(*) AS k, 1.959963984540054::DOUBLE * sqrt(count(*) * (count(*) - 1) * (2 * count(*) + 5) / 18::DOUBLE) AS w FROM p)
        SELECT 'fleet' AS device_id, 'water' AS kind, k AS fit_points, len(o) AS pairs,
          round({_median('o')}, 9) AS slope_per_hour,
          round(o[greatest(floor((len(o) - w) / 2), 0)::BIGINT + 1], 9) AS slope_low_per_hour,
          round(o[least(ceil((len(o) + w) / 2), len(o) - 1)::BIGINT + 1], 9) AS slope_high_per_hour
        FROM s, c""",
        "pairwise_slopes": fit.format("fit_points, pairs"),
        "theil_sen_slope": fit.format(_r("slope_per_hour", 9)),
        "slope_interval": fit.format(
            _r("slope_low_per_hour", 9) + ", " + _r("slope_high_per_hour", 9)
        ),
        "intercept_residual": fit.format(_r("value_at_anchor") + ", " + _r("residual_mad")),
        "crossing": forecasts + "SELECT device_id, kind, as_of, crosses_at FROM forecasts",
        "crossing_band": forecasts
        + """SELECT device_id, kind, crosses_at_earliest, crosses_at, crosses_at_latest
          FROM forecasts""",
        "status_precedence": forecasts
        + "SELECT device_id, kind, as_of, status, latest_value FROM forecasts",
        "status_mix": forecasts
        + "SELECT kind, status, count(*) AS series FROM forecasts GROUP BY 1, 2",
        "truncated_fits": _with(_BASE, _metrics(catalog.CAPPED), _forecasts())
        + """SELECT device_id, kind, truncated, segment_points, fit_points, fit_span_seconds
          FROM forecasts""",
        "forecast_pass": forecasts
        + f"""SELECT device_id, kind, as_of, status, target_value, latest_value,
          {_r('slope_per_hour', 9)}, {_r('residual_mad')}, fit_points, segment_points, truncated,
          {_STAMPS[0]} AS computed_at FROM forecasts""",
        "pass_stats": first_alerts
        + """SELECT (SELECT count(DISTINCT device_id) FROM forecasts) AS devices,
          (SELECT count(*) FROM forecasts) AS written,
          (SELECT count(*) FROM decided_alerts WHERE transition = 'firing') AS fired,
          (SELECT count(*) FROM decided_alerts WHERE transition = 'cleared') AS cleared,
          (SELECT count(*) FROM forecasts WHERE kind = 'water' AND status = 'not_depleting')
            AS signals""",
        "segmenter_signals": _with(_BASE, _metrics(catalog.UNSPLIT), _forecasts())
        + """SELECT device_id, kind, as_of, slope_per_hour FROM forecasts
          WHERE kind = 'water' AND status = 'not_depleting'""",
        "no_data_forecasts": _with(_BASE, _DEVICES, _METRICS, _samples("a_", _FIRST_HOURS))
        + f"""SELECT d.device_id, k.kind, 'no_data' AS status, m.target AS target_value
          FROM devices d, (VALUES {kinds}) k(kind) JOIN metrics m ON m.kind = k.kind
          WHERE NOT EXISTS (SELECT 1 FROM a_samples s
            WHERE s.device_id = d.device_id AND s.kind = k.kind)""",
        "horizon_seconds": forecasts
        + f"SELECT device_id, kind, round({_horizon()}, 3) AS horizon_seconds FROM forecasts f",
        # alerts
        "alert_transition": forecasts
        + f""", states AS (
            SELECT device_id, kind,
              CASE WHEN (length(device_id) + length(status)) % 3 = 1 THEN 'cleared'
                   ELSE 'firing' END AS state,
              as_of - CASE WHEN (length(device_id) + length(status)) % 3 = 0
                THEN INTERVAL 30 HOUR ELSE INTERVAL 6 HOUR END AS as_of FROM forecasts)
          SELECT device_id, kind, as_of, status, transition
          FROM ({_transition('states').format(forecasts='forecasts')})""",
        "alert_decisions": first_alerts
        + f"""SELECT device_id, kind, transition AS state, as_of, crosses_at,
          {_r('horizon_seconds', 3)}, alert_horizon AS threshold_seconds FROM decided_alerts""",
        "alert_message": first_alerts
        + """SELECT device_id, kind,
          'planter ' || device_id || ': ' || kind || ' attention needed' AS title,
          kind || ' ' || noun || ' in ' || printf('%.1f', horizon_seconds / 86400.0)
            || ' days of device time (' || strftime(crosses_at, '%Y-%m-%d %H:%M') || ' UTC)'
            AS message FROM decided_alerts""",
        # joins
        "device_readings": fleet
        + """SELECT device_id, measured_at, water_level, first_seen
          FROM readings JOIN devices USING (device_id)""",
        "known_keys": wired
        + f"""SELECT device_id, measured_at, received_at, arrival_seq FROM accepted
          WHERE measured_at <= {_EARLIER}""",
        "changed_status": _with(_BASE, _METRICS, _forecasts("a_", _EARLIER), _forecasts("b_"))
        + """SELECT b.device_id, b.kind, b.as_of, b.status FROM b_forecasts b
          LEFT JOIN a_forecasts a USING (device_id, kind, as_of)
          WHERE a.status IS NULL OR a.status <> b.status""",
    }
