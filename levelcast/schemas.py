"""Explicit schemas of every stream and table; nothing is ever inferred."""

from pyspark.sql import types as T


def _schema(*fields):
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


_S, _TS, _D, _L, _I = (
    T.StringType(),
    T.TimestampType(),
    T.DoubleType(),
    T.LongType(),
    T.IntegerType(),
)

# arrival_seq breaks ties of received_at: (received_at, arrival_seq) names one arrival.
# Sources that need two numbers for that (Kafka, capture files) give a pair instead.
MESSAGES = _schema(
    ("topic", _S), ("payload", T.BinaryType()), ("received_at", _TS), ("arrival_seq", _L)
)

READINGS = _schema(
    ("device_id", _S),
    ("measured_at", _TS),
    ("water_level", _D),
    ("battery_voltage", _D),
    ("schema_version", T.ShortType()),
    ("received_at", _TS),
)

TELEMETRY = T.StructType(READINGS.fields + _schema(("batch_id", _S)).fields)

DEAD_LETTER = _schema(
    ("topic", _S), ("payload", T.BinaryType()), ("reason", _S), ("received_at", _TS)
)

INGEST_EVENTS = _schema(
    ("event", _S), ("device_id", _S), ("measured_at", _TS), ("occurred_at", _TS)
)

INGEST_STATS = _schema(
    ("ingested", _L), ("deduplicated", _L), ("dead_lettered", _L), ("out_of_order", _L)
)

DEVICES = _schema(
    ("device_id", _S), ("first_seen", _TS), ("last_seen", _TS), ("metadata", _S)
)

ROLLUP = _schema(
    ("device_id", _S),
    ("bucket", _TS),
    ("water_avg", _D),
    ("water_min", _D),
    ("water_max", _D),
    ("battery_avg", _D),
    ("battery_min", _D),
    ("sample_count", _L),
)

SAMPLES = _schema(("device_id", _S), ("kind", _S), ("at", _TS), ("value", _D))

FORECASTS = _schema(
    ("device_id", _S),
    ("kind", _S),
    ("as_of", _TS),
    ("status", _S),
    ("target_value", _D),
    ("latest_value", _D),
    ("crosses_at", _TS),
    ("crosses_at_earliest", _TS),
    ("crosses_at_latest", _TS),
    ("slope_per_hour", _D),
    ("residual_mad", _D),
    ("fit_points", _I),
    ("segment_points", _I),
    ("fit_span_seconds", _D),
    ("truncated", T.BooleanType()),
    ("computed_at", _TS),
)

ALERT_EVENTS = _schema(
    ("device_id", _S),
    ("kind", _S),
    ("state", _S),
    ("as_of", _TS),
    ("crosses_at", _TS),
    ("horizon_seconds", _D),
    ("threshold_seconds", _D),
    ("notified", T.BooleanType()),
    ("notify_error", _S),
    ("occurred_at", _TS),
)

ALERT_OUTCOMES = _schema(
    ("device_id", _S),
    ("kind", _S),
    ("as_of", _TS),
    ("state", _S),
    ("error", _S),
    ("delivered_at", _TS),
)

CAPTURE = _schema(
    ("topic", _S), ("captured_at", _TS), ("payload", T.BinaryType()), ("line_no", _L)
)
