"""Message classification: topic shape, payload checks, identity cross-check.

A narrow chain of projections, no shuffle. The payload is parsed once, into a struct that holds only
the five known fields as VARIANT, so a missing field (SQL NULL), a JSON null
(VOID) and a value of the wrong JSON type stay apart. Every message ends as a
reading or as a dead letter with a reason; nothing raises.
"""

from pyspark.sql import functions as F

from levelcast.functions import wire
from levelcast.operators.stages import compute_once

_FIELDS = ("schema_version", "device_id", "measured_at", "water_level", "battery_voltage")
_MAX_ERRORS = 3
_MAX_CHARS = 500

# The payload is parsed as the first of exactly two elements of an array, the
# second being a hash of the payload. An array has no keys that a payload could
# set, and text beyond the payload's one JSON value gives more elements or none.
_ENVELOPE = "array<struct<" + ",".join(f"{f}:variant" for f in _FIELDS) + ",seal:string>>"
_JSON_OPTIONS = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}

# The wording of each check.
MISSING = "Field required"
BAD_JSON = "Invalid JSON"
NOT_OBJECT = "Input should be an object"
BAD_VERSION = "Input should be 1"
NOT_TEXT = "Input should be a valid string"
BAD_ID = f"String should match pattern '{wire.DEVICE_ID_PATTERN}'"
NOT_TIME = "Input should be a valid datetime"
NO_ZONE = "Input should have timezone info"
NOT_NUMBER = "Input should be a valid number"
NOT_NUMERIC_TEXT = "Input should be a valid number, unable to parse string as a number"
AT_LEAST = "Input should be greater than or equal to {}"
AT_MOST = "Input should be less than or equal to {}"
BAD_TOPIC = "topic does not match planter/v1/{device_id}/telemetry"

_NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_NON_FINITE = r"(?i)^[+-]?(nan|inf|infinity)$"
_DATE = r"(?!0000)\d{4}-\d{2}-\d{2}"
_CLOCK = r"\d{2}:\d{2}(:\d{2}([.,]\d+)?)?"
_ZONED = rf"\A{_DATE}[Tt _]{_CLOCK}([Zz]|[+-]\d{{2}}:?\d{{2}})\z"
# What devices and captures normally hold, and a cast reads as it stands: offsets below 18 hours.
_PLAIN = rf"\A{_DATE}T\d{{2}}:\d{{2}}:\d{{2}}(\.\d{{1,6}})?(Z|[+-](0\d|1[0-7]):[0-5]\d)\z"
_ZONELESS = rf"\A{_DATE}([Tt _]{_CLOCK})?\z"
# The first and last days there are, on which an offset may lead out of the calendar.
_EDGE = r"\A(0001-01-01|9999-12-31)"
# The first microsecond of year 1 and the last of year 9999.
_FIRST_MICROS, _LAST_MICROS = -62_135_596_800_000_000, 253_402_300_799_999_999
# Fixed value: the characters of white space that may stand around a number in text.
_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Fixed value: epoch numbers beyond this magnitude count milliseconds.
_SECONDS_LIMIT = 2e10


# Below, `raw` is the JSON text of one field: text in quotes, numbers and
# booleans bare, NULL for a missing field. Casting the VARIANT to each candidate
# type instead is many times slower.


def _is_text(raw):
    return raw.startswith('"')


def _body(raw):
    """The field's text without its quotes."""
    return F.when(_is_text(raw), F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)


def _with_numbers(df, **fields):
    """Lenient numbers of raw fields: numbers, numeric text and booleans, under the names given.

    Step by step, each in a column of its own: JSON escapes read, white space around it
    off, underscores between digits out.
    """
    names = {name: f"_digits_{name}" for name in fields}
    at = lambda name: F.col(names[name])

    def read(raw):
        body = _body(raw)
        escaped = F.when(body.contains("\\"), F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v"))
        return F.when(_is_text(raw), F.coalesce(escaped, body)).otherwise(raw)

    def trimmed(text):
        bare = F.regexp_replace(text, rf"\A{_SPACE}+|{_SPACE}+\z", "")
        return F.when(text.rlike(rf"\A{_SPACE}|{_SPACE}\z"), bare).otherwise(text)

    def joined(text):
        return F.when(text.contains("_"), F.regexp_replace(text, r"(?<=\d)_(?=\d)", "")).otherwise(text)

    kept = df.columns
    df = compute_once(df, **{names[n]: read(raw) for n, raw in fields.items()})
    for step in (trimmed, joined):
        done = {names[n]: F.when(_is_text(raw), step(at(n))).otherwise(at(n)) for n, raw in fields.items()}
        df = compute_once(df, kept, **done)
    return compute_once(df, kept, **{n: _number(raw, at(n)) for n, raw in fields.items()})


def _number(raw, body):
    return (
        F.when(body.rlike(_NUMERIC), body.try_cast("double"))
        .when(raw == "true", F.lit(1.0))
        .when(raw == "false", F.lit(0.0))
        .when(_is_text(raw) & body.rlike(_NON_FINITE), F.lit(float("nan")))
    )


def _number_error(raw, value, bounds):
    low, high = bounds
    return (
        F.when(raw.isNull(), MISSING)
        .when(value.isNull(), F.when(_is_text(raw), NOT_NUMERIC_TEXT).otherwise(NOT_NUMBER))
        .when(value > F.lit(high), AT_MOST.format(f"{high:g}"))
        .when(value < F.lit(low), AT_LEAST.format(f"{low:g}"))
    )


def utc_timestamp(text):
    """TIMESTAMP of ISO text that carries an offset; NULL for any other text."""
    read = _instant(_iso(text))
    inside = lambda t: F.unix_micros(t).between(_FIRST_MICROS, _LAST_MICROS)
    return F.when(text.rlike(_EDGE), F.get(F.filter(F.array(read), inside), 0)).otherwise(read)


def with_utc(df, **texts):
    """`utc_timestamp` of text columns under the names given, step by step in columns of their own.

    Generated code then stays short enough for the JVM to compile it, which it does not
    do for methods of more than 8,000 bytes, and there is none for a function over an array.
    """
    kept = df.columns
    df = compute_once(df, **{f"_iso_{name}": _iso(F.col(text)) for name, text in texts.items()})
    read = {f"_iso_{name}": _instant(F.col(f"_iso_{name}")) for name in texts}
    df = compute_once(df, kept, **read)

    def inside(name, text):
        instant = F.col(f"_iso_{name}")
        outside = F.col(text).rlike(_EDGE) & ~F.unix_micros(instant).between(_FIRST_MICROS, _LAST_MICROS)
        return F.when(~F.coalesce(outside, F.lit(False)), instant)

    return compute_once(df, kept, **{name: inside(name, text) for name, text in texts.items()})


def _iso(text):
    """The one form of a zoned ISO text that a cast reads; NULL for any other text.

    A chain in which each step uses the one before it once, so the generated code
    stays small.
    """
    iso = F.regexp_replace(text, r"^(.{10})[t _]", "$1T")
    iso = F.regexp_replace(iso, r"^(.{11}\d{2}:\d{2})(?!:)", "$1:00")
    iso = F.regexp_replace(iso, r"[.,](\d{1,6})\d*", ".$1")
    iso = F.regexp_replace(iso, r"([+-]\d{2}):?(\d{2})$", "$1:$2")
    return F.when(text.rlike(_PLAIN), text).when(text.rlike(_ZONED), F.upper(iso))


def _instant(iso):
    """A cast knows offsets up to 18 hours; larger ones are taken off by hand."""
    far = iso.rlike(r"[+-](1[89]|2[0-3]):[0-5]\d$")
    return F.when(far, _far_zone(iso)).otherwise(iso.try_cast("timestamp"))


def _far_zone(iso):
    local = F.unix_micros(F.concat(F.left(iso, F.length(iso) - 6), F.lit("Z")).try_cast("timestamp"))
    zone = F.right(iso, F.lit(6))
    minutes = F.substr(zone, F.lit(2), F.lit(2)).try_cast("bigint") * 60 + F.right(
        zone, F.lit(2)
    ).try_cast("bigint")
    sign = F.when(zone.startswith("-"), F.lit(-60_000_000)).otherwise(F.lit(60_000_000))
    return F.timestamp_micros(local - minutes * sign)


def _epoch(number):
    seconds = F.when(F.abs(number) <= _SECONDS_LIMIT, number).otherwise(number / 1000.0)
    usable = (seconds >= F.lit(_FIRST_MICROS / 1e6)) & (seconds < F.lit((_LAST_MICROS + 1) / 1e6))
    return F.when(usable, F.timestamp_micros(F.rint(seconds * 1e6).cast("bigint")))


def _with_time(df, name, raw):
    """An instant under the name given: zoned ISO text or Unix seconds."""
    kept, body = df.columns, F.trim(_body(raw))
    df = compute_once(
        df,
        _seconds=F.when(body.rlike(_NUMERIC), body.try_cast("double")),
        _text=F.when(_is_text(raw), _body(raw)),
    )
    df = with_utc(df, _zoned="_text")
    seconds = F.col("_seconds")
    return compute_once(
        df, kept, **{name: F.when(seconds.isNotNull(), _epoch(seconds)).otherwise(F.col("_zoned"))}
    )


def _time_error(raw, value):
    zoneless = _is_text(raw) & _body(raw).rlike(_ZONELESS)
    return F.when(raw.isNull(), MISSING).when(
        value.isNull(), F.when(zoneless, NO_ZONE).otherwise(NOT_TIME)
    )


def _version_error(raw):
    return F.when(raw.isNotNull() & ~raw.isin("1", "1.0", "true"), BAD_VERSION)


def _device_error(raw):
    return (
        F.when(raw.isNull(), MISSING)
        .when(~_is_text(raw), NOT_TEXT)
        .when(~wire.is_device_id(_body(raw)), BAD_ID)
    )


def _located(field, error):
    return F.when(error.isNotNull(), F.concat(F.lit(f"{field}: "), error))


def condense(errors):
    """First three errors, how many more there are, cut at 500 characters.

    `errors` are columns that are NULL where a check holds; concat_ws skips those.
    """
    found = sum((e.isNotNull().cast("int") for e in errors), F.lit(0))
    # No wording holds a line break, so it can part the errors while they are cut.
    first = F.substring_index(F.concat_ws("\n", *errors), "\n", _MAX_ERRORS)
    shown = F.replace(first, F.lit("\n"), F.lit("; "))
    more = F.when(
        found > _MAX_ERRORS,
        F.concat(F.lit("; (+"), (found - _MAX_ERRORS).cast("string"), F.lit(" more)")),
    )
    return F.left(F.concat(shown, F.coalesce(more, F.lit(""))), F.lit(_MAX_CHARS))


def parse_payload(messages):
    """Add the checked field values and `payload_error` (NULL when all hold).

    `payload_error` is the condensed text without its prefix.
    """
    inputs = messages.columns
    text = F.col("payload").cast("string")
    seal = F.xxhash64("payload").cast("string")
    sealed = F.concat(F.lit("["), text, F.lit(',{"seal":"'), seal, F.lit('"}]'))
    doc = F.from_json(F.when(F.is_valid_utf8(text), sealed), _ENVELOPE, _JSON_OPTIONS)
    parsed = compute_once(messages, _doc=doc)

    p = F.get("_doc", 0)
    whole = p.isNotNull() & (F.size("_doc") == 2) & (F.get("_doc", 1)["seal"] == seal)
    other_json = F.when(
        F.is_valid_utf8(text) & ~F.ltrim(text).startswith("{"), F.try_parse_json(text).isNotNull()
    )
    document_error = F.when(
        ~F.coalesce(whole, F.lit(False)), F.when(other_json, NOT_OBJECT).otherwise(BAD_JSON)
    )
    leaves = compute_once(
        parsed, inputs, _document=document_error, **{f"_{f}": F.to_json(p[f]) for f in _FIELDS}
    )
    version, device, at, water, battery = (F.col(f"_{f}") for f in _FIELDS)
    timed = _with_time(leaves, "measured_at", at)
    values = _with_numbers(timed, water_level=water, battery_voltage=battery)
    values = compute_once(values, payload_device_id=F.when(_is_text(device), _body(device)))
    # Sound payloads, nearly all of them, skip the wording of the checks. Stages keep the
    # generated methods short: the JVM never compiles one of more than 8,000 bytes.
    sound = (
        F.col("_document").isNull()
        & _version_error(version).isNull()
        & _device_error(device).isNull()
        & F.col("measured_at").isNotNull()
        & wire.in_range("water_level", wire.WATER_RANGE)
        & wire.in_range("battery_voltage", wire.BATTERY_RANGE)
    )
    read = [*inputs, "payload_device_id", "measured_at", "water_level", "battery_voltage"]
    judged = compute_once(values, _sound=F.coalesce(sound, F.lit(False)))
    checks = {
        "schema_version": _version_error(version),
        "device_id": _device_error(device),
        "measured_at": _time_error(at, F.col("measured_at")),
        "water_level": _number_error(water, F.col("water_level"), wire.WATER_RANGE),
        "battery_voltage": _number_error(battery, F.col("battery_voltage"), wire.BATTERY_RANGE),
    }
    faulty = ~F.col("_sound") & F.col("_document").isNull()
    for field, error in checks.items():
        judged = compute_once(judged, **{f"_{field}_error": F.when(faulty, _located(field, error))})
    error = F.when(F.col("_document").isNotNull(), _located("payload", F.col("_document"))).when(
        faulty, condense([F.col(f"_{field}_error") for field in checks])
    )
    return compute_once(judged, read, payload_error=error)


def mismatch_reason(topic_id, payload_id):
    return F.concat(
        F.lit("device_id mismatch: topic="),
        wire.quoted(topic_id),
        F.lit(" payload="),
        wire.quoted(payload_id),
    )


def classify(messages):
    """One outcome per message: `outcome` is 'reading' or 'dead_letter'.

    Checks run in a fixed order: topic shape, payload, then the cross-check of
    the two identifiers. Field values are NULL on dead letters.
    """
    checked = compute_once(parse_payload(messages), _topic_id=wire.topic_device_id("topic"))
    payload_id = F.col("payload_device_id")
    reason = (
        F.when(F.col("_topic_id").isNull(), BAD_TOPIC)
        .when(
            F.col("payload_error").isNotNull(),
            F.concat(F.lit("invalid payload: "), F.col("payload_error")),
        )
        .when(payload_id != F.col("_topic_id"), mismatch_reason("_topic_id", "payload_device_id"))
    )
    judged = compute_once(checked, reason=reason)
    valid = F.col("reason").isNull()
    return judged.select(
        *messages.columns,
        F.when(valid, "reading").otherwise("dead_letter").alias("outcome"),
        "reason",
        F.when(valid, payload_id).alias("device_id"),
        F.when(valid, F.col("measured_at")).alias("measured_at"),
        F.when(valid, F.col("water_level")).alias("water_level"),
        F.when(valid, F.col("battery_voltage")).alias("battery_voltage"),
        F.when(valid, F.lit(wire.SCHEMA_VERSION).cast("smallint")).alias("schema_version"),
    )


def readings_of(classified):
    return classified.filter(F.col("outcome") == "reading").drop("outcome", "reason", "topic", "payload")


def dead_letters_of(classified):
    return classified.filter(F.col("outcome") == "dead_letter").select(
        "topic", "payload", "reason", "received_at"
    )
