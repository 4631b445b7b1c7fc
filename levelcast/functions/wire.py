"""The wire contract: topics, identifiers, payload text."""

from pyspark.sql import functions as F

from levelcast.functions.timecols import as_col

# Fixed values of the wire contract.
TOPIC_ROOT = "planter"
TOPIC_VERSION = "v1"
TOPIC_LEAF = "telemetry"
SCHEMA_VERSION = 1
DEVICE_ID_PATTERN = "^[a-z0-9][a-z0-9_-]{0,31}$"
WATER_RANGE = (0.0, 100.0)
BATTERY_RANGE = (2.5, 4.4)

_TOPIC_REGEX = rf"(?s)\A{TOPIC_ROOT}/{TOPIC_VERSION}/([^/]+)/{TOPIC_LEAF}\z"
_DEVICE_REGEX = r"\A[a-z0-9][a-z0-9_-]{0,31}\z"


def topic_device_id(topic):
    """The device segment of a v1 telemetry topic, NULL for any other topic."""
    return F.nullif(F.regexp_extract(as_col(topic), _TOPIC_REGEX, 1), F.lit(""))


def telemetry_topic(device_id):
    return F.concat(
        F.lit(f"{TOPIC_ROOT}/{TOPIC_VERSION}/"), as_col(device_id), F.lit(f"/{TOPIC_LEAF}")
    )


def is_device_id(c):
    return as_col(c).rlike(_DEVICE_REGEX)


def in_range(c, bounds):
    return as_col(c).between(*bounds)


def quoted(c):
    """A quoted text literal: single quotes unless only the text itself has some."""
    c = as_col(c)
    body = c
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(single)


def escape_bytes(payload, chars=None):
    """Printable text of raw bytes: octal for zero and high bytes, doubled backslash.

    Whole payloads are rendered unless `chars` asks for the leading characters;
    then only the bytes that can reach the output are touched (each byte gives
    at least one character).
    """
    payload = as_col(payload)
    if chars is not None:
        payload = F.substring(payload, 1, chars)
    text = F.hex(payload)
    positions = F.sequence(F.lit(1), F.octet_length(payload))

    def shown(i):
        byte = F.conv(F.substr(text, i * 2 - 1, F.lit(2)), 16, 10).cast("int")
        octal = F.concat(F.lit("\\"), F.lpad(F.conv(byte.cast("string"), 10, 8), 3, "0"))
        return (
            F.when((byte == 0) | (byte >= 128), octal)
            .when(byte == 92, F.lit("\\\\"))
            .otherwise(F.chr(byte))
        )

    whole = F.when(F.octet_length(payload) == 0, F.lit("")).otherwise(
        F.array_join(F.transform(positions, shown), "")
    )
    return whole if chars is None else F.left(whole, F.lit(chars))
