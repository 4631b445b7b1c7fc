import json

import pytest
from conftest import START, aware
from pyspark.sql import functions as F

from levelcast import schemas
from levelcast.functions import numbers, timecols, wire
from levelcast.operators.classify import classify

TOPIC = "planter/v1/p-0/telemetry"
GOOD = {
    "device_id": "p-0",
    "measured_at": "2026-01-01T00:00:00Z",
    "water_level": 55.5,
    "battery_voltage": 3.8,
}


def payload(**changes):
    fields = {**GOOD, **changes}
    return json.dumps({k: v for k, v in fields.items() if v is not ...}).encode()


def raw(field, text):
    rest = ",".join(f'"{k}":{json.dumps(v)}' for k, v in GOOD.items() if k != field)
    return ("{" + f'"{field}":{text},' + rest + "}").encode()


def outcomes(spark, messages):
    rows = [(t, bytearray(p), START, i) for i, (t, p) in enumerate(messages)]
    df = classify(spark.createDataFrame(rows, schemas.MESSAGES))
    return df.orderBy("arrival_seq").collect()


def test_topics(spark):
    """Four segments: three of them fixed, the third any text that is not empty."""
    right = ["planter", "v1", "fern-7", "telemetry"]
    topics = {"/".join([*right[:2], name, right[3]]): name for name in ("fern-7", "7", "Fern 7", "\u00e9t\u00e9", "-" * 90)}
    for place in (0, 1, 3):
        for other in ("", "x", right[place].upper(), right[place] + "x"):
            topics["/".join([*right[:place], other, *right[place + 1 :]])] = None
    for wrong in (right[:3], [*right, ""], ["", *right], [*right[:2], "", right[3]], [*right[:3], "a", right[3]], []):
        topics["/".join(wrong)] = None
    df = spark.createDataFrame([(t,) for t in topics], "topic string")
    got = df.select("topic", wire.topic_device_id("topic").alias("id")).collect()
    assert {r.topic: r.id for r in got} == topics
    back = df.select("topic", wire.telemetry_topic(wire.topic_device_id("topic")).alias("t")).filter("t IS NOT NULL")
    assert all(r.t == r.topic for r in back.collect())


def test_device_ids(spark):
    """1 to 32 of a-z, 0-9, '_' and '-'; the first is a letter or a digit."""
    inner = "abcdefghijklmnopqrstuvwxyz0123456789"
    good = [*inner, *(c + t for c in "q4" for t in "_-z9"), inner[:32], "7" * 32, "m" + "-_" * 15]
    bad = ["", inner[:33], *(c for c in "_-. /+#$@A\u00e9\n"), *("q" + c for c in ". /+#$@Z\u00e9\n"), " q", "q "]
    df = spark.createDataFrame([(v,) for v in good + bad], "v string")
    got = [r.ok for r in df.select(wire.is_device_id("v").alias("ok")).collect()]
    assert got == [True] * len(good) + [False] * len(bad)


ACCEPTED = [
    (payload(), START, 55.5),
    (payload(water_level="55.5"), START, 55.5),
    (payload(water_level=True), START, 1.0),
    (payload(water_level=0), START, 0.0),
    (payload(water_level=100), START, 100.0),
    (payload(battery_voltage=2.5), START, 55.5),
    (payload(battery_voltage=4.4), START, 55.5),
    (payload(soil_temperature=21.5, nested={"a": [1, {"b": None}]}), START, 55.5),
    (payload(schema_version=1), START, 55.5),
    (raw("schema_version", "1.0"), START, 55.5),
    (payload(schema_version=True), START, 55.5),
    (payload(measured_at="2026-01-01T02:00:00+02:00"), START, 55.5),
    (payload(measured_at="2026-01-01 02:00+0200"), START, 55.5),
    (payload(measured_at="2026-01-01t00:00:00.0000009z"), START, 55.5),
    (payload(measured_at=1767225600), START, 55.5),
    (payload(measured_at="1767225600"), START, 55.5),
    (payload(measured_at=1767225600000), START, 55.5),
    (b" " + payload() + b"\n", START, 55.5),
    (raw("water_level", '7,"water_level":55.5'), START, 55.5),
]

REFUSED = [
    (payload(water_level=150), "water_level"),
    (payload(water_level=-0.1), "water_level"),
    (payload(battery_voltage=2.49), "battery_voltage"),
    (payload(battery_voltage=4.41), "battery_voltage"),
    (payload(water_level="high"), "water_level"),
    (payload(water_level=None), "valid number"),
    (payload(water_level=[1]), "valid number"),
    (raw("water_level", "NaN"), "water_level"),
    (raw("water_level", '"NaN"'), "water_level"),
    (raw("water_level", "Infinity"), "water_level"),
    (raw("water_level", '"5d"'), "water_level"),
    (payload(device_id=...), "device_id: Field required"),
    (payload(device_id=7), "device_id"),
    (payload(device_id="NOPE!"), "device_id"),
    (payload(schema_version="1"), "schema_version: Input should be 1"),
    (payload(schema_version=2), "schema_version"),
    (payload(schema_version=None), "schema_version"),
    (payload(measured_at="2026-01-01T00:00:00"), "measured_at: Input should have timezone info"),
    (payload(measured_at="2026-01-01"), "timezone"),
    (payload(measured_at="yesterday"), "measured_at"),
    (payload(measured_at="now"), "measured_at"),
    (payload(measured_at="2026-02-30T00:00:00Z"), "measured_at"),
    (payload(measured_at="2026-01-01T25:00:00Z"), "measured_at"),
    (payload(measured_at=None), "measured_at"),
    (payload()[:25], "invalid payload: payload: Invalid JSON"),
    (payload() + b" trailing", "Invalid JSON"),
    (payload() + payload(), "Invalid JSON"),
    (b"", "invalid payload"),
    (b"\xff\xfe{}", "Invalid JSON"),
    (b"[1]", "Input should be an object"),
    (b"5", "Input should be an object"),
]


def test_accepted_payloads(spark):
    got = outcomes(spark, [(TOPIC, p) for p, _, _ in ACCEPTED])
    for row, (sent, when, water) in zip(got, ACCEPTED):
        assert row.outcome == "reading" and row.reason is None, (sent, row.reason)
        assert (aware(row.measured_at), row.water_level) == (when, water), sent
        assert row.device_id == "p-0" and row.schema_version == 1


def test_refused_payloads(spark):
    got = outcomes(spark, [(TOPIC, p) for p, _ in REFUSED])
    for row, (sent, part) in zip(got, REFUSED):
        assert row.outcome == "dead_letter" and part in row.reason, (sent, row.reason)
        assert bytes(row.payload) == sent and row.device_id is None
        assert len(row.reason) <= 520


def test_text_around_a_payload_is_refused(spark):
    """What would close or extend a wrapper around the payload is no JSON."""
    sound = payload().decode()
    forms = [sound + ',"q":1', '{},"p":' + sound, sound + ',"p":{}', sound + "," + sound, sound + ',{"seal":"1"}', sound + "],[" + sound, "{}" + sound]
    for row in outcomes(spark, [(TOPIC, f.encode()) for f in forms]):
        assert row.reason == "invalid payload: payload: Invalid JSON", bytes(row.payload)


def test_times_before_year_one_are_refused(spark):
    for number in (-250_000_000_000_000, -62_135_596_801_000, 253_402_300_800_000):
        (row,) = outcomes(spark, [(TOPIC, payload(measured_at=number))])
        assert row.outcome == "dead_letter" and "measured_at" in row.reason
    (row,) = outcomes(spark, [(TOPIC, payload(measured_at=-62_000_000_000_000))])
    assert row.outcome == "reading"


def test_rounding_of_very_large_values(spark):
    row = spark.range(1).select(numbers.round_half_up(F.lit(1e300), 1).alias("v"), numbers.round_half_up(F.lit(None).cast("double"), 1).alias("n")).first()
    assert row.v == 1e300 and row.n is None


def test_order_of_checks_and_wording(spark):
    hostile = b'{"device_id":"NOPE!","measured_at":"yesterday","water_level":"high"}'
    got = outcomes(
        spark,
        [
            ("planter/v1/p-1/telemetry", payload()),
            ("planter/v1/p-0/status", b"nope"),
            ("planter/v1/o'x/telemetry", payload()),
            (TOPIC, hostile),
            ("planter/v1/p-1/telemetry", payload(water_level=150)),
        ],
    )
    assert got[0].reason == "device_id mismatch: topic='p-1' payload='p-0'"
    assert got[1].reason == "topic does not match planter/v1/{device_id}/telemetry"
    assert got[2].reason == "device_id mismatch: topic=\"o'x\" payload='p-0'"
    assert got[3].reason.startswith("invalid payload: device_id: ")
    assert got[3].reason.count("; ") == 3 and got[3].reason.endswith("; (+1 more)")
    assert got[4].reason.startswith("invalid payload: water_level")


def test_escape_bytes(spark):
    cases = {b"plain": "plain", b"a\\b": "a\\\\b", b"\x00\xff": "\\000\\377", b"": "", b"a\n": "a\n"}
    df = spark.createDataFrame([(bytearray(k),) for k in cases], "p binary")
    got = df.select("p", wire.escape_bytes("p").alias("t"), wire.escape_bytes("p", 3).alias("s"))
    for row in got.collect():
        assert row.t == cases[bytes(row.p)]
        assert row.s == row.t[:3]


@pytest.mark.parametrize(
    "value,digits,expected", [(2.345, 2, 2.35), (-2.345, 2, -2.35), (37.849999999999994, 1, 37.9), (0.125, 2, 0.13)]
)
def test_round_half_up(spark, value, digits, expected):
    df = spark.range(1).select(numbers.round_half_up(F.lit(value), digits).alias("v"))
    assert df.first().v == expected


def test_bands_and_seconds(spark):
    df = spark.createDataFrame([(599.9,), (600.0,), (1800.0,), (None,)], "v double")
    bands = [r[0] for r in df.select(numbers.threshold_band("v", numbers.STALENESS_CUTS)).collect()]
    assert bands == ["green", "amber", "red", None]
    days = spark.createDataFrame([(0.9,), (1.0,), (3.0,)], "v double")
    got = [r[0] for r in days.select(numbers.threshold_band("v", numbers.ATTENTION_CUTS)).collect()]
    assert got == ["red", "amber", "green"]
    assert spark.range(1).select(numbers.whole_seconds(F.lit(1.5))).first()[0] == 2


def test_crossing_guard(spark):
    df = spark.createDataFrame([(START,)], "a timestamp")
    c = lambda value, slope: timecols.crossing_time(F.lit(value), F.lit(10.0), F.lit(slope), "a")
    row = df.select(
        c(80.0, -2.0).alias("plain"),
        c(80.0, -1e-300).alias("never"),
        c(80.0, -1e-4).alias("late"),
        c(80.0, 0.0).alias("flat"),
        c(5.0, -1.0).alias("below"),
        timecols.horizon_seconds(F.lit(None).cast("timestamp"), "a").alias("none"),
    ).first()
    assert (aware(row.plain) - START).total_seconds() == 35 * 3600
    assert row.never is None and row.flat is None and row.none is None
    assert aware(row.late).year == 2105
    assert aware(row.below) == START


def test_times_outside_the_calendar(spark):
    """Year 0 as written, year 0 or 10000 once in UTC; the edges themselves are times."""
    times = {
        "0000-01-01T00:00:00Z": False, "0000-12-31T23:00:00-05:00": False, "0001-01-01T00:00:00+05:00": False,
        "0001-01-01T00:00:00Z": True, "0001-01-01T06:00:00+05:00": True, "0001-01-01T04:59:59.999999+05:00": False,
        "9999-12-31T23:59:59.999999Z": True, "9999-12-31T23:00:00-05:00": False, "9999-12-31T18:59:59-05:00": True,
    }
    given = [(TOPIC, bytearray(payload(measured_at=t)), START, i) for i, t in enumerate(times)]
    judged = classify(spark.createDataFrame(given, schemas.MESSAGES))
    rows = judged.orderBy("arrival_seq").select("outcome", "reason").collect()
    assert [r.outcome == "reading" for r in rows] == list(times.values())
    refused = [r.reason for r in rows if r.outcome != "reading"]
    assert all(r == "invalid payload: measured_at: Input should be a valid datetime" for r in refused)


def test_numbers_as_text(spark):
    """White space of all kinds around a number and underscores between digits are read over."""
    texts = {
        '"5\\t"': 5.0, '"\\n 5.5 \\r"': 5.5, '"\\u00a05\\u3000"': 5.0, '"3_5"': 35.0, '"1_0.2_5"': 10.25, '"\\u0035"': 5.0,
        '"_5"': None, '"5_"': None, '"5__5"': None, '"5 5"': None, '"5._5"': None, '""': None, '"\\t"': None, '"5\\\\t"': None,
    }
    rows = outcomes(spark, [(TOPIC, raw("water_level", t)) for t in texts])
    assert [r.water_level for r in rows] == list(texts.values())
