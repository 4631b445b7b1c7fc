import datetime
import json

import pytest
from conftest import START, aware

from levelcast.sources import captures

TOPIC = "planter/v1/fern-7/telemetry"
STAMP = '"captured_at":"2026-01-01T00:00:00+00:00"'


def line_of(**changes):
    """A sound record with fields changed; `...` takes a field out."""
    fields = {"topic": TOPIC, "captured_at": "2031-03-09T10:11:12.5+02:00", "payload": "moist", **changes}
    return json.dumps({k: v for k, v in fields.items() if v is not ...})


def encode(spark, rows):
    df = spark.createDataFrame(
        [(t, bytearray(p), a) for t, p, a in rows], "topic string, payload binary, captured_at timestamp"
    )
    return [r.value for r in captures.capture_lines(df).collect()]


def test_line_has_fixed_key_order_and_no_spaces(spark):
    when = START + datetime.timedelta(days=40, seconds=1, milliseconds=250)
    (line,) = encode(spark, [(TOPIC, b'["x", 1]', when)])
    assert list(json.loads(line)) == ["topic", "captured_at", "payload"]
    assert json.loads(line) == {"topic": TOPIC, "captured_at": "2026-02-10T00:00:01.250000+00:00", "payload": '["x", 1]'}
    assert line == json.dumps(json.loads(line), separators=(",", ":"))


@pytest.mark.parametrize(
    "payload",
    [bytes(range(256)), "leaf \U0001f331 wet".encode()[:7], bytes(0), "\u00fcber \u2014 \n\t\"\\".encode(), bytes(3)],
)
def test_round_trip_is_lossless(spark, payload):
    when = START + datetime.timedelta(hours=7, microseconds=1)
    (line,) = encode(spark, [(TOPIC, payload, when)])
    row = captures.decode_records(spark.createDataFrame([(line,)], "value string")).first()
    assert row.error is None
    assert (row.topic, bytes(row.payload), aware(row.captured_at)) == (TOPIC, payload, when)


def refused_lines():
    """Lines that break one rule of the format each, with the reason."""
    # A line is one JSON object and nothing besides.
    sound = line_of()
    for shape in (sound[:-1], sound + sound, sound + ",", "{" + sound + "}", "'" + sound + "'", "topic=fern"):
        yield shape, captures.BAD_JSON
    # Text that would close or extend a wrapper around the line.
    for shape in (sound + ',"q":1', '{},"r":' + sound, sound + ',"seal":"0"', sound + "," + sound, sound + "],[" + sound):
        yield shape, captures.BAD_JSON
    for shape in ("3.5", "null", '"fern"', f"[{sound}]", "[]"):
        yield shape, captures.NOT_OBJECT
    # Both names are text; a topic is not empty.
    for other in (..., None, 12, False, ["a"], {"a": 1}):
        yield line_of(topic=other), captures.BAD_TOPIC
        yield line_of(captured_at=other), captures.NO_TIME
    yield line_of(topic=""), captures.BAD_TOPIC
    # The time is an instant.
    for text in ("2031-03-09", "2031-03-09T10:11", "2031-03-09 10:11:12.25"):
        yield line_of(captured_at=text), captures.NO_ZONE
    for text in ("", "noon", "2031-13-09T10:11:12Z", "2031-03-09T10:61:12Z", "1930000000"):
        yield line_of(captured_at=text), captures.BAD_TIME
    # One payload, as text or as base64.
    yield line_of(payload=...), captures.ONE_PAYLOAD
    yield line_of(payload=None, payload_b64=None), captures.ONE_PAYLOAD
    yield line_of(payload_b64="bW9pc3Q="), captures.ONE_PAYLOAD
    for other in (0, True, [], {"wet": 1}):
        yield line_of(payload=other), captures.NOT_TEXT
        yield line_of(payload=..., payload_b64=other), captures.NOT_TEXT_B64
    for text in ("bW9pc3Q", "bW9p c3Q=", "bW9-c3Q=", "====", "bW9pc3Q=="):
        yield line_of(payload=..., payload_b64=text), captures.BAD_B64


def test_refused_lines(spark):
    cases = list(refused_lines())
    df = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(cases)], "i int, value string")
    rows = captures.decode_records(df).orderBy("i").collect()
    assert [(line, r.error) for (line, _), r in zip(cases, rows)] == cases
    assert all(r.topic is None and r.payload is None and r.captured_at is None for r in rows)


def test_read_numbers_lines_and_fails_fast(spark, tmp_path):
    good = '{"topic":"t",' + STAMP + ',"payload":"x"}'
    path = tmp_path / "window.jsonl"
    path.write_text("\n".join([good, "", good, "broken", good]) + "\n")
    rows = captures.read_capture(spark, str(path), "quarantine").orderBy("line_no").collect()
    assert [(r.line_no, r.error) for r in rows] == [(1, None), (3, None), (4, "invalid json"), (5, None)]
    with pytest.raises(Exception, match="line 4: invalid json"):
        captures.read_capture(spark, str(path)).collect()
    with pytest.raises(ValueError):
        captures.read_capture(spark, str(path), "lenient")


def test_line_numbers_across_splits(spark, tmp_path):
    path = tmp_path / "many.txt"
    path.write_text("".join(f"line {i}\n" for i in range(1, 5001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = captures.numbered_lines(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({r.block for r in rows}) > 3
    assert sorted((r.line_no, r.value) for r in rows) == [(i, f"line {i}") for i in range(1, 5001)]


def offsets(spark, seconds, speed, per_block=2):
    rows = [
        ("f", i // per_block, i, START + datetime.timedelta(seconds=s)) for i, s in enumerate(seconds)
    ]
    df = spark.createDataFrame(rows, "file string, block int, line_no int, captured_at timestamp")
    return [r.offset_seconds for r in captures.replay_offsets(df, speed).orderBy("line_no").collect()]


def test_replay_offsets(spark):
    assert offsets(spark, [0, 300, 100, 400], 100.0) == [0.0, 3.0, 3.0, 6.0]
    assert offsets(spark, [0, 50, 50, 250], 10.0) == [0.0, 5.0, 5.0, 25.0]
    assert offsets(spark, [0, 10, 25], None) == [0.0, 0.0, 0.0]
    assert offsets(spark, [7], 1.0) == [0.0]
    for speed in (0.0, -1.0):
        with pytest.raises(ValueError, match="speed"):
            offsets(spark, [0], speed)


def test_capture_bounds(spark):
    rows = [(i, START + datetime.timedelta(seconds=10 * i)) for i in range(10)]
    df = spark.createDataFrame(rows, "n int, captured_at timestamp")
    bounded = lambda **kw: sorted(
        r.n for r in captures.capture_bounds(df, ["captured_at", "n"], "captured_at", **kw).collect()
    )
    assert bounded(count=3) == [0, 1, 2]
    assert bounded(duration_seconds=45) == [0, 1, 2, 3, 4]
    assert bounded(count=3, duration_seconds=10) == [0, 1]
    for bad in ({}, {"count": 0}, {"duration_seconds": -1}):
        with pytest.raises(ValueError):
            bounded(**bad)
