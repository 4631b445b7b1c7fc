import datetime
import random
import statistics

import pytest
from conftest import START, STEP, ramp, series

from levelcast.metrics import METRICS, WATER, configured
from levelcast.operators import forecast as fc

SCHEMA = "device_id string, kind string, at timestamp, value double, seq long"
HOUR = datetime.timedelta(hours=1)


def with_glitch():
    points = ramp(130, 83.0, -1.6)
    points[44] = (points[44][0], 21.5)
    return points


def refilled(n, slope, old=220):
    points = ramp(old, 61.0, -1.3)
    return points + ramp(n, 93.0, slope, start=points[-1][0] + STEP)


def emptied():
    points = ramp(150, 42.0, -2.6)
    return points + [(points[-1][0] + (i + 1) * STEP, 0.0) for i in range(70)]


NAN = float("nan")
# name: points in the order received
CASES = {
    "ok": ramp(260, 71.0, -1.75),
    "glitch": with_glitch(),
    "flat": series([64.2] * 48),
    "drip": ramp(72, 68.0, -0.015),
    "few": ramp(14, 77.0, -1.4),
    "dense": ramp(150, 88.0, -3.0, step=datetime.timedelta(seconds=20)),
    "refilled": refilled(9, -1.9),
    "refilled-later": refilled(55, -1.9),
    "below": series([10.8, 9.6]),
    "emptied": emptied(),
    "backwards": series([70.0, 65.0, 61.5, 60.0])[::-1],
    "swapped": [series([70.0, 65.0, 61.5])[i] for i in (0, 2, 1)],
    "repeated": series([70.0, 69.5, 69.0]) + [(START + 2 * STEP, 68.5)],
    "nan": series([44.0, NAN, 43.0, 42.5]),
    "nan-last": series([44.0, 43.0, NAN]),
    "long": ramp(420, 95.0, -0.9),
    "overflow": ramp(44, 57.0, -1e-12),
}


def run(spark, cases, shift=None, window_start=None, metrics=METRICS):
    """Forecast each case with `now` at its newest sample (plus shift)."""
    out = {}
    groups = {}
    for name, points in cases.items():
        now = max(a for a, _ in points) + (shift or datetime.timedelta())
        groups.setdefault(now, {})[name] = points
    frames = None
    for now, members in groups.items():
        rows = [(n, "water", a, v, i) for n, ps in members.items() for i, (a, v) in enumerate(ps)]
        df = spark.createDataFrame(rows, SCHEMA)
        part = fc.forecast_samples(df, metrics, now, window_start, position="seq")
        frames = part if frames is None else frames.unionByName(part)
    for row in frames.collect():
        out[row.device_id] = row
    return out


@pytest.fixture(scope="module")
def results(spark):
    # One clock for all series that must be fresh at their own newest sample is
    # not possible, so series are aligned to end at the same instant.
    aligned, end = {}, START + datetime.timedelta(days=30)
    for name, points in CASES.items():
        move = end - max(a for a, _ in points)
        aligned[name] = [(a + move, v) for a, v in points]
    return run(spark, aligned)


@pytest.mark.parametrize(
    "name,status",
    [
        ("ok", fc.OK),
        ("glitch", fc.OK),
        ("flat", fc.NOT_DEPLETING),
        ("drip", fc.BEYOND_HORIZON),
        ("few", fc.INSUFFICIENT_POINTS),
        ("dense", fc.INSUFFICIENT_SPAN),
        ("refilled", fc.INSUFFICIENT_POINTS),
        ("refilled-later", fc.OK),
        ("below", fc.AT_OR_BELOW_TARGET),
        ("emptied", fc.AT_OR_BELOW_TARGET),
        ("backwards", fc.INVALID_SERIES),
        ("swapped", fc.INVALID_SERIES),
        ("repeated", fc.INVALID_SERIES),
        ("nan", fc.INVALID_SERIES),
        ("nan-last", fc.INVALID_SERIES),
        ("long", fc.OK),
        ("overflow", fc.BEYOND_HORIZON),
    ],
)
def test_status(results, name, status):
    assert results[name].status == status


def test_crossing_goes_with_status(results):
    for name, row in results.items():
        crosses = row.crosses_at is not None
        # A crossing past the year 9999 has no timestamp; the status stays.
        assert crosses == (row.status in fc.CROSSING_STATUSES and name != "overflow"), name


def test_fit_values(results):
    row, n = results["ok"], 260
    for slope in (row.slope_per_hour, row.slope_low_per_hour, row.slope_high_per_hour):
        assert slope == pytest.approx(-1.75, abs=1e-9)
    assert row.residual_mad == pytest.approx(0.0, abs=1e-9)
    assert row.value_at_anchor == pytest.approx(row.latest_value, abs=1e-9)
    assert (row.fit_points, row.segment_points, row.pairs) == (n, n, n * (n - 1) // 2)
    assert row.fit_span_seconds == (n - 1) * STEP.total_seconds()
    hours = (row.latest_value - WATER.target) / 1.75
    wait = (row.crosses_at - row.as_of).total_seconds()
    assert wait == pytest.approx(hours * 3600, abs=0.01)
    assert abs(results["glitch"].slope_per_hour + 1.6) <= 0.05
    capped = results["long"]
    assert (capped.fit_points, capped.segment_points) == (WATER.max_fit_points, 420)
    below = results["below"]
    assert below.crosses_at == below.as_of == below.crosses_at_latest
    assert results["refilled"].slope_per_hour is None
    assert results["nan-last"].latest_value is None


def test_slope_of_imprecise_series(spark):
    """Bounds from the error of the samples: a pair of two errors over its distance in time."""
    rng, n, slope = random.Random(8), 240, -1.1
    exact = ramp(n, 78.0, slope)
    apart = statistics.median((j - i) * STEP.total_seconds() / 3600 for i in range(n) for j in range(i + 1, n))
    got = run(
        spark,
        {
            "quantised": [(a, round(v * 2) / 2) for a, v in exact],
            "noisy": [(a, v + rng.gauss(0, 0.4)) for a, v in exact],
        },
    )
    assert abs(got["quantised"].slope_per_hour - slope) <= 0.5 / apart
    # Standard error of a straight line through n samples, doubled for the median of pairs; four of them.
    span = n * STEP.total_seconds() / 3600
    assert abs(got["noisy"].slope_per_hour - slope) <= 4 * 2 * 0.4 * (12 / n) ** 0.5 / span
    noisy = got["noisy"]
    assert noisy.slope_low_per_hour < noisy.slope_per_hour < noisy.slope_high_per_hour
    assert 0.1 < noisy.residual_mad < 0.6


def test_staleness(spark):
    """Old after half an hour, or after six gaps where a device reports less often."""
    series_ = {
        "rare": ramp(48, 66.0, -0.4, step=2 * HOUR),
        "low": series([31.0, 7.5]),
        "quick": ramp(90, 81.0, -1.0, step=datetime.timedelta(seconds=15)),
    }
    stale = lambda **kw: {
        n for n, r in run(spark, series_, shift=datetime.timedelta(**kw)).items() if r.status == fc.STALE
    }
    assert stale(minutes=29) == set()
    assert stale(minutes=31) == {"low", "quick"}
    assert stale(hours=11.9) == {"low", "quick"}
    assert stale(hours=12.1) == {"rare", "low", "quick"}


def test_truncated(spark):
    points = CASES["ok"]
    flag = lambda start, p=points: run(spark, {"x": p}, window_start=start)["x"].truncated
    assert flag(points[0][0] - 9 * HOUR) is False
    assert flag(points[0][0] - STEP) is True
    assert flag(None) is True
    assert flag(points[0][0] - STEP, CASES["refilled-later"]) is False


def test_configured_metrics(spark):
    custom = configured(water_target_pct=25.0, battery_alert_days=1)
    assert custom[1].alert_horizon_seconds == 86400.0
    got = run(spark, {"x": series([27.5, 22.0])}, metrics=custom)["x"]
    assert got.status == fc.AT_OR_BELOW_TARGET and got.target_value == 25.0
    for bad in ({"water_target_pct": 101}, {"battery_target_volts": 5}, {"water_alert_days": 0}):
        with pytest.raises(ValueError):
            configured(**bad)


def test_missing_column_is_an_error(spark):
    df = spark.createDataFrame(
        [("a", START, 1.0)], "device_id string, measured_at timestamp, water_level double"
    )
    with pytest.raises(ValueError, match="battery"):
        fc.melt_metrics(df, METRICS)


def test_readings_path_equals_samples_path(spark):
    """The wide scan and the long samples give the same forecasts."""
    rows = [
        (d, a, v, 3.3 + v / 100)
        for d, pts in (("a", CASES["ok"]), ("b", CASES["refilled-later"]), ("c", CASES["long"]))
        for a, v in pts
    ]
    wide = spark.createDataFrame(
        rows, "device_id string, measured_at timestamp, water_level double, battery_voltage double"
    )
    now = max(r[1] for r in rows)
    by_readings = fc.forecast_readings(wide, METRICS, now)
    by_samples = fc.forecast_samples(
        fc.melt_metrics(wide, METRICS), METRICS, now, now - datetime.timedelta(days=10)
    )
    columns = [c for c in fc.FORECAST_COLUMNS if c != "truncated"]
    left, right = by_readings.select(*columns), by_samples.select(*columns)
    assert left.count() == 6
    assert left.exceptAll(right).count() == 0


def test_no_data(spark):
    roster = spark.createDataFrame([("a",), ("b",)], "device_id string")
    done = spark.createDataFrame([("a", "water")], "device_id string, kind string")
    rows = fc.no_data(roster, METRICS, done).collect()
    assert {(r.device_id, r.kind, r.status) for r in rows} == {
        ("a", "battery", "no_data"),
        ("b", "water", "no_data"),
        ("b", "battery", "no_data"),
    }
    assert WATER in METRICS
