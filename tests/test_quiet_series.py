"""Quiet devices are lagged and summed up without slices; busy ones are cut into slices, with the same results."""

import datetime

import pytest
from conftest import START, load

from levelcast.metrics import METRICS
from levelcast.operators import forecast, series

END = START + datetime.timedelta(days=4)
AT_ONCE = 0  # busy_rows under which every device is busy


def fleet(spark, tables):
    """Falling levels with refills, gaps, a doubled time, a value that is no number, and one reading alone."""
    rows = []
    for i in range(900):
        when = START + datetime.timedelta(minutes=5 * i + (600 if i > 400 else 0))
        rows.append(("plain", when, 95.0 - 0.05 * i, 4.1 - 0.0003 * i))
        rows.append(("filled", when, 90.0 - 0.2 * (i % 350), 4.1 - 0.0003 * (i % 500)))
        rows.append(("slow", START + datetime.timedelta(minutes=7 * (i // 2), seconds=i % 2), 80.0 - 0.01 * i, 4.0))
        rows.append(("broken", when, float("nan") if i == 500 else 50.0, 4.0))
    rows += [("twice", START, 50.0, 4.0), ("twice", START, 50.0, 4.0), ("alone", START, 50.0, 4.0)]
    load(tables, rows)
    return tables.telemetry()


def shown(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_busy_and_quiet_devices_have_the_same_forecasts(spark, tables):
    rows = fleet(spark, tables)
    quiet, busy = (forecast.forecast_readings(rows, METRICS, END, busy_rows=n) for n in (10_000, AT_ONCE))
    mixed = forecast.forecast_readings(rows, METRICS, END, busy_rows=100)
    assert len(shown(quiet)) == 12 and shown(quiet) == shown(busy) == shown(mixed)


@pytest.mark.parametrize("busy_rows", [AT_ONCE, 100, 10_000])
def test_busy_and_quiet_keys_have_the_same_previous_rows(spark, tables, busy_rows):
    rows = fleet(spark, tables).filter("device_id <> 'twice'").drop("batch_id")
    lagged = series.with_previous(rows, ["device_id"], "measured_at", ["water_level"], busy_rows=busy_rows)
    plain = series.lag_sliced(rows, ["device_id"], "measured_at", ["water_level"])
    assert shown(lagged) == shown(plain)


def test_rows_of_quiet_devices_are_shuffled_twice(spark, tables):
    """Once to be lagged, once for the newest ones; what else moves has one row per series."""
    found = forecast.forecast_readings(fleet(spark, tables), METRICS, END)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(device_id") <= 4 and "_slice" not in plan
