"""Plan shapes: what is pruned, what is shuffled, what never happens."""

import datetime

import pytest
from conftest import START, load, ramp
from pyspark.sql import functions as F

from levelcast.operators import arrivals, forecast, rollups, series
from levelcast.plans import catalog, oracle, panels
from levelcast.metrics import METRICS

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture()
def telemetry(tables):
    load(tables, [("p", a, v, 3.9) for a, v in ramp(600, 90.0, -0.1, datetime.timedelta(hours=1))])
    return tables


def test_scan_is_pruned_and_projected(telemetry):
    since = START + datetime.timedelta(days=20)
    window = telemetry.telemetry(since=since).select("device_id", "measured_at", "water_level")
    text = plan(window)
    assert "PartitionFilters: [isnotnull(measured_date" in text
    assert "PushedFilters: [IsNotNull(measured_at), GreaterThan(measured_at" in text
    schema = next(line for line in text.splitlines() if line.startswith("ReadSchema"))
    assert "battery_voltage" not in schema and "batch_id" not in schema


def test_first_arrival_is_limited_before_the_shuffle(spark):
    text = plan(arrivals.first_arrivals(catalog._valid(spark, SF)))
    assert text.count("WindowGroupLimit") >= 2
    assert text.count("from_json") <= 2  # the payload is parsed once


def test_rollup_aggregates_before_the_shuffle(spark):
    text = plan(rollups.rollup(catalog._readings(spark, SF), "hour"))
    assert text.count("HashAggregate (") >= 2 and "partial_avg" in text
    assert text.count("Exchange (") == 1 and "SortAggregate" not in text


def test_no_cross_joins_and_no_whole_device_windows(spark):
    readings = catalog._readings(spark, SF)
    now = datetime.datetime(2024, 1, 31, tzinfo=datetime.timezone.utc)
    frames = {
        "forecast": forecast.forecast_readings(readings, METRICS, now),
        "segments": series.segment_split(forecast.melt_metrics(readings), METRICS),
        "late": arrivals.stored_out_of_order(readings),
        "used": panels.daily_water_consumption(readings),
        "missed": panels.missed_checkins(rollups.rollup(readings, "hour"), START, START),
    }
    for name, df in frames.items():
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name
        assert "SinglePartition" not in text or name == "missed", name


def test_fit_takes_at_most_the_cap_from_each_task(spark):
    readings = catalog._readings(spark, SF)
    text = plan(forecast.forecast_readings(readings, METRICS, START))
    assert "WindowGroupLimit" in text and text.count("ArrowEvalPython (") == 1


def test_every_query_has_sql(spark):
    assert set(catalog.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize(
    "name", ["missed_checkins", "dedupe_first_arrival", "segment_split", "forecast_detail"]
)
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    df = catalog.queries()[name](spark, SF)
    order = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in order)) for r in df.collect())
    result = con.sql(oracle.oracle_sql()[name])
    places = [result.columns.index(c) for c in order]
    want = sorted(str(tuple(r[i] for i in places)) for r in result.fetchall())
    assert sorted(result.columns) == order and got == want
    assert df.filter(F.lit(True)).columns


def test_fit_code_needs_no_package_on_executors(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    blob = tmp_path / "fit.bin"
    blob.write_bytes(cloudpickle.dumps(forecast._fit_one))
    script = (
        "import pickle, numpy as np; "
        f"fit = pickle.load(open({str(blob)!r}, 'rb')); "
        "x = np.arange(5) * 3600000000; "
        "assert abs(fit(x, 9.0 - np.arange(5.0))[1] + 1.0) < 1e-12"
    )
    subprocess.run([sys.executable, "-c", script], cwd=tmp_path, check=True, timeout=60)
