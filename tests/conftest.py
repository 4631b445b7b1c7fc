import datetime
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from levelcast.session import build_session  # noqa: E402

START = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)
STEP = datetime.timedelta(minutes=5)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]",
        "levelcast-tests",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def tables(spark, tmp_path):
    from levelcast.sources.tables import Tables

    return Tables(spark, str(tmp_path / "tables"))


def at(minutes=0, **delta):
    return START + datetime.timedelta(minutes=minutes, **delta)


def aware(value):
    """A collected timestamp as an aware UTC instant."""
    return None if value is None else value.astimezone(datetime.timezone.utc)


def ramp(n, value, slope_per_hour, step=STEP, start=START):
    hours = step.total_seconds() / 3600.0
    return [(start + i * step, value + slope_per_hour * hours * i) for i in range(n)]


def series(values, step=STEP, start=START):
    return [(start + i * step, float(v)) for i, v in enumerate(values)]


def load(tables, rows, batch="load"):
    """Store (device_id, measured_at, water, battery[, received_at]) rows as telemetry."""
    from levelcast.schemas import READINGS
    from pyspark.sql import functions as F

    full = [
        (r[0], r[1], r[2], r[3], 1, r[4] if len(r) > 4 else r[1]) for r in rows
    ]
    df = tables.spark.createDataFrame(full, READINGS)
    tables.append_telemetry(df.withColumn("batch_id", F.lit(batch)))
    return df
