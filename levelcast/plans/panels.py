"""The named reports. Each takes tables as DataFrames and returns a DataFrame.

`start` and `end` bound a report on device time, both inclusive.
"""

from pyspark.sql import functions as F

from levelcast.functions.numbers import (
    ATTENTION_CUTS,
    round_half_up,
    threshold_band,
    whole_seconds,
)
from levelcast.functions.timecols import horizon_seconds, seconds_between
from levelcast.functions.wire import escape_bytes
from levelcast.metrics import KINDS
from levelcast.operators import arrivals, forecast, rollups, series
from levelcast.operators.merge import latest_per_key

EXPECTED_PER_HOUR = 12
DAY = 86400.0


def _between(df, column, start, end):
    return df.filter(F.col(column).between(F.lit(start), F.lit(end)))


def _scalar(df, aggregate):
    """A whole-table aggregate as a scalar subquery."""
    return df.agg(aggregate).scalar()


def water_raw(telemetry, start, end):
    return (
        _between(telemetry, "measured_at", start, end)
        .select(F.col("measured_at").alias("time"), "device_id", "water_level")
        .orderBy("time", "device_id")
    )


def battery_raw(telemetry, start, end):
    return (
        _between(telemetry, "measured_at", start, end)
        .select(F.col("measured_at").alias("time"), "device_id", "battery_voltage")
        .orderBy("time", "device_id")
    )


def checkin_staleness(devices, telemetry):
    newest = _scalar(telemetry, F.max("measured_at"))
    behind = whole_seconds(seconds_between(newest, "last_seen"))
    return devices.select("device_id", behind.alias("behind_seconds")).orderBy("device_id")


def _hourly_part(hourly, start, end, columns):
    return (
        _between(hourly, "bucket", start, end)
        .select(F.col("bucket").alias("time"), "device_id", *columns)
        .orderBy("time", "device_id")
    )


def water_hourly(hourly, start, end):
    return _hourly_part(hourly, start, end, ["water_avg"])


def water_hourly_envelope(hourly, start, end):
    return _hourly_part(hourly, start, end, ["water_avg", "water_min", "water_max"])


def dead_letter_total(dead_letter):
    return dead_letter.agg(F.count(F.lit(1)).alias("dead_lettered"))


def dead_letter_rate(dead_letter, telemetry, now):
    """Dead letters per minute of the covered part of the last 15 wall minutes."""
    now = F.lit(now)
    opened = now - F.expr("INTERVAL '15' MINUTE")
    recent = dead_letter.filter(F.col("received_at") > opened).agg(
        F.count(F.lit(1)).alias("_dead")
    )
    first = _scalar(telemetry, F.min("received_at"))
    covered = F.greatest(seconds_between(now, F.greatest(first, opened)), F.lit(60.0))
    return recent.select(
        round_half_up(F.col("_dead") * 60.0 / covered, 2).alias("per_minute")
    )


def deduplicated_total(ingest_events):
    return ingest_events.filter(F.col("event") == "deduplicated").agg(
        F.count(F.lit(1)).alias("deduplicated")
    )


def out_of_order_arrivals(telemetry):
    return arrivals.stored_out_of_order(telemetry).agg(F.count(F.lit(1)).alias("out_of_order"))


def missed_checkins(hourly, start, end, expected=EXPECTED_PER_HOUR, ends=None):
    """Shortfall per device and full hour; the fleet's first and last hour are left out.

    `ends` is a one-row (first, last) of the fleet's hours. Without it they are
    looked up in `hourly`, which is then read as a whole.
    """
    if ends is None:
        ends = hourly.agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"))
    full = _between(hourly, "bucket", start, end).filter(
        (F.col("bucket") > _scalar(ends, F.min("first"))) & (F.col("bucket") < _scalar(ends, F.max("last")))
    )
    missed = F.greatest(F.lit(expected) - F.col("sample_count"), F.lit(0))
    return full.select(
        F.col("bucket").alias("time"), "device_id", missed.alias("missed")
    ).orderBy("time", "device_id")


def recent_dead_letters(dead_letter, n=10, prefix=80):
    """The newest dead letters with a printable payload prefix."""
    newest = dead_letter.orderBy(F.col("received_at").desc(), "topic", "payload").limit(n)
    return newest.select(
        "received_at", "topic", "reason", escape_bytes("payload", prefix).alias("payload_prefix")
    )


def last_dead_letters(dead_letter, n=3):
    newest = dead_letter.orderBy(F.col("received_at").desc(), "topic", "payload").limit(n)
    return newest.select("topic", "reason", "received_at")


def forecasts_latest(devices, forecasts, kinds=KINDS):
    """The newest forecast per roster device and kind, with the seconds left."""
    roster = devices.select(
        "device_id", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind")
    )
    newest = latest_per_key(forecasts, ["device_id", "kind"], ["as_of"])
    return roster.join(newest, ["device_id", "kind"]).withColumn(
        "horizon_seconds", horizon_seconds("crosses_at", "as_of")
    )


def attention_needed(devices, latest):
    """Days left per device, soonest metric first; NULL reads as warming up."""
    counted = latest.filter(F.col("status").isin(*forecast.ATTENTION_STATUSES))
    soonest = counted.groupBy("device_id").agg(F.min("horizon_seconds").alias("_soonest"))
    days = F.col("_soonest") / F.lit(DAY)
    label = F.coalesce(threshold_band(days, ATTENTION_CUTS), F.lit("warming up"))
    return (
        devices.select("device_id")
        .join(soonest, "device_id", "left")
        .select("device_id", days.alias("days_left"), label.alias("label"))
        .orderBy("device_id")
    )


def device_list(devices):
    return devices.select("device_id").orderBy("device_id")


def forecast_history(forecasts, device_id, start, end):
    kept = forecasts.filter(
        (F.col("device_id") == device_id)
        & (F.col("kind") == "water")
        & F.col("status").isin(*forecast.ATTENTION_STATUSES)
    )
    return (
        _between(kept, "as_of", start, end)
        .select(
            F.col("as_of").alias("time"),
            F.lit("days until empty").alias("metric"),
            (horizon_seconds("crosses_at", "as_of") / F.lit(DAY)).alias("value"),
        )
        .orderBy("time")
    )


def actual_level(telemetry, device_id, start, end):
    return (
        _between(telemetry.filter(F.col("device_id") == device_id), "measured_at", start, end)
        .select(
            F.col("measured_at").alias("time"),
            F.lit("water level").alias("metric"),
            F.col("water_level").alias("value"),
        )
        .orderBy("time")
    )


def forecast_detail(latest):
    return latest.orderBy(F.asc_nulls_first("horizon_seconds"), "device_id", "kind").select(
        "device_id",
        "kind",
        "status",
        round_half_up("latest_value", 2).alias("latest"),
        round_half_up("target_value", 2).alias("target"),
        round_half_up(F.col("slope_per_hour") * 24.0, 3).alias("change_per_day"),
        round_half_up(F.col("horizon_seconds") / DAY, 2).alias("days_left"),
        "crosses_at",
        "crosses_at_earliest",
        "crosses_at_latest",
        "fit_points",
        round_half_up(F.col("fit_span_seconds") / 3600.0, 1).alias("fit_hours"),
        "as_of",
    )


def fleet_snapshot(devices, telemetry):
    """Latest levels per device. Readings are aggregated before the join."""
    latest = telemetry.groupBy("device_id").agg(
        F.max_by("water_level", "measured_at").alias("_water"),
        F.max_by("battery_voltage", "measured_at").alias("_battery"),
        F.max("measured_at").alias("last_reading"),
    )
    return (
        devices.join(latest, "device_id")
        .select(
            "device_id",
            round_half_up("_water", 1).alias("water_pct"),
            round_half_up("_battery", 2).alias("battery_v"),
            "last_reading",
            "first_seen",
        )
        .orderBy("device_id")
    )


def daily_water_consumption(telemetry):
    used = series.daily_consumption(telemetry)
    return used.select(
        "device_id", "day", round_half_up("water_used", 1).alias("pct_consumed")
    ).orderBy("day", "device_id")


def checkin_health(hourly, expected=EXPECTED_PER_HOUR, n=20):
    """The newest hours that delivered fewer readings than expected.

    The fleet's newest hour is still filling and is left out.
    """
    short = hourly.filter(
        (F.col("sample_count") < expected) & (F.col("bucket") < _scalar(hourly, F.max("bucket")))
    )
    return (
        short.select("device_id", "bucket", "sample_count")
        .orderBy(F.col("bucket").desc(), "device_id")
        .limit(n)
    )


def recent_hourly(hourly, n=8):
    newest = hourly.orderBy(F.col("bucket").desc(), "device_id").limit(n)
    return newest.select(
        "device_id", "bucket", round_half_up("water_avg", 1).alias("water_avg"), "sample_count"
    )


def device_last_readings(telemetry, device_id, n=5):
    mine = telemetry.filter(F.col("device_id") == device_id)
    return mine.orderBy(F.col("measured_at").desc()).limit(n)


def window_counts(telemetry, ingest_events, start, end):
    """Readings and absorbed redeliveries in a device-time window."""
    events = _between(ingest_events, "measured_at", start, end).filter(
        F.col("event") == "deduplicated"
    )
    stored = _between(telemetry, "measured_at", start, end)
    united = stored.select(F.lit(1).alias("r"), F.lit(0).alias("e")).unionByName(
        events.select(F.lit(0).alias("r"), F.lit(1).alias("e"))
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return united.agg(total("r").alias("readings"), total("e").alias("dedupe_events"))


def window_checksum(telemetry, start, end):
    return rollups.window_checksum(telemetry, start, end)
