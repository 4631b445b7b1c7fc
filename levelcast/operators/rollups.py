"""Hourly and daily rollups: batch, settled-bucket refresh, real-time union."""

from pyspark.sql import functions as F

from levelcast.functions.timecols import time_bucket

# Fixed values: (refresh start offset, refresh end offset) per unit, in seconds.
POLICIES = {"hour": (6 * 3600, 3600), "day": (3 * 86400, 86400)}
SCHEDULE_SECONDS = {"hour": 15 * 60, "day": 3600}
WIDTH_SECONDS = {"hour": 3600, "day": 86400}
KEY_FORMAT = {"hour": "yyyyMMddHH", "day": "yyyyMMdd"}


def rollup(readings, unit):
    """Per device and bucket: water avg/min/max, battery avg/min, sample count.

    Daily rollups read raw readings too; an average of averages would be wrong.
    """
    return readings.groupBy(
        "device_id", time_bucket(unit, "measured_at").alias("bucket")
    ).agg(
        F.avg("water_level").alias("water_avg"),
        F.min("water_level").alias("water_min"),
        F.max("water_level").alias("water_max"),
        F.avg("battery_voltage").alias("battery_avg"),
        F.min("battery_voltage").alias("battery_min"),
        F.count(F.lit(1)).alias("sample_count"),
    )


def rollup_realtime(settled, readings, unit, boundary):
    """Settled buckets before the boundary, plus an aggregate of the raw rows from it on.

    With no boundary (nothing settled yet) this is the plain aggregate.
    """
    if boundary is None:
        return rollup(readings, unit)
    edge = F.lit(boundary)
    fresh = rollup(readings.filter(F.col("measured_at") >= edge), unit)
    return settled.filter(F.col("bucket") < edge).select(*fresh.columns).unionByName(fresh)


def fleet_watermark(readings):
    """The newest device time of the fleet, NULL on an empty table."""
    return readings.agg(F.max("measured_at").alias("data_now"))


def last_value(readings, value, at="measured_at"):
    return readings.groupBy("device_id").agg(F.max_by(value, at).alias(f"last_{value}"))


def window_checksum(readings, start, end):
    """Order-free digest of the readings in a device-time window.

    Each row is hashed as device|time|water|battery; row hashes are added up, so
    equal windows have equal digests and no task ever sees the whole window.
    """
    row = F.concat_ws(
        "|",
        "device_id",
        F.unix_micros("measured_at").cast("string"),
        F.col("water_level").cast("string"),
        F.col("battery_voltage").cast("string"),
    )
    digest = F.md5(row)

    def part(first):
        return F.conv(F.substring(digest, first, 15), 16, 10).cast("decimal(38,0)")

    total = lambda first: F.coalesce(F.sum(part(first)), F.lit(0)).cast("string")
    inside = readings.filter(F.col("measured_at").between(F.lit(start), F.lit(end)))
    sums = inside.agg(
        F.count(F.lit(1)).alias("readings"), total(1).alias("_high"), total(16).alias("_low")
    )
    return sums.select(
        "readings",
        F.md5(F.concat_ws("|", F.col("readings").cast("string"), "_high", "_low")).alias(
            "checksum"
        ),
    )
