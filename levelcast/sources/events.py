"""Readings and wire messages derived from a generic `events` table.

Map-only integer arithmetic (no per-device minimum, so no shuffle): water falls
0.2-0.6 pct/h from 100 and is refilled at 10, battery falls 0.8-1.2 mV/h.
"""

from pyspark.sql import functions as F

from levelcast.functions import wire

# 2024-01-01T00:00:00Z in microseconds, and one hour.
EPOCH_US = 1_704_067_200_000_000
HOUR_US = 3_600_000_000


def load_events(spark, directory):
    events = spark.read.parquet(f"{directory}/events.parquet")
    return events.select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("measured_at")
    )


def _levels(events):
    elapsed = f"(unix_micros(measured_at) - {EPOCH_US})"
    tenths = f"1000 - ({elapsed} * (2 + user_id % 5) div {HOUR_US} + user_id * 37) % 900"
    millis = f"4200 - ({elapsed} * (8 + user_id % 5) div {HOUR_US * 10} + user_id * 11) % 900"
    return events.select(
        "event_id",
        F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("device_id"),
        "measured_at",
        F.expr(tenths).alias("tenths"),
        F.expr(millis).alias("millis"),
        F.expr(
            "measured_at + CASE WHEN event_id % 33 = 0 THEN INTERVAL '36' HOUR "
            "ELSE INTERVAL '1' SECOND END"
        ).alias("received_at"),
    )


def readings(spark, directory):
    """One reading per event; every 33rd arrives 36 hours late."""
    return _levels(load_events(spark, directory)).select(
        "device_id",
        "measured_at",
        (F.col("tenths") / 10).alias("water_level"),
        (F.col("millis") / 1000).alias("battery_voltage"),
        F.lit(1).cast("smallint").alias("schema_version"),
        "received_at",
    )


def messages(spark, directory):
    """Wire messages: damage by event_id % 50, every 20th emitted twice.

    Damage 8 and 9 are text that would extend a wrapper around the payload, 10 and
    11 times outside the calendar, in year 0 as written and as UTC; 12 and 13 are
    numbers as text that are valid: with white space and with an underscore.
    """
    rows = _levels(load_events(spark, directory)).withColumn("damage", F.col("event_id") % 50)
    damaged = lambda n: F.col("damage") == n
    at = F.date_format("measured_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    at = F.when(damaged(10), "0000-01-01T00:00:00").when(damaged(11), "0001-01-01T00:00:00").otherwise(at)
    zone = F.when(damaged(6), "").when(damaged(11), "+05:00").otherwise("Z")
    level = F.expr("concat(tenths div 10, '.', tenths % 10)")
    water = (
        F.when(damaged(2), '"high"')
        .when(damaged(7), "150")
        .when(damaged(12), F.concat(F.lit('"'), level, F.lit('\\t\\u00a0"')))
        .when(damaged(13), F.concat(F.lit('"'), F.left(level, F.lit(1)), F.lit("_"), F.substr(level, F.lit(2)), F.lit('"')))
        .otherwise(level)
    )
    device = F.when(damaged(3), "").otherwise(
        F.concat(F.lit('"device_id":"'), "device_id", F.lit('",'))
    )
    text = F.concat(
        F.lit('{"schema_version":1,'),
        device,
        F.lit('"measured_at":"'),
        at,
        zone,
        F.lit('","water_level":'),
        water,
        F.lit(',"battery_voltage":'),
        F.expr("concat(millis div 1000, '.', lpad(millis % 1000, 3, '0'))"),
        F.lit("}"),
    )
    half = F.expr("left(_text, length(_text) div 2)")
    topic = (
        F.when(damaged(4), wire.telemetry_topic(F.concat(F.col("device_id"), F.lit("x"))))
        .when(damaged(5), F.concat(F.lit(f"{wire.TOPIC_ROOT}/v1/"), "device_id", F.lit("/status")))
        .otherwise(wire.telemetry_topic("device_id"))
    )
    copies = F.expr("CASE WHEN event_id % 20 = 0 THEN array(0, 1) ELSE array(0) END")
    return (
        rows.withColumn("_text", text)
        .withColumn(
            "_payload",
            F.when(damaged(1), half)
            .when(damaged(8), F.concat(F.col("_text"), F.lit(',"q":1')))
            .when(damaged(9), F.concat(F.lit('{},"p":'), F.col("_text")))
            .otherwise(F.col("_text")),
        )
        .withColumn("_copy", F.explode(copies))
        .select(
            topic.alias("topic"),
            F.encode("_payload", "UTF-8").alias("payload"),
            F.expr("received_at + _copy * INTERVAL '1' SECOND").alias("received_at"),
            (F.col("event_id") * 2 + F.col("_copy")).alias("arrival_seq"),
        )
    )
