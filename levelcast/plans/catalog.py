"""Every operator and report as a named query over the driver's tables.

`queries()` maps a name to a function of (spark, directory). Results are plain
flat rows; TIMESTAMP columns leave as zone-less UTC so they compare by value.
"""

import dataclasses
import datetime

from pyspark.sql import functions as F, types as T

from levelcast.functions import numbers, timecols, wire
from levelcast.metrics import BATTERY, DAY, HOUR, WATER
from levelcast.operators import alerts, arrivals, classify, forecast, merge, rollups, series
from levelcast.plans import forecast_pass as passes
from levelcast.plans import ingest, panels
from levelcast.plans.rollup_states import RollupStates
from levelcast.plans.rollup_tables import RollupTable
from levelcast.session import empty, prepare, scratch_dir, written
from levelcast.sources import captures, events, messages
from levelcast.sources.tables import (
    Tables,
    age_out_compaction,
    write_day_partitioned,
)
from levelcast.streaming import jobs

UTC = datetime.timezone.utc
START = datetime.datetime(2024, 1, 1, tzinfo=UTC)
END = datetime.datetime(2025, 1, 1, tzinfo=UTC)
# The first pass of two-pass queries sees the readings up to this instant.
EARLIER = datetime.datetime(2024, 1, 20, tzinfo=UTC)
# A report window that cuts readings off at both ends, and a time before most devices report.
FROM, TO = datetime.datetime(2024, 1, 6, 7, 30, tzinfo=UTC), datetime.datetime(2024, 1, 19, 18, tzinfo=UTC)
FIRST_HOURS = datetime.datetime(2024, 1, 1, 6, tzinfo=UTC)
WALL_NOW = datetime.datetime(2024, 1, 30, 12, tzinfo=UTC)
STAMPS = tuple(datetime.datetime(2024, 2, d, tzinfo=UTC) for d in (1, 2))
DEVICE = "dev-7"

# Constants for readings about ten hours apart, as the events table gives.
METRICS = (
    dataclasses.replace(
        WATER,
        min_points=5,
        min_span_seconds=24 * HOUR,
        max_horizon_seconds=7 * DAY,
        alert_horizon_seconds=3 * DAY,
    ),
    dataclasses.replace(
        BATTERY,
        min_points=8,
        min_span_seconds=48 * HOUR,
        max_horizon_seconds=10 * DAY,
        alert_horizon_seconds=5 * DAY,
    ),
)
SHORT_FIT, LONG_FIT = 12, 5000  # points
FIRST_MESSAGES = 500
# Constants under which caps bite, and refills are not seen as such.
CAPPED = tuple(dataclasses.replace(m, max_fit_points=SHORT_FIT) for m in METRICS)
UNSPLIT = tuple(dataclasses.replace(m, refill_jump=1000.0, gap_factor=1000.0) for m in METRICS)

_QUERIES = {}


def query(fn):
    def run(spark, directory):
        return _plain(fn(prepare(spark), directory))

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    _QUERIES[fn.__name__] = run
    return fn


def queries():
    return dict(_QUERIES)


def _plain(df):
    columns = [
        F.col(f.name).cast("timestamp_ntz").alias(f.name)
        if isinstance(f.dataType, T.TimestampType)
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*columns)


def _text(c):
    return F.col(c).cast("string").alias(c)


# -- shared inputs ----------------------------------------------------------------


def _readings(spark, d):
    return events.readings(spark, d)


def _classified(spark, d):
    return classify.classify(events.messages(spark, d))


def _parsed(spark, d):
    """The classified messages without their text, written: several uses, one parse."""
    return written(_classified(spark, d).drop("topic", "payload", "reason"), scratch_dir(spark, "parsed"))


def _parsed_valid(spark, d):
    return _parsed(spark, d).filter(F.col("outcome") == "reading").drop("outcome")


def _valid(spark, d):
    return classify.readings_of(_classified(spark, d))


def _dead(spark, d):
    return classify.dead_letters_of(_classified(spark, d))


def _accepted(spark, d):
    return arrivals.first_arrivals(_valid(spark, d))


def _events_log(spark, d):
    valid = _parsed_valid(spark, d)
    return arrivals.dedupe_events(valid, arrivals.first_arrivals(valid))


def _devices(spark, d):
    return arrivals.registry_delta(_readings(spark, d))


def _hourly(spark, d):
    return rollups.rollup(_readings(spark, d), "hour")


def _samples(spark, d):
    return forecast.melt_metrics(_readings(spark, d), METRICS)


def _now(spark, d):
    return passes.data_now(_readings(spark, d))


def _window_samples(spark, d):
    return series.metric_window(_samples(spark, d), METRICS, _now(spark, d))


def _lagged(spark, d):
    return series.with_previous(_window_samples(spark, d), ["device_id", "kind"], "at", ["value"])


def _forecasts(spark, d, until=None, metrics=METRICS):
    rows = _readings(spark, d)
    if until is not None:
        rows = rows.filter(F.col("measured_at") <= F.lit(until))
    return forecast.forecast_readings(rows, metrics, passes.data_now(rows))


def _latest(spark, d):
    return panels.forecasts_latest(_devices(spark, d), _forecasts(spark, d))


def _tables(spark, name):
    return Tables(spark, scratch_dir(spark, name))


def _stored(spark, d, name, until=None):
    """State tables holding the readings, as an ingest of them would leave them."""
    tables = _tables(spark, name)
    rows = _readings(spark, d)
    _load(tables, rows if until is None else rows.filter(F.col("measured_at") <= F.lit(until)))
    return tables


def _load(tables, rows):
    tables.append_telemetry(rows.withColumn("batch_id", F.lit("load")))


def _two_passes(spark, d, name):
    """A pass over the readings up to EARLIER, then one over all of them."""
    tables = _stored(spark, d, name, until=EARLIER)
    passes.forecast_pass(tables, "pass-1", METRICS, computed_at=STAMPS[0])
    _load(tables, _readings(spark, d).filter(F.col("measured_at") > F.lit(EARLIER)))
    passes.forecast_pass(tables, "pass-2", METRICS, computed_at=STAMPS[1])
    return tables


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


ROLLUP_COLUMNS = (
    "device_id",
    "bucket",
    "water_avg",
    "water_min",
    "water_max",
    "battery_avg",
    "battery_min",
    "sample_count",
)


def _shown_rollup(df):
    return _rounded(df.select(*ROLLUP_COLUMNS), "water_avg", "battery_avg")


# -- sources and sinks ------------------------------------------------------------


def _message_rows(df, at="received_at"):
    return df.select("topic", _text("payload"), at, "arrival_seq")


@query
def message_stream(spark, d):
    """Messages written as files, read back as a stream, filtered by subscription."""
    root = scratch_dir(spark, "message-stream")
    events.messages(spark, d).write.parquet(f"{root}/in")
    stream = messages.message_stream(spark, f"{root}/in")
    running = (
        stream.writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return _message_rows(spark.read.parquet(f"{root}/out"))


def _captured(spark, d):
    return events.messages(spark, d).withColumnRenamed("received_at", "captured_at")


def _capture_file(spark, d, name):
    path = scratch_dir(spark, name)
    captures.write_capture(_captured(spark, d), path, ("captured_at", "arrival_seq"))
    return path


@query
def read_capture(spark, d):
    records = captures.read_capture(spark, _capture_file(spark, d, "read-capture"))
    return records.select("topic", "captured_at", _text("payload"))


@query
def write_capture(spark, d):
    return captures.capture_lines(_captured(spark, d)).withColumnRenamed("value", "line")


@query
def capture_bounds(spark, d):
    kept = captures.capture_bounds(
        _captured(spark, d),
        ("captured_at", "arrival_seq"),
        "captured_at",
        duration_seconds=20 * DAY,
    )
    return _message_rows(kept, "captured_at")


@query
def capture_first(spark, d):
    """The first messages of a capture by number; the last ones share their second with others."""
    kept = captures.capture_bounds(_captured(spark, d), ("captured_at", "arrival_seq"), "captured_at", count=FIRST_MESSAGES)
    return _message_rows(kept, "captured_at")


@query
def telemetry_insert_if_absent(spark, d):
    """First arrivals against a table that already holds the readings up to EARLIER."""
    existing = _readings(spark, d).filter(F.col("measured_at") <= F.lit(EARLIER))
    return arrivals.new_arrivals(_valid(spark, d), existing)


@query
def dead_letter_append(spark, d):
    return _dead(spark, d).select("topic", _text("payload"), "reason", "received_at")


@query
def ingest_event_append(spark, d):
    return _events_log(spark, d)


@query
def device_registry_upsert(spark, d):
    """Registry of the later half merged into the registry of the earlier half."""
    valid = _valid(spark, d)
    early = arrivals.registry_delta(valid.filter(F.col("measured_at") > F.lit(EARLIER)))
    late = arrivals.registry_delta(valid.filter(F.col("measured_at") <= F.lit(EARLIER)))
    return arrivals.merge_registry(early, late)


@query
def telemetry_window_scan(spark, d):
    return passes.read_window(_readings(spark, d), _now(spark, d), METRICS)


@query
def day_partitioned_layout(spark, d):
    path = scratch_dir(spark, "day-layout")
    write_day_partitioned(_readings(spark, d), path)
    days = spark.read.parquet(path).groupBy("measured_date")
    return days.agg(F.count(F.lit(1)).alias("readings"))


@query
def age_out_compacted(spark, d):
    """The readings after all days older than a week were rewritten."""
    root = scratch_dir(spark, "age-out")
    write_day_partitioned(_readings(spark, d), f"{root}/telemetry")
    age_out_compaction(spark, f"{root}/telemetry", WALL_NOW, f"{root}/staged")
    return spark.read.parquet(f"{root}/telemetry").select(
        "device_id", "measured_at", "water_level", "battery_voltage", "measured_date"
    )


@query
def forecast_upsert(spark, d):
    tables = _two_passes(spark, d, "forecast-upsert")
    return tables.forecasts().select("device_id", "kind", "as_of", "status", "computed_at")


@query
def alert_insert_if_absent(spark, d):
    tables = _two_passes(spark, d, "alert-insert")
    return _rounded(
        tables.alert_events().select(
            "device_id", "kind", "state", "as_of", "horizon_seconds", "threshold_seconds"
        ),
        "horizon_seconds",
        digits=3,
    )


@query
def mark_notified(spark, d):
    """Delivery outcomes of firing alerts: battery pushes time out, others arrive."""
    tables = _stored(spark, d, "mark-notified")
    passes.forecast_pass(tables, "pass-1", METRICS, computed_at=STAMPS[0])
    sent = alerts.outbox(tables.alert_events(), METRICS)
    error = F.when(F.col("kind") == "battery", F.lit("TimeoutError"))
    passes.deliver(
        tables, "delivery-1", sent.select(*alerts.EVENT_KEYS, error.alias("error")), STAMPS[1]
    )
    return tables.alert_events().select(
        "device_id", "kind", "state", "as_of", "notified", "notify_error"
    )


# -- the validator ------------------------------------------------------------------


@query
def topic_device_id(spark, d):
    found = wire.topic_device_id("topic").alias("device_id")
    return events.messages(spark, d).select("topic", found, "arrival_seq")


@query
def telemetry_topic(spark, d):
    return _readings(spark, d).select(
        "device_id", "measured_at", wire.telemetry_topic("device_id").alias("topic")
    )


@query
def device_id_format(spark, d):
    """Part names and brands as candidate identifiers."""
    part = spark.read.parquet(f"{d}/part.parquet")
    candidate = F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("-")))
    return part.select(
        "p_partkey",
        wire.is_device_id("p_brand").alias("raw_ok"),
        wire.is_device_id(candidate).alias("lower_ok"),
        wire.is_device_id(F.concat(candidate, F.lit("-"), F.col("p_name"))).alias("name_ok"),
    )


@query
def utc_canonical(spark, d):
    """Times written with an offset of +02:00 come back as the same UTC instant."""
    shifted = F.expr("measured_at + INTERVAL '2' HOUR")
    text = F.concat(F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00"))
    naive = F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return _readings(spark, d).select(
        "device_id",
        "measured_at",
        classify.utc_timestamp(text).alias("canonical"),
        classify.utc_timestamp(naive).alias("offsetless"),
    )


@query
def range_checks(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(
        "event_id",
        wire.in_range("value", wire.WATER_RANGE).alias("water_ok"),
        wire.in_range(F.col("value") / 100.0, wire.BATTERY_RANGE).alias("battery_ok"),
    )


@query
def payload_validate(spark, d):
    checked = classify.parse_payload(events.messages(spark, d))
    good = F.col("payload_error").isNull()
    return checked.select(
        "arrival_seq",
        F.when(good, F.col("payload_device_id")).alias("device_id"),
        F.when(good, F.col("measured_at")).alias("measured_at"),
        F.when(good, F.col("water_level")).alias("water_level"),
        F.when(good, F.col("battery_voltage")).alias("battery_voltage"),
        "payload_error",
    )


@query
def device_cross_check(spark, d):
    c = _classified(spark, d)
    return c.filter(F.col("reason").startswith("device_id mismatch")).select(
        "arrival_seq", "topic", "reason"
    )


@query
def reason_condense(spark, d):
    """Reasons of payloads that carry one, two or five faults."""
    e = spark.read.parquet(f"{d}/events.parquet")
    faults = F.col("event_id") % 3
    text = (
        F.when(faults == 0, F.lit("{}"))
        .when(faults == 1, F.lit('{"device_id":"NOPE!","measured_at":"yesterday","water_level":1}'))
        .otherwise(F.lit('{"device_id":"a","measured_at":0,"water_level":-1,"battery_voltage":9}'))
    )
    checked = classify.parse_payload(
        e.select("event_id", F.encode(text, "UTF-8").alias("payload"))
    )
    return checked.select("event_id", F.col("payload_error").alias("reason"))


@query
def classify_messages(spark, d):
    return _classified(spark, d).select(
        "arrival_seq",
        "outcome",
        "reason",
        "device_id",
        "measured_at",
        "water_level",
        "battery_voltage",
        "received_at",
    )


@query
def melt_metrics(spark, d):
    return _samples(spark, d)


# -- ingestion ----------------------------------------------------------------------


@query
def ingest_batch(spark, d):
    """Telemetry after the messages were ingested twice."""
    tables = _tables(spark, "ingest-batch")
    batch = events.messages(spark, d)
    ingest.ingest_batch(tables, batch, "first")
    ingest.ingest_batch(tables, batch, "second")
    return tables.telemetry().select(
        "device_id", "measured_at", "water_level", "battery_voltage", "received_at", "batch_id"
    )


@query
def dedupe_first_arrival(spark, d):
    return _accepted(spark, d)


@query
def dedupe_events(spark, d):
    per_device = _events_log(spark, d).groupBy("device_id")
    return per_device.agg(F.count(F.lit(1)).alias("absorbed"))


@query
def arrival_out_of_order(spark, d):
    judged = arrivals.arrival_out_of_order(_parsed_valid(spark, d))
    return judged.select("arrival_seq", "device_id", "measured_at", "newest_before", "out_of_order")


@query
def ingest_counters(spark, d):
    classified = _parsed(spark, d)
    valid = classified.filter(F.col("outcome") == "reading").drop("outcome")
    return arrivals.ingest_counters(
        classified, arrivals.first_arrivals(valid), arrivals.arrival_out_of_order(valid)
    )


@query
def replay_window(spark, d):
    """Counters of replaying one captured window twice."""
    path = _capture_file(spark, d, "replay")
    tables = _tables(spark, "replay-tables")
    ingest.replay_window(tables, path, "replay-1")
    ingest.replay_window(tables, path, "replay-2")
    return tables.log("ingest_stats")


@query
def replay_offsets(spark, d):
    """Offsets at speed 100, one captured stream per device in arrival order."""
    stream = events.messages(spark, d).select(
        F.split("topic", "/")[2].alias("file"),
        F.col("received_at").alias("captured_at"),
        F.to_date("received_at").alias("block"),
        F.struct("received_at", "arrival_seq").alias("line_no"),
        "arrival_seq",
    )
    due = captures.replay_offsets(stream, 100.0)
    return due.select("file", "arrival_seq", "captured_at", "offset_seconds")


@query
def streaming_ingest(spark, d):
    """The messages as a stream of four files, with the hourly rollup kept up to date."""
    root = scratch_dir(spark, "stream-ingest")
    tables = Tables(spark, f"{root}/tables")
    ordered = events.messages(spark, d).repartitionByRange(4, "received_at", "arrival_seq")
    ordered.write.parquet(f"{root}/in")
    stream = messages.message_stream(spark, f"{root}/in", max_files_per_trigger=1)
    running = jobs.start_ingest(
        stream, tables, f"{root}/checkpoint", units=("hour",), now=lambda: WALL_NOW
    )
    running.awaitTermination()
    return _shown_rollup(RollupTable(tables, "hour").view())


# -- aggregates and rollups ---------------------------------------------------------


@query
def telemetry_hourly(spark, d):
    return _shown_rollup(_hourly(spark, d))


@query
def telemetry_daily(spark, d):
    return _shown_rollup(rollups.rollup(_readings(spark, d), "day"))


@query
def time_bucket(spark, d):
    return _readings(spark, d).select(
        "device_id",
        "measured_at",
        timecols.time_bucket("hour", "measured_at").alias("hour"),
        timecols.time_bucket("day", "measured_at").alias("day"),
        timecols.time_bucket(900, "measured_at").alias("quarter"),
    )


@query
def rollup_realtime(spark, d):
    rows = _readings(spark, d)
    settled = rollups.rollup(rows.filter(F.col("measured_at") < F.lit(EARLIER)), "hour")
    return _shown_rollup(rollups.rollup_realtime(settled, rows, "hour", EARLIER))


@query
def rollup_refresh(spark, d):
    """Daily rollup: refreshed with the first part, then with late rows, then viewed."""
    tables = _tables(spark, "rollup-refresh")
    table = RollupTable(tables, "day")
    rows = _readings(spark, d)
    late = (F.unix_micros("received_at") - F.unix_micros("measured_at")) > timecols.MICROS
    _load(tables, rows.filter(~late))
    table.refresh(WALL_NOW - datetime.timedelta(days=10))
    _load(tables, rows.filter(late))
    table.refresh(WALL_NOW, touched=rows.filter(late))
    return _shown_rollup(table.view())


@query
def fleet_watermark(spark, d):
    return rollups.fleet_watermark(_readings(spark, d))


@query
def last_value(spark, d):
    return rollups.last_value(_readings(spark, d), "water_level")


@query
def exact_median(spark, d):
    return series.exact_median(_readings(spark, d), ["device_id"], "water_level")


@query
def window_checksum(spark, d):
    return panels.window_checksum(_readings(spark, d), FROM, TO)


# -- windows ------------------------------------------------------------------------


@query
def out_of_order_arrivals(spark, d):
    return panels.out_of_order_arrivals(_readings(spark, d))


@query
def latest_alert_states(spark, d):
    tables = _two_passes(spark, d, "alert-states")
    return alerts.latest_alert_states(tables.alert_events())


@query
def forecasts_latest(spark, d):
    shown = _latest(spark, d).select("device_id", "kind", "as_of", "status", "horizon_seconds")
    return _rounded(shown, "horizon_seconds", digits=3)


@query
def segment_split(spark, d):
    return series.segment_split(_window_samples(spark, d), METRICS)


@query
def newest_segment(spark, d):
    """Rows of the newest segment of every series."""
    return series.newest_segment(series.segment_split(_window_samples(spark, d), METRICS))


@query
def cap_recent(spark, d):
    """The newest samples of every series, as many as a short fit may use."""
    return series.newest_rows(_window_samples(spark, d), ["device_id", "kind"], "at", SHORT_FIT)


@query
def gap_breaks(spark, d):
    return series.gap_breaks(_readings(spark, d)).select(
        "device_id", "measured_at", "gap_seconds", "starts_new_line"
    )


# -- reports ------------------------------------------------------------------------


@query
def water_raw(spark, d):
    return panels.water_raw(_readings(spark, d), FROM, TO)


@query
def battery_raw(spark, d):
    return panels.battery_raw(_readings(spark, d), FROM, TO)


@query
def checkin_staleness(spark, d):
    staleness = panels.checkin_staleness(_devices(spark, d), _readings(spark, d))
    band = numbers.threshold_band("behind_seconds", numbers.STALENESS_CUTS)
    return staleness.withColumn("band", band)


def _states(spark, d, unit):
    """Rollup states of four batches, the later ones with readings of all days; one fold on the way."""
    states = RollupStates(_tables(spark, f"states-{unit}"), unit)
    rows = _readings(spark, d).withColumn("part", F.pmod(F.xxhash64("device_id", "measured_at"), F.lit(4)))
    for part in range(4):
        states.fold(fold_every=2)
        states.add(rows.filter(F.col("part") == part), f"batch-{part}")
    return states


@query
def rollup_states_daily(spark, d):
    """The daily rollup merged from states of batches that overlap in time."""
    return _shown_rollup(_states(spark, d, "day").view())


@query
def envelope_of_states(spark, d):
    """Water by hour from merged states; days outside the window are not read."""
    hourly = _states(spark, d, "hour").view(FROM, TO)
    return _rounded(panels.water_hourly_envelope(hourly, FROM, TO), "water_avg")


@query
def missed_checkins_of_states(spark, d):
    """Missed check-ins of a window from merged states; the fleet's ends come from its first and last day."""
    states = _states(spark, d, "hour")
    return panels.missed_checkins(states.view(FROM, TO), FROM, TO, ends=states.ends())


@query
def water_hourly(spark, d):
    return _rounded(panels.water_hourly(_hourly(spark, d), FROM, TO), "water_avg")


@query
def water_hourly_envelope(spark, d):
    return _rounded(panels.water_hourly_envelope(_hourly(spark, d), FROM, TO), "water_avg")


@query
def dead_letter_total(spark, d):
    return panels.dead_letter_total(_dead(spark, d))


@query
def dead_letter_rate(spark, d):
    now = datetime.datetime(2024, 1, 15, 12, tzinfo=UTC)
    return panels.dead_letter_rate(_dead(spark, d), _readings(spark, d), now)


@query
def deduplicated_total(spark, d):
    return panels.deduplicated_total(_events_log(spark, d))


@query
def missed_checkins(spark, d):
    return panels.missed_checkins(_hourly(spark, d), START, END)


@query
def recent_dead_letters(spark, d):
    return panels.recent_dead_letters(_dead(spark, d))


@query
def last_dead_letters(spark, d):
    return panels.last_dead_letters(_dead(spark, d))


@query
def recent_hourly(spark, d):
    return panels.recent_hourly(_hourly(spark, d))


@query
def device_last_readings(spark, d):
    return panels.device_last_readings(_readings(spark, d), DEVICE)


@query
def attention_needed(spark, d):
    needed = panels.attention_needed(_devices(spark, d), _latest(spark, d))
    return _rounded(needed, "days_left")


@query
def device_list(spark, d):
    return panels.device_list(_devices(spark, d))


@query
def forecast_history(spark, d):
    """Water horizons of one device over two passes."""
    history = _two_passes(spark, d, "forecast-history").forecasts()
    return _rounded(panels.forecast_history(history, DEVICE, START, END), "value")


@query
def actual_level(spark, d):
    return panels.actual_level(_readings(spark, d), DEVICE, FROM, TO)


@query
def forecast_detail(spark, d):
    return panels.forecast_detail(_latest(spark, d))


@query
def threshold_band(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(
        "event_id",
        numbers.threshold_band(F.col("value") * 10, numbers.STALENESS_CUTS).alias("staleness"),
        numbers.threshold_band(F.col("value") / 100, numbers.ATTENTION_CUTS).alias("attention"),
    )


@query
def fleet_snapshot(spark, d):
    return panels.fleet_snapshot(_devices(spark, d), _readings(spark, d))


@query
def daily_water_consumption(spark, d):
    return panels.daily_water_consumption(_readings(spark, d))


@query
def checkin_health(spark, d):
    return panels.checkin_health(_hourly(spark, d))


@query
def window_counts(spark, d):
    valid = _parsed_valid(spark, d)
    accepted = arrivals.first_arrivals(valid)
    return panels.window_counts(accepted, arrivals.dedupe_events(valid, accepted), FROM, TO)


# -- forecasting --------------------------------------------------------------------


@query
def metric_window(spark, d):
    return _window_samples(spark, d)


@query
def series_valid(spark, d):
    """Validity of each device's event series as received, and of its time order."""
    e = spark.read.parquet(f"{d}/events.parquet")
    samples = e.select(
        F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("device_id"),
        F.lit("water").alias("kind"),
        F.col("ts").cast("timestamp").alias("at"),
        F.when(F.col("event_id") % 1000 == 7, F.lit(float("nan"))).otherwise(F.col("value")).alias(
            "value"
        ),
        # Received in event order, except that users divisible by 10 send it backwards.
        F.when(F.col("user_id") % 10 == 0, -F.col("event_id"))
        .otherwise(F.col("event_id"))
        .alias("seq"),
    )
    judged = forecast.forecast_samples(samples, METRICS, END, position="seq")
    invalid = F.col("status") == forecast.INVALID_SERIES
    return judged.select("device_id", "as_of", invalid.alias("invalid"))


@query
def cadence(spark, d):
    return series.cadence(_lagged(spark, d), ["device_id", "kind"])


@query
def stale_rule(spark, d):
    f = _forecasts(spark, d)
    stale = F.col("status") == forecast.STALE
    return f.select("device_id", "kind", "as_of", "cadence_seconds", stale.alias("stale"))


@query
def long_fits(spark, d):
    """The fit over LONG_FIT points, 12.5 million pairs, of one series in which times and values repeat."""
    samples = _samples(spark, d).filter("kind = 'water'").withColumn("at", F.date_trunc("minute", "at"))
    fits = forecast.fit_newest(samples.withColumn("device_id", F.lit("fleet")), LONG_FIT)
    columns = ("slope_per_hour", "slope_low_per_hour", "slope_high_per_hour")
    return _rounded(fits.select("device_id", "kind", "fit_points", "pairs", *columns), *columns, digits=9)


@query
def pairwise_slopes(spark, d):
    """How many sample pairs the fit of each series compared, and over how many points."""
    f = _forecasts(spark, d).filter(F.col("pairs").isNotNull())
    return f.select("device_id", "kind", "fit_points", "pairs")


@query
def theil_sen_slope(spark, d):
    f = _forecasts(spark, d).filter(F.col("pairs").isNotNull())
    return _rounded(f.select("device_id", "kind", "slope_per_hour"), "slope_per_hour", digits=9)


@query
def slope_interval(spark, d):
    f = _forecasts(spark, d).filter(F.col("pairs").isNotNull())
    return _rounded(
        f.select("device_id", "kind", "slope_low_per_hour", "slope_high_per_hour"),
        "slope_low_per_hour",
        "slope_high_per_hour",
        digits=9,
    )


@query
def intercept_residual(spark, d):
    f = _forecasts(spark, d).filter(F.col("pairs").isNotNull())
    return _rounded(
        f.select("device_id", "kind", "value_at_anchor", "residual_mad"),
        "value_at_anchor",
        "residual_mad",
    )


@query
def crossing(spark, d):
    return _forecasts(spark, d).select("device_id", "kind", "as_of", "crosses_at")


@query
def crossing_band(spark, d):
    return _forecasts(spark, d).select(
        "device_id", "kind", "crosses_at_earliest", "crosses_at", "crosses_at_latest"
    )


@query
def status_precedence(spark, d):
    return _forecasts(spark, d).select("device_id", "kind", "as_of", "status", "latest_value")


@query
def status_mix(spark, d):
    """How many series end in each status."""
    counted = _forecasts(spark, d).groupBy("kind", "status")
    return counted.agg(F.count(F.lit(1)).alias("series"))


@query
def truncated_fits(spark, d):
    """Fits that may use few points: most segments are longer."""
    return _forecasts(spark, d, metrics=CAPPED).select(
        "device_id", "kind", "truncated", "segment_points", "fit_points", "fit_span_seconds"
    )


@query
def forecast_pass(spark, d):
    """Forecast rows after a pass, a repeated pass and a skipped one."""
    tables = _stored(spark, d, "forecast-pass")
    first = passes.forecast_pass(tables, "pass-1", METRICS, computed_at=STAMPS[0])
    passes.forecast_pass(tables, "pass-2", METRICS, computed_at=STAMPS[1])
    passes.forecast_pass(tables, "pass-3", METRICS, since=first["data_now"])
    shown = tables.forecasts().select(
        "device_id",
        "kind",
        "as_of",
        "status",
        "target_value",
        "latest_value",
        "slope_per_hour",
        "residual_mad",
        "fit_points",
        "segment_points",
        "truncated",
        "computed_at",
    )
    return shown.withColumns(
        {"slope_per_hour": F.round("slope_per_hour", 9), "residual_mad": F.round("residual_mad", 6)}
    )


@query
def pass_stats(spark, d):
    # Written: four counts read the same forecasts.
    f = written(_forecasts(spark, d), scratch_dir(spark, "pass-stats"))
    decided = alerts.alert_decisions(f, _no_alerts(spark), METRICS)
    return passes.pass_stats(f, f, decided)


@query
def segmenter_signals(spark, d):
    """Water series that do not deplete, where refills are not split off."""
    return forecast.segmenter_signals(_forecasts(spark, d, metrics=UNSPLIT))


@query
def no_data_forecasts(spark, d):
    """Devices of the registry without a sample in a metric's lookback."""
    return forecast.no_data(_devices(spark, d), METRICS, _forecasts(spark, d, until=FIRST_HOURS))


@query
def horizon_seconds(spark, d):
    f = _forecasts(spark, d)
    left = timecols.horizon_seconds("crosses_at", "as_of").alias("horizon_seconds")
    return _rounded(f.select("device_id", "kind", left), "horizon_seconds", digits=3)


# -- alerts -------------------------------------------------------------------------


def _no_alerts(spark):
    from levelcast.schemas import ALERT_EVENTS

    return empty(spark, ALERT_EVENTS)


def _previous_states(f):
    """One earlier decision per series, derived from its forecast, in three flavours."""
    flavour = F.length("device_id") + F.length("status")
    earlier = F.when(flavour % 3 == 0, F.expr("as_of - INTERVAL '30' HOUR")).otherwise(
        F.expr("as_of - INTERVAL '6' HOUR")
    )
    return f.select(
        "device_id",
        "kind",
        F.when(flavour % 3 == 1, "cleared").otherwise("firing").alias("state"),
        earlier.alias("as_of"),
    )


@query
def alert_transition(spark, d):
    f = _forecasts(spark, d)
    judged = alerts.alert_transition(f, _previous_states(f), METRICS)
    return judged.select("device_id", "kind", "as_of", "status", "transition")


@query
def alert_decisions(spark, d):
    decided = alerts.alert_decisions(_forecasts(spark, d), _no_alerts(spark), METRICS)
    return _rounded(decided, "horizon_seconds", digits=3)


@query
def alert_message(spark, d):
    decided = alerts.alert_decisions(_forecasts(spark, d), _no_alerts(spark), METRICS)
    return alerts.alert_message(decided, METRICS).select("device_id", "kind", "title", "message")


# -- joins named on their own -------------------------------------------------------


@query
def device_readings(spark, d):
    """Readings with their device's first sighting."""
    devices = _devices(spark, d).select("device_id", "first_seen")
    joined = _readings(spark, d).join(devices, "device_id")
    return joined.select("device_id", "measured_at", "water_level", "first_seen")


@query
def known_keys(spark, d):
    """Arrivals whose key is already stored: the complement of insert-if-absent."""
    existing = _readings(spark, d).filter(F.col("measured_at") <= F.lit(EARLIER))
    kept = _accepted(spark, d).join(existing.select(*arrivals.KEY), arrivals.KEY, "left_semi")
    return kept.select("device_id", "measured_at", "received_at", "arrival_seq")


@query
def changed_status(spark, d):
    """Forecasts of all readings whose status is new against those up to EARLIER."""
    before = _forecasts(spark, d, until=EARLIER)
    changed = merge.changed_status(before, _forecasts(spark, d), passes.FORECAST_KEYS)
    return changed.select("device_id", "kind", "as_of", "status")
