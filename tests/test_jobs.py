"""Multi-step scenarios: state across ingests, passes, refreshes and streams."""

import datetime
import json

import pytest
from conftest import START, STEP, aware, load, ramp
from pyspark.sql import functions as F

from levelcast import schemas
from levelcast.metrics import METRICS
from levelcast.operators import alerts, rollups
from levelcast.plans import panels
from levelcast.plans.forecast_pass import deliver, forecast_pass
from levelcast.plans.ingest import ingest_batch, replay_window
from levelcast.plans.rollup_tables import RollupTable
from levelcast.sources import captures, messages
from levelcast.sources.tables import age_out_compaction, stage_open_days, swap_unchanged
from levelcast.streaming.jobs import start_ingest

MINUTE = datetime.timedelta(minutes=1)
SECOND = datetime.timedelta(seconds=1)


def message(device, when, water=50.0, seq=0, received=None, body=None):
    fields = {
        "schema_version": 1,
        "device_id": device,
        "measured_at": when.strftime("%Y-%m-%dT%H:%M:%S.%fZ"),
        "water_level": water,
        "battery_voltage": 3.9,
    }
    text = json.dumps(fields).encode() if body is None else body
    return (f"planter/v1/{device}/telemetry", bytearray(text), received or when, seq)


def batch_of(spark, rows):
    return spark.createDataFrame(rows, schemas.MESSAGES)


def stats(row):
    return (row.ingested, row.deduplicated, row.dead_lettered, row.out_of_order)


def content(tables):
    return sorted(map(tuple, tables.telemetry().drop("batch_id").collect()))


def test_ingest_is_idempotent_and_retry_safe(spark, tables):
    rows = [message(f"p-{i % 4}", START + i * MINUTE, 50 - i / 10, seq=i) for i in range(60)]
    rows.append(message("p-9", START, seq=60, body=b"not json"))
    first = ingest_batch(tables, batch_of(spark, rows), "b1").first()
    assert stats(first) == (60, 0, 1, 0)
    before, registry = content(tables), sorted(map(tuple, tables.devices().collect()))

    second = ingest_batch(tables, batch_of(spark, rows), "b2").first()
    assert stats(second) == (0, 60, 1, 56)
    assert content(tables) == before
    assert sorted(map(tuple, tables.devices().collect())) == registry
    assert tables.ingest_events().count() == 60 and tables.dead_letter().count() == 2
    assert "p-9" not in {r.device_id for r in tables.devices().collect()}

    # A retry under the same name replaces its own rows and nothing else.
    retried = ingest_batch(tables, batch_of(spark, rows), "b1").first()
    assert stats(retried)[:3] == (60, 0, 1)
    assert content(tables) == before
    assert tables.ingest_events().count() == 60 and tables.dead_letter().count() == 2


def test_hot_key_and_first_arrival_wins(spark, tables):
    copies = [message("hot", START, 50.0, seq=i, received=START + i * SECOND) for i in range(400)]
    other = [message("hot", START, 40.0, seq=900, received=START - SECOND)]
    twins = [message("twin", START, 50.0, seq=7, received=START)] * 3
    row = ingest_batch(tables, batch_of(spark, copies + other + twins), "b").first()
    assert stats(row)[:3] == (2, 402, 0)
    kept = {r.device_id: r.water_level for r in tables.telemetry().collect()}
    assert kept == {"hot": 40.0, "twin": 50.0}
    assert tables.ingest_events().count() == 402


def test_late_arrival_across_batches(spark, tables):
    newer = [message("p", START + 10 * MINUTE, seq=1, received=START)]
    older = [message("p", START, seq=2, received=START + SECOND)]
    ingest_batch(tables, batch_of(spark, newer), "b1")
    assert stats(ingest_batch(tables, batch_of(spark, older), "b2").first()) == (1, 0, 0, 1)
    assert tables.telemetry().count() == 2
    late = panels.out_of_order_arrivals(tables.telemetry()).first().out_of_order
    assert late == 1
    device = tables.devices().first()
    assert (aware(device.first_seen), aware(device.last_seen)) == (START, START + 10 * MINUTE)
    tables.fold_devices()
    assert tables.devices().first() == device


def test_replay_of_a_capture(spark, tables, tmp_path):
    rows = [message(f"p-{i % 3}", START + i * MINUTE, seq=i) for i in range(30)]
    sent = batch_of(spark, rows).withColumnRenamed("received_at", "captured_at")
    captures.write_capture(sent, str(tmp_path / "cap"), ("captured_at", "arrival_seq"))
    assert stats(replay_window(tables, str(tmp_path / "cap"), "r1").first())[:2] == (30, 0)
    end = START + datetime.timedelta(days=1)
    digest = panels.window_checksum(tables.telemetry(), START, end).first()
    assert stats(replay_window(tables, str(tmp_path / "cap"), "r2").first())[:2] == (0, 30)
    assert panels.window_checksum(tables.telemetry(), START, end).first() == digest
    assert digest.readings == 30
    counts = panels.window_counts(tables.telemetry(), tables.ingest_events(), START, end).first()
    assert (counts.readings, counts.dedupe_events) == (30, 30)


def rows_for(device, points):
    return [(device, a, v, 4.0 - i * 1e-6) for i, (a, v) in enumerate(points)]


def water(tables, device="p"):
    rows = tables.forecasts().filter((F.col("kind") == "water") & (F.col("device_id") == device))
    return rows.orderBy("as_of").collect()


def test_repeated_pass_changes_nothing(tables):
    points = ramp(288, 80.0, -2.5)
    load(tables, rows_for("p", points))
    first = forecast_pass(tables, "1", METRICS)
    assert (first["written"], first["fired"], first["devices"]) == (2, 1, 1)
    assert first["data_now"] == points[-1][0]
    shown = sorted(map(str, tables.forecasts().collect()))
    second = forecast_pass(tables, "2", METRICS)
    assert (second["written"], second["fired"], second["cleared"]) == (0, 0, 0)
    assert sorted(map(str, tables.forecasts().collect())) == shown
    assert forecast_pass(tables, "3", METRICS, since=first["data_now"])["skipped"]
    # A retried pass sees the state before its first try.
    again = forecast_pass(tables, "1", METRICS)
    assert (again["written"], again["fired"]) == (2, 1)
    assert tables.forecasts().count() == 2 and tables.alert_events().count() == 1


def test_empty_tables_pass(tables):
    result = forecast_pass(tables, "1", METRICS)
    assert result["data_now"] is None and result["written"] == 0


def test_alert_life_cycle_refill_and_delivery(tables):
    points = ramp(288, 80.0, -2.5)
    load(tables, rows_for("p", points))
    assert forecast_pass(tables, "1", METRICS)["fired"] == 1
    sent = alerts.outbox(tables.alert_events(), METRICS)
    assert sent.count() == 1
    deliver(
        tables,
        "d1",
        sent.select(*alerts.EVENT_KEYS, F.lit("HTTPStatusError").alias("error")),
        START,
    )
    event = tables.alert_events().first()
    assert (event.notified, event.notify_error) == (False, "HTTPStatusError")

    fresh = ramp(20, 95.0, -0.5, start=points[-1][0] + STEP)
    load(tables, rows_for("p", fresh), "l2")
    assert forecast_pass(tables, "2", METRICS)["cleared"] == 0
    assert water(tables)[-1].status == "insufficient_points"
    assert water(tables)[-1].slope_per_hour is None
    more = ramp(20, fresh[-1][1], -0.5, start=fresh[-1][0] + STEP)
    load(tables, rows_for("p", more), "l3")
    assert forecast_pass(tables, "3", METRICS)["cleared"] == 1
    newest = water(tables)[-1]
    assert newest.status == "ok" and newest.slope_per_hour == pytest.approx(-0.5, abs=0.05)
    assert [r.status for r in water(tables)] == ["ok", "insufficient_points", "ok"]


def test_dark_device_turns_stale_in_place(tables):
    points = ramp(288, 80.0, -0.5)
    load(tables, rows_for("dark", points))
    forecast_pass(tables, "1", METRICS)
    before = water(tables, "dark")[0]
    load(tables, rows_for("lit", ramp(60, 80.0, -0.5, start=points[-1][0] + STEP)), "l2")
    forecast_pass(tables, "2", METRICS)
    (after,) = water(tables, "dark")
    assert before.status == "ok" and after.status == "stale"
    assert after.as_of == before.as_of and after.crosses_at is None
    roster = tables.telemetry().select("device_id").distinct()
    latest = panels.forecasts_latest(roster, tables.forecasts())
    dark = latest.filter("device_id = 'dark' AND kind = 'water'").first()
    assert dark.horizon_seconds is None
    need = {r.device_id: r for r in panels.attention_needed(roster, latest).collect()}
    assert need["dark"].label == "warming up" and need["dark"].days_left is None
    tables.fold_forecasts()
    assert water(tables, "dark") == [after]


def test_rollup_values_and_refresh(spark, tables):
    rows = [
        ("p", START + 10 * 60 * MINUTE + m * MINUTE, w, b)
        for m, w, b in ((5, 60.0, 3.9), (25, 50.0, 3.7), (45, 40.0, 3.8), (65, 30.0, 3.6))
    ]
    load(tables, rows)
    hourly = RollupTable(tables, "hour")
    shown = lambda: [
        (r.water_avg, r.water_min, r.water_max, r.battery_avg, r.battery_min, r.sample_count)
        for r in hourly.view().orderBy("bucket").collect()
    ]
    expected = [
        (50.0, 40.0, 60.0, pytest.approx(3.8), 3.7, 3),
        (30.0, 30.0, 30.0, 3.6, 3.6, 1),
    ]
    assert hourly.boundary() is None and shown() == expected
    now = START + 12 * 60 * MINUTE
    hourly.refresh(now)
    assert hourly.boundary() == START + 11 * 60 * MINUTE
    assert shown() == expected and hourly.settled().count() == 1
    hourly.refresh(now + 60 * MINUTE)
    assert shown() == expected and hourly.settled().count() == 2

    # A reading that lands in a bucket settled long ago.
    late = load(tables, [("p", START + 600 * MINUTE + 55 * MINUTE, 10.0, 3.5)], "late")
    hourly.refresh(now + 48 * 60 * MINUTE, touched=late)
    assert shown()[0] == (40.0, 10.0, 60.0, pytest.approx(3.725), 3.5, 4)
    plain = rollups.rollup(tables.telemetry(), "hour")
    assert plain.select("bucket", "sample_count").exceptAll(
        hourly.view().select("bucket", "sample_count")
    ).isEmpty()


def test_logs_stay_short(spark, tables):
    """Many batches leave few directories, and every row; a retry of the newest one counts once."""
    for k in range(14):
        label = f"b-{k:03d}"
        for _ in range(2 if k % 6 == 0 else 1):
            tables.tidy(4, without=label)
            ingest_batch(tables, batch_of(spark, [message("p", START + k * MINUTE, seq=k), ("x", bytearray(b""), START, k)]), label)
    for name, rows in (("dead_letter", 14), ("ingest_stats", 14), ("devices", 1)):
        generations = tables.children(tables.path(name))
        assert len(generations) <= 2 and all(len(tables.children(tables.path(name, g))) <= 7 for g in generations)
        assert tables.log(name).count() >= rows
    assert tables.log("dead_letter").count() == 14 and tables.telemetry().count() == 14
    assert tables.log("ingest_stats").agg(F.sum("ingested"), F.sum("dead_lettered")).first()[:] == (14, 14)


def test_compaction_keeps_every_reading(spark, tables, tmp_path):
    points = ramp(2000, 90.0, -0.1, step=datetime.timedelta(minutes=20))
    load(tables, rows_for("a", points[::2]))
    load(tables, rows_for("b", points[1::2]), "l2")
    before = content(tables)
    path, now = tables.path("telemetry"), points[-1][0]
    run = lambda k: age_out_compaction(spark, path, now, str(tmp_path / f"stage{k}")).count()
    old = tables.telemetry().filter(F.col("measured_date") < F.date_sub(F.to_date(F.lit(now)), 7)).count()
    assert run(1) == old > 0
    assert content(tables) == before and tables.data_now() == now
    files = {}
    shown = tables.telemetry().select("*", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i"))
    for r in shown.filter(F.col("measured_date") < F.date_sub(F.to_date(F.lit(now)), 7)).orderBy("i").collect():
        files.setdefault((r.measured_date, r.f), []).append((r.device_id, -r.measured_at.timestamp()))
    assert all(rows == sorted(rows) for rows in files.values())
    assert len({d for d, _ in files}) == len(files)
    assert run(2) == 0

    # A late reading re-opens its own day; one that comes beside a run makes the day wait.
    load(tables, [("c", START + 5 * MINUTE, 50.0, 3.9)], "late")
    staged, seen = stage_open_days(spark, path, now, str(tmp_path / "stage3"))
    assert {r.measured_date for r in seen.collect()} == {START.date()} and staged.count() > 1
    load(tables, [("d", START + 6 * MINUTE, 50.0, 3.9)], "later")
    assert swap_unchanged(spark, path, staged, seen, str(tmp_path / "stage3")).count() == 0
    assert len(content(tables)) == len(before) + 2
    assert run(4) == tables.telemetry().filter(F.col("measured_date") == F.lit(START.date())).count()
    assert len(content(tables)) == len(before) + 2 and run(5) == 0


def test_streaming_ingest_matches_batch(spark, tables, tmp_path):
    rows = [message(f"p-{i % 4}", START + i * MINUTE, 60 - i / 10, seq=i) for i in range(200)]
    rows += [message(f"p-{i % 4}", START + i * MINUTE, 60 - i / 10, seq=1000 + i) for i in range(50)]
    rows.append(("planter/v1/p-0/status", bytearray(b"{}"), START, 5000))
    rows.append(message("p-0", START, seq=5001, body=b"{"))
    source = str(tmp_path / "in")
    batch_of(spark, rows).repartition(3).write.parquet(source)

    def run():
        stream = messages.message_stream(spark, source, max_files_per_trigger=1)
        query = start_ingest(
            stream, tables, str(tmp_path / "checkpoint"), units=("hour",),
            now=lambda: START + datetime.timedelta(days=2),
        )
        query.awaitTermination()

    run()
    totals = tables.log("ingest_stats").agg(
        F.sum("ingested"), F.sum("deduplicated"), F.sum("dead_lettered")
    ).first()
    assert tuple(totals) == (200, 50, 1)
    assert tables.telemetry().count() == 200
    hourly = RollupTable(tables, "hour")
    assert hourly.view().agg(F.sum("sample_count")).first()[0] == 200
    run()  # nothing new: the checkpoint has seen every file
    assert tables.telemetry().count() == 200 and tables.ingest_events().count() == 50


def test_kafka_records_become_messages(spark):
    df = spark.createDataFrame(
        [
            ("planter/v1/p/telemetry", bytearray(b"{}"), START, 5, 5000),
            ("planter/v1/q/telemetry", bytearray(b"{}"), START, 6, 904),
            ("x", bytearray(b""), START, 6, 0),
        ],
        "key string, value binary, timestamp timestamp, offset long, partition int",
    )
    rows = messages.kafka_messages(df).orderBy("arrival_seq").collect()
    assert [tuple(r.arrival_seq) for r in rows] == [(5, 5000), (6, 904)]
    assert all(r.topic.endswith("/telemetry") for r in rows)
