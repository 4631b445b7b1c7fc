"""Rollup states against a full recompute, whatever the batches."""

import datetime
import random

import pytest
from conftest import START, at
from pyspark.sql import functions as F

from levelcast.operators.rollups import rollup
from levelcast.plans import panels
from levelcast.plans.rollup_states import RollupStates, merge_states, partial_states

SCHEMA = "device_id string, measured_at timestamp, water_level double, battery_voltage double"


def readings(spark, seed, n, days=6):
    rng = random.Random(seed)
    rows = [
        (rng.choice("abc"), at(seconds=rng.randrange(days * 86400)), rng.randrange(800) / 8, rng.choice([None, rng.randrange(30, 44) / 8]))
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def shown(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("unit", ["hour", "day"])
def test_states_equal_a_full_recompute(spark, tables, unit):
    states, seen = RollupStates(tables, unit), None
    for k in range(6):
        batch = readings(spark, k, 40)
        states.add(readings(spark, 100 + k, 30), f"b-{k:03d}")
        states.add(batch, f"b-{k:03d}")  # the batch is tried again
        seen = batch if seen is None else seen.unionAll(batch)
        states.fold(fold_every=2)
        assert shown(states.view()) == shown(rollup(seen, unit))
    assert any(p.startswith("fold-") for p in states.pieces())
    one = states._read(states.pieces())
    assert shown(merge_states(merge_states(one))) == shown(merge_states(one))


def test_folds_fold_among_themselves(spark, tables):
    states, seen = RollupStates(tables, "day"), readings(spark, 0, 12)
    states.add(seen, "b-000")
    for k in range(1, 9):
        batch = readings(spark, k, 12)
        states.add(batch, f"b-{k:03d}")
        states.fold(fold_every=1)
        seen = seen.unionAll(batch)
    assert any(p.startswith("fold-2-") for p in states.pieces()) and len(states.pieces()) <= 5
    assert shown(states.view()) == shown(rollup(seen, "day"))


def test_a_fold_that_was_cut_short_counts_nothing_twice(spark, tables):
    states, batches = RollupStates(tables, "day"), [readings(spark, k, 20) for k in range(3)]
    for k, batch in enumerate(batches):
        states.add(batch, f"b-{k}")
    whole = shown(rollup(batches[0].unionAll(batches[1]).unionAll(batches[2]), "day"))
    merged = merge_states(states._read(["b-0", "b-1"]))
    states._write(merged, "fold-1-b-1")
    assert shown(states.view()) == whole  # written, not ready
    for n in ("b-0", "b-1"):
        tables.mark(f"{states.path}/piece=fold-1-b-1/_inputs/{n}")
    tables.mark(f"{states.path}/piece=fold-1-b-1/_ready")
    assert shown(states.view()) == whole  # ready, inputs not deleted yet
    states.fold(fold_every=100)
    assert shown(states.view()) == whole and set(states.pieces()) == {"b-2", "fold-1-b-1"}
    assert not tables.exists(f"{states.path}/piece=b-0")


def test_a_late_reading_costs_one_row_and_no_raw_scan(spark, tables):
    states = RollupStates(tables, "hour")
    states.add(readings(spark, 1, 300), "b-0")
    late = spark.createDataFrame([("a", START, 50.0, 3.5)], SCHEMA)
    states.add(late, "b-1")
    assert states._read(["b-1"]).count() == 1 and partial_states(late, "hour").count() == 1
    assert "telemetry" not in states.view()._jdf.queryExecution().toString()


def test_the_view_reads_only_its_days(spark, tables):
    states = RollupStates(tables, "hour")
    states.add(readings(spark, 2, 400), "b-0")
    since, until = START + datetime.timedelta(days=2), START + datetime.timedelta(days=2, hours=12)
    part = states.view(since, until)
    want = rollup(readings(spark, 2, 400), "hour").filter(F.col("bucket").between(F.lit(since), F.lit(until)))
    assert shown(part) == shown(want) and part.count() > 0
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(measured_date" in plan
    full = states.view()
    assert states.ends().first() == full.agg(F.min("bucket"), F.max("bucket")).first()
    a = panels.missed_checkins(states.view(since, until), since, until, ends=states.ends())
    b = panels.missed_checkins(full, since, until)
    assert shown(a) == shown(b)


def test_empty_states(spark, tables):
    states = RollupStates(tables, "day")
    assert states.view().count() == 0 and states.ends().first()["first"] is None
    states.add(readings(spark, 1, 1).limit(0), "b-0")
    assert states.view().count() == 0
    with pytest.raises(ValueError):
        states.add(readings(spark, 1, 1), "fold-1")
