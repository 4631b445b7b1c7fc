import dataclasses
import datetime
import random
import statistics

import pytest
from conftest import START, STEP, at, aware, ramp, series as values_at
from pyspark.sql import Window, functions as F

from levelcast.metrics import METRICS, WATER
from levelcast.operators import series

SCHEMA = "device_id string, kind string, at timestamp, value double"


def samples(spark, **named):
    rows = [(d, "water", a, float(v)) for d, points in named.items() for a, v in points]
    return spark.createDataFrame(rows, SCHEMA)


def segments(spark, points, jump=5.0):
    metric = dataclasses.replace(WATER, refill_jump=jump)
    rows = series.segment_split(samples(spark, d=points), (metric,)).orderBy("at").collect()
    out = {}
    for r in rows:
        out.setdefault(r.segment_id, []).append(r.value)
    return [out[k] for k in sorted(out)]


def test_segments_come_back_as_they_were_joined(spark):
    """Falling runs joined by rises of the jump or more; smaller rises join nothing."""
    rng = random.Random(21)
    runs, top = [], 60.0
    for size in (1, 1, 7, 2, 30, 1, 12):
        run = [top]
        for _ in range(size - 1):
            run.append(run[-1] + (2.0 if rng.random() < 0.3 else -rng.choice([0.5, 1.25])))
        runs.append(run)
        top = run[-1] + rng.choice([4.0, 8.5])
    assert segments(spark, values_at([v for run in runs for v in run]), jump=4.0) == runs
    assert segments(spark, values_at(runs[2]), jump=4.0) == [runs[2]]
    assert segments(spark, values_at([3.5])) == [[3.5]]


@pytest.mark.parametrize("missing", [0, 4, 5, 6, 20])
def test_only_a_gap_above_six_steps_splits(spark, missing):
    first = ramp(31, 72.0, -0.6)
    rest = ramp(17, 69.0, -0.6, start=first[-1][0] + (missing + 1) * STEP)
    sizes = [len(s) for s in segments(spark, first + rest)]
    assert sizes == ([31, 17] if missing + 1 > WATER.gap_factor else [48])


def test_sliced_operators_match_plain_windows(spark):
    """One device holds most rows; results must not depend on the slices."""
    rng = random.Random(5)
    rows, seq = [], 0
    for device, n in (("hot", 3000), ("a", 200), ("b", 3)):
        t = START
        for _ in range(n):
            t += datetime.timedelta(seconds=rng.choice([1, 20, 300, 300, 300, 9000]))
            late = t + datetime.timedelta(seconds=rng.choice([1, 1, 1, 40000]))
            rows.append((device, "water", t, rng.uniform(0, 100), late, seq))
            seq += 1
    df = spark.createDataFrame(rows, SCHEMA + ", received_at timestamp, seq long").cache()
    by_time = Window.partitionBy("device_id").orderBy("at")
    plain = df.select(
        "seq",
        F.lag("at").over(by_time).alias("prev_at"),
        F.lag("value").over(by_time).alias("prev_value"),
        F.row_number().over(by_time).cast("bigint").alias("pos"),
    )
    sliced = series.with_previous(df, ["device_id"], "at", ["value"]).select(*plain.columns)
    assert plain.exceptAll(sliced).count() == 0 and sliced.count() == len(rows)

    arrival = Window.partitionBy("device_id").orderBy("received_at", "seq")
    plain = df.select(
        "seq", F.max("at").over(arrival.rowsBetween(Window.unboundedPreceding, -1)).alias("newest_before")
    )
    sliced = series.running_max_before(df, ["device_id"], ["received_at", "seq"], "at")
    assert plain.exceptAll(sliced.select("seq", "newest_before")).count() == 0

    expected = {}
    for device in ("hot", "a", "b"):
        mine = sorted(r[2] for r in rows if r[0] == device)
        expected[device] = statistics.median(
            [(y - x).total_seconds() for x, y in zip(mine, mine[1:])]
        )
    lagged = series.with_previous(df, ["device_id"], "at", [])
    got = {r.device_id: r.cadence_seconds for r in series.cadence(lagged, ["device_id"]).collect()}
    assert got == expected

    medians = {r.device_id: r.median for r in series.exact_median(df, ["device_id"], "value").collect()}
    for device, value in medians.items():
        assert value == statistics.median([r[3] for r in rows if r[0] == device])
    df.unpersist()


def test_split_agrees_with_a_plain_loop(spark):
    rng = random.Random(11)
    level, points, t = 90.0, [], START
    for _ in range(1500):
        level = level - rng.uniform(0, 2) if level > 15 else rng.uniform(85, 100)
        t += datetime.timedelta(seconds=rng.choice([300, 300, 300, 310, 4000]))
        points.append((t, level))
    gaps = [(b[0] - a[0]).total_seconds() for a, b in zip(points, points[1:])]
    limit = statistics.median(gaps) * 6.0
    ids, current = [0], 0
    for a, b in zip(points, points[1:]):
        current += b[1] - a[1] >= 5.0 or (b[0] - a[0]).total_seconds() > limit
        ids.append(current)
    rows = series.segment_split(samples(spark, d=points), METRICS).orderBy("at").collect()
    assert [r.segment_id for r in rows] == ids
    newest = series.newest_segment(series.segment_split(samples(spark, d=points), METRICS))
    assert newest.count() == ids.count(ids[-1])


def test_newest_rows_and_gap_breaks(spark):
    df = samples(spark, a=ramp(10, 80, -1), b=ramp(3, 80, -1))
    got = series.newest_rows(df, ["device_id"], "at", 4).groupBy("device_id").count().collect()
    assert {r.device_id: r["count"] for r in got} == {"a": 4, "b": 3}
    readings = spark.createDataFrame(
        [("a", START + datetime.timedelta(seconds=s)) for s in (0, 300, 750, 1201)],
        "device_id string, measured_at timestamp",
    )
    rows = series.gap_breaks(readings).orderBy("measured_at").collect()
    assert [r.starts_new_line for r in rows] == [False, False, False, True]
    assert aware(rows[0].measured_at) == START and rows[0].gap_seconds is None


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_radix_median_equals_a_sort(spark, levels):
    rng = random.Random(levels)
    rows = [("jitter", 300_000_000 + rng.randrange(1_000_000)) for _ in range(3001)]
    rows += [("wide", rng.choice([1, 7, 10**3, 10**9, 10**15]) + rng.randrange(3)) for _ in range(500)]
    rows += [("signs", rng.randrange(-50, 50)) for _ in range(301)] + [("one", 5), ("two", 5), ("two", 2**62), ("none", None)]
    df = spark.createDataFrame(rows, "device_id string, value bigint")
    got = {r.device_id: r["median"] for r in series.exact_median(df, ["device_id"], "value", levels).collect()}
    held = {}
    for k, v in rows:
        if v is not None:
            held.setdefault(k, []).append(v)
    assert got == {k: statistics.median(v) for k, v in held.items()}
    halves = df.withColumn("value", F.col("value") / 8)
    got = {r.device_id: r["median"] for r in series.exact_median(halves, ["device_id"], "value", levels).collect()}
    assert got == {k: statistics.median(x / 8 for x in v) for k, v in held.items()}


def test_a_jittery_series_is_narrowed_before_it_is_sorted(spark):
    rng = random.Random(8)
    gaps = spark.createDataFrame([("d", 300_000_000 + rng.randrange(10**6)) for _ in range(20_000)], "device_id string, v bigint")
    by = lambda level: gaps.groupBy(series.digits(F.col("v"), level)).agg(F.countDistinct("v").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert by(1)[0] < 5000 and by(1)[1] < 16 and by(2)[0] < 40


@pytest.mark.parametrize("widths", [(3600,), (3600, 60), (86400, 3600, 1)])
@pytest.mark.parametrize("newest", [True, False])
def test_cut_off_equals_a_sort(spark, widths, newest):
    rng = random.Random(len(widths))
    rows = [(rng.choice("ab"), at(seconds=rng.choice([0, 1, 59, 3600, 3601, 90_000, rng.randrange(200_000)])), i) for i in range(400)]
    rows += [("c", at(), 1000 + i) for i in range(30)] + [("d", at(), 5000)]
    df = spark.createDataFrame(rows, "k string, at timestamp, i int")
    got = series.first_rows(df, ["k"], "at", 25, ["i"], newest, widths)
    want = []
    for k in "abcd":
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: r[1:], reverse=newest)
        want += [(r[0], r[2]) for r in mine[:25]]
    assert sorted((r.k, r.i) for r in got.collect()) == sorted(want)
    first = series.first_rows(df, [], "at", 40, ["i"], newest, widths).collect()
    assert sorted(r.i for r in first) == sorted(r[2] for r in sorted(rows, key=lambda r: r[1:], reverse=newest)[:40])
    assert series.first_rows(df.limit(0), ["k"], "at", 3).count() == 0


def test_cut_off_ranks_no_row_over_the_bare_key(spark):
    df = spark.createDataFrame([("a", at(), 1)], "k string, at timestamp, i int")
    for plan in (series.newest_rows(df, ["k"], "at", 3), series.first_rows(df, [], "at", 3)):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        ranks = [line for line in text.splitlines() if "row_number()" in line and "windowspecdefinition" in line]
        assert ranks and all("_last#" in line for line in ranks) and "Limit" not in text.replace("WindowGroupLimit", "")
