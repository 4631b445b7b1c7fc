"""Per-device, per-metric forecasts of when a falling level reaches its target.

Shape of the job. Readings are lagged once in their wide form (one shuffle by
device and time slice), melted to one row per metric, and reduced to a histogram
of gaps per series that also carries the newest jump and the newest row behind
each gap. Cadence, the newest segment's start and its size all come out of that
histogram, so no row is joined back to its series. The fit itself needs at most
`max_fit_points` rows per series; they are taken with a per-task top-n.

Device time only: `now` is an argument, nothing here reads a clock.
"""

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

from levelcast.functions.numbers import is_finite
from levelcast.functions.timecols import MICROS, crossing_time, seconds_between
from levelcast.metrics import METRICS, constant, require_columns
from levelcast.operators import series
from levelcast.operators.slopes import PairwiseSlopes
from levelcast.operators.stages import compute_once

# The fit travels to executors as code, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ["device_id", "kind"]
MIN_FIT_POINTS = 3
# Fixed value: the two-sided 95 % quantile of the standard normal distribution.
Z95 = 1.959963984540054

# The statuses in order of precedence.
NO_DATA = "no_data"
INVALID_SERIES = "invalid_series"
STALE = "stale"
AT_OR_BELOW_TARGET = "at_or_below_target"
INSUFFICIENT_POINTS = "insufficient_points"
INSUFFICIENT_SPAN = "insufficient_span"
NOT_DEPLETING = "not_depleting"
BEYOND_HORIZON = "beyond_horizon"
OK = "ok"
CROSSING_STATUSES = (OK, BEYOND_HORIZON, AT_OR_BELOW_TARGET)
ATTENTION_STATUSES = (OK, AT_OR_BELOW_TARGET)

FIT_TYPE = T.StructType(
    [
        T.StructField("pairs", T.LongType()),
        T.StructField("slope_per_hour", T.DoubleType()),
        T.StructField("slope_low_per_hour", T.DoubleType()),
        T.StructField("slope_high_per_hour", T.DoubleType()),
        T.StructField("value_at_anchor", T.DoubleType()),
        T.StructField("residual_mad", T.DoubleType()),
    ]
)


def melt_metrics(readings, metrics=METRICS):
    """Wide readings to (device_id, kind, at, value), paired by column name."""
    require_columns(metrics, readings.columns)
    pairs = F.array(
        *[
            F.struct(F.lit(m.kind).alias("kind"), F.col(m.column).alias("value"))
            for m in metrics
        ]
    )
    return readings.select(
        "device_id", F.col("measured_at").alias("at"), F.inline(pairs)
    ).select(*KEYS, "at", "value")


def _melt_lagged(lagged, metrics):
    pairs = F.array(
        *[
            F.struct(
                F.lit(m.kind).alias("kind"),
                F.col(m.column).alias("value"),
                F.col(f"prev_{m.column}").alias("prev_value"),
            )
            for m in metrics
        ]
    )
    return lagged.select(
        "device_id",
        F.col("measured_at").alias("at"),
        F.col("prev_measured_at").alias("prev_at"),
        "pos",
        F.inline(pairs),
    )


def _cutoff(metrics, now):
    micros = F.rint(constant(metrics, "lookback_seconds") * F.lit(1e6)).cast("bigint")
    return F.timestamp_micros(F.unix_micros(F.lit(now)) - micros)


def _quiet_facts(lagged, metrics):
    """`_series_facts` of quiet series in one aggregate, which holds the gaps of a series in a list.

    Rows lagged by device are in place for it already, so nothing is shuffled.
    """
    gap = F.unix_micros("at") - F.unix_micros("prev_at")
    jump = F.col("value") - F.col("prev_value") >= constant(metrics, "refill_jump")
    step = F.struct(F.col("_gap").alias("gap"), "pos", "at")
    facts = lagged.withColumns({"_gap": gap, "_jump": jump}).groupBy(*KEYS).agg(
        F.max("at").alias("as_of"),
        F.max_by("value", "pos").alias("latest_value"),
        F.min("at").alias("first_at"),
        F.min("pos").alias("_first_pos"),
        F.max("pos").alias("_last_pos"),
        F.count(F.lit(1)).alias("samples"),
        F.max(F.when(F.col("_jump"), F.col("pos"))).alias("_jump_pos"),
        F.max(F.when(F.col("_jump"), F.col("at"))).alias("_jump_at"),
        F.bool_and(is_finite("value") & F.col("at").isNotNull()).alias("_finite"),
        F.bool_and(F.coalesce(F.col("at") > F.col("prev_at"), F.lit(True))).alias("_rising"),
        F.sort_array(F.collect_list(F.when(F.col("_gap") > 0, step))).alias("_steps"),
    )
    n = F.size("_steps")
    seconds = lambda place: F.get("_steps", place.cast("int"))["gap"] / F.lit(float(MICROS))
    middle = (seconds(F.floor((n + 1) / 2) - 1) + seconds(F.floor(n / 2))) / F.lit(2.0)
    # Stages: the optimizer would copy the lists' expressions to every place that refers to them.
    facts = compute_once(facts, cadence_seconds=middle)
    limit = F.col("cadence_seconds") * constant(metrics, "gap_factor")
    facts = compute_once(facts, _limit=limit)
    broken = F.filter("_steps", lambda s: s["gap"] / F.lit(float(MICROS)) > F.col("_limit"))
    facts = compute_once(facts, _broken=broken)
    ends = {"_gap_pos": F.array_max("_broken.pos"), "_gap_at": F.array_max("_broken.at")}
    return _ends(compute_once(facts, **ends))


def _series_facts(lagged, metrics):
    """One row per series: ends, validity, cadence and the newest segment's start.

    `lagged` has KEYS, at, prev_at, value, prev_value, pos. The histogram has one
    row per (series, gap); a valid series has at most sqrt(2 x span) of those.
    """
    gap = F.unix_micros("at") - F.unix_micros("prev_at")
    jump = F.col("value") - F.col("prev_value") >= constant(metrics, "refill_jump")
    histogram = (
        lagged.withColumns({"_gap": gap, "_jump": jump})
        .groupBy(*KEYS, "_gap")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.max("at").alias("_newest_at"),
            F.max_by("value", "pos").alias("_newest_value"),
            F.min("at").alias("_first_at"),
            F.min("pos").alias("_first_pos"),
            F.max("pos").alias("_last_pos"),
            F.max(F.when(F.col("_jump"), F.col("pos"))).alias("_jump_pos"),
            F.max(F.when(F.col("_jump"), F.col("at"))).alias("_jump_at"),
            F.bool_and(is_finite("value") & F.col("at").isNotNull()).alias("_finite"),
            F.bool_and(F.coalesce(F.col("at") > F.col("prev_at"), F.lit(True))).alias("_rising"),
        )
    )
    # The gap limit reaches the histogram over (series, digit of the gap), never over the bare series.
    histogram = histogram.withColumn("_digit", series.digits(F.col("_gap"), 1))
    known = histogram.select(*KEYS, "_digit").distinct().join(series.cadence_of(histogram, KEYS), KEYS, "left")
    timed = histogram.join(known, [*KEYS, "_digit"])
    limit = F.col("cadence_seconds") * constant(metrics, "gap_factor")
    broken = F.col("_gap") / F.lit(float(MICROS)) > limit
    facts = timed.withColumn("_broken", broken).groupBy(*KEYS).agg(
        F.max("_newest_at").alias("as_of"),
        F.max_by("_newest_value", "_last_pos").alias("latest_value"),
        F.min("_first_at").alias("first_at"),
        F.min("_first_pos").alias("_first_pos"),
        F.max("_last_pos").alias("_last_pos"),
        F.sum("_n").alias("samples"),
        F.first("cadence_seconds").alias("cadence_seconds"),
        F.max("_jump_pos").alias("_jump_pos"),
        F.max("_jump_at").alias("_jump_at"),
        F.max(F.when(F.col("_broken"), F.col("_last_pos"))).alias("_gap_pos"),
        F.max(F.when(F.col("_broken"), F.col("_newest_at"))).alias("_gap_at"),
        F.bool_and("_finite").alias("_finite"),
        F.bool_and("_rising").alias("_rising"),
    )
    return _ends(facts)


def _ends(facts):
    start_pos = F.greatest("_jump_pos", "_gap_pos", "_first_pos")
    return facts.select(
        *KEYS,
        "as_of",
        F.when(is_finite("latest_value"), F.col("latest_value")).alias("latest_value"),
        "first_at",
        "samples",
        "cadence_seconds",
        (F.col("_finite") & F.col("_rising")).alias("valid"),
        F.greatest("_jump_at", "_gap_at", "first_at").alias("segment_start"),
        (F.col("_last_pos") - start_pos + 1).cast("int").alias("segment_points"),
        (F.col("_jump_pos").isNull() & F.col("_gap_pos").isNull()).alias("single_segment"),
    )


def _fit_one(at, value):
    """Median of pairwise slopes of one capped segment, with its rank interval."""
    n = len(at)
    if n < MIN_FIT_POINTS:
        return None
    x = (at - at[-1]) / 1e6 / 3600.0
    slopes = PairwiseSlopes(x, value)
    m = slopes.count
    if m == 0:
        return None
    # Ranks of the interval's ends around the middle rank: outward to whole ranks, kept inside.
    half = Z95 * math.sqrt(n * (n - 1) * (2 * n + 5) / 18.0) / 2.0
    outward = (math.floor(m / 2.0 - half), math.ceil(m / 2.0 + half))
    low, high = (int(r) for r in np.clip(outward, 0, m - 1))
    low, high, *middle = slopes.at_ranks([low, high, (m - 1) // 2, m // 2])
    slope = (middle[0] + middle[1]) / 2.0
    intercept = np.median(value - slope * x)
    mad = np.median(np.abs(value - (slope * x + intercept)))
    return m, slope, low, high, intercept, mad


@F.pandas_udf(FIT_TYPE)
def fit_points(at: pd.Series, value: pd.Series) -> pd.DataFrame:
    """Fit each row's points (epoch microseconds ascending, values).

    A row holds at most `max_fit_points` points. Their pairs are neither rows nor
    an array: slopes are selected by rank in memory that grows with the points.
    """
    empty = (None,) * len(FIT_TYPE.fields)
    out = [
        empty if a is None else (_fit_one(np.asarray(a, "int64"), np.asarray(v, "float64")) or empty)
        for a, v in zip(at, value)
    ]
    frame = pd.DataFrame(out, columns=FIT_TYPE.fieldNames())
    types = {name: "float64" for name in FIT_TYPE.fieldNames()[1:]}
    return frame.astype({"pairs": "Int64", **types})


def fit_newest(samples, cap, keys=KEYS):
    """The fit over the newest `cap` samples of every series, whatever its segments; one row per series."""
    newest = series.newest_rows(samples, keys, "at", cap, ["value"])
    pair = F.struct(F.unix_micros("at").alias("at"), F.col("value").alias("value"))
    points = newest.groupBy(*keys).agg(F.sort_array(F.collect_list(pair)).alias("_points"))
    fit = fit_points(F.col("_points.at"), F.col("_points.value"))
    fitted = points.select(*keys, F.size("_points").alias("fit_points"), fit.alias("_fit"))
    return fitted.select(*keys, "fit_points", "_fit.*")


def _gather(points):
    """One row per series with its newest points in time order."""
    pair = F.struct(F.unix_micros("at").alias("at"), F.col("value").alias("value"))
    return points.groupBy(*KEYS).agg(F.sort_array(F.collect_list(pair)).alias("_points"))


def _decide(joined, metrics, now, window_start):
    """Forecasts of series facts with their `_points`."""
    c = lambda field: constant(metrics, field)
    limit = F.col("cadence_seconds") * c("gap_factor")
    stale_after = F.greatest(c("stale_after_seconds"), limit)
    in_segment = F.filter(
        "_points", lambda p: p["at"] >= F.unix_micros(F.col("segment_start"))
    )
    rest = [name for name in joined.columns if name != "_points"]
    joined = compute_once(joined, rest, _segment=in_segment)
    size = F.size("_segment")
    capped = F.when(
        size > c("max_fit_points"),
        F.slice("_segment", size - c("max_fit_points") + 1, c("max_fit_points")),
    ).otherwise(F.col("_segment"))
    joined = compute_once(joined, rest, _points=capped)
    span = (
        F.unix_micros("as_of") - F.element_at(F.col("_points"), 1)["at"]
    ) / F.lit(float(MICROS))
    joined = joined.withColumn("_span", F.when(F.size("_points") > 0, span))
    behind = seconds_between(F.lit(now), "as_of")
    gate = (
        F.when(~F.col("valid"), INVALID_SERIES)
        .when(behind > stale_after, STALE)
        .when(F.col("latest_value") <= c("target"), AT_OR_BELOW_TARGET)
        .when(F.col("segment_points") < c("min_points"), INSUFFICIENT_POINTS)
        .when(F.col("_span") < c("min_span_seconds"), INSUFFICIENT_SPAN)
    )
    gated = compute_once(joined, _gate=gate)
    open_points = F.when(F.col("_gate").isNull(), F.col("_points"))
    fitted = gated.withColumn(
        "_fit",
        fit_points(
            F.transform(open_points, lambda p: p["at"]),
            F.transform(open_points, lambda p: p["value"]),
        ),
    )
    slope = F.col("_fit.slope_per_hour")
    has_fit = slope.isNotNull()
    crossing = crossing_time(F.col("_fit.value_at_anchor"), c("target"), slope, "as_of")
    fitted = fitted.withColumn("_crosses", crossing)
    far = F.col("_crosses").isNull() | (
        seconds_between("_crosses", "as_of") > c("max_horizon_seconds")
    )
    status = (
        F.when(F.col("_gate").isNotNull(), F.col("_gate"))
        .when(~has_fit, INSUFFICIENT_POINTS)
        .when(slope >= 0.0, NOT_DEPLETING)
        .when(far, BEYOND_HORIZON)
        .otherwise(OK)
    )
    fitted = fitted.withColumn("status", status)
    now_crossed = F.col("status") == AT_OR_BELOW_TARGET

    def crossing_of(c_):
        return F.when(now_crossed, F.col("as_of")).otherwise(c_)

    def band(field):
        edge = crossing_time(F.col("_fit.value_at_anchor"), c("target"), F.col(f"_fit.{field}"), "as_of")
        return F.when(slope < 0.0, edge)

    if window_start is None:
        reached = F.lit(True)
    else:
        slack = F.coalesce(limit, F.lit(0.0))
        reached = seconds_between("segment_start", window_start) <= slack
    return fitted.select(
        *KEYS,
        "as_of",
        "status",
        c("target").alias("target_value"),
        "latest_value",
        crossing_of(F.col("_crosses")).alias("crosses_at"),
        crossing_of(band("slope_low_per_hour")).alias("crosses_at_earliest"),
        crossing_of(band("slope_high_per_hour")).alias("crosses_at_latest"),
        slope.alias("slope_per_hour"),
        F.col("_fit.residual_mad").alias("residual_mad"),
        F.when(has_fit, F.size("_points")).alias("fit_points"),
        F.when(has_fit, F.col("segment_points")).alias("segment_points"),
        F.when(has_fit, F.col("_span")).alias("fit_span_seconds"),
        F.coalesce(has_fit & F.col("single_segment") & reached, F.lit(False)).alias("truncated"),
        F.when(has_fit, F.col("_fit.pairs")).alias("pairs"),
        F.col("_fit.slope_low_per_hour").alias("slope_low_per_hour"),
        F.col("_fit.slope_high_per_hour").alias("slope_high_per_hour"),
        F.col("_fit.value_at_anchor").alias("value_at_anchor"),
        F.col("cadence_seconds"),
        F.col("segment_start"),
        F.col("samples"),
    )


# The columns of the forecasts table, without the extra fit detail.
FORECAST_COLUMNS = (
    "device_id kind as_of status target_value latest_value crosses_at crosses_at_earliest "
    "crosses_at_latest slope_per_hour residual_mad fit_points segment_points fit_span_seconds "
    "truncated"
).split()


def forecast_readings(
    readings, metrics, now, slice_seconds=series.SLICE_SECONDS, busy_rows=series.BUSY_ROWS
):
    """Forecasts of every (device, metric) with a sample in the metric's lookback."""
    require_columns(metrics, readings.columns)
    columns = [m.column for m in metrics]
    cutoff = _cutoff(metrics, now)
    window = readings.filter(
        F.col("measured_at") > series.lookback_cutoff(now, metrics)
    ).select("device_id", "measured_at", *columns)
    cap = max(m.max_fit_points for m in metrics)

    def melted(lagged):
        inside = F.col("prev_at") > cutoff
        return _melt_lagged(lagged, metrics).filter(F.col("at") > cutoff).withColumns(
            {
                "prev_at": F.when(inside, F.col("prev_at")),
                "prev_value": F.when(inside, F.col("prev_value")),
            }
        )

    quiet, busy = series.parted(window, ["device_id"], busy_rows)
    lagged = series.lag_whole(quiet, ["device_id"], "measured_at", columns)
    facts = _quiet_facts(melted(lagged), metrics)
    newest = series.newest_whole(quiet, ["device_id"], "measured_at", cap)
    if busy is not None:
        lagged = series.lag_sliced(busy, ["device_id"], "measured_at", columns, slice_seconds)
        facts = facts.unionByName(_series_facts(melted(lagged), metrics))
        newest = newest.unionByName(series.newest_rows(busy, ["device_id"], "measured_at", cap))
    points = melt_metrics(newest, metrics).filter(F.col("at") > cutoff)
    return _decide(facts.join(_gather(points), KEYS, "left"), metrics, now, cutoff)


def forecast_samples(
    samples, metrics, now, window_start=None, position=None, slice_seconds=series.SLICE_SECONDS
):
    """Forecasts of untrusted long samples (device_id, kind, at, value).

    `position` names a column that gives the order of a series as received; it
    makes a series that is not in time order INVALID_SERIES. Without it samples
    are taken in time order, and only repeated times or non-finite values are
    invalid. `window_start` is where the samples were cut off, None if unknown.
    """
    columns = [*KEYS, "at", "value"] + ([position] if position else [])
    samples = samples.select(*columns)
    lagged = series.with_previous(samples, KEYS, "at", ["value"], slice_seconds)
    facts = _series_facts(lagged, metrics)
    if position:
        # Both orders must agree; the newest sample is the last one received.
        last = samples.groupBy(*KEYS).agg(
            F.max_by("at", position).alias("_last_at"),
            F.max_by("value", position).alias("_last_value"),
        )
        moved = _out_of_step(samples, position, slice_seconds)
        facts = facts.join(last, KEYS).join(moved, KEYS, "left")
        facts = facts.withColumns(
            {
                "valid": F.col("valid") & F.col("_moved").isNull(),
                "as_of": F.col("_last_at"),
                "latest_value": F.when(is_finite("_last_value"), F.col("_last_value")),
            }
        )
    cap = max(m.max_fit_points for m in metrics)
    newest = series.newest_rows(samples, KEYS, "at", cap)
    start = None if window_start is None else F.lit(window_start)
    return _decide(facts.join(_gather(newest), KEYS, "left"), metrics, now, start)


def _out_of_step(samples, position, slice_seconds):
    """Series whose `position` does not rise with time, one row each."""
    lagged = series.with_previous(samples, KEYS, "at", [position], slice_seconds)
    wrong = F.col(position) < F.col(f"prev_{position}")
    return lagged.filter(wrong).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_moved"))


def no_data(roster, metrics, forecasts):
    """(device, kind) pairs of a roster without any sample, as NO_DATA rows.

    They have no as_of and are therefore never written.
    """
    kinds = F.explode(F.array(*[F.lit(m.kind) for m in metrics])).alias("kind")
    missing = roster.select("device_id", kinds).join(forecasts, KEYS, "left_anti")
    return missing.select(
        *KEYS, F.lit(NO_DATA).alias("status"), constant(metrics, "target").alias("target_value")
    )


def segmenter_signals(forecasts):
    """Water forecasts that do not deplete: depletion is monotone inside a
    segment, so each row points at a refill the segmenter missed."""
    return forecasts.filter(
        (F.col("kind") == "water") & (F.col("status") == NOT_DEPLETING)
    ).select("device_id", "kind", "as_of", "slope_per_hour")
