"""Ordered per-key series without a task per key.

A window over a whole key would put a busy device into one task. Here a series
is cut into time slices and shuffled by (key, slice), so a busy device spreads
over as many tasks as it has slices. What must cross a slice border (the last
row before it, a running maximum, a running count) is carried by a table with
one row per (key, slice), which is pre-aggregated before its own shuffle. Its
size per key is bounded by the time span divided by the slice width.

Where slices hold a row or two each, that table is as large as the series. So only
busy keys, of more than `BUSY_ROWS` rows, are cut for `with_previous` and the
forecasts; a count of rows per key tells which they are.
"""

from pyspark.sql import Window, functions as F

from levelcast.functions.timecols import MICROS, minus_seconds, seconds_between
from levelcast.metrics import constant

SLICE_SECONDS = 3600
BUSY_ROWS = 50_000  # a key of more rows is cut into slices
LEVELS = 1  # digits a median is narrowed by
_SLICE = "_slice"


def _sliced(df, at, slice_seconds):
    width = F.lit(round(slice_seconds * MICROS))
    micros = F.unix_micros(F.col(at))
    return df.withColumn(_SLICE, (micros - F.pmod(micros, width)))


def _before(keys):
    """All earlier slices of a key."""
    return (
        Window.partitionBy(*keys)
        .orderBy(_SLICE)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def parted(df, keys, busy_rows=BUSY_ROWS):
    """The rows of quiet keys and those of busy ones; None for the latter if there are none.

    Counts rows per key at once. Busy keys are broadcast: there are at most rows / busy_rows.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    busy = counts.filter(F.col("_n") > busy_rows).select(*keys)
    if busy.isEmpty():
        return df, None
    busy = F.broadcast(busy)
    return df.join(busy, keys, "left_anti"), df.join(busy, keys, "left_semi")


def with_previous(df, keys, at, values, slice_seconds=SLICE_SECONDS, busy_rows=BUSY_ROWS):
    """Add `prev_<col>` for `at` and `values`, and the 1-based position `pos`.

    Rows of one key are ordered by `at`; the first row of a key has NULLs.
    """
    quiet, busy = parted(df, keys, busy_rows)
    lagged = lag_whole(quiet, keys, at, values)
    return lagged if busy is None else lagged.unionByName(lag_sliced(busy, keys, at, values, slice_seconds))


def lag_whole(df, keys, at, values):
    """`with_previous` for quiet keys: one shuffle by key."""
    order = Window.partitionBy(*keys).orderBy(at)
    return df.select(
        *df.columns,
        *[F.lag(c).over(order).alias(f"prev_{c}") for c in [at, *values]],
        F.row_number().over(order).cast("bigint").alias("pos"),
    )


def lag_sliced(df, keys, at, values, slice_seconds=SLICE_SECONDS):
    """`with_previous` for busy keys, by (key, slice)."""
    carried = [at, *values]
    rows = _sliced(df, at, slice_seconds)
    ends = rows.groupBy(*keys, _SLICE).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(at).alias(f"_end_{at}"),
        *[F.max_by(v, at).alias(f"_end_{v}") for v in values],
    )
    by_slice = Window.partitionBy(*keys).orderBy(_SLICE)
    carry = ends.select(
        *keys,
        _SLICE,
        F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)).alias("_n_before"),
        *[F.lag(f"_end_{c}").over(by_slice).alias(f"_carry_{c}") for c in carried],
    )
    inside = Window.partitionBy(*keys, _SLICE).orderBy(at)
    local = rows.select(
        "*",
        F.row_number().over(inside).alias("_local"),
        *[F.lag(c).over(inside).alias(f"_lag_{c}") for c in carried],
    )
    first = F.col("_local") == 1
    return local.join(carry, [*keys, _SLICE]).select(
        *df.columns,
        *[
            F.when(first, F.col(f"_carry_{c}")).otherwise(F.col(f"_lag_{c}")).alias(f"prev_{c}")
            for c in carried
        ],
        (F.col("_local") + F.col("_n_before")).alias("pos"),
    )


def running_max_before(
    df, keys, order, value, alias="newest_before", start=None, slice_seconds=SLICE_SECONDS
):
    """Add the maximum of `value` over all earlier rows of the key.

    `order` is a list of columns whose first is a TIMESTAMP. `start` may hold
    one row per key with a maximum from before this data, in column `alias`.
    """
    rows = _sliced(df, order[0], slice_seconds)
    tops = rows.groupBy(*keys, _SLICE).agg(F.max(value).alias("_top"))
    carry = tops.select(*keys, _SLICE, F.max("_top").over(_before(keys)).alias("_carry"))
    if start is not None:
        carry = carry.join(start.select(*keys, F.col(alias).alias("_start")), keys, "left").select(
            *keys, _SLICE, F.greatest("_carry", "_start").alias("_carry")
        )
    inside = (
        Window.partitionBy(*keys, _SLICE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = rows.withColumn("_local", F.max(value).over(inside))
    return local.join(carry, [*keys, _SLICE]).select(
        *df.columns, F.greatest("_local", "_carry").alias(alias)
    )


def running_total(df, keys, block, order, value, alias):
    """Running sum of an integer column, inclusive, in blocks of a given column.

    `block` must not decrease along `order`; it plays the part of the slice.
    """
    totals = df.groupBy(*keys, block).agg(F.sum(value).alias("_total"))
    before = (
        Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *keys, block, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carry")
    )
    inside = (
        Window.partitionBy(*keys, block)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = df.withColumn("_local", F.sum(value).over(inside))
    return local.join(carry, [*keys, block]).select(
        *df.columns, (F.col("_local") + F.col("_carry")).alias(alias)
    )


def digits(value, level):
    """The first `level` digits of a number's place on the scale of binary logarithms, as one integer.

    Never falls where the value rises. The first digit has 1024 places an octave,
    so 65,536 for all 64-bit integers; each further one parts a place into 256.
    """
    size = F.floor((F.log2(F.abs(value).cast("double")) + 1100.0) * float(1024 * 256 ** (level - 1)))
    return F.when(value > 0, size + 1).when(value < 0, -1 - size).otherwise(F.lit(0)).cast("bigint")


def radix_middle(histogram, keys, value, count, levels=LEVELS):
    """The two middle values, `low` and `high`, per key of a (key, value, count) histogram.

    Selection digit by digit from the most significant one: totals per digit
    tell in which one the middle ranks lie, and only that one is looked at by its
    next digit. A task sees the totals of one digit group of a key, at the end the
    values that agree in all `levels` digits: after one, those within 0.07 % of
    the middle value, after two within three millionths. NULL values have no rank.
    """
    places = [f"_p{k}" for k in range(1, levels + 1)]
    values = histogram.filter(F.col(value).isNotNull()).withColumns(
        {p: digits(F.col(value), k + 1) for k, p in enumerate(places)}
    )
    totals = [values.groupBy(*keys, *places).agg(F.sum(count).alias("_in"))]
    for k in range(levels - 1, 0, -1):
        totals.insert(0, totals[0].groupBy(*keys, *places[:k]).agg(F.sum("_in").alias("_in")))
    totals.append(values.withColumnRenamed(count, "_in"))
    path = [*places, value]
    # Which digit groups are open, the rows of the key below them, and the two ranks.
    held = None
    for k, group in enumerate(totals):
        group = group.select(*keys, *path[: k + 1], "_in")
        above = [*keys, *path[:k]]
        if held is None:
            all_of = F.sum("_in").over(Window.partitionBy(*keys))
            group = group.select("*", F.lit(0).cast("bigint").alias("_below"), all_of.alias("_all"))
        else:
            group = group.join(held, above)
        within = Window.partitionBy(*above).orderBy(path[k])
        upto = F.sum("_in").over(within.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_below")
        ranked = group.withColumn("_upto", upto)
        ranks = (F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1)
        holds = [(F.col("_upto") - F.col("_in") < r) & (F.col("_upto") >= r) for r in ranks]
        open_ = ranked.filter(holds[0] | holds[1])
        if k < levels:
            held = open_.select(*keys, *path[: k + 1], (F.col("_upto") - F.col("_in")).alias("_below"), "_all")
    return open_.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def exact_median(df, keys, value, levels=LEVELS):
    """Exact median of a numeric column per key, pre-aggregated by value: the mean of the two middle values."""
    histogram = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    middle = radix_middle(histogram, keys, value, "_n", levels)
    return middle.select(*keys, ((F.col("low") + F.col("high")) / F.lit(2.0)).alias("median"))


def cadence_of(histogram, keys):
    """Median of the positive gaps of a (key, _gap in microseconds, _n) histogram, in seconds."""
    middle = radix_middle(histogram.filter(F.col("_gap") > 0).select(*keys, "_gap", "_n"), keys, "_gap", "_n")
    seconds = lambda c: F.col(c) / F.lit(float(MICROS))
    return middle.select(*keys, ((seconds("low") + seconds("high")) / F.lit(2.0)).alias("cadence_seconds"))


def cadence(lagged, keys):
    """Median of the positive gaps of each key, in seconds; keys without a gap have no row."""
    gap = F.unix_micros("at") - F.unix_micros("prev_at")
    gaps = lagged.select(*keys, gap.alias("_gap")).filter(F.col("_gap") > 0)
    return cadence_of(gaps.groupBy(*keys, "_gap").agg(F.count(F.lit(1)).alias("_n")), keys)


def metric_window(samples, metrics, now):
    """Samples inside their own metric's lookback: at > now - lookback, strictly."""
    lookback = constant(metrics, "lookback_seconds")
    cutoff = F.timestamp_micros(
        F.unix_micros(F.lit(now)) - F.rint(lookback * F.lit(1e6)).cast("bigint")
    )
    return samples.filter(F.col("at") > cutoff)


def segment_split(samples, metrics, slice_seconds=SLICE_SECONDS):
    """Number the segments of every (device, kind) series, from 0.

    A segment starts where the value steps up by the refill jump or the gap to
    the previous sample exceeds cadence x gap factor (strictly).
    """
    keys = ["device_id", "kind"]
    lagged = with_previous(samples, keys, "at", ["value"], slice_seconds)
    limit = F.col("cadence_seconds") * constant(metrics, "gap_factor")
    # The gap limit reaches the rows over (key, slice), never over the bare key.
    sliced = _sliced(lagged, "at", slice_seconds)
    slices = _sliced(samples, "at", slice_seconds).select(*keys, _SLICE).distinct()
    limits = slices.join(cadence(lagged, keys), keys, "left").select(
        *keys, _SLICE, limit.alias("_limit")
    )
    jumps = F.col("value") - F.col("prev_value") >= constant(metrics, "refill_jump")
    gaps = seconds_between("at", "prev_at") > F.col("_limit")
    starts = F.coalesce(jumps, F.lit(False)) | F.coalesce(gaps, F.lit(False))
    flagged = sliced.join(limits, [*keys, _SLICE]).select(
        *samples.columns, _SLICE, starts.cast("bigint").alias("_starts")
    )
    return running_total(flagged, keys, _SLICE, ["at"], "_starts", "segment_id").drop(
        _SLICE, "_starts"
    )


def newest_segment(segmented):
    """Rows of the last segment of every (device, kind)."""
    keys = ["device_id", "kind"]
    last = segmented.groupBy(*keys).agg(F.max("segment_id").alias("segment_id"))
    return segmented.join(last, [*keys, "segment_id"])


def first_rows(df, keys, at, cap, ties=(), newest=False, slice_seconds=(SLICE_SECONDS,)):
    """The first (or newest) `cap` rows per key by `at`, ties by the columns `ties`.

    The cut-off comes from counts per time slice, one row each: slices before the
    one that holds the last row wanted are kept whole, later ones dropped, and
    only the rows of that one slice are ranked. Further, narrower widths in
    `slice_seconds` cut that slice in the same way first, for busy hours.
    """
    way = (lambda c: F.col(c).desc()) if newest else F.col
    cut, done, rows = F.lit(cap).cast("bigint"), None, df
    for width in slice_seconds:
        rows = _sliced(rows, at, width)
        by = [*keys, _SLICE]
        totals = rows.groupBy(*by, *(["_room"] if done is not None else [])).agg(F.count(F.lit(1)).alias("_in"))
        before = Window.partitionBy(*keys).orderBy(way(_SLICE)).rowsBetween(Window.unboundedPreceding, -1)
        room = (cut if done is None else F.col("_room")) - F.coalesce(F.sum("_in").over(before), F.lit(0))
        cutoff = totals.withColumn("_left", room).filter(F.col("_left") > 0)
        cutoff = cutoff.select(*by, F.col("_left"), (F.col("_in") <= F.col("_left")).alias("_whole"))
        joined = rows.drop("_room").join(cutoff, by)
        kept = joined.filter("_whole").select(*df.columns)
        done = kept if done is None else done.unionAll(kept)
        rows = joined.filter("NOT _whole").select(*df.columns, F.col("_left").alias("_room"), F.col(_SLICE).alias("_last"))
    order = Window.partitionBy(*keys, "_last").orderBy(way(at), *[way(c) for c in ties])
    ranked = rows.withColumn("_rank", F.row_number().over(order)).filter((F.col("_rank") <= cap) & (F.col("_rank") <= F.col("_room")))
    return done.unionAll(ranked.select(*df.columns))


def newest_rows(df, keys, at, cap, ties=(), slice_seconds=(SLICE_SECONDS,)):
    """The newest `cap` rows per key; see `first_rows`."""
    return first_rows(df, keys, at, cap, ties, True, slice_seconds)


def newest_whole(df, keys, at, cap):
    """`newest_rows` for quiet keys: rows are ranked by key, limited per task before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col(at).desc())
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= cap).drop("_rank")


def gap_breaks(readings, max_gap_seconds=450.0, slice_seconds=SLICE_SECONDS):
    """Readings with the gap to the device's previous one and whether it breaks the line."""
    lagged = with_previous(readings, ["device_id"], "measured_at", [], slice_seconds)
    gap = seconds_between("measured_at", "prev_measured_at")
    return lagged.drop("pos").withColumns(
        {
            "gap_seconds": gap,
            "starts_new_line": F.coalesce(gap > F.lit(float(max_gap_seconds)), F.lit(False)),
        }
    )


def daily_consumption(readings, slice_seconds=SLICE_SECONDS):
    """Water used per device and day: the sum of downward steps only.

    Steps inside a slice and the step into a slice are summed apart, so readings
    are never joined back and only slice totals reach the per-device window.
    """
    if 86400 % slice_seconds:
        raise ValueError("slice_seconds must divide a day")
    keys = ["device_id"]
    rows = _sliced(readings, "measured_at", slice_seconds)
    inside = Window.partitionBy(*keys, _SLICE).orderBy("measured_at")
    drop = F.lag("water_level").over(inside) - F.col("water_level")
    stepped = rows.withColumn("_drop", F.greatest(drop, F.lit(0.0)))
    slices = stepped.groupBy(*keys, _SLICE).agg(
        F.sum("_drop").alias("_inside"),
        F.min_by("water_level", "measured_at").alias("_first"),
        F.max_by("water_level", "measured_at").alias("_last"),
        F.to_date(F.min("measured_at")).alias("day"),
    )
    into = F.lag("_last").over(Window.partitionBy(*keys).orderBy(_SLICE)) - F.col("_first")
    used = F.col("_inside") + F.greatest(into, F.lit(0.0))
    return (
        slices.withColumn("_used", used)
        .groupBy(*keys, "day")
        .agg(F.sum("_used").alias("water_used"))
    )


def lookback_cutoff(now, metrics):
    """The earliest instant any metric looks at."""
    return minus_seconds(F.lit(now), max(m.lookback_seconds for m in metrics))
