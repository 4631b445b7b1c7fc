"""One analytics pass over the state tables; safe to run any number of times."""

import datetime

from pyspark.sql import functions as F

from levelcast import schemas
from levelcast.functions.timecols import utc
from levelcast.metrics import METRICS, require_columns
from levelcast.operators import alerts, forecast
from levelcast.operators.merge import changed_status
from levelcast.operators.rollups import fleet_watermark
from levelcast.operators.series import lookback_cutoff

FORECAST_KEYS = ["device_id", "kind", "as_of"]


def forecast_pass(tables, pass_id, metrics=METRICS, since=None, computed_at=None, fold_every=100, **rule):
    """Watermark, window, forecasts, status-gated upsert, alert decisions.

    Returns a dict: data_now (None on empty tables), skipped, and the counts of
    devices forecast, forecasts written, alerts fired and cleared, and segmenter
    signals. `since` is the watermark an earlier pass returned; an unmoved fleet
    does no work. `computed_at` stamps the rows (wall clock, for ops only). Logs of
    more than `fold_every` passes are folded first.
    """
    spark = tables.spark
    require_columns(metrics, schemas.TELEMETRY.fieldNames())
    data_now = tables.data_now()
    result = dict(
        data_now=data_now, skipped=False, devices=0, written=0, fired=0, cleared=0, signals=0
    )
    if data_now is None:
        return result
    if since is not None and data_now <= since:
        return {**result, "skipped": True}
    tables.tidy(fold_every, without=pass_id)
    stamp = F.lit(computed_at or datetime.datetime.now(datetime.timezone.utc))
    longest = max(m.lookback_seconds for m in metrics)
    cutoff = data_now - datetime.timedelta(seconds=longest)
    window = tables.telemetry(since=cutoff)

    # Staged as a table: upsert, alerts and counts all read the same forecasts.
    staged_at = tables.path("pass_stage", f"pass={pass_id}")
    (
        forecast.forecast_readings(window, metrics, data_now)
        .select(*forecast.FORECAST_COLUMNS)
        .withColumn("computed_at", stamp)
        .write.mode("overwrite")
        .parquet(staged_at)
    )
    staged = spark.read.schema(schemas.FORECASTS).parquet(staged_at)

    changed = changed_status(tables.forecasts(without=pass_id), staged, FORECAST_KEYS)
    tables.put("forecasts", changed, pass_id)
    decided = alerts.alert_decisions(
        staged, tables.alert_events(without=pass_id), metrics, **rule
    ).select(
        "*",
        F.lit(False).alias("notified"),
        F.lit(None).cast("string").alias("notify_error"),
        stamp.alias("occurred_at"),
    )
    tables.put("alert_events", decided, pass_id)

    stats = pass_stats(
        staged,
        tables.log("forecasts").filter(F.col("batch") == pass_id),
        tables.log("alert_events").filter(F.col("batch") == pass_id),
    ).first()
    tables.delete(staged_at)
    return {**result, **stats.asDict()}


def pass_stats(forecasts, written, decided):
    """One row of pass totals."""
    zero = F.lit(0)
    columns = ("devices", "written", "fired", "cleared", "signals")

    def part(df, **values):
        return df.select(*[values.get(c, zero).cast("bigint").alias(c) for c in columns])

    devices = forecasts.select("device_id").distinct()
    parts = (
        part(devices, devices=F.lit(1)),
        part(forecast.segmenter_signals(forecasts), signals=F.lit(1)),
        part(written, written=F.lit(1)),
        part(
            decided,
            fired=(F.col("state") == "firing").cast("int"),
            cleared=(F.col("state") == "cleared").cast("int"),
        ),
    )
    united = parts[0]
    for other in parts[1:]:
        united = united.unionByName(other)
    return united.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in columns])


def deliver(tables, batch, outcomes, delivered_at):
    """Record delivery outcomes (device_id, kind, as_of, state, error) of decisions."""
    tables.put(
        "alert_outcomes", outcomes.withColumn("delivered_at", F.lit(delivered_at)), batch
    )


def data_now(readings):
    """The fleet watermark as an aware UTC datetime, None when there are no readings."""
    return utc(fleet_watermark(readings).first()[0])


def read_window(readings, now, metrics=METRICS):
    """The projected scan one pass needs: everything newer than the longest lookback."""
    return readings.filter(F.col("measured_at") > lookback_cutoff(now, metrics)).select(
        "device_id", "measured_at", *[m.column for m in metrics]
    )
