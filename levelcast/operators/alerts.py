"""Alert decisions on transitions between firing and cleared."""

from pyspark.sql import functions as F

from levelcast.functions.timecols import horizon_seconds, seconds_between
from levelcast.metrics import ALERT_CLEAR_FACTOR, ALERT_COOLDOWN_SECONDS, constant
from levelcast.operators.merge import insert_absent, latest_per_key

KEYS = ["device_id", "kind"]
EVENT_KEYS = ["device_id", "kind", "as_of", "state"]


def latest_alert_states(alert_events):
    """The newest decision per (device, kind); equal as_of is settled by occurred_at."""
    return latest_per_key(alert_events, KEYS, ["as_of", "occurred_at", "state"]).select(
        *KEYS, "state", "as_of"
    )


def alert_transition(
    forecasts,
    states,
    metrics,
    cooldown_seconds=ALERT_COOLDOWN_SECONDS,
    clear_factor=ALERT_CLEAR_FACTOR,
):
    """Add horizon_seconds, threshold_seconds and `transition` (NULL: nothing changes)."""
    previous = states.select(
        *KEYS, F.col("state").alias("_state"), F.col("as_of").alias("_as_of")
    )
    judged = forecasts.join(previous, KEYS, "left").withColumns(
        {
            "horizon_seconds": horizon_seconds("crosses_at", "as_of"),
            "threshold_seconds": constant(metrics, "alert_horizon_seconds"),
        }
    )
    near = F.col("horizon_seconds") <= F.col("threshold_seconds")
    quiet = F.col("_state").isNull() | (F.col("_state") == "cleared")
    due = seconds_between("as_of", "_as_of") >= F.lit(float(cooldown_seconds))
    recovered = F.col("horizon_seconds") > F.col("threshold_seconds") * F.lit(float(clear_factor))
    transition = (
        F.when(F.col("horizon_seconds").isNull(), F.lit(None).cast("string"))
        .when(near, F.when(quiet | due, "firing"))
        .when((F.col("_state") == "firing") & recovered, "cleared")
    )
    return judged.withColumn("transition", transition).drop("_state", "_as_of")


def alert_decisions(forecasts, alert_events, metrics, **rule):
    """New decision rows: transitions not yet recorded under the same key."""
    judged = alert_transition(forecasts, latest_alert_states(alert_events), metrics, **rule)
    decided = judged.filter(F.col("transition").isNotNull()).select(
        *KEYS,
        F.col("transition").alias("state"),
        "as_of",
        "crosses_at",
        "horizon_seconds",
        "threshold_seconds",
    )
    return insert_absent(alert_events, decided, EVENT_KEYS)


def alert_message(alerts, metrics):
    """Add the notification `title` and `message` of alert rows."""
    days = F.call_function(
        "format_number", F.col("horizon_seconds") / F.lit(86400.0), F.lit("0.0")
    )
    crosses = F.coalesce(
        F.concat(F.date_format("crosses_at", "yyyy-MM-dd HH:mm"), F.lit(" UTC")), F.lit("now")
    )
    return alerts.withColumns(
        {
            "title": F.concat(
                F.lit("planter "), "device_id", F.lit(": "), "kind", F.lit(" attention needed")
            ),
            "message": F.concat(
                "kind",
                F.lit(" "),
                constant(metrics, "noun"),
                F.lit(" in "),
                days,
                F.lit(" days of device time ("),
                crosses,
                F.lit(")"),
            ),
        }
    )


def outbox(alert_events, metrics):
    """Firing decisions still to be delivered, with their text."""
    waiting = alert_events.filter(
        (F.col("state") == "firing") & ~F.col("notified") & F.col("notify_error").isNull()
    )
    return alert_message(waiting, metrics).select(*EVENT_KEYS, "title", "message")
