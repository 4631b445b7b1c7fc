import datetime

from conftest import START

from levelcast import schemas
from levelcast.metrics import METRICS
from levelcast.operators import alerts

HOUR = datetime.timedelta(hours=1)

AGES = (0.5, 23.75, 24, 90)  # hours since the last decision
PREVIOUS = (None, *((state, age) for state in ("cleared", "firing") for age in AGES))


def expected(hours, limit, previous):
    """The rule in plain words: fire when near, again after a day, clear when well past the limit."""
    if hours is None:
        return None
    state, age = previous or (None, None)
    if hours <= limit:
        return "firing" if state != "firing" or age >= 24 else None
    return "cleared" if state == "firing" and hours > 1.5 * limit else None


def scenarios():
    """name: (kind, horizon hours or None, previous, expected); horizons around the limits of each kind."""
    out = {}
    for metric in METRICS:
        limit = metric.alert_horizon_seconds / 3600
        for share in (None, 0.0, 0.4, 1.0, 1.001, 1.5, 1.501, 9.0):
            for previous in PREVIOUS:
                hours = None if share is None else limit * share
                name = f"{metric.kind}-{share}-{previous}"
                out[name] = (metric.kind, hours, previous, expected(hours, limit, previous))
    return out


TABLE = scenarios()


def forecasts(spark):
    rows = [(n, k, START, None if h is None else START + h * HOUR) for n, (k, h, _, _) in TABLE.items()]
    return spark.createDataFrame(
        rows, "device_id string, kind string, as_of timestamp, crosses_at timestamp"
    )


def states(spark):
    rows = [(n, k, p[0], START - p[1] * HOUR) for n, (k, _, p, _) in TABLE.items() if p]
    return spark.createDataFrame(
        rows, "device_id string, kind string, state string, as_of timestamp"
    )


def test_transitions_follow_the_rule(spark):
    rows = alerts.alert_transition(forecasts(spark), states(spark), METRICS).collect()
    assert {r.device_id: r.transition for r in rows} == {n: v[3] for n, v in TABLE.items()}
    assert {v[3] for v in TABLE.values()} == {None, "firing", "cleared"}


def test_latest_state_and_new_decisions_only(spark):
    base = (None, 0.0, 172800.0, False, None)
    first, dry = "water-0.4-None", "water-0.0-None"
    rows = [
        (first, "water", "firing", START, *base, START),
        ("x", "water", "firing", START, *base, START),
        ("x", "water", "cleared", START, *base, START + HOUR),
        ("x", "battery", "firing", START + HOUR, *base, START),
    ]
    events = spark.createDataFrame(rows, schemas.ALERT_EVENTS)
    latest = alerts.latest_alert_states(events).collect()
    assert {(r.device_id, r.kind): r.state for r in latest} == {
        (first, "water"): "firing",
        ("x", "water"): "cleared",
        ("x", "battery"): "firing",
    }
    decided = alerts.alert_decisions(forecasts(spark), events, METRICS, cooldown_seconds=0.0)
    names = {r.device_id for r in decided.collect()}
    assert first not in names and {dry, "water-1.0-None"} <= names


def test_message_text(spark):
    rows = [
        ("fern", "battery", 60 * 3600.0, START + 60 * HOUR),
        ("moss", "water", 0.04 * 86400, START),
    ]
    df = spark.createDataFrame(
        rows, "device_id string, kind string, horizon_seconds double, crosses_at timestamp"
    )
    fern, moss = alerts.alert_message(df, METRICS).orderBy("device_id").collect()
    assert fern.title == "planter fern: battery attention needed"
    assert fern.message == "battery below charge threshold in 2.5 days of device time (2026-01-03 12:00 UTC)"
    assert moss.title == "planter moss: water attention needed"
    assert moss.message == "water empty in 0.0 days of device time (2026-01-01 00:00 UTC)"
