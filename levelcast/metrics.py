"""The falling metrics of the fleet: one frozen record each, data only.

A further metric is one more record plus the value column it is read from.
Operators look constants up by kind (`constant`), they never branch on a kind.
"""

import dataclasses

from pyspark.sql import functions as F

HOUR = 3600.0
DAY = 86400.0


@dataclasses.dataclass(frozen=True)
class Metric:
    kind: str
    unit: str
    column: str
    noun: str
    target: float
    refill_jump: float
    min_points: int
    min_span_seconds: float
    max_fit_points: int
    lookback_seconds: float
    gap_factor: float
    stale_after_seconds: float
    max_horizon_seconds: float
    alert_horizon_seconds: float


# The production constants.
WATER = Metric(
    kind="water",
    unit="pct",
    column="water_level",
    noun="empty",
    target=10.0,
    refill_jump=5.0,
    min_points=36,
    min_span_seconds=3 * HOUR,
    max_fit_points=300,
    lookback_seconds=10 * DAY,
    gap_factor=6.0,
    stale_after_seconds=1800.0,
    max_horizon_seconds=30 * DAY,
    alert_horizon_seconds=2 * DAY,
)
BATTERY = Metric(
    kind="battery",
    unit="V",
    column="battery_voltage",
    noun="below charge threshold",
    target=3.4,
    refill_jump=0.05,
    min_points=144,
    min_span_seconds=12 * HOUR,
    max_fit_points=300,
    lookback_seconds=35 * DAY,
    gap_factor=6.0,
    stale_after_seconds=1800.0,
    max_horizon_seconds=60 * DAY,
    alert_horizon_seconds=3 * DAY,
)
METRICS = (WATER, BATTERY)

# Kinds in roster order for reports that list every device and kind.
KINDS = tuple(m.kind for m in METRICS)

ALERT_COOLDOWN_SECONDS = 24 * HOUR
ALERT_CLEAR_FACTOR = 1.5


def configured(
    water_target_pct=WATER.target,
    battery_target_volts=BATTERY.target,
    water_alert_days=WATER.alert_horizon_seconds / DAY,
    battery_alert_days=BATTERY.alert_horizon_seconds / DAY,
):
    """The production metrics with the operator's overrides applied."""
    if not 0 <= water_target_pct <= 100:
        raise ValueError("water_target_pct must be within 0..100")
    if not 2.5 <= battery_target_volts <= 4.4:
        raise ValueError("battery_target_volts must be within 2.5..4.4")
    if water_alert_days <= 0 or battery_alert_days <= 0:
        raise ValueError("alert days must be positive")
    return (
        dataclasses.replace(
            WATER, target=water_target_pct, alert_horizon_seconds=water_alert_days * DAY
        ),
        dataclasses.replace(
            BATTERY, target=battery_target_volts, alert_horizon_seconds=battery_alert_days * DAY
        ),
    )


def require_columns(metrics, columns):
    missing = sorted(m.kind for m in metrics if m.column not in columns)
    if missing:
        raise ValueError(f"no telemetry column for metric kind(s): {missing}")


def constant(metrics, field, kind="kind"):
    """The constant `field` of the row's metric, as a literal CASE over kinds."""
    expr = None
    for metric in metrics:
        value = F.lit(getattr(metric, field))
        condition = F.col(kind) == metric.kind
        expr = F.when(condition, value) if expr is None else expr.when(condition, value)
    return expr
