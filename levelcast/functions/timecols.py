"""Time arithmetic on TIMESTAMP columns (microseconds, UTC session)."""

import datetime

from pyspark.sql import functions as F

MICROS = 1_000_000
# Fixed value: the last microsecond of the year 9999.
MAX_MICROS = 253_402_300_799_999_999


def utc(value):
    """A collected TIMESTAMP (naive, in this process's local zone) as an aware UTC instant."""
    return None if value is None else value.astimezone(datetime.timezone.utc)


def as_col(c):
    return F.col(c) if isinstance(c, str) else c


def seconds_between(later, earlier):
    """Exact difference in seconds as a double."""
    delta = F.unix_micros(as_col(later)) - F.unix_micros(as_col(earlier))
    return delta / F.lit(float(MICROS))


def minus_seconds(c, seconds):
    """Shift back by a whole number of microseconds."""
    return F.timestamp_micros(F.unix_micros(as_col(c)) - F.lit(round(seconds * MICROS)))


def time_bucket(unit, c):
    """Floor to a UTC-aligned bucket: 'hour', 'day', or a width in seconds."""
    if isinstance(unit, str):
        return F.date_trunc(unit, as_col(c))
    width = F.lit(round(unit * MICROS))
    micros = F.unix_micros(as_col(c))
    return F.timestamp_micros(micros - F.pmod(micros, width))


def horizon_seconds(crosses_at, as_of):
    """Seconds left, never negative; NULL without a crossing (greatest skips NULL)."""
    crosses_at = as_col(crosses_at)
    left = F.greatest(seconds_between(crosses_at, as_of), F.lit(0.0))
    return F.when(crosses_at.isNotNull(), left)


def crossing_time(value, target, slope_per_hour, anchor):
    """When a line through (anchor, value) reaches target.

    NULL for a slope that does not fall, and for a crossing past the year 9999.
    A fitted value already below the target crosses at the anchor.
    """
    hours = F.greatest((as_col(value) - target) / -as_col(slope_per_hour), F.lit(0.0))
    whole = F.floor(F.least(hours, F.lit(1e9)))
    rest = F.rint((hours - whole) * F.lit(3.6e9)).cast("bigint")
    micros = F.unix_micros(as_col(anchor)) + whole * F.lit(3_600_000_000) + rest
    fits = (hours < F.lit(1e9)) & (micros <= F.lit(MAX_MICROS))
    falls = as_col(slope_per_hour) < F.lit(0.0)
    return F.when(falls, F.when(fits, F.timestamp_micros(micros)))


def iso_offset(c):
    """ISO-8601 text with an explicit +00:00, fraction only when there is one."""
    c = as_col(c)
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(c), F.lit(MICROS))
    fraction = F.when(micros == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))
    )
    return F.concat(whole, fraction, F.lit("+00:00"))
