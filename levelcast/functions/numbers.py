"""Rounding and labels as the reports show them."""

from pyspark.sql import functions as F

from levelcast.functions.timecols import as_col


def round_half_up(c, digits):
    """Decimal rounding of the 15 significant digits of a double, half away from zero.

    Values too large for the decimal (1e23 and beyond) have no such digits and stay as they are.
    """
    text = F.format_string("%.14e", as_col(c))
    exact = F.when(as_col(c).isNotNull(), text).try_cast("decimal(38,15)")
    return F.coalesce(F.round(exact, digits).cast("double"), as_col(c).cast("double"))


def whole_seconds(c):
    """Double seconds to bigint by rounding; a plain cast would truncate."""
    return F.round(as_col(c).try_cast("decimal(38,6)"), 0).cast("bigint")


def is_finite(c):
    c = as_col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


# Fixed values: (upper bound, label) in ascending order, last label is open-ended.
STALENESS_CUTS = ((600.0, "green"), (1800.0, "amber"), (None, "red"))
ATTENTION_CUTS = ((1.0, "red"), (3.0, "amber"), (None, "green"))


def threshold_band(c, cuts):
    """The label of the first cut the value lies below; NULL stays NULL."""
    c = as_col(c)
    band = F.when(c.isNull(), F.lit(None).cast("string"))
    for bound, label in cuts:
        band = band.otherwise(F.lit(label)) if bound is None else band.when(c < bound, label)
    return band
