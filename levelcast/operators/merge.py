"""Keyed merges for tables that plain Parquet cannot update in place.

State tables are logs of keyed rows (see sources/tables.py); these operators
decide which incoming rows are written, and which logged row is current.
"""

from pyspark.sql import Window, functions as F


def insert_absent(existing, incoming, keys):
    """Incoming rows whose key is new."""
    return incoming.join(existing.select(*keys), keys, "left_anti")


def changed_status(existing, incoming, keys, status="status"):
    """Incoming rows that are new or whose status differs from the current one.

    Rows with a NULL key column have nothing to be keyed on and are dropped.
    """
    for key in keys:
        incoming = incoming.filter(F.col(key).isNotNull())
    current = existing.select(*keys, F.col(status).alias("_status"), F.lit(True).alias("_known"))
    joined = incoming.join(current, keys, "left")
    changed = F.col("_known").isNull() | ~F.col(status).eqNullSafe(F.col("_status"))
    return joined.filter(changed).drop("_status", "_known")


def latest_per_key(log, keys, order):
    """The last logged row of every key; `order` is ascending, newest last."""
    newest = [F.col(c).desc() for c in order]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))
    return log.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def with_outcomes(alerts, outcomes, keys):
    """Alert rows with delivery outcomes laid over: notified when there was no error."""
    marked = outcomes.select(
        *keys,
        F.col("error").isNull().alias("_notified"),
        F.col("error").alias("_error"),
        F.lit(True).alias("_marked"),
    )
    joined = alerts.join(marked, keys, "left")
    return joined.withColumns(
        {
            "notified": F.coalesce(F.col("_notified"), F.col("notified")),
            "notify_error": F.when(F.col("_marked"), F.col("_error")).otherwise(
                F.col("notify_error")
            ),
        }
    ).drop("_notified", "_error", "_marked")
