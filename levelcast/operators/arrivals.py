"""Idempotent ingestion: first arrival wins, redeliveries leave an event.

Arrivals are rows with device_id, measured_at, received_at and arrival_seq;
(received_at, arrival_seq) orders them and names one arrival of a key.
"""

from pyspark.sql import Window, functions as F

from levelcast.operators import series

KEY = ["device_id", "measured_at"]
ORDER = ["received_at", "arrival_seq"]


def first_arrivals(arrivals):
    """One row per reading key: its earliest arrival.

    The rank filter is applied before the shuffle too, so each task passes on one
    row per key however many copies a key has.
    """
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(*ORDER))
    return arrivals.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def new_arrivals(arrivals, existing):
    """First arrivals whose key is not among the existing readings."""
    return first_arrivals(arrivals).join(existing.select(*KEY), KEY, "left_anti")


def absorbed(arrivals, accepted):
    """Every arrival that did not become a reading: its key and arrival columns.

    Grouped and joined on the identity of the arrival, not on the reading key, so
    that the copies of one key stay spread over all tasks. Arrivals that share
    even their identity are counted, and an accepted one is taken off once.
    """
    identity = [*KEY, *ORDER]
    counted = arrivals.groupBy(*identity).agg(F.count(F.lit(1)).alias("_n"))
    taken = accepted.select(*identity, F.lit(1).alias("_taken"))
    left = F.col("_n") - F.coalesce(F.col("_taken"), F.lit(0))
    rest = counted.join(taken, identity, "left").withColumn("_left", left)
    return rest.filter(F.col("_left") > 0).select(
        *identity, F.explode(F.sequence(F.lit(1), F.col("_left"))).alias("_copy")
    ).drop("_copy")


def dedupe_events(arrivals, accepted):
    return absorbed(arrivals, accepted).select(
        F.lit("deduplicated").alias("event"),
        *KEY,
        F.col("received_at").alias("occurred_at"),
    )


def arrival_out_of_order(arrivals, seen=None, slice_seconds=series.SLICE_SECONDS):
    """Valid arrivals, redeliveries included, older than what their device had sent.

    Adds `newest_before` and `out_of_order`. `seen` is the device registry before
    these arrivals; its last_seen continues the running maximum across batches.
    """
    start = None
    if seen is not None:
        start = seen.select("device_id", F.col("last_seen").alias("newest_before"))
    ranked = series.running_max_before(
        arrivals, ["device_id"], ORDER, "measured_at", start=start, slice_seconds=slice_seconds
    )
    late = F.coalesce(F.col("measured_at") < F.col("newest_before"), F.lit(False))
    return ranked.withColumn("out_of_order", late)


def stored_out_of_order(telemetry, slice_seconds=series.SLICE_SECONDS):
    """Stored readings that arrived after a newer reading of their device.

    Counts stored rows only; equal arrival times are ordered by device time.
    """
    ranked = series.running_max_before(
        telemetry,
        ["device_id"],
        ["received_at", "measured_at"],
        "measured_at",
        slice_seconds=slice_seconds,
    )
    return ranked.filter(F.col("measured_at") < F.col("newest_before"))


def registry_delta(arrivals):
    """First and last device time per device; order of arrival plays no part."""
    return arrivals.groupBy("device_id").agg(
        F.min("measured_at").alias("first_seen"),
        F.max("measured_at").alias("last_seen"),
    )


def merge_registry(*parts):
    """Fold registries and deltas: least first_seen, greatest last_seen."""
    merged = parts[0].select("device_id", "first_seen", "last_seen")
    for part in parts[1:]:
        merged = merged.unionByName(part.select("device_id", "first_seen", "last_seen"))
    return merged.groupBy("device_id").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def ingest_counters(classified, accepted, judged):
    """One row of totals: ingested, deduplicated, dead_lettered, out_of_order."""
    outcome = F.col("outcome")
    parts = (
        classified.select(
            F.lit(0).alias("ingested"),
            (outcome == "reading").cast("int").alias("valid"),
            (outcome == "dead_letter").cast("int").alias("dead_lettered"),
            F.lit(0).alias("out_of_order"),
        ),
        accepted.select(
            F.lit(1).alias("ingested"),
            F.lit(0).alias("valid"),
            F.lit(0).alias("dead_lettered"),
            F.lit(0).alias("out_of_order"),
        ),
        judged.select(
            F.lit(0).alias("ingested"),
            F.lit(0).alias("valid"),
            F.lit(0).alias("dead_lettered"),
            F.col("out_of_order").cast("int").alias("out_of_order"),
        ),
    )
    total = lambda name: F.coalesce(F.sum(name), F.lit(0)).cast("bigint")
    united = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return united.agg(
        total("ingested").alias("ingested"),
        (total("valid") - total("ingested")).alias("deduplicated"),
        total("dead_lettered").alias("dead_lettered"),
        total("out_of_order").alias("out_of_order"),
    )
