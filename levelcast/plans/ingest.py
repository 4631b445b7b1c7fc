"""The ingest job: the same function for a batch, a replay and a micro-batch."""

from pyspark.sql import functions as F

from levelcast.operators import arrivals as ops
from levelcast.operators.classify import classify, dead_letters_of, readings_of
from levelcast.session import scratch_tables, spread
from levelcast.sources import captures


def ingest_batch(tables, messages, batch, after=None, dealt=False):
    """Classify one batch of messages and bring every state table up to date.

    The registry goes first, so no reading exists without its device. A retry
    under the same batch name sees the tables as they were before its first try:
    logs replace the batch's own rows and own telemetry rows are set apart.
    `after` is called with the batch's readings once they are stored. Messages are
    dealt over all cores first, unless they are `dealt` already: a batch of one file
    would be parsed by one or two.
    """
    with scratch_tables(tables.spark, "ingest") as write:
        # The payload is parsed once; only dead letters still need it.
        rejected = F.col("outcome") == "dead_letter"
        judged_once = classify(messages if dealt else spread(messages)).withColumn("payload", F.when(rejected, F.col("payload")))
        classified = write(judged_once, "classified")
        valid = readings_of(classified)
        seen = tables.devices(without=batch)
        tables_before, own = _stored(tables, valid, batch)
        accepted = write(ops.new_arrivals(valid, tables_before), "accepted")
        judged = ops.arrival_out_of_order(valid, seen)
        counters = ops.ingest_counters(classified, accepted, judged)

        tables.put("devices", ops.registry_delta(valid).withColumn("metadata", F.lit("{}")), batch)
        tables.put("dead_letter", dead_letters_of(classified), batch)
        tables.put("ingest_events", ops.dedupe_events(valid, accepted), batch)
        tables.put("ingest_stats", counters, batch)
        # Last: what is stored under this batch name is not counted as stored before.
        missing = accepted.join(own, ops.KEY, "left_anti")
        tables.append_telemetry(
            missing.drop("arrival_seq").withColumn("batch_id", F.lit(batch))
        )
        if after is not None:
            after(accepted)
    return tables.log("ingest_stats").filter(F.col("batch") == batch).drop("batch")


def _stored(tables, valid, batch):
    """Keys stored before this batch, and keys a previous try of it stored.

    Only the days the batch touches are read: a semi join on the partition column,
    which reaches the scan as dynamic pruning, inside literal bounds of the days.
    """
    days = valid.select(F.to_date("measured_at").alias("measured_date"))
    first, last = days.agg(F.min("measured_date"), F.max("measured_date")).first()
    stored = tables.telemetry().filter(F.col("measured_date").between(F.lit(first), F.lit(last)))
    stored = stored.join(days.distinct(), "measured_date", "left_semi").select(*ops.KEY, "batch_id")
    return stored.filter(F.col("batch_id") != batch), stored.filter(F.col("batch_id") == batch)


def replay_window(tables, path, batch):
    """Run a captured window through the ingest path, byte for byte."""
    records = captures.read_capture(tables.spark, path)
    return ingest_batch(tables, captures.replay_messages(records), batch, dealt=True)
