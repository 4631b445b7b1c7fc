"""Streaming queries: micro-batches through the batch operators.

State lives in the tables, not in the query: duplicates are absorbed over all of
history and late readings of any age are stored, so no watermark bounds them.
"""

from levelcast.plans.ingest import ingest_batch
from levelcast.plans.rollup_states import RollupStates
from levelcast.plans.rollup_tables import RollupTable


def start_ingest(
    messages, tables, checkpoint, name="ingest", trigger=None, units=(), now=None, fold_every=100, state_units=()
):
    """Ingest a message stream; optionally keep rollups of `units` up to date.

    `state_units` names the rollups kept as mergeable states: every batch adds the
    states of its own readings, so no reading is aggregated twice.

    `now` (a function without arguments) gives the time the rollup policies
    count from; the fleet watermark is used when it is not given. A log of more
    than `fold_every` batches is folded into one.
    """

    def apply(batch, epoch):
        label = f"{name}-{epoch:012d}"
        tables.tidy(fold_every, without=label)

        def refresh(accepted):
            for unit in state_units:
                states = RollupStates(tables, unit)
                states.fold(fold_every)
                states.add(accepted, label)
            clock = now() if now is not None else tables.data_now()
            for unit in units:
                if clock is not None:
                    # The policy window, and the buckets the batch's own readings fall into.
                    RollupTable(tables, unit).refresh(clock, touched=accepted)

        ingest_batch(tables, batch, label, after=refresh)

    writer = messages.writeStream.queryName(name).foreachBatch(apply)
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
