"""Rollups as mergeable state: every batch adds partial states, readers merge them.

A state row holds the sums, extremes and count of one device and bucket in one
batch. States of a bucket merge in any order, so a late reading of any age costs
one row of its own bucket: nothing is aggregated again and raw readings are not
read. Pieces (the states of one batch) are folded into larger ones from time to
time, as many at once as pile up, so a state is rewritten once per level.
"""

from pyspark.sql import functions as F, types as T

from levelcast.functions.timecols import time_bucket
from levelcast.session import empty

_READY, _INPUTS, _FOLD = "_ready", "_inputs", "fold-"

STATE = T.StructType(
    [
        T.StructField("device_id", T.StringType()),
        T.StructField("bucket", T.TimestampType()),
        *[T.StructField(f"{c}_{part}", T.DoubleType()) for c in ("water", "battery") for part in ("sum", "min", "max")],
        *[T.StructField(f"{c}_n", T.LongType()) for c in ("water", "battery")],
        T.StructField("sample_count", T.LongType()),
        T.StructField("measured_date", T.DateType()),
    ]
)
KEYS = ["device_id", "bucket", "measured_date"]
VALUES = {"water": "water_level", "battery": "battery_voltage"}


def partial_states(readings, unit):
    """One state row per device and bucket of some readings."""
    rows = readings.withColumn("bucket", time_bucket(unit, "measured_at"))
    aggregates = [F.count(F.lit(1)).alias("sample_count")]
    for name, column in VALUES.items():
        aggregates += [F.sum(column).alias(f"{name}_sum"), F.min(column).alias(f"{name}_min")]
        aggregates += [F.max(column).alias(f"{name}_max"), F.count(column).alias(f"{name}_n")]
    states = rows.groupBy("device_id", "bucket").agg(*aggregates)
    return states.withColumn("measured_date", F.to_date("bucket")).select(STATE.names)


def merge_states(states):
    """States of the same device and bucket become one; order and grouping do not matter."""
    ways = {"sum": F.sum, "min": F.min, "max": F.max, "n": F.sum, "count": F.sum}
    columns = [c for c in STATE.names if c not in KEYS]
    return states.groupBy(*KEYS).agg(*[ways[c.rsplit("_", 1)[1]](c).alias(c) for c in columns]).select(STATE.names)


def finish(states):
    """The columns of a rollup from merged states."""
    average = lambda name: F.when(F.col(f"{name}_n") > 0, F.col(f"{name}_sum") / F.col(f"{name}_n")).alias(f"{name}_avg")
    return states.select(
        "device_id", "bucket", average("water"), "water_min", "water_max", average("battery"), "battery_min", "sample_count"
    )


class RollupStates:
    """telemetry_hourly or telemetry_daily as partial states below the tables' root.

    One writer at a time. A piece of a batch is replaced when the batch is tried
    again; only the newest batch may be, and it is never folded. A fold counts
    once its marker is there, and from then on instead of its inputs, whose names
    it holds; so a fold that was cut short is no loss and no double count.
    """

    def __init__(self, tables, unit):
        self.tables, self.unit = tables, unit
        self.path = tables.path(f"rollup_state_{unit}")

    def add(self, readings, batch):
        """Store the states of a batch's new readings, replacing what an earlier try left."""
        if batch.startswith(_FOLD):
            raise ValueError(f"batch names may not begin with {_FOLD}")
        self._write(partial_states(readings, self.unit), batch)

    def _write(self, states, piece):
        states.hint("rebalance", "measured_date").write.mode("overwrite").partitionBy("measured_date").parquet(
            f"{self.path}/piece={piece}"
        )

    def pieces(self):
        """Names of the pieces that count now."""
        names = [c.split("=", 1)[1] for c in self.tables.children(self.path) if c.startswith("piece=")]
        folds = [n for n in names if n.startswith(_FOLD) and self.tables.exists(f"{self.path}/piece={n}/{_READY}")]
        absorbed = {i for f in folds for i in self.tables.children(f"{self.path}/piece={f}/{_INPUTS}")}
        return [n for n in names if n not in absorbed and (n in folds or not n.startswith(_FOLD))]

    def _read(self, pieces):
        paths = [p for p in (f"{self.path}/piece={n}" for n in pieces) if self._days(p)]
        if not paths:
            return empty(self.tables.spark, STATE)
        return self.tables.spark.read.schema(STATE).option("basePath", self.path).parquet(*paths)

    def _days(self, path):
        return [c.split("=")[1] for c in self.tables.children(path) if c.startswith("measured_date=")]

    def view(self, since=None, until=None):
        """The rollup with every stored reading in it; buckets from `since` up to `until`, both included.

        The bounds prune days before anything is read.
        """
        states = self._read(self.pieces())
        for bound, holds in ((since, "__ge__"), (until, "__le__")):
            if bound is not None:
                states = states.filter(getattr(F.col("measured_date"), holds)(F.to_date(F.lit(bound))))
                states = states.filter(getattr(F.col("bucket"), holds)(F.lit(bound)))
        return finish(merge_states(states))

    def ends(self):
        """The first and last bucket as a row (first, last), from the states of the first and last day alone."""
        pieces = self.pieces()
        days = sorted({d for n in pieces for d in self._days(f"{self.path}/piece={n}")})
        outer = self._read(pieces).filter(F.col("measured_date").isin([F.lit(d).cast("date") for d in {*days[:1], *days[-1:]}]))
        return outer.agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"))

    def fold(self, fold_every=100):
        """Merge pieces of a level once more than `fold_every` of them count; the newest batch stays as it is.

        Inputs are deleted when the fold counts. A fold's name begins with its level,
        so folds of batches fold among themselves later. Batch names rise in order.
        """
        pieces = self.pieces()
        for left in {c.split("=", 1)[1] for c in self.tables.children(self.path) if c.startswith("piece=")}.difference(pieces):
            self.tables.delete(f"{self.path}/piece={left}")  # what an interrupted fold left
        batches = sorted(n for n in pieces if not n.startswith(_FOLD))
        levels = {0: batches[:-1]}
        for n in pieces:
            if n.startswith(_FOLD):
                levels.setdefault(int(n[len(_FOLD) :].split("-")[0]), []).append(n)
        for level, inputs in sorted(levels.items()):
            if len(inputs) <= fold_every:
                continue
            name = f"{_FOLD}{level + 1}-{max(inputs).removeprefix(_FOLD)}"
            self._write(merge_states(self._read(inputs)), name)
            for n in inputs:
                self.tables.mark(f"{self.path}/piece={name}/{_INPUTS}/{n}")
            self.tables.mark(f"{self.path}/piece={name}/{_READY}")
            for n in inputs:
                self.tables.delete(f"{self.path}/piece={n}")
