"""Materialised rollups: one directory per bucket, refreshed bucket by bucket."""

import datetime

from pyspark.sql import functions as F, types as T

from levelcast import schemas
from levelcast.functions.timecols import time_bucket
from levelcast.operators.rollups import KEY_FORMAT, POLICIES, WIDTH_SECONDS, rollup, rollup_realtime
from levelcast.session import empty


class RollupTable:
    """telemetry_hourly or telemetry_daily over the state tables."""

    def __init__(self, tables, unit):
        self.tables = tables
        self.unit = unit
        self.width = datetime.timedelta(seconds=WIDTH_SECONDS[unit])
        self.path = tables.path(f"rollup_{unit}")

    def settled(self):
        schema = T.StructType(
            schemas.ROLLUP.fields + [T.StructField("bucket_key", T.StringType())]
        )
        if not self.tables.exists(self.path):
            return empty(self.tables.spark, schema)
        return self.tables.spark.read.schema(schema).parquet(self.path)

    def boundary(self):
        """End of the newest settled bucket, read from directory names alone."""
        keys = [
            c.split("=")[1] for c in self.tables.children(self.path) if c.startswith("bucket_key=")
        ]
        if not keys:
            return None
        pattern = "%Y%m%d%H" if self.unit == "hour" else "%Y%m%d"
        newest = datetime.datetime.strptime(max(keys), pattern)
        return newest.replace(tzinfo=datetime.timezone.utc) + self.width

    def view(self):
        """Settled buckets united with an aggregate of the newer raw readings."""
        edge = self.boundary()
        since = None if edge is None else edge - datetime.timedelta(microseconds=1)
        return rollup_realtime(
            self.settled(), self.tables.telemetry(since=since), self.unit, edge
        )

    def refresh(self, now, touched=None):
        """Recompute the policy window [now - start, now - end) of settled buckets.

        The first refresh starts at the beginning of history. `touched` holds
        readings that arrived late (column measured_at): settled buckets they
        fall into are recomputed as well, whatever their age.
        """
        start_offset, end_offset = POLICIES[self.unit]
        end = self._floor(now - datetime.timedelta(seconds=end_offset))
        edge = self.boundary()
        start = None if edge is None else self._floor(now - datetime.timedelta(seconds=start_offset))
        if start is not None:
            start = min(start, edge)
        late = None
        if edge is not None and touched is not None:
            bucket = time_bucket(self.unit, "measured_at").alias("bucket")
            late = touched.select(bucket, F.to_date("measured_at").alias("measured_date")).filter(
                F.col("bucket") < F.lit(start)
            ).distinct()
        self._recompute(start, end, late)

    def _recompute(self, start, end, late):
        """Two reads: the policy window, bounded by its instants, and late buckets, by their days.

        `late` are buckets before `start` with their days; joined to the partition
        column, they prune the scan to those days however old they are.
        """
        if start is None:
            raw = self.tables.telemetry().filter(F.col("measured_at") < F.lit(end))
        else:
            raw = self.tables.telemetry(since=start - datetime.timedelta(microseconds=1)).filter(
                F.col("measured_at") < F.lit(end)
            )
        if late is not None and start is not None:
            old = self.tables.telemetry().filter(F.col("measured_date") <= F.to_date(F.lit(start)))
            old = old.join(late.select("measured_date").distinct(), "measured_date", "left_semi")
            old = old.withColumn("bucket", time_bucket(self.unit, "measured_at"))
            old = old.join(late.select("bucket").distinct(), "bucket", "left_semi")
            raw = raw.unionByName(old.select(*raw.columns))
        fresh = rollup(raw, self.unit)
        key = F.date_format("bucket", KEY_FORMAT[self.unit])
        (
            fresh.withColumn("bucket_key", key)
            .hint("rebalance", "bucket_key")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket_key")
            .parquet(self.path)
        )

    def _floor(self, at):
        if self.unit == "hour":
            return at.replace(minute=0, second=0, microsecond=0)
        return at.replace(hour=0, minute=0, second=0, microsecond=0)
