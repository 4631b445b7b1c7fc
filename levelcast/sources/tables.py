"""State tables on plain Parquet below one shared root.

Two layouts. `telemetry` is partitioned by the day of device time and appended
to. Every other table is a log: each batch owns one directory and overwrites it
when it is retried, so a retried batch never counts twice. Readers fold a log to
its current rows; `fold` rewrites a long log into one batch of a new generation.
One writer at a time, as with any plain Parquet table.
"""

import datetime

from pyspark.sql import functions as F, types as T

from levelcast import schemas
from levelcast.functions.timecols import utc
from levelcast.operators.arrivals import merge_registry
from levelcast.operators.merge import latest_per_key, with_outcomes
from levelcast.session import empty, written

_READY = "_ready"

LOGS = {
    "dead_letter": schemas.DEAD_LETTER,
    "ingest_events": schemas.INGEST_EVENTS,
    "ingest_stats": schemas.INGEST_STATS,
    "devices": schemas.DEVICES,
    "forecasts": schemas.FORECASTS,
    "alert_events": schemas.ALERT_EVENTS,
    "alert_outcomes": schemas.ALERT_OUTCOMES,
}


class Tables:
    def __init__(self, spark, root):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- paths -----------------------------------------------------------------

    def path(self, *parts):
        return "/".join([self.root, *parts])

    def _fs(self, path):
        jvm = self.spark._jvm
        hpath = jvm.org.apache.hadoop.fs.Path(path)
        return hpath.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), hpath

    def exists(self, path):
        fs, hpath = self._fs(path)
        return fs.exists(hpath)

    def delete(self, path):
        fs, hpath = self._fs(path)
        fs.delete(hpath, True)

    def mark(self, path):
        """Create an empty marker file."""
        fs, hpath = self._fs(path)
        fs.create(hpath, True).close()

    def children(self, path):
        fs, hpath = self._fs(path)
        if not fs.exists(hpath):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(hpath))

    # -- telemetry ---------------------------------------------------------------

    def telemetry(self, since=None, days=None):
        """Readings; `since` (exclusive instant) and `days` also prune partitions."""
        schema = T.StructType(
            schemas.TELEMETRY.fields + [T.StructField("measured_date", T.DateType())]
        )
        if not self.exists(self.path("telemetry")):
            return empty(self.spark, schema)
        rows = self.spark.read.schema(schema).parquet(self.path("telemetry"))
        return prune(rows, since, days)

    def newest_day(self):
        """The newest day that has readings, from directory names alone."""
        days = [c for c in self.children(self.path("telemetry")) if c.startswith("measured_date=")]
        return max(days).split("=")[1] if days else None

    def data_now(self):
        """The fleet watermark (max measured_at) as an aware UTC datetime, or None.

        Only the newest day is scanned.
        """
        day = self.newest_day()
        if day is None:
            return None
        newest = self.telemetry(days=[datetime.date.fromisoformat(day)])
        return utc(newest.agg(F.max("measured_at")).first()[0])

    def append_telemetry(self, readings):
        """Append; files are sized per day by a rebalance, which also splits big days."""
        (
            with_day(readings)
            .hint("rebalance", "measured_date")
            .write.mode("append")
            .partitionBy("measured_date")
            .parquet(self.path("telemetry"))
        )

    # -- logs --------------------------------------------------------------------

    def _generation(self, name):
        ready = [
            int(child.split("=")[1])
            for child in self.children(self.path(name))
            if child.startswith("gen=") and self.exists(self.path(name, child, _READY))
        ]
        return max(ready, default=0)

    def _log_path(self, name):
        return self.path(name, f"gen={self._generation(name)}")

    def log(self, name, without=None):
        """All rows of a log with their `batch`; `without` leaves one batch out."""
        schema = T.StructType(LOGS[name].fields + [T.StructField("batch", T.StringType())])
        path = self._log_path(name)
        if not any(child.startswith("batch=") for child in self.children(path)):
            return empty(self.spark, schema)
        rows = self.spark.read.schema(schema).parquet(path)
        return rows if without is None else rows.filter(F.col("batch") != without)

    def put(self, name, rows, batch):
        """Write the batch's rows of a log, replacing what an earlier try left."""
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in LOGS[name].fields]
        rows.select(*columns).write.mode("overwrite").parquet(
            f"{self._log_path(name)}/batch={batch}"
        )

    def fold(self, name, rows):
        """Replace a log by one batch; readers switch over when it is complete."""
        following = f"gen={self._generation(name) + 1}"
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in LOGS[name].fields]
        rows.select(*columns).write.mode("overwrite").parquet(
            self.path(name, following, "batch=folded")
        )
        self.mark(self.path(name, following, _READY))

    def tidy(self, limit, without=None):
        """Fold every log of more than `limit` batches; generations before the last two go.

        `without` names the batch being written: an earlier try of it is left out,
        it is written again. A folded batch is no longer known by its name, so only
        the newest batch may be tried again, which is what a stream does.
        """
        current = {"devices": self.devices, "forecasts": self.forecasts}
        for name in LOGS:
            batches = [c for c in self.children(self._log_path(name)) if c.startswith("batch=")]
            if len(batches) <= limit:
                continue
            rows = current[name](without) if name in current else self.log(name, without).drop("batch")
            self.fold(name, rows)
            newest = self._generation(name)
            for child in self.children(self.path(name)):
                if child.startswith("gen=") and int(child.split("=")[1]) < newest - 1:
                    self.delete(self.path(name, child))

    # -- current rows --------------------------------------------------------------

    def devices(self, without=None):
        return merge_registry(self.log("devices", without)).withColumn("metadata", F.lit("{}"))

    def forecasts(self, without=None):
        """One row per (device, kind, as_of): the last one written."""
        rows = latest_per_key(
            self.log("forecasts", without), ["device_id", "kind", "as_of"], ["computed_at", "batch"]
        )
        return rows.drop("batch")

    def alert_events(self, without=None):
        keys = ["device_id", "kind", "as_of", "state"]
        outcomes = latest_per_key(self.log("alert_outcomes"), keys, ["delivered_at", "batch"])
        return with_outcomes(self.log("alert_events", without).drop("batch"), outcomes, keys)

    def dead_letter(self):
        return self.log("dead_letter").drop("batch")

    def ingest_events(self):
        return self.log("ingest_events").drop("batch")

    def fold_devices(self):
        self.fold("devices", self.devices())

    def fold_forecasts(self):
        self.fold("forecasts", self.forecasts())


def with_day(readings):
    return readings.withColumn("measured_date", F.to_date("measured_at"))


def prune(rows, since=None, days=None):
    """Bound a day-partitioned scan by instant and by day; both reach the partitions."""
    if since is not None:
        edge = F.lit(since)
        rows = rows.filter(
            (F.col("measured_at") > edge) & (F.col("measured_date") >= F.to_date(edge))
        )
    if days is not None:
        rows = rows.filter(F.col("measured_date").isin(days))
    return rows


def write_day_partitioned(readings, path):
    """Readings by day of device time, each day's files sized by a rebalance."""
    (
        with_day(readings)
        .hint("rebalance", "measured_date")
        .write.mode("overwrite")
        .partitionBy("measured_date")
        .parquet(path)
    )


# Below the table; readers skip folders whose name starts with an underscore.
COMPACTED = "_compacted"
ROWS_PER_FILE = 2_000_000


def _files(spark, path, limit):
    """(measured_date, file) of all days before `limit`; no column is read."""
    rows = spark.read.parquet(path).filter(F.col("measured_date") < limit)
    return rows.select("measured_date", F.col("_metadata.file_name").alias("file")).distinct()


def stage_open_days(spark, path, now, staging, older_than_days=7):
    """Stage old days that hold a file no compaction has written; clustered, newest reading first.

    Returns the staged rows and the files they were read from.
    """
    limit = F.date_sub(F.to_date(F.lit(now)), older_than_days)
    tables, known = Tables(spark, path), f"{path}/{COMPACTED}"
    files = written(_files(spark, path, limit), f"{staging}/files")
    new = files
    if tables.exists(known):
        new = files.join(spark.read.schema(files.schema).parquet(known), ["measured_date", "file"], "left_anti")
    days = new.select("measured_date").distinct()
    seen = written(files.join(days, "measured_date", "left_semi"), f"{staging}/seen")
    old = spark.read.parquet(path).withColumn("_file", F.col("_metadata.file_name"))
    old = old.filter(F.col("measured_date") < limit).join(
        seen.withColumnRenamed("file", "_file"), ["measured_date", "_file"], "left_semi"
    ).drop("_file")
    parts = max(1, -(-old.count() // ROWS_PER_FILE))
    clustered = old.repartitionByRange(parts, "measured_date", "device_id", "measured_at")
    clustered.write.mode("overwrite").partitionBy("measured_date").parquet(f"{staging}/rows")
    return spark.read.schema(old.schema).parquet(f"{staging}/rows"), seen


def swap_unchanged(spark, path, staged, seen, staging):
    """Put staged days in place of the days they came from, unless those have got a file since.

    Such a day is left for the next run. Returns the rows put in place.
    """
    newest = seen.agg(F.max("measured_date")).first()[0]
    if newest is None:
        return staged.limit(0)
    present = _files(spark, path, F.date_add(F.lit(newest), 1))
    added = present.join(seen, ["measured_date", "file"], "left_anti")
    added = added.join(seen.select("measured_date").distinct(), "measured_date", "left_semi")
    # Written: after the swap the files it was found from are gone.
    added = written(added.select("measured_date").distinct(), f"{staging}/added")
    rows = staged.join(added, "measured_date", "left_anti").select(*staged.columns)
    (
        rows.sortWithinPartitions("measured_date", "device_id", F.col("measured_at").desc())
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("measured_date")
        .parquet(path)
    )
    after = _files(spark, path, F.date_add(F.lit(newest), 1))
    after = after.join(seen.select("measured_date").distinct(), "measured_date", "left_semi")
    fresh = after.join(seen, ["measured_date", "file"], "left_anti").join(added, "measured_date", "left_anti")
    fresh.select("measured_date", "file").write.mode("append").parquet(f"{path}/{COMPACTED}")
    return rows


def age_out_compaction(spark, path, now, staging, older_than_days=7):
    """Rewrite days older than the limit, clustered by device, newest reading first.

    Only days with a file that no earlier run has written are touched, so a run
    with nothing new rewrites nothing and a late append re-opens its own day. The
    days are staged first and then replace their partitions; a day that is
    appended to in between waits for the next run. An append during the swap of
    its own day itself must be kept out by the caller. Returns the rewritten rows.
    """
    staged, seen = stage_open_days(spark, path, now, staging, older_than_days)
    return swap_unchanged(spark, path, staged, seen, staging)
