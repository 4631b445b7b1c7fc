"""Session defaults and the shared scratch folder."""

import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession, functions as F

# Settings the operators rely on for right results (UTC) or for skew (AQE).
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(master=None, app_name="levelcast", **conf):
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark):
    """Apply the required settings to a session somebody else built."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch_dir(spark, prefix="run"):
    """A fresh path below the cluster's shared checkpoint folder.

    Only a session without `spark.checkpoint.dir` (a test on one machine) falls
    back to a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/levelcast-{prefix}-{uuid.uuid4().hex}"


def written(df, path):
    """Write a table and read it back: computed once, whatever executor is lost later."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty(spark, schema):
    """No rows of a schema, known as such to the optimizer: what is joined to them is not planned."""
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return spark.range(0).filter(F.lit(False)).select(*columns)


def spread(df):
    """The rows dealt evenly over the cluster's cores, for costly steps on input of few files."""
    spark = df.sparkSession
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, shuffled))


@contextlib.contextmanager
def scratch_tables(spark, prefix):
    """Gives write(df, name) for tables below one scratch folder, which is deleted at the end."""
    root = scratch_dir(spark, prefix)
    try:
        yield lambda df, name: written(df, f"{root}/{name}")
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
