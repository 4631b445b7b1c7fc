"""What the operators share: words, written intermediate tables, ordering of rows."""

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from levelcast.session import scratch_dir

# Functions of this package travel to executors as code, so they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

# A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text):
    """The words of a text as an array; NULL has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def count_words(text):
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def lower_ascii(text):
    """A-Z to a-z; every other letter stays, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def materialize(df, name):
    """Write a table below the shared scratch folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read and not the whole plan.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stable_hash(*columns):
    """60 bits of md5 as a bigint: the same number in any SQL engine. NULL counts as ''."""
    text = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
