"""The corpus pipeline: stages over documents, each written and read again."""

from pyspark.sql import functions as F

from levelcast.llm import decontaminate, line_rules, mixing, near_dup, shards
from levelcast.llm.common import table
from levelcast.session import scratch_dir


def quality_rules(spark, docs, sf_dir):
    """Failing lines go; rejected documents go. n_chars follows the cleaned text."""
    judged = line_rules.clean_lines(docs, keep=docs.columns).filter("kept")
    changed = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("bigint")}
    return judged.select(*[changed.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near duplicates stays: five words, 0.8.

    It is the one of the smallest doc_id; rows without an id go by their text. Of
    rows equal in doc_id and text one stays.
    """
    key = lambda text_hash: F.xxhash64("doc_id", text_hash)
    stay = near_dup.near_duplicates(docs).filter("representative")
    stay = stay.select(key("text_hash").alias("__stay"), F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h"))
    rows = docs.withColumn("__hash", F.xxhash64("text")).withColumn("__key", key("__hash"))
    same = (F.col("__key") == F.col("__stay")) & (F.col("__hash") == F.col("__h"))
    joined = rows.join(stay, same & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return joined.dropDuplicates(["__key", "doc_id", "__hash"]).select(*docs.columns)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark, docs, sf_dir):
    """Every reading of every document as a row, in training order."""
    return mixing.apply_mix(docs)


def sharding(spark, docs, sf_dir):
    """Adds `shard`."""
    return shards.place(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("sharding", sharding),
]

# Edit distance to any stretch of a text is not expressible in SQL at this size.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages, one after the other, over `documents`; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
