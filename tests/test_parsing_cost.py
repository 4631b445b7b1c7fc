"""Parsing runs on all cores, in generated methods the JVM compiles (up to 8,000 bytes)."""

from conftest import at
from pyspark.sql import functions as F

from levelcast import schemas
from levelcast.operators import classify
from levelcast.plans import ingest
from levelcast.sources import captures

COMPILED = 8000


def largest_method(spark, df):
    debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
    stages = getattr(debug, "MODULE$").codegenStringSeq(df._jdf.queryExecution().executedPlan()).iterator()
    sizes = []
    while stages.hasNext():
        sizes.append(stages.next()._3().maxMethodCodeSize())
    return max(sizes)


def one_file(spark, path, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def messages(spark, path):
    text = '{"schema_version":1,"device_id":"dev-1","measured_at":"2026-01-01T00:00:00Z","water_level":50,"battery_voltage":4}'
    return one_file(spark, path, schemas.MESSAGES, [("planter/v1/dev-1/telemetry", text.encode(), at(i), i) for i in range(20)])


def test_classification_is_compiled(spark, tmp_path):
    assert largest_method(spark, classify.classify(messages(spark, str(tmp_path / "in")))) <= COMPILED


def test_decoding_is_compiled(spark, tmp_path):
    lines = one_file(spark, str(tmp_path / "lines"), "value string", [("{}",)])
    assert largest_method(spark, captures.decode_records(lines)) <= COMPILED


def test_a_batch_of_one_file_is_parsed_on_all_cores(spark, tables, tmp_path, monkeypatch):
    seen = []

    def watched(df):
        seen.append(df.select(F.spark_partition_id()).distinct().count())
        return classify.classify(df)

    monkeypatch.setattr(ingest, "classify", watched)
    totals = ingest.ingest_batch(tables, messages(spark, str(tmp_path / "in")), "one").first()
    assert seen[0] >= spark.sparkContext.defaultParallelism
    assert (totals["ingested"], totals["deduplicated"]) == (1, 19)
