"""Message streams: files or Kafka in, (topic, payload, received_at, arrival_seq) out."""

from pyspark.sql import functions as F

from levelcast import schemas
from levelcast.functions import wire

# The subscription filter: any single segment in place of the device.
_SUBSCRIBED = rf"(?s)\A{wire.TOPIC_ROOT}/{wire.TOPIC_VERSION}/[^/]*/{wire.TOPIC_LEAF}\z"


def subscribed(messages):
    return messages.filter(F.col("topic").rlike(_SUBSCRIBED))


def message_stream(spark, path, max_files_per_trigger=None):
    """Messages from Parquet files of the message schema as they appear below a path."""
    reader = spark.readStream.schema(schemas.MESSAGES)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return subscribed(reader.parquet(path))


def kafka_messages(records):
    """Kafka records (key = topic text) as messages.

    arrival_seq is the pair of offset and partition, which names a record of the topic.
    """
    return subscribed(
        records.select(
            F.col("key").cast("string").alias("topic"),
            F.col("value").alias("payload"),
            F.col("timestamp").alias("received_at"),
            F.struct("offset", "partition").alias("arrival_seq"),
        )
    )


def kafka_stream(spark, servers, topic, **options):
    """The same from Kafka; needs Spark's Kafka connector on the classpath."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return kafka_messages(reader.option("subscribe", topic).options(**options).load())
