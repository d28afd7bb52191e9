"""Where events come from: stored tables, file streams, brokers, and a generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions import padded, pick


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as keyed events: key, seq (order of arrival), ts and the payload's fields."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), "ts", "event_type", "value", "props")


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def broker_stream(spark: SparkSession, servers: str, topic: str, per_trigger: int | None = None, **options: str) -> DataFrame:
    """Messages of a topic as keyed events; needs Spark's Kafka connector on the class path.

    Arrival order is the offset within a partition; a key always has one partition.
    """
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options)
    if per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    m = reader.load()
    return m.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("payload"), F.col("timestamp").alias("ts"), F.col("offset").alias("seq"))


CHANNELS = ["push", "email", "sms", "inapp"]


def synthetic(spark: SparkSession, n: int, keys: int, start: str = "2024-01-01 00:00:00") -> DataFrame:
    """n generated events over ``keys`` keys, all fields derived from the row number."""
    i = F.col("id")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + i)
    return spark.range(n).select(
        padded("crn_", 9, i % keys).alias("key"),
        i.alias("seq"),
        pick(CHANNELS, i).alias("channel"),
        (i % 5 + 1).cast("int").alias("priority"),
        padded("camp_", 4, i % 100).alias("campaign_id"),
        at.alias("updated_at"),
        (at + F.expr("INTERVAL 24 HOURS")).alias("expires_at"),
    )


def synthetic_stream(spark: SparkSession, rows_per_second: int, keys: int) -> DataFrame:
    i = F.col("value")
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    payload = F.to_json(F.struct(pick(CHANNELS, i).alias("channel"), (i % 5 + 1).alias("priority"), padded("camp_", 4, i % 100).alias("campaign_id")))
    return rate.select(padded("crn_", 9, i % keys).alias("key"), payload.alias("payload"), F.col("timestamp").alias("ts"), i.alias("seq"))
