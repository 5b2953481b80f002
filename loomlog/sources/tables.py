"""Logs read from plain Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def event_log(spark: SparkSession, directory: str) -> DataFrame:
    """The committed log ``sequenced_events``, already in the canonical schema."""
    return table(spark, directory, "sequenced_events")


def events_as_log(spark: SparkSession, directory: str) -> DataFrame:
    """The ``events`` table as a log: position = event_id + 1, tags from the user and the property k."""
    e = table(spark, directory, "events")
    return e.select(
        (F.col("event_id") + 1).alias("position"),
        "event_type",
        F.array(F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.concat(F.lit("k:"), F.get_json_object("props", "$.k"))).alias("tags"),
        F.col("props").cast("binary").alias("data"),
        F.lit(None).cast("string").alias("uuid"),
        F.array(F.struct(F.lit("value").alias("key"), F.col("value").cast("string").alias("value"))).alias("metadata"),
        F.lit(None).cast("struct<source:string,position:bigint>").alias("tracking_info"),
    )
