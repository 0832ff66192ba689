"""Streaming counterparts of grouped aggregates (an extension: the same expressions run on batches and on streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.schema import TOKENS


def hourly(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Count and total of values by type and hour; on a stream, events later than ``delay`` are dropped."""
    e = events.withWatermark("ts", delay) if events.isStreaming else events
    g = e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select("event_type", F.col("w.start").alias("hour"), "n", "total")


def token_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Token files arriving as Parquet in a folder."""
    return spark.readStream.schema(TOKENS).parquet(folder)


def missing_by_phoneme(tokens: DataFrame) -> DataFrame:
    """Running totals and missing formants by phoneme, for complete or update output."""
    return tokens.groupBy(F.coalesce("phoneme", F.lit("")).alias("phoneme")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("F1").isNull()).alias("missing")
    )
