"""Streaming forms of the batch imports: an extension. State is bounded by watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def commits_stream(spark: SparkSession, path: str, schema: str, late: str = "30 days") -> DataFrame:
    """New commits as their export files arrive (JSON lines with sha and committedAt), each sha once."""
    rows = spark.readStream.schema(schema).option("mode", "FAILFAST").json(path)
    return rows.withWatermark("committedAt", late).dropDuplicatesWithinWatermark(["sha"])


def load_windows(points: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Requests and highest p95 per endpoint and time window of a stream (at, endpoint, requests, p95)."""
    w = points.withWatermark("at", late).groupBy(F.window("at", width), "endpoint")
    return w.agg(F.sum("requests").alias("requests"), F.max("p95").alias("p95")).select(F.col("window.start").alias("start"), "endpoint", "requests", "p95")
