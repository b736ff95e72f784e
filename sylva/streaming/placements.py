"""Placement results as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PLACED = "sample string, pq_id long, loc int, ml_ratio double, distal_bl double, pendant_bl double, placed_at timestamp"


def read(spark: SparkSession, path: str, schema: str = PLACED) -> DataFrame:
    """Placement rows from Parquet files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def running_mass(stream: DataFrame) -> DataFrame:
    """(sample, loc, weight, n) so far; for complete or update mode."""
    return stream.groupBy("sample", "loc").agg(F.sum("ml_ratio").alias("weight"), F.count("*").alias("n"))


def windowed_mass(stream: DataFrame, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, sample, loc, weight) by arrival, closed once later than the watermark."""
    return stream.withWatermark("placed_at", late).groupBy(F.window("placed_at", every), "sample", "loc").agg(F.sum("ml_ratio").alias("weight"))
