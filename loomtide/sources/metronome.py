"""A made-up signal: each band fires at its own interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtide.schema import HOP, SAMPLE_RATE

INTERVALS = {"low": 0.5, "mid": 1.0, "high": 0.25}


def events(spark: SparkSession, frames: int, intervals: dict[str, float] | None = None) -> DataFrame:
    """(band, frame, ts) of the frames at which a band's count goes up."""
    steps = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(s).alias("step")) for b, s in (intervals or INTERVALS).items()])
    at = lambda n: n * HOP / F.lit(float(SAMPLE_RATE))
    rows = spark.range(1, frames).select(F.col("id").alias("frame"), F.explode(steps).alias("b")).select("frame", "b.band", "b.step")
    up = F.floor(at(F.col("frame")) / F.col("step")) > F.floor(at(F.col("frame") - 1) / F.col("step"))
    return rows.where(up).withColumn("ts", at(F.col("frame")))
