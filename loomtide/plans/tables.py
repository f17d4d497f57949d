"""The driver's tables as signals, spectra and samples, in Spark and in SQL.

events: a track for each user, value is the signal, frames count from 1.
embeddings: a track for each label, the absolute values are a spectrum of 64
bins, seven to the octave from 32.703 Hz. lineitem: a track of samples for each
supplier, quantities moved into [-1, 1].
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BINS = 64
FREQS = [32.703 * 2 ** (i / 7) for i in range(BINS)]
PCM_HOP = 64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def kind(c: Column) -> Column:
    return F.when(c == "click", "low").when(c == "view", "mid").otherwise("high")


def signal(spark: SparkSession, sf: str) -> DataFrame:
    """track, frame, event_id, ts (seconds), x, kind."""
    w = Window.partitionBy("track").orderBy("us", "event_id")
    return (
        table(spark, sf, "events")
        .select(F.col("user_id").alias("track"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("x"), kind(F.col("event_type")).alias("kind"))
        .withColumn("frame", F.row_number().over(w).cast("long")).withColumn("ts", F.col("us") / F.lit(1e6))
    )


def spectra(spark: SparkSession, sf: str) -> DataFrame:
    """track, frame, vec_id, mag, phase."""
    w = Window.partitionBy("track").orderBy("vec_id")
    return (
        table(spark, sf, "embeddings")
        .select(F.col("label").cast("long").alias("track"), "vec_id", F.col("embedding").cast("array<double>").alias("e"))
        .withColumn("frame", F.row_number().over(w).cast("long"))
        .select("track", "frame", "vec_id", F.transform("e", F.abs).alias("mag"), F.transform("e", lambda x: x * F.lit(math.pi)).alias("phase"))
    )


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """track, n (from 0), x."""
    w = Window.partitionBy("track").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return (
        table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("track"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", ((F.col("l_quantity") - 25.0) / 25.0).alias("x"))
        .withColumn("n", F.row_number().over(w).cast("long") - 1).select("track", "n", "x")
    )


SIGNAL = """signal AS (
  SELECT user_id AS track, event_id, epoch_us(ts) / 1e6 AS ts, value AS x,
    CASE event_type WHEN 'click' THEN 'low' WHEN 'view' THEN 'mid' ELSE 'high' END AS kind,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame
  FROM events
)"""

SPECTRA = """spectra AS (
  SELECT CAST(label AS BIGINT) AS track, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS frame,
    list_transform(CAST(embedding AS DOUBLE[]), lambda v: abs(v)) AS mag,
    list_transform(CAST(embedding AS DOUBLE[]), lambda v: v * pi()) AS phase
  FROM embeddings
)"""

#: A row for each bin (from 0) of each frame.
BINNED = SPECTRA + """, binned AS (
  SELECT track, frame, unnest(range(0, len(mag))) AS bin, unnest(mag) AS m, unnest(phase) AS p FROM spectra
)"""

AXIS = """axis AS (
  SELECT bin, f, CASE WHEN f > 0 THEN ra / (SELECT pow(12194.0, 2) * 1e12 / ((1e6 + pow(20.6, 2)) * sqrt((1e6 + pow(107.7, 2)) * (1e6 + pow(737.9, 2))) * (1e6 + pow(12194.0, 2)))) ELSE 0 END AS w
  FROM (
    SELECT bin, f, pow(12194.0, 2) * pow(f, 4) / ((f * f + pow(20.6, 2)) * sqrt((f * f + pow(107.7, 2)) * (f * f + pow(737.9, 2))) * (f * f + pow(12194.0, 2))) AS ra
    FROM (SELECT range AS bin, CAST(32.703 AS DOUBLE) * pow(2, range / 7.0) AS f FROM range(64))
  )
)"""

SAMPLES = """samples AS (
  SELECT l_suppkey AS track, (l_quantity - 25.0) / 25.0 AS x,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS n
  FROM lineitem
)"""


def r6(c: Column | str) -> Column:
    """Rounded as the SQL side is, so that hashes agree."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def per_bin(df: DataFrame, *columns: str) -> DataFrame:
    """A row for each bin, with the arrays' values rounded."""
    zipped = F.arrays_zip(*[F.col(c) for c in columns])
    return df.select("track", "frame", F.posexplode(zipped).alias("bin", "z")).select("track", "frame", F.col("bin").cast("long").alias("bin"), *[r6(F.col(f"z.{c}")).alias(c) for c in columns])
