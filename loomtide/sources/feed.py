"""Where samples come from: given arrays, files, or a stream of files.

A live device is not something Spark reads; a stream of hop files takes its
place, with maxFilesPerTrigger for back-pressure.
"""

from __future__ import annotations

import json
import tomllib
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from loomtide.schema import Settings

HOPS = "track long, frame long, pcm array<double>"


def given(spark: SparkSession, hops: list[tuple[int, int, list[float]]]) -> DataFrame:
    return spark.createDataFrame(hops, HOPS)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HOPS).parquet(path)


def stream(spark: SparkSession, path: str, per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(HOPS).option("maxFilesPerTrigger", per_trigger).parquet(path)


def weights(path: str | Path) -> tuple[np.ndarray, dict[str, int]]:
    """A flat vector ``weights`` and whole-number dimensions, from an npz file."""
    with np.load(path) as data:
        return data["weights"].astype(np.float64), {k: int(data[k]) for k in data.files if k != "weights" and data[k].ndim == 0}


def merged(base: dict, over: dict) -> dict:
    """base with the values of over, dictionaries merged at every depth."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def settings(path: str | Path | None = None) -> Settings:
    """The default settings, with what a TOML file says instead."""
    base = {k: dict(v) for k, v in vars(Settings()).items()}
    if path and Path(path).exists():
        told = tomllib.loads(Path(path).read_text())
        base = merged(base, {k: v for k, v in told.items() if k in base})
    return Settings(**base)


def schema_json(df: DataFrame) -> dict:
    return json.loads(df.schema.json())
