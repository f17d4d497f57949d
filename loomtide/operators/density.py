"""Onset density: how many onsets a second, smoothed, and its trend."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtide.operators.folds import Emas
from loomtide.operators.scan import scan
from loomtide.schema import alpha_for_seconds


def rate(events: DataFrame, window_us: int, keys: list[str] = ("track", "kind"), seconds: float | None = None) -> DataFrame:
    """Adds raw: events of the keys from window_us before up to now, a second."""
    w = Window.partitionBy(*keys).orderBy("us").rangeBetween(-window_us, 0)
    return events.withColumn("raw", F.count("*").over(w) / F.lit(window_us / 1e6 if seconds is None else seconds))


def smoothed(rates: DataFrame, fast: float | None = None, slow: float | None = None, keys: list[str] = ("track", "kind"), order: list[str] = ("us", "event_id")) -> DataFrame:
    """Adds fast and slow averages of raw."""
    a, b = alpha_for_seconds(0.1) if fast is None else fast, alpha_for_seconds(2.0) if slow is None else slow
    return scan(rates, Emas(fast=a, slow=b), ["raw"], list(keys), list(order), keep=rates.columns)


def total(rates: DataFrame, bands: list[str], density: str = "slow", keys: list[str] = ("track",), order: list[str] = ("us", "event_id")) -> DataFrame:
    """Adds total: the sum over the bands (values of kind) of each one's density
    as last known, 0 before it has one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = [F.coalesce(F.last(F.when(F.col("kind") == b, F.col(density)), ignorenulls=True).over(w), F.lit(0.0)) for b in bands]
    return rates.withColumn("total", sum(parts[1:], parts[0]))


def delta(rates: DataFrame, window_us: int, keys: list[str] = ("track", "kind")) -> DataFrame:
    """Adds delta: fast now less the oldest one within the window; 0 if alone."""
    w = Window.partitionBy(*keys).orderBy("us").rangeBetween(-window_us, 0)
    return rates.withColumn("delta", F.when(F.count("*").over(w) < 2, F.lit(0.0)).otherwise(F.col("fast") - F.first("fast").over(w)))
