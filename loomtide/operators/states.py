"""Mode and break states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtide.operators.folds import Break, Mode
from loomtide.operators.scan import scan


def sessions(df: DataFrame, starts: Column) -> DataFrame:
    """Adds session: song starts so far. Folds keyed by it begin anew."""
    w = Window.partitionBy("track").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("session", F.sum(starts.cast("long")).over(w))


def mode(df: DataFrame, keys: list[str] = ("track",), **kw) -> DataFrame:
    """(novelty, rms, confidence) -> mode."""
    return scan(df, Mode(**kw), ["novelty", "rms", "confidence"], keys=list(keys), keep=[*keys, "frame"])


def breaks(df: DataFrame, level: str, keys: list[str] = ("track",), keep: list[str] | None = None, **kw) -> DataFrame:
    """(level, low, bpm, drifting) -> breaking and intensity."""
    return scan(df, Break(**kw), [level, "low", "bpm", "drifting"], keys=list(keys), keep=keep or [*keys, "frame"])


def intensity(mode_: Column, *breaks_: Column) -> Column:
    """The stronger of the breaks, in beat mode only."""
    top = breaks_[0] if len(breaks_) == 1 else F.greatest(*breaks_)
    return F.when(mode_ == "beat", top).otherwise(F.lit(0.0))
