"""Frames, beats and smoothing factors as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtide.schema import FRAME_RATE


def beat_frames(bpm: Column) -> Column:
    """Frames of a beat; a tempo that isn't positive counts as 120."""
    return F.lit(60.0) / F.when(bpm > 0, bpm).otherwise(F.lit(120.0)) * F.lit(FRAME_RATE)


def frames(beats: Column | float, of_beat: Column) -> Column:
    """Whole frames of so many beats, half-even, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.bround(F.lit(beats) * of_beat).cast("long"))


def alpha(n: Column) -> Column:
    """Smoothing factor that forgets 95 % within n frames."""
    return F.pow(F.lit(0.05), F.lit(1.0) / F.greatest(n.cast("double"), F.lit(1.0)))


def blend(slow: Column, fast: Column, bpm: Column, steepness: float = 0.03, midpoint: float = 120.0) -> Column:
    """From slow to fast along a logistic curve of the tempo."""
    t = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(steepness) * (bpm - F.lit(midpoint))))
    return slow * (F.lit(1.0) - t) + fast * t


def novelty_alpha(bpm: Column, beats: float = 0.5, fresh: bool = True) -> Column:
    """Smoothing of the novelty at a tempo.

    With ``fresh``, each frame starts from 120 and takes only 5 % of the
    tempo's effect, as the engine this follows does.
    """
    own = beat_frames(bpm)
    of_beat = F.lit(0.95 * 0.5 * FRAME_RATE) + F.lit(0.05) * own if fresh else own
    return alpha(of_beat * F.lit(beats))
