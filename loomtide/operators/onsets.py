"""Onset detectors over a scalar flux per track (and band)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtide.operators.folds import BeatPeaks, HeadPeaks, Refractory
from loomtide.operators.halo import chunked
from loomtide.operators.scan import scan
from loomtide.schema import HISTORY, frames_for_beats

DEFAULT_COOLDOWN = frames_for_beats(120.0, 0.25)


def _before(keys: list[str], n: int):
    return Window.partitionBy(*keys).orderBy("frame").rowsBetween(-n, -1)


def _refractory(df: DataFrame, keys: list[str], cooldown: int, last: int = 0) -> DataFrame:
    """Keeps the candidates that count. Only candidates are folded, so what a
    track holds beside them isn't moved."""
    kept = df.where("candidate").drop("candidate").withColumn("candidate", F.lit(True))
    out = scan(kept, Refractory(cooldown, last), ["frame", "candidate"], keys=keys, order=["frame"], keep=[c for c in kept.columns if c != "candidate"])
    return out.where("fired").drop("fired")


def percentile(df: DataFrame, percent: float = 99.0, history: int = HISTORY, cooldown: int = DEFAULT_COOLDOWN, min_flux: float = 1e-7, keys: list[str] = ("track",), chunk: int | None = None) -> DataFrame:
    """Adds energy to the rows (keys, frame, x) that are onsets.

    x must exceed a percentile of up to ``history`` values before it, of which
    there must be ten; where that is near silence, 1000 times min_flux. With a
    chunk, thresholds of long tracks (frames without gaps) are worked out in
    chunks of so many frames; only candidates are folded in one task.
    """
    def thresholds(rows: DataFrame, own: list[str]) -> DataFrame:
        w = _before(own, history)
        return rows.withColumn("threshold", F.percentile("x", F.lit(percent / 100.0)).over(w)).withColumn("__n", F.count("x").over(w))

    seen = thresholds(df, list(keys)) if chunk is None else chunked(df, thresholds, history, chunk=chunk, keys=list(keys))
    near = F.col("threshold") < min_flux
    hit = F.when(near, F.col("x") > min_flux * 1000).otherwise(F.col("x") > F.col("threshold"))
    energy = F.when(near, F.lit(1.0)).otherwise(F.least(F.lit(1.0), (F.col("x") - F.col("threshold")) / (F.col("threshold") + 1e-10)))
    found = seen.withColumn("candidate", (F.col("__n") >= 10) & (F.col("x") > min_flux) & hit).withColumn("energy", energy).drop("__n")
    return _refractory(found, list(keys), cooldown)


def flux(df: DataFrame, threshold: float = 1.5, bins: int = 30, history: int = HISTORY, cooldown: int = DEFAULT_COOLDOWN, min_flux: float = 1e-7, sharpness: float | None = 3.0, stability: Column | None = None, scaling: float = 1.0, keys: list[str] = ("track",)) -> DataFrame:
    """Adds energy to the rows that rise well above the mean before them.

    A sharpness (None for low bands) also asks for a jump over the median of
    the four values before; a stability column raises the threshold in quiet
    steady sound.
    """
    w, short = _before(list(keys), history), _before(list(keys), 4)
    seen = df.withColumn("__mean", F.avg("x").over(w)).withColumn("__n", F.count("x").over(w))
    seen = seen.withColumn("__pre", F.percentile("x", F.lit(0.5)).over(short)).withColumn("__k", F.count("x").over(short))
    thr = F.lit(threshold * max(1.0, math.sqrt(30.0 / max(bins, 1))))
    if stability is not None:
        thr = thr * (F.lit(1.0) + stability * F.lit(scaling) / (F.lit(1.0) + F.col("__mean") * 10.0))
    seen = seen.withColumn("threshold", thr)
    sharp = F.lit(True)
    if sharpness is not None:
        need = F.lit(1.0) + F.lit(sharpness - 1.0) / (F.lit(1.0) + F.col("__pre") * 10.0)
        sharp = (F.col("__k") < 4) | (F.col("__pre") <= min_flux) | (F.col("x") / F.col("__pre") >= need)
    quiet = F.col("__mean") < min_flux
    hit = F.when(quiet, F.col("x") > min_flux * 1000).otherwise(F.col("x") > F.col("__mean") * F.col("threshold"))
    energy = F.when(quiet, F.lit(1.0)).otherwise(F.least(F.lit(1.0), (F.col("x") / F.col("__mean") - F.col("threshold")) / F.col("threshold")))
    found = seen.withColumn("candidate", (F.col("__n") >= 10) & (F.col("x") > min_flux) & sharp & hit).withColumn("energy", energy).drop("__n", "__k", "__pre", "__mean")
    return _refractory(found, list(keys), cooldown)


def peaks(df: DataFrame, threshold: float = 0.3, distance: int = 5, keys: list[str] = ("track",)) -> DataFrame:
    """Inner local maxima of x (ties count) of at least threshold, ``distance`` apart."""
    w = Window.partitionBy(*keys).orderBy("frame")
    top = (F.col("x") >= F.lag("x").over(w)) & (F.col("x") >= F.lead("x").over(w)) & (F.col("x") >= threshold)
    return _refractory(df.withColumn("candidate", F.coalesce(top, F.lit(False))), list(keys), distance, last=-(1 << 40))


def beat_peaks(df: DataFrame, **kw) -> DataFrame:
    """(beat, downbeat) activations -> events, at the frame that tells them."""
    return scan(df, BeatPeaks(**kw), ["beat", "downbeat"])


def head_peaks(df: DataFrame, **kw) -> DataFrame:
    """(downbeat, beat, onset) activations -> events, at the frame that tells them."""
    return scan(df, HeadPeaks(**kw), ["downbeat", "beat", "onset"])


def accept(events: DataFrame, *filters: Callable[[DataFrame], Column]) -> DataFrame:
    """Events that all filters let through; without filters, all."""
    for f in filters:
        events = events.where(f(events))
    return events


DETECTORS = {"percentile": percentile, "flux": flux, "peaks": peaks, "activations": beat_peaks, "heads": head_peaks}


def detector(kind: str):
    """A detector by name; an unknown one gives the percentile detector."""
    return DETECTORS.get(kind, percentile)
