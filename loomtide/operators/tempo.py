"""Tempo: autocorrelation, inter-beat intervals, and their reconciliation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtide.operators.folds import ParticleTempo, TempoState
from loomtide.operators.scan import Fold, scan

HOP_SECONDS = 0.01067


class Autocorrelation(Fold):
    """(onset strength, onset density) -> an estimate at every ``every`` frames.

    The window starts as zeros, which count. Gives raw bpm (null in silence)
    and confidence. The last values are kept twice in a row of memory, so that
    a window is always one slice and a frame costs no copying.
    """

    out = "raw_bpm double, confidence double"

    def __init__(self, hop: float = HOP_SECONDS, seconds: float = 8.0, interval: float = 0.5, min_bpm: float = 60.0, max_bpm: float = 400.0, centre: float = 110.0, width: float = 1.4):
        self.size, self.every = int(seconds / hop), max(1, int(interval / hop))
        low, high = int(60.0 / max_bpm / hop), min(int(60.0 / min_bpm / hop), self.size // 2)
        self.lags = np.arange(low, high + 1)
        self.bpms = 60.0 / (self.lags * hop)
        self.prior = np.exp(-0.5 * (np.log2(self.bpms / centre) / width) ** 2)
        self.reach = int(min(3 * high, self.size - 1))

    def start(self):
        return np.zeros(2 * self.size), 0

    def estimate(self, x: np.ndarray, density: float) -> tuple[float, float] | None:
        spread = x.std()
        if spread < 1e-10:
            return None
        x = (x - x.mean()) / spread
        near = np.array([float((x[: len(x) - k] * x[k:]).sum()) for k in range(self.reach + 1)])
        near /= near[0] + 1e-10
        own = near[self.lags]
        score = own * self.prior
        for times, share in ((2, 0.25), (3, 0.5 / 3)):
            far = self.lags * times
            ok = far < min(len(x), len(near))
            score[ok] += near[far[ok]] * self.prior[ok] * share
        best = int(score.argmax())
        half = int(self.lags[best]) // 2 - int(self.lags[0])
        if 0 <= half < len(score) and density > self.bpms[best] / 60.0 * 3.5 * 1.5 and score[half] > 0.3 * score[best]:
            best = half
        top = np.sort(score)[-len(score) // 4 :].mean()
        return float(self.bpms[best]), float(min(1.0, own[best] * 2.0 * min(score[best] / top if top > 0 else 1.0, 3.0)))

    def step(self, state, row):
        ring, n = state
        at = n % self.size
        ring[at] = ring[at + self.size] = row[0]
        n += 1
        if n % self.every or n < self.size // 2:
            return (ring, n), None
        found = self.estimate(ring[at + 1 : at + 1 + self.size], row[1] or 0.0)
        return (ring, n), found or (None, 0.0)


def autocorrelation(df: DataFrame, **kw) -> DataFrame:
    """(track, frame, strength, density) -> raw estimates at anchor frames."""
    return scan(df, Autocorrelation(**kw), ["strength", "density"])


def smoothed(anchors: DataFrame, **kw) -> DataFrame:
    """raw_bpm and confidence at anchors -> the tempo that is shown."""
    return scan(anchors.withColumnRenamed("confidence", "raw_confidence"), TempoState(**kw), ["raw_bpm", "raw_confidence"], keep=["track", "frame", "raw_bpm", "raw_confidence"])


def particle(df: DataFrame, **kw) -> DataFrame:
    """(track, frame, bpm, confidence) of a particle filter, smoothed."""
    return scan(df.withColumnRenamed("bpm", "raw_bpm"), ParticleTempo(**kw), ["raw_bpm", "confidence"], keep=["track", "frame", "raw_bpm", "confidence"])


class Percival(Fold):
    """Generalised autocorrelation with harmonics enhanced, and a pulse train's phase."""

    out = "raw_bpm double, confidence double, bpm double, phase long"

    def __init__(self, hop: float = HOP_SECONDS, min_bpm: float = 50.0, max_bpm: float = 210.0, power: float = 0.5, seconds: float = 6.0, interval: float = 0.37, taps: int = 15, compress: bool = True):
        self.size, self.every, self.power, self.hop, self.compress = int(seconds / hop), max(1, int(interval / hop)), power, hop, compress
        self.low, self.high = max(1, int(60.0 / max_bpm / hop)), int(60.0 / min_bpm / hop)
        # A windowed low-pass at the fastest tempo's rate.
        t = np.arange(taps) - (taps - 1) / 2
        kernel = np.sinc(2 * max_bpm / 60.0 * hop * t) * (0.54 + 0.46 * np.cos(2 * np.pi * t / (taps - 1)))
        self.kernel = kernel / kernel.sum()

    def start(self):
        return (), (), 0, None

    def step(self, state, row):
        recent, window, n, bpm = state
        x = max(0.0, row[0])
        recent = (math.log1p(1000.0 * x) if self.compress else x, *recent)[: len(self.kernel)]
        window = (*window, float(sum(k * v for k, v in zip(self.kernel, recent))))[-self.size :]
        n += 1
        if n % self.every or n < self.size // 2:
            return (recent, window, n, bpm), None
        buf = np.concatenate([np.zeros(self.size - len(window)), window])
        found = self._estimate(buf)
        if found is None:
            return (recent, window, n, bpm), None
        raw, conf, phase = found
        share = 0.3 * conf + 0.05
        bpm = raw if bpm is None else (1 - share) * bpm + share * raw
        return (recent, window, n, bpm), (raw, conf, bpm, phase)

    def _estimate(self, buf: np.ndarray):
        if buf.std() < 1e-10:
            return None
        x = (buf - buf.mean()) / buf.std()
        size = 1 << (2 * len(x) - 1).bit_length()
        near = np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** self.power, size)[: len(x)]
        high = min(self.high, len(x))
        both = np.zeros(len(x))
        for t in range(self.low, high):
            both[t] = near[t] + sum(near[k * t] for k in (2, 4) if k * t < len(x))
        tops = [t for t in range(self.low, min(high, len(x) - 1)) if both[t] > both[t - 1] and both[t] > both[t + 1]]
        if not tops:
            return None
        lag = max(tops, key=lambda t: (both[t], t))
        reach = both[self.low : high].max() - np.median(both[self.low : high])
        conf = min(1.0, both[lag] / (reach + 1e-10) * 0.5) if reach > 0 else 0.0
        return 60.0 / self.hop / lag, float(conf), pulse_train(buf, lag)[2]


def pulse_train(x: np.ndarray, period: int) -> tuple[float, float, int]:
    """(best, variance, phase) of pulses at the beat, and at half weight every
    one and a half and every two beats."""
    if period < 2:
        return 0.0, 0.0, 0
    fit = np.zeros(period)
    for step, weight in ((period, 1.0), (period * 1.5, 0.5), (period * 2, 0.5)):
        k = np.arange(int(len(x) / step) + 1)
        at = (np.arange(period)[:, None] + k[None, :] * step).astype(int)
        fit += weight * np.where(at < len(x), x[np.minimum(at, len(x) - 1)], 0.0).sum(1)
    return float(fit.max()), float(fit.var()), int(fit.argmax())


def percival(df: DataFrame, **kw) -> DataFrame:
    return scan(df, Percival(**kw), ["strength"])


def beat_rate(events: DataFrame, window: int = 6, limit: float = 0.20, keys: list[str] = ("track",)) -> DataFrame:
    """(keys, seq, ts, kind) -> for each beat: beat_rate and whether it is stable.

    Only low and mid events count, and those that go back in time are dropped:
    a time counts if no earlier one in order is greater. The rate is from the
    median of the last window - 1 intervals.
    """
    if window < 3:
        raise ValueError("window must be 3 or more")
    w = Window.partitionBy(*keys).orderBy("seq")
    top = F.max("ts").over(w.rowsBetween(Window.unboundedPreceding, -1))
    kept = events.where(F.col("kind").isin("low", "mid")).withColumn("__top", top).where(F.col("__top").isNull() | (F.col("ts") >= F.col("__top"))).drop("__top")
    last = w.rowsBetween(-(window - 2), 0)
    ibi = kept.withColumn("ibi", F.col("ts") - F.lag("ts").over(w))
    out = ibi.withColumn("__median", F.percentile("ibi", F.lit(0.5)).over(last)).withColumn("__mean", F.avg("ibi").over(last)).withColumn("__sd", F.stddev_samp("ibi").over(last)).withColumn("__n", F.count("ibi").over(last))
    stable = (F.col("__n") >= 2) & (F.col("__mean") > 0) & (F.col("__sd") / F.col("__mean") <= limit)
    return out.withColumn("beat_rate", F.when(F.col("__median") > 0, F.lit(60.0) / F.col("__median"))).withColumn("stable", F.coalesce(stable, F.lit(False))).drop("__median", "__mean", "__sd", "__n")


#: Octaves a tracker may be off by, in the order that wins ties.
OCTAVES = (1 / 3, 1 / 2, 1.0, 2.0, 3.0)


def octave(tracker: Column, rate: Column) -> Column:
    """The factor that brings the tracker closest to the beat rate."""
    gaps = F.array(*[F.struct((F.abs(tracker * F.lit(s) - rate) / F.greatest(rate, F.lit(1e-6))).alias("gap"), F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(OCTAVES)])
    return F.when(tracker <= 0, F.lit(1.0)).otherwise(F.array_min(gaps)["s"])


def reconcile(tracker: Column, rate: Column, stable: Column, method: str = "shift", tolerance: float = 0.05) -> Column:
    """struct(bpm, trustable, octave_factor, tracker_agreed).

    'override' takes the beat rate unless the tracker agrees; 'shift' moves
    the tracker to the nearest octave; 'octave' does so only by 2 or a half,
    and only if it then agrees.
    """
    def result(bpm: Column, trust: bool, factor: Column, agreed: Column) -> Column:
        return F.struct(bpm.alias("bpm"), F.lit(trust).alias("trustable"), factor.alias("octave_factor"), agreed.alias("tracker_agreed"))

    def gap(x: Column) -> Column:
        return F.abs(x - rate) / F.greatest(rate, F.lit(1e-6))

    one, s = F.lit(1.0), octave(tracker, rate)
    if method == "override":
        ok = gap(tracker) <= tolerance
        good = result(F.when(ok, tracker).otherwise(rate), True, one, ok)
    elif method == "shift":
        good = result(tracker * s, True, s, s == 1.0)
    elif method == "octave":
        act = s.isin(0.5, 2.0) & (gap(tracker * s) <= tolerance)
        good = result(F.when(act, tracker * s).otherwise(tracker), True, F.when(act, s).otherwise(one), ~act)
    else:
        raise ValueError(method)
    return F.when(rate.isNotNull() & stable, good).otherwise(result(tracker, False, one, F.lit(False)))


def hint_due(n: Column, pf_confidence: Column, other_confidence: Column, other_bpm: Column) -> Column:
    """Every 100 hops, a sure tempo of another tracker is passed to an unsure filter."""
    return (n % 100 == 0) & (pf_confidence < 0.10) & (other_confidence >= 0.50) & (other_bpm > 0)
