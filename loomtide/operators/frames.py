"""Samples into hops, levels, and other signal conditioning."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtide.functions import arrays as A
from loomtide.operators.folds import Agc, Envelope
from loomtide.operators.scan import Fold, scan
from loomtide.schema import HOP, SAMPLE_RATE


def hops(samples: DataFrame, size: int = HOP, whole: bool = True) -> DataFrame:
    """(track, n from 0, x) -> (track, frame from 0, pcm); only full hops if whole."""
    out = (
        samples.withColumn("frame", F.floor(F.col("n") / size)).groupBy("track", "frame")
        .agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("s")).select("track", "frame", F.transform("s", lambda s: s["x"]).alias("pcm"))
    )
    return out.where(F.size("pcm") == size) if whole else out


def overlapping(hops_: DataFrame, count: int = 4) -> DataFrame:
    """Adds window: this hop after count - 1 before it; rows with fewer go."""
    w = Window.partitionBy("track").orderBy("frame").rowsBetween(-(count - 1), 0)
    return hops_.withColumn("__h", F.collect_list("pcm").over(w)).where(F.size("__h") == count).withColumn("window", F.flatten("__h")).drop("__h")


def delayed(df: DataFrame, column: str, delay: int, keys: list[str] = ("track",), order: str = "frame") -> Column:
    """What a ring buffer gives back after a delay; fractional ones interpolate."""
    w = Window.partitionBy(*keys).orderBy(order)
    low = math.floor(delay)
    part = delay - low
    near = F.lag(column, low).over(w)
    return near if not part else near * (1 - part) + F.lag(column, low + 1).over(w) * part


def gate(pcm: Column, floor: float = 0.001) -> Column:
    return F.transform(pcm, lambda x: F.when(F.abs(x) < floor, F.lit(0.0)).otherwise(x))


def sounding_rms(pcm: Column) -> Column:
    """RMS over the samples that aren't zero; null if all are."""
    power = F.aggregate(pcm, F.lit(0.0), lambda s, x: s + x * x)
    n = F.size(F.filter(pcm, lambda x: x != 0))
    return F.when(n > 0, F.sqrt(power / n))


def agc(hops_: DataFrame, floor: float = 0.001, **kw) -> DataFrame:
    """(track, frame, pcm) -> gated and levelled pcm, with slow_rms and gain."""
    gated = hops_.withColumn("pcm", gate(F.col("pcm"), floor)).withColumn("__rms", sounding_rms(F.col("pcm"))).withColumn("__n", F.size("pcm"))
    out = scan(gated, Agc(floor=floor, **kw), ["__n", "__rms"], keep=["track", "frame", "pcm"])
    return out.withColumn("pcm", A.scaled(F.col("pcm"), F.col("gain")))


def sounding(hops_: DataFrame) -> Column:
    """Whether any sample isn't zero; silent hops skip everything after this."""
    return F.exists("pcm", lambda x: x != 0)


def with_idle(hops_: DataFrame, features: DataFrame, idle: dict[str, float]) -> DataFrame:
    """Puts silent hops back beside the features of the others, with idle values."""
    out = hops_.select("track", "frame").join(features, ["track", "frame"], "left")
    return out.fillna(idle)


def zero_crossings(pcm: Column) -> Column:
    """Sign changes for each sample; zero counts as positive."""
    n = F.size(pcm)
    pairs = F.zip_with(F.slice(pcm, F.lit(1), n - 1), F.slice(pcm, F.lit(2), n - 1), lambda a, b: ((a < 0) != (b < 0)).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x) / n


def resampler(up: int = 147, down: int = 320, half: int = 10, beta: float = 5.0):
    """Polyphase FIR for one hop at a time: a Kaiser-windowed low-pass."""
    n = 2 * half * max(up, down) + 1
    t = np.arange(n) - n // 2
    kernel = np.sinc(t / max(up, down)) * np.kaiser(n, beta)
    kernel *= up / kernel.sum()

    def run(x: np.ndarray) -> np.ndarray:
        wide = np.zeros(len(x) * up)
        wide[::up] = x
        full = np.convolve(wide, kernel)[n // 2 :]
        return full[: -(-len(x) * up // down) * down : down][: -(-len(x) * up // down)]

    return run


def half_band(n: int = 6, transition: float = 0.1) -> list[float]:
    """Coefficients of n all-passes of an elliptic half-band filter, from the
    width of its transition as a share of the rate."""
    k = math.tan((1 - 2 * transition) * math.pi / 4) ** 2
    root = (1 - k * k) ** 0.25
    e = 0.5 * (1 - root) / (1 + root)
    q = e + 2 * e**5 + 15 * e**9 + 150 * e**13
    out = []
    for c in range(1, n + 1):
        angle = c * math.pi / (2 * n + 1)
        top = q**0.25 * sum((-1) ** i * q ** (i * (i + 1)) * math.sin((2 * i + 1) * angle) for i in range(9))
        low = 0.5 + sum((-1) ** i * q ** (i * i) * math.cos(2 * i * angle) for i in range(1, 9))
        w = (top / low) ** 2
        x = math.sqrt((1 - w * k) * (1 - w / k)) / (1 + w)
        out.append((1 - x) / (1 + x))
    return out


class HalfBand(Fold):
    """Halves the rate with two chains of all-passes, one for each phase of the
    samples; a hop of even size gives half as many."""

    out = "half array<double>"

    def __init__(self, coefficients: list[float] | None = None):
        own = half_band() if coefficients is None else coefficients
        # The earlier sample of a pair takes every second one, the later the rest.
        self.chains = (tuple(own[1::2]), tuple(own[0::2]))

    def start(self):
        return tuple(tuple((0.0, 0.0) for _ in c) for c in self.chains)

    def step(self, state, row):
        after, paths = [], []
        for coefficients, memory, phase in zip(self.chains, state, (0, 1)):
            y, kept = list(row[0][phase::2]), []
            for a, (x1, y1) in zip(coefficients, memory):
                out = []
                for x in y:
                    y1 = a * (x - y1) + x1
                    x1 = x
                    out.append(y1)
                kept.append((x1, y1))
                y = out
            after.append(tuple(kept))
            paths.append(y)
        return tuple(after), ([(a + b) / 2 for a, b in zip(*paths)],)


class Octaves(Fold):
    """A hop of samples -> the same at half the rate, a quarter, and so on: all stages in one fold."""

    def __init__(self, stages: int):
        self.halves = [HalfBand() for _ in range(1, stages)]
        self.out = ", ".join(f"octave_{k} array<double>" for k in range(1, stages))

    def start(self):
        return tuple(h.start() for h in self.halves)

    def step(self, state, row):
        after, out, x = [], [], row[0]
        for half, own in zip(self.halves, state):
            own, (x,) = half.step(own, (x,))
            after.append(own)
            out.append(x)
        return tuple(after), tuple(out)


def octaves(hops_: DataFrame, stages: int = 9) -> DataFrame:
    """Adds octave_0 (pcm) to octave_{stages-1}, each at half the rate before; one shuffle for all."""
    out = hops_.withColumnRenamed("pcm", "octave_0")
    return scan(out, Octaves(stages), ["octave_0"], keep=out.columns) if stages > 1 else out


def compress(samples: DataFrame, ratio: float = 4.0, threshold_db: float = -12.0, attack_ms: float = 5.0, release_ms: float = 50.0, block: int = 64, rate: float = SAMPLE_RATE) -> DataFrame:
    """(track, n, x) -> x with loud blocks turned down, then made up to the old peak."""
    coefficient = [math.exp(-block / (rate * ms / 1000.0)) for ms in (attack_ms, release_ms)]
    blocks = samples.withColumn("frame", F.floor(F.col("n") / block))
    levels = blocks.groupBy("track", "frame").agg(F.max(F.abs("x")).alias("level"))
    envelope = scan(levels, Envelope(*coefficient), ["level"]).withColumnRenamed("y", "envelope")
    peak = levels.groupBy("track").agg(F.max("level").alias("peak"))
    thr = F.col("peak") * F.lit(10 ** (threshold_db / 20))
    db = F.when(F.col("envelope") > thr, F.lit((1 - 1 / ratio) * 20) * F.log10(F.col("envelope") / thr + 1e-10)).otherwise(F.lit(0.0))
    gains = envelope.join(peak, "track").select("track", "frame", "peak", F.pow(F.lit(10.0), -db / 20).alias("gain"))
    out = blocks.join(gains, ["track", "frame"]).withColumn("y", F.col("x") * F.col("gain"))
    loudest = out.groupBy("track").agg(F.max(F.abs("y")).alias("top"))
    return out.join(loudest, "track").select("track", "n", F.when(F.col("top") > 1e-10, F.col("y") * F.col("peak") / F.col("top")).otherwise(F.col("y")).alias("x"))
