"""How steady each bin is: harmonic against percussive sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtide.functions import arrays as A
from loomtide.operators.folds import Shape, Variability
from loomtide.operators.halo import chunked
from loomtide.operators.scan import scan
from loomtide.schema import alpha_for, alpha_for_seconds, frames_for_beats


def epochs(frames: DataFrame, mag: str = "mag") -> DataFrame:
    """Adds epoch, which counts up whenever the number of bins changes."""
    w = Window.partitionBy("track").orderBy("frame")
    changed = (F.size(mag) != F.lag(F.size(mag)).over(w)).cast("int")
    return frames.withColumn("__new", F.coalesce(changed, F.lit(0))).withColumn("epoch", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def ema(frames: DataFrame, alpha: float, mag: str = "mag", keep: list[str] = ("track", "frame")) -> DataFrame:
    return scan(frames, Variability(alpha), [mag], keep=list(keep))


def shape(frames: DataFrame, alpha: float = 0.95, kernel: int = 7, mag: str = "mag", keep: list[str] = ("track", "frame")) -> DataFrame:
    return scan(frames, Shape(alpha, kernel), [mag], keep=list(keep))


def median(frames: DataFrame, window: int | None = None, kernel: int = 15, mag: str = "mag", chunk: int | None = None) -> DataFrame:
    """Adds sustained (each bin's median over the last frames, this one
    included) and stability (its share beside the median over neighbours).

    The window over time is one over rows of a track, on the frames' arrays;
    the medians of all bins come from the same window, so that there is one
    shuffle and no row for each bin. With a chunk, long tracks (frames without
    gaps) are worked on in chunks of so many frames.
    """
    n = frames_for_beats(60.0, 1.0) if window is None else window
    across = F.transform(F.sequence(F.lit(0), F.size(mag) - 1), lambda i: F.sort_array(F.transform(F.col("__seen"), lambda s: F.get(s, i))))

    def middle(a: Column) -> Column:
        k = F.size(a)
        half = F.floor(k / 2).cast("int")
        return F.when(k % 2 == 1, F.get(a, half)).otherwise((F.get(a, half - 1) + F.get(a, half)) / 2)

    def held(rows: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("frame").rowsBetween(-(n - 1), 0)
        return rows.withColumn("__seen", F.collect_list(mag).over(w)).withColumn("sustained", F.transform(across, middle)).drop("__seen")

    out = held(frames, ["track"]) if chunk is None else chunked(frames, held, n - 1, chunk=chunk)
    out = out.withColumn("__near", A.sliding_median(F.col(mag), kernel))
    share = F.zip_with("sustained", "__near", lambda h, p: F.when(h + p > 1e-10, h / (h + p + 1e-10)).otherwise(F.lit(1.0)))
    return out.withColumn("stability", share).drop("__near")


def composite(frames: DataFrame, method: str = "median", mag: str = "mag") -> DataFrame:
    """stability by the method named, slow_stability by a memory of 2 s, and
    sustained, which only the median has; the others give none."""
    if clash := {"mean", "variance", "stability", "sustained", "fast"} & set(frames.columns):
        raise ValueError(f"frames have columns {sorted(clash)}")
    if method == "median":
        fast = median(frames, mag=mag).withColumnRenamed("stability", "fast")
    else:
        fold = Shape() if method == "shape" else Variability(alpha_for(0.5 * frames_for_beats(120.0, 1.0)))
        fast = scan(frames, fold, [mag], keep=frames.columns).drop("mean", "variance").withColumnRenamed("stability", "fast")
        fast = fast.withColumn("sustained", F.lit(None).cast("array<double>"))
    slow = scan(fast, Variability(alpha_for_seconds(2.0)), [mag], keep=fast.columns).drop("mean", "variance")
    return slow.withColumnRenamed("stability", "slow_stability").withColumnRenamed("fast", "stability")


def band_stability(stability: Column, freqs, band) -> Column:
    """Mean in a band, 1 for a band without bins."""
    part = A.band(stability, freqs, band)
    return F.when(F.size(part) > 0, A.mean(part)).otherwise(F.lit(1.0))


def band_variability(mean: Column, variance: Column, freqs, band) -> Column:
    """A band's stability from its bins' mean level and variance, 1 if it has none."""
    m, v = A.mean(A.band(mean, freqs, band)), A.mean(A.band(variance, freqs, band))
    return F.when(m < 1e-10, F.lit(1.0)).otherwise(F.lit(1.0) / (F.lit(1.0) + F.sqrt(v) / (m + F.lit(1e-10))))


def harmonic_rms(mag: Column, stability: Column, freqs, band) -> Column:
    return A.rms(A.band(A.harmonic(mag, stability), freqs, band))
