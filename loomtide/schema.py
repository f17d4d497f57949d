"""Tables, bands and tuning values of the signal engine."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Fixed values that results depend on.
SAMPLE_RATE = 48000
HOP = 512
FFT_SIZE = 2048
HISTORY = 43
FRAME_RATE = SAMPLE_RATE / HOP


@dataclass(frozen=True)
class Band:
    """A half-open frequency range; allowed bounds where it may move."""

    name: str
    kind: str  # 'energy' or 'detection'
    lo: float
    hi: float
    allowed_lo: float | None = None
    allowed_hi: float | None = None

    def __post_init__(self):
        if not self.lo < self.hi:
            raise ValueError(f"band {self.name}: {self.lo} isn't below {self.hi}")


BANDS = (
    Band("subbass", "energy", 20.0, 200.0),
    Band("low", "detection", 30.0, 200.0, 25.0, 150.0),
    Band("mid", "detection", 200.0, 1000.0, 150.0, 2000.0),
    Band("high", "detection", 1000.0, 24000.0, 800.0, 24000.0),
)


def check_bands(bands: tuple[Band, ...]) -> tuple[Band, ...]:
    """Names are unique, and detection bands leave no gap between them."""
    if len({b.name for b in bands}) < len(bands):
        raise ValueError("band names repeat")
    row = sorted((b for b in bands if b.kind == "detection"), key=lambda b: b.lo)
    for a, b in zip(row, row[1:]):
        if b.lo > a.hi:
            raise ValueError(f"gap between {a.name} and {b.name}")
    return bands


def alpha_for(frames: float) -> float:
    """Smoothing factor that forgets 95 % within so many frames."""
    return 0.05 ** (1.0 / max(1.0, frames))


def alpha_for_seconds(seconds: float) -> float:
    return alpha_for(seconds * FRAME_RATE)


def frames_for_beats(bpm: float, beats: float) -> int:
    """Half-even rounded frames of so many beats, one at least."""
    return max(1, round(beats * 60.0 / (bpm if bpm > 0 else 120.0) * FRAME_RATE))


@dataclass(frozen=True)
class Settings:
    """Tuning values; a file may override them (sources.config.load)."""

    agc: dict = field(default_factory=lambda: {"target": 0.1, "floor": 0.001, "seconds": 120.0, "save_seconds": 30.0})
    energy: dict = field(default_factory=lambda: {"rms": 0.1, "centroid": 0.1, "novelty_beats": 0.5, "attack": 2.0, "release": 0.5, "method": "shape"})
    section: dict = field(default_factory=lambda: {"fast": 2.0, "slow": 15.0, "centroid": 1.0, "energy": 1.0})
    density: dict = field(default_factory=lambda: {"window": 1.0, "delta": 2.0, "fast": 0.1, "slow": 2.0})
    tempo: dict = field(default_factory=lambda: {"min_bpm": 60.0, "max_bpm": 400.0, "default": 120.0, "seconds": 8.0, "every": 0.5, "centre": 110.0, "width": 1.4, "smooth": 0.8, "first": 0.15, "confident": 0.5})
    breaks: dict = field(default_factory=lambda: {"beats": 2.0, "bass_beats": 1.5, "ratio": 0.15, "bass_ratio": 0.10, "lows": 8, "cooldown": 15.0})
    detection: dict = field(default_factory=lambda: {"threshold": 1.5, "stability": 1.0, "sharpness": 3.0, "min_flux": 1e-7, "percentile": 99.0, "cooldown_beats": 0.25})
    stability: dict = field(default_factory=lambda: {"method": "median", "time_beats": 1.0, "kernel": 15, "ema_beats": 0.5, "slow": 2.0, "shape_alpha": 0.95, "shape_kernel": 7})


FRAME = T.StructType([
    T.StructField("track", T.LongType()), T.StructField("frame", T.LongType()),
    T.StructField("magnitude", T.ArrayType(T.DoubleType())), T.StructField("phase", T.ArrayType(T.DoubleType()), True),
    T.StructField("flux", T.ArrayType(T.DoubleType())), T.StructField("zcr", T.DoubleType()),
])
BAND_STATE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("rms", "harmonic_rms", "slow_rms", "slow_harmonic_rms", "onset_density", "density_delta")])
EVENT = T.StructType([
    T.StructField("track", T.LongType()), T.StructField("frame", T.LongType()), T.StructField("ts", T.DoubleType()),
    T.StructField("kind", T.StringType()), T.StructField("energy", T.DoubleType()),
])
SNAPSHOT = T.StructType([
    T.StructField("track", T.LongType()), T.StructField("frame", T.LongType()),
    T.StructField("spectrum", T.ArrayType(T.DoubleType())), T.StructField("stability", T.ArrayType(T.DoubleType())), T.StructField("sustained", T.ArrayType(T.DoubleType())),
    *[T.StructField(n, T.DoubleType()) for n in ("centroid", "centroid_delta", "centroid_rms", "centroid_harmonic_rms", "slow_centroid_harmonic_rms", "percussiveness", "spectral_novelty", "section_change", "bpm", "effective_bpm", "tempo_confidence")],
    T.StructField("tempo_saturated", T.BooleanType()), T.StructField("mode", T.StringType()), T.StructField("break_intensity", T.DoubleType()),
    T.StructField("bands", T.MapType(T.StringType(), BAND_STATE)), T.StructField("events", T.ArrayType(EVENT)),
])
