"""The whole engine as one fold: a hop of samples in, a snapshot out.

The operators of this library can be planned one by one, with windows where
they are bounded; then events use a fixed tempo. Here everything of a track is
carried along hop by hop, so that the tempo found so far sets how soon a next
onset may follow, as when listening live. It runs in batch with scan(), and on
a stream with streaming.folds.scan_stream(), with one shuffle for all of it.
"""

from __future__ import annotations

import math

import numpy as np

from loomtide.functions.arrays import a_weights
from loomtide.operators.folds import Agc, Break, Centroid, ComplexDifference, Energy, Mode, Novelty, TempoState
from loomtide.operators.frames import HalfBand
from loomtide.operators.models import ConstantQ, SlidingCq
from loomtide.operators.scan import Fold
from loomtide.operators.tempo import Autocorrelation
from loomtide.schema import BANDS, HISTORY, HOP, SAMPLE_RATE, Band, alpha_for, alpha_for_seconds, frames_for_beats


class MedianStability(Fold):
    """Median over the last frames against the median over neighbours: (magnitude)."""

    out = "stability array<double>, sustained array<double>"

    def __init__(self, window: int = frames_for_beats(60.0, 1.0), kernel: int = 15):
        self.window, self.kernel = window, kernel

    def start(self):
        return ()

    def step(self, seen, row):
        m = np.asarray(row[0], np.float64)
        if seen and len(seen[0]) != len(m):
            seen = ()
        seen = (*seen, m)[-self.window :]
        held = np.median(np.array(seen), axis=0)
        near = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(m, self.kernel // 2, mode="reflect"), self.kernel), axis=1)
        both = held + near
        share = np.where(both > 1e-10, held / (both + 1e-10), 1.0)
        return seen, (share.tolist(), held.tolist())


class PercentileDetector(Fold):
    """Onsets of one band: (flux, tempo). The tempo sets the refractory period."""

    out = "energy double"

    def __init__(self, percent: float = 99.0, history: int = HISTORY, beats: float = 0.25, min_flux: float = 1e-7):
        self.percent, self.history, self.beats, self.min_flux = percent, history, beats, min_flux

    def start(self):
        return (), 0, 0

    def step(self, state, row):
        seen, n, last = state
        x, bpm = row
        n += 1
        out = None
        if len(seen) >= 10 and x > self.min_flux and n - last >= frames_for_beats(bpm, self.beats):
            thr = float(np.percentile(seen, self.percent))
            if thr < self.min_flux:
                out = 1.0 if x > self.min_flux * 1000 else None
            elif x > thr:
                out = min(1.0, (x - thr) / (thr + 1e-10))
            last = n if out is not None else last
        return ((*seen, x)[-self.history :], n, last), None if out is None else (out,)


class Density(Fold):
    """Onsets a second of one band, smoothed: (seconds, whether there is an onset)."""

    out = "fast double, slow double, delta double"

    def __init__(self, window: float = 1.0, delta: float = 2.0, fast: float = 0.1, slow: float = 2.0):
        self.window, self.delta, self.a, self.b = window, delta, alpha_for_seconds(fast), alpha_for_seconds(slow)

    def start(self):
        return (), 0.0, 0.0, ()

    def step(self, state, row):
        times, fast, slow, past = state
        now, onset = row
        times = tuple(t for t in ((*times, now) if onset else times) if t >= now - self.window)
        raw = len(times) / self.window
        fast, slow = self.a * fast + (1 - self.a) * raw, self.b * slow + (1 - self.b) * raw
        past = tuple(p for p in (*past, (now, fast)) if p[0] >= now - self.delta)
        return (times, fast, slow, past), (fast, slow, fast - past[0][1] if len(past) > 1 else 0.0)


_SCALARS = (
    "centroid", "centroid_delta", "centroid_rms", "centroid_harmonic_rms", "slow_centroid_harmonic_rms", "section_change", "percussiveness", "spectral_novelty",
    "bpm", "tempo_confidence", "effective_bpm", "bpm_delta", "break_intensity", "gain",
)


class Engine(Fold):
    """(pcm) -> a snapshot. A silent hop leaves everything as it is but the mode."""

    out = (
        ", ".join(f"{n} double" for n in _SCALARS)
        + ", mode string, spectrum array<double>, stability array<double>, sustained array<double>"
        + ", bands map<string, struct<rms: double, harmonic_rms: double, slow_rms: double, slow_harmonic_rms: double, onset_density: double, density_delta: double>>"
        + ", events array<struct<kind: string, energy: double>>"
    )

    def __init__(self, octaves: int = 9, per_octave: int = 12, hop: int = HOP, rate: float = SAMPLE_RATE, bands: tuple[Band, ...] = BANDS, percent: float = 99.0, floor: float = 0.001):
        if hop % (1 << (octaves - 1)):
            raise ValueError(f"{octaves} octaves need hops of a multiple of {1 << (octaves - 1)} samples")
        self.hop, self.rate, self.bands, self.floor = hop, rate, bands, floor
        cq = ConstantQ(rate, octaves, per_octave)
        freqs = np.array(cq.freqs)[cq.order]
        self.weights = np.array(a_weights(freqs))
        self.masks = {b.name: (freqs >= b.lo) & (freqs < b.hi) for b in bands}
        self.detection = [b.name for b in bands if b.kind == "detection"]
        self.folds = {
            "agc": Agc(floor=floor, rate=rate), "cq": SlidingCq(cq), "csd": ComplexDifference(), "stable": MedianStability(), "centroid": Centroid(freqs, self.weights),
            "novelty": Novelty(alpha_for(0.5 * frames_for_beats(120.0, 1.0))), "acf": Autocorrelation(hop / rate), "tempo": TempoState(), "mode": Mode(), "break": Break(dt=hop / rate),
            "bass": Break(ratio=0.10, beats=1.5, dt=hop / rate), **{f"half{k}": HalfBand() for k in range(1, octaves)}, **{f"level:{n}": Energy() for n in self.masks},
            **{f"onset:{n}": PercentileDetector(percent) for n in self.detection}, **{f"density:{n}": Density() for n in self.detection},
        }
        self.octaves = octaves

    def start(self):
        idle = dict.fromkeys(_SCALARS, 0.0) | {"percussiveness": 0.5, "bpm": 0.0, "effective_bpm": 120.0, "centroid": 1000.0, "gain": 1.0}
        return {"n": 0, "of": {k: f.start() for k, f in self.folds.items()}, "last": idle}

    def step(self, state, row):
        of, last = dict(state["of"]), dict(state["last"])

        def run(name, *args):
            of[name], told = self.folds[name].step(of[name], args)
            return told

        n = state["n"]
        now = n * self.hop / self.rate
        pcm = np.asarray(row[0], np.float64)
        pcm = np.where(np.abs(pcm) < self.floor, 0.0, pcm)
        loud = pcm[pcm != 0]
        level, last["gain"] = run("agc", len(pcm), math.sqrt(float((loud * loud).mean())) if len(loud) else None)
        if not len(loud):
            mode = run("mode", 0.0, 0.0, last["tempo_confidence"])[0]
            zeros = [0.0] * len(self.weights)
            quiet = last | {k: 0.0 for k in ("centroid_rms", "centroid_harmonic_rms", "slow_centroid_harmonic_rms", "spectral_novelty", "section_change", "break_intensity")} | {"percussiveness": 0.5}
            bands = {b: dict.fromkeys(("rms", "harmonic_rms", "slow_rms", "slow_harmonic_rms", "onset_density", "density_delta"), 0.0) for b in self.masks}
            return {"n": n + 1, "of": of, "last": last}, (*(quiet[k] for k in _SCALARS), mode, zeros, zeros, zeros, bands, [])
        rates = [(pcm * last["gain"]).tolist()]
        for k in range(1, self.octaves):
            rates.append(run(f"half{k}", rates[-1])[0])
        magnitude, phase, _ = run("cq", *rates)
        flux = np.array(run("csd", magnitude, phase)[0])
        logs = np.log1p(1000.0 * np.array(magnitude)) / math.log1p(1000.0)
        stability, sustained = run("stable", logs)
        events, density = [], {}
        for b in self.detection:
            mask = self.masks[b]
            told = run(f"onset:{b}", float(flux[mask].mean()) if mask.any() else 0.0, last["effective_bpm"])
            if told:
                events.append({"kind": b, "energy": told[0]})
            density[b] = run(f"density:{b}", now, told is not None)
        anchor = run("acf", float((flux * self.weights).sum()), sum(d[1] for d in density.values()))
        if anchor:
            last["bpm"], last["tempo_confidence"], last["effective_bpm"], last["bpm_delta"] = run("tempo", *anchor)
        steady = np.array(stability)
        bands = {}
        for b, mask in self.masks.items():
            m = logs[mask]
            rms = [math.sqrt(float((x * x).mean())) if len(x) else 0.0 for x in (m, m * steady[mask])]
            r, slow, h, slow_h = run(f"level:{b}", *rms)
            d = density.get(b, (0.0, 0.0, 0.0))
            bands[b] = {"rms": r, "harmonic_rms": h, "slow_rms": slow, "slow_harmonic_rms": slow_h, "onset_density": d[0], "density_delta": d[2]}
        last |= dict(zip(("centroid", "centroid_delta", "centroid_rms", "centroid_harmonic_rms", "slow_centroid_harmonic_rms", "section_change"), run("centroid", logs, steady)))
        last["spectral_novelty"] = last["percussiveness"] = run("novelty", logs)[0]
        mode = run("mode", last["spectral_novelty"], max(b["rms"] for b in bands.values()), last["tempo_confidence"])[0]
        last["break_intensity"] = 0.0
        if mode == "beat":
            low = any(e["kind"] == "low" for e in events)
            told = [run(name, x, low, last["effective_bpm"], False)[1] for name, x in (("break", last["centroid_rms"]), ("bass", bands.get("subbass", {"rms": 0.0})["rms"]))]
            last["break_intensity"] = max(told)
        return {"n": n + 1, "of": of, "last": last}, (*(last[k] for k in _SCALARS), mode, logs.tolist(), stability, sustained, bands, events)

    def restart(self, state):
        """A new song: tempo, bands and breaks begin again, in energy mode."""
        of = {k: f.start() if k not in ("agc", "cq", "mode") and not k.startswith("half") else state["of"][k] for k, f in self.folds.items()}
        of["mode"] = ("energy", *self.folds["mode"].start()[1:])
        return {"n": state["n"], "of": of, "last": self.start()["last"] | {"gain": state["last"]["gain"]}}

    def hint(self, state, bpm: float):
        """A tempo told from outside."""
        of = dict(state["of"])
        of["tempo"] = self.folds["tempo"].hint(of["tempo"], bpm)
        t = of["tempo"]
        shown = {"bpm": t["bpm"], "tempo_confidence": t["conf"], "effective_bpm": t["last"] * (1 - t["conf"]) + t["bpm"] * t["conf"]} if t["has"] else {}
        return state | {"of": of, "last": state["last"] | shown}

