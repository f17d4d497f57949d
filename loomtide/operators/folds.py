"""Step functions of everything that remembers: smoothing, detectors, states."""

from __future__ import annotations

import math
from collections import deque

import numpy as np

from loomtide.operators.scan import Fold
from loomtide.schema import FRAME_RATE, HOP, SAMPLE_RATE, alpha_for_seconds, frames_for_beats


class Ema(Fold):
    """y = a y + (1 - a) x from a start value; a null x leaves y as it is."""

    out = "y double"

    def __init__(self, alpha: float, first: float = 0.0):
        self.alpha, self.first = alpha, first

    def start(self):
        return self.first

    def step(self, y, row):
        if row[0] is not None:
            y = self.alpha * y + (1 - self.alpha) * row[0]
        return y, (y,)


class Emas(Fold):
    """Several averages of one value, from 0 each, side by side in one fold."""

    def __init__(self, **alphas: float):
        self.alphas = tuple(alphas.values())
        self.out = ", ".join(f"{name} double" for name in alphas)

    def start(self):
        return (0.0,) * len(self.alphas)

    def step(self, state, row):
        if row[0] is not None:
            state = tuple(a * y + (1 - a) * row[0] for a, y in zip(self.alphas, state))
        return state, state


class Envelope(Fold):
    """An average that rises with one factor and falls with another."""

    out = "y double"

    def __init__(self, attack: float, release: float):
        self.attack, self.release = attack, release

    def start(self):
        return 0.0

    def step(self, y, row):
        x = row[0]
        if x is not None:
            a = self.attack if x > y else self.release
            y = a * y + (1 - a) * x
        return y, (y,)


class Refractory(Fold):
    """Greedy selection: a candidate counts if cooldown frames have passed.

    Rows are (frame, is candidate); ``last`` starts at 0 where frames count
    from 1, so the first cooldown - 1 frames never count.
    """

    out = "fired boolean"

    def __init__(self, cooldown: int, last: int = 0):
        self.cooldown, self.last = cooldown, last

    def start(self):
        return self.last

    def step(self, last, row):
        frame, candidate = row
        fired = bool(candidate) and frame - last >= self.cooldown
        return (frame if fired else last), (fired,)


class Agc(Fold):
    """Slow level and gain of a hop from its (size, RMS of what isn't gated)."""

    out = "slow_rms double, gain double"

    def __init__(self, target: float = 0.1, floor: float = 0.001, seconds: float = 120.0, rate: float = SAMPLE_RATE, first: float | None = None):
        self.target, self.floor, self.seconds, self.rate = target, floor, seconds, rate
        self.first = target if first is None else first

    def start(self):
        return self.first

    def step(self, slow, row):
        size, rms = row
        if rms is not None and rms > self.floor:
            a = 1.0 - math.exp(-(size / self.rate) / self.seconds)
            slow = (1.0 - a) * slow + a * rms
        return slow, (slow, self.target / max(slow, self.floor))


class Deadband(Fold):
    """Emits a value when it is over width from the one emitted last."""

    out = "sent double"

    def __init__(self, width: float = 1.0, first: float = 0.0):
        self.width, self.first = width, first

    def start(self):
        return self.first

    def step(self, last, row):
        if row[0] is None or abs(row[0] - last) <= self.width:
            return last, None
        return row[0], (row[0],)


class Variability(Fold):
    """Per-bin mean and variance with exponential memory, and stability from them."""

    out = "mean array<double>, variance array<double>, stability array<double>"

    def __init__(self, alpha: float):
        self.alpha = alpha

    def start(self):
        return None

    def step(self, state, row):
        m = np.asarray(row[0], np.float64)
        mean, var = state if state is not None and len(state[0]) == len(m) else (np.zeros(len(m)), np.zeros(len(m)))
        gap = m - mean
        mean = self.alpha * mean + (1 - self.alpha) * m
        var = self.alpha * var + (1 - self.alpha) * gap * (m - mean)
        return (mean, var), (mean.tolist(), var.tolist(), (1.0 / (1.0 + np.sqrt(var) / (mean + 1e-10))).tolist())


class Shape(Fold):
    """Likeness of each bin's surroundings to their own slow average."""

    out = "stability array<double>"

    def __init__(self, alpha: float = 0.95, kernel: int = 7, steepness: float = 40.0, centre: float = 0.95):
        self.alpha, self.kernel, self.steepness, self.centre = alpha, kernel, steepness, centre

    def start(self):
        return None

    def _patches(self, x):
        return np.lib.stride_tricks.sliding_window_view(np.pad(x, self.kernel // 2, mode="reflect"), self.kernel)

    def step(self, slow, row):
        m = np.asarray(row[0], np.float64)
        if slow is None or len(slow) != len(m):
            return m, ([0.5] * len(m),)
        a, b = self._patches(m), self._patches(slow)
        na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
        like = np.clip((a * b).sum(1) / (na * nb + 1e-10), 0.0, 1.0)
        out = 1.0 / (1.0 + np.exp(-self.steepness * (like - self.centre)))
        out[(na < 1e-8) & (nb < 1e-8)] = 1.0
        return self.alpha * slow + (1 - self.alpha) * m, (out.tolist(),)


class ComplexDifference(Fold):
    """Onset flux from magnitude and phase: (magnitude, phase) -> what exceeds
    the slow mean of the distance to the predicted frame. Three frames warm up."""

    out = "flux array<double>"

    def __init__(self, rate: float = 0.05):
        self.rate = rate

    def start(self):
        return None, None, None, None

    def step(self, state, row):
        m, p = np.asarray(row[0], np.float64), np.asarray(row[1], np.float64)
        m1, p1, p2, slow = state
        if m1 is not None and len(m1) != len(m):
            m1 = p1 = p2 = slow = None
        flux = np.zeros(len(m))
        if p2 is not None:
            gap = p - 2 * p1 + p2
            gap -= 2 * np.pi * np.floor((gap + np.pi) / (2 * np.pi))
            raw = np.sqrt(np.maximum(m - m1, 0) ** 2 + (m * np.sin(gap)) ** 2)
            slow = raw if slow is None else slow + self.rate * (raw - slow)
            flux = np.maximum(raw - slow, 0)
        return (m, p, p1, slow), (flux.tolist(),)


class Novelty(Fold):
    """Distance of a spectrum's shape to its slow average: (magnitude, alpha)."""

    out = "novelty double"

    def __init__(self, alpha: float):
        self.alpha = alpha

    def start(self):
        return None, 0.0

    def step(self, state, row):
        shape, y = state
        m = np.asarray(row[0], np.float64)
        a = self.alpha if len(row) < 2 or row[1] is None else row[1]
        size = math.sqrt(float((m * m).sum()))
        if size > 1e-10:
            x = m / size
            if shape is None or len(shape) != len(x):
                shape = x
            else:
                y = a * y + (1 - a) * min(1.0, max(0.0, 1.0 - float((shape * x).sum())))
                moved = a * shape + (1 - a) * x
                size = math.sqrt(float((moved * moved).sum()))
                shape = moved / size if size > 1e-10 else x
        return (shape, y), (y,)


class Energy(Fold):
    """Band levels and envelopes: rows are (rms, harmonic rms) of a band."""

    out = "rms double, slow_rms double, harmonic_rms double, slow_harmonic_rms double"

    def __init__(self, seconds: float = 0.1, attack: float = 2.0, release: float = 0.5):
        self.alpha = alpha_for_seconds(seconds)
        self.attack, self.release = alpha_for_seconds(attack), alpha_for_seconds(release)

    def start(self):
        return 0.0, 0.0, 0.0, 0.0

    def _slow(self, y, x):
        a = self.attack if x > y else self.release
        return a * y + (1 - a) * x

    def step(self, state, row):
        r, sr, h, sh = state
        r = self.alpha * r + (1 - self.alpha) * row[0]
        h = self.alpha * h + (1 - self.alpha) * row[1]
        state = r, self._slow(sr, r), h, self._slow(sh, h)
        return state, state


class Centroid(Fold):
    """Everything that follows the centroid: rows are (magnitude, stability).

    Silent frames (weighted sum of 1e-10 or less) leave all as it is; the
    distance to the frame before then stays what it was.
    """

    out = "centroid double, centroid_delta double, centroid_rms double, harmonic_centroid_rms double, slow_harmonic_centroid_rms double, section_change double"

    def __init__(self, freqs, weights, seconds: float = 0.1, attack: float = 2.0, release: float = 0.5, fast: float = 2.0, slow: float = 15.0, reference: float = 1024.0):
        self.freqs, self.weights = np.asarray(freqs), np.asarray(weights)
        self.alpha, self.attack, self.release = alpha_for_seconds(seconds), alpha_for_seconds(attack), alpha_for_seconds(release)
        self.fast, self.slow, self.reference = alpha_for_seconds(fast), alpha_for_seconds(slow), reference

    def start(self):
        return 1000.0, 1000.0, 0.0, 0.0, 0.0, (0.5, 0.5, 0.0, 0.0)

    def step(self, state, row):
        c, before, level, harmonic, slow_harmonic, (cf, cs, ef, es) = state
        m, stable = np.asarray(row[0], np.float64), np.asarray(row[1], np.float64)
        weighted = m * self.weights
        mass = float(weighted.sum())
        if mass > 1e-10:
            a = self.alpha
            before, c = c, a * c + (1 - a) * float((self.freqs * weighted).sum() / mass)
            place = (math.log2(max(c, 20.0)) - math.log2(20.0)) / math.log2(1000.0)
            loud = mass / self.reference
            cf, cs = self.fast * cf + (1 - self.fast) * place, self.slow * cs + (1 - self.slow) * place
            ef, es = self.fast * ef + (1 - self.fast) * loud, self.slow * es + (1 - self.slow) * loud
            near = (self.freqs >= c / 2) & (self.freqs <= c * 2)
            if near.any():
                level = a * level + (1 - a) * math.sqrt(float((m[near] ** 2).mean()))
                raw = math.sqrt(float(((m * stable)[near] ** 2).mean()))
                harmonic = a * harmonic + (1 - a) * raw
                way = self.attack if raw > slow_harmonic else self.release
                slow_harmonic = way * slow_harmonic + (1 - way) * raw
        state = c, before, level, harmonic, slow_harmonic, (cf, cs, ef, es)
        return state, (c, abs(c - before), level, harmonic, slow_harmonic, math.hypot(cf - cs, ef - es))


class TempoState(Fold):
    """Smooths the estimates at anchor frames: (raw bpm or null, confidence, peak kept).

    A raw bpm of null is silence and changes nothing.
    """

    out = "bpm double, confidence double, effective_bpm double, bpm_delta double"

    def __init__(self, smooth: float = 0.8, first: float = 0.15, confident: float = 0.5, default: float = 120.0):
        self.smooth, self.first, self.confident, self.default = smooth, first, confident, default

    def start(self):
        return {"bpm": 0.0, "conf": 0.0, "has": False, "recent": (), "temporal": 0.0, "last": self.default, "fast": 0.0, "slow": 0.0}

    def hint(self, state, bpm):
        """A tempo told from outside, if it is one of 60 to 400."""
        if 60 <= bpm <= 400:
            state = state | {"bpm": bpm, "last": bpm, "conf": 0.5, "has": True, "fast": bpm, "slow": bpm}
        return state

    def step(self, state, row):
        raw, conf = row
        s = dict(state)
        if raw is not None and (s["has"] or conf >= self.first):
            if not s["has"]:
                s["bpm"], s["has"] = raw, True
            else:
                ratio = raw / s["bpm"] if s["bpm"] > 0 else 1.0
                if 0.45 < ratio < 0.55 or 1.9 < ratio < 2.1:
                    if conf > s["conf"] * 1.5:
                        s["bpm"] = raw
                else:
                    s["bpm"] = self.smooth * s["bpm"] + (1 - self.smooth) * raw
            if conf >= 0.3:
                s["recent"] = (*s["recent"], raw)[-10:]
            if len(s["recent"]) >= 3:
                n = len(s["recent"])
                mean = sum(s["recent"]) / n
                spread = math.sqrt(sum((x - mean) ** 2 for x in s["recent"]) / n) / mean if mean > 0 else 0.1
                s["temporal"] = min(1.0, max(0.0, 1.0 - 10 * spread))
            s["conf"] = max(conf, min(s["temporal"], conf * 2.5))
            if s["conf"] >= self.confident:
                s["last"] = s["bpm"]
            s["fast"] = 0.3 * s["fast"] + 0.7 * s["bpm"]
            s["slow"] = 0.85 * s["slow"] + 0.15 * s["bpm"]
        shown = s["last"] * (1 - s["conf"]) + s["bpm"] * s["conf"] if s["has"] else s["last"]
        return s, (s["bpm"], s["conf"], shown, s["fast"] - s["slow"])


class ParticleTempo(Fold):
    """Smooths the particle filter's readings: (bpm, confidence)."""

    out = "bpm double, bpm_delta double, saturated boolean"

    def __init__(self, seconds: float = 2.0, delta_seconds: float = 5.0, default: float = 120.0, least: float = 0.05, hop: float = HOP / SAMPLE_RATE):
        self.b, self.d, self.default, self.least, self.hop = hop / seconds, hop / delta_seconds, default, least, hop

    def start(self):
        return self.default, 0.0, 0

    def step(self, state, row):
        bpm, delta, railed = state
        raw, conf = row
        if raw is not None and conf is not None:
            if conf < self.least:
                delta = (1 - self.d) * delta
            else:
                railed = min(railed + 1, 100) if raw <= 55.5 or raw >= 214.5 else max(0, railed - 1)
                was, bpm = bpm, (1 - self.b) * bpm + self.b * raw
                delta = (1 - self.d) * delta + self.d * (bpm - was) / self.hop
        return (bpm, delta, railed), (bpm, delta, railed > 30)


class Mode(Fold):
    """idle, energy or beat from (novelty, loudest band rms, tempo confidence)."""

    out = "mode string"

    def __init__(self, enter: int = 90, leave: int = 900, idle: int = 1800, speech: float = 0.13, music: float = 0.10, sure: float = 0.7, silent: float = 1e-4):
        self.enter, self.leave, self.idle = enter, leave, idle
        self.speech, self.music, self.sure, self.silent = speech, music, sure, silent

    def start(self):
        return "idle", 0.0, 0, 0, 0

    def step(self, state, row):
        mode, y, musical, other, quiet = state
        novelty, rms, conf = row
        y = 0.95 * y + (1 - 0.95) * novelty
        silent = rms < self.silent
        if mode == "beat":
            music = y < self.speech or conf > self.sure
        else:
            music = y < self.music or (y < self.speech and conf > self.sure)
        quiet = quiet + 1 if silent else 0
        musical = musical + 1 if music and not silent else 0
        other = 0 if music and not silent else other + 1
        if mode == "idle":
            mode = mode if silent else "beat" if music else "energy"
        elif mode == "energy":
            mode = "beat" if musical >= self.enter else "idle" if quiet >= self.idle else mode
        elif quiet >= self.idle or (other >= self.leave and silent):
            mode = "idle"
        elif other >= self.leave:
            mode = "energy"
        return (mode, y, musical, other, quiet), (mode,)


class Break(Fold):
    """A level that drops out: (level, is a low onset, bpm, drifting)."""

    out = "breaking boolean, intensity double"

    def __init__(self, ratio: float = 0.15, beats: float = 2.0, lows: int = 8, cooldown: float = 15.0, warmup: int = 300, dt: float = 1 / FRAME_RATE):
        self.ratio, self.beats, self.lows, self.cooldown, self.warmup, self.dt = ratio, beats, lows, cooldown, warmup, dt

    def start(self):
        return 0.0, 0, 0.0, 0, 0, False, 0

    def step(self, state, row):
        mean, seen, wait, quiet, lows, on, since = state
        level, low, bpm, drifting = row
        mean = 0.97 * mean + 0.03 * level
        seen += 1
        if wait > 0:
            wait -= self.dt
        if seen >= self.warmup:
            dropped = level < mean * self.ratio and mean > 1e-6
            lows += bool(low)
            if low or not dropped:
                if on:
                    wait, on = self.cooldown, False
                quiet = 0
            else:
                quiet += 1
            if not on and quiet >= frames_for_beats(bpm, self.beats) and lows > self.lows and wait <= 0 and not drifting:
                on, since = True, quiet
        return (mean, seen, wait, quiet, lows, on, since), (on, min(1.0, (quiet - since) / 60.0) if on else 0.0)


class AdaptiveBand(Fold):
    """Weights of a band that follow its flux: rows are (flux).

    Every ``every`` frames the weights become a mixture of the peak-scaled slow
    flux and the default ones; a large move makes the memory shorter a while.
    """

    out = "weights array<double>, band_flux double"

    def __init__(self, default, allowed, alpha: float = 0.98, fast: float = 0.90, fast_frames: int = 60, every: int = 30, anchor: float = 0.3, jump: float = 0.3):
        self.default, self.allowed = np.asarray(default, np.float64), np.asarray(allowed, np.float64)
        self.alpha, self.fast, self.fast_frames, self.every, self.anchor, self.jump = alpha, fast, fast_frames, every, anchor, jump

    def start(self):
        return np.zeros(len(self.default)), self.default, 0, 0

    def step(self, state, row):
        slow, weights, n, hurry = state
        flux = np.asarray(row[0], np.float64)
        a = self.fast if hurry else self.alpha
        slow = a * slow + (1 - a) * flux * self.allowed
        hurry = max(0, hurry - 1)
        n += 1
        if n == self.every:
            n, was = 0, weights
            peak = float((slow * self.allowed).max())
            if peak > 1e-7:
                weights = (1 - self.anchor) * slow * self.allowed / peak + self.anchor * self.default
                weights = weights / weights.sum() if weights.sum() > 0 else weights
            else:
                weights = self.default
            if np.abs(weights - was).sum() > self.jump:
                hurry = self.fast_frames
        mass = weights.sum()
        return (slow, weights, n, hurry), (weights.tolist(), float((flux * weights).sum() / mass) if mass > 0 else 0.0)


class SpringBand(Fold):
    """A band's centre, pulled to its default and to where the flux is.

    Rows are (flux, stability, the neighbours' centres); the centre moves
    every ``every`` frames and stays half a width inside the allowed range.
    """

    out = "centre double"

    def __init__(self, freqs, lo: float, hi: float, allowed: tuple[float, float], every: int = 9, anchor: float = 0.3, pull: float = 0.5, push: float = 0.1, alpha: float = 0.95):
        self.freqs, self.centre, self.half = np.asarray(freqs), (lo + hi) / 2, (hi - lo) / 2
        self.allowed, self.every, self.anchor, self.pull, self.push, self.alpha = allowed, every, anchor, pull, push, alpha
        self.inside = (self.freqs >= allowed[0]) & (self.freqs < allowed[1])

    def start(self):
        return self.centre, np.zeros(len(self.freqs)), 0

    def step(self, state, row):
        centre, slow, n = state
        n += 1
        if n == self.every:
            n = 0
            flux, stable = np.asarray(row[0], np.float64), np.asarray(row[1], np.float64)
            slow = self.alpha * slow + (1 - self.alpha) * flux * (1 - stable)
            own = slow * self.inside
            mass = float(own.sum())
            target = float((self.freqs * own).sum()) / mass if mass >= 1e-10 else self.centre
            force = self.anchor * (self.centre - centre) + self.pull * (target - centre)
            for other in row[2] or ():
                gap = centre - other
                force += self.push / (gap if abs(gap) >= 1e-6 else 1.0)
            low, high = self.allowed[0] + self.half, self.allowed[1] - self.half
            # A band wider than what is allowed has its centre at the lower bound.
            centre = max(low, min(high, centre + force))
        return (centre, slow, n), (centre,)


class BeatPeaks(Fold):
    """Peaks of (beat, downbeat) activations, told a frame late."""

    out = "kind string, energy double"

    def __init__(self, threshold: float = 0.3, downbeat: float = 0.15, distance: int = 3):
        self.threshold, self.downbeat, self.distance = threshold, downbeat, distance

    def start(self):
        return (), 1 << 30, 1 << 30

    def step(self, state, row):
        last, beat, down = state
        last = (*last, row)[-3:]
        beat, down = beat + 1, down + 1
        out = None
        if len(last) == 3:
            (b0, _), (b, d), (b1, _) = last
            if b >= self.threshold and b > b0 and b >= b1 and beat >= self.distance:
                beat = 0
                if 2 * d > b and d >= self.downbeat and down >= self.distance:
                    down, out = 0, ("low", b)
                else:
                    out = ("mid", b)
        return (last, beat, down), out


class HeadPeaks(Fold):
    """Peaks of (downbeat, beat, onset) activations within ``around`` frames on
    both sides, the most specific head first; told ``around`` frames late."""

    out = "kind string, energy double"

    def __init__(self, thresholds=(0.15, 0.30, 0.30), around: int = 9, distance: int = 9):
        self.thresholds, self.around, self.distance = thresholds, around, distance

    def start(self):
        return deque(maxlen=2 * self.around + 1), 1 << 30

    def step(self, state, row):
        seen, since = state
        seen = deque(seen, seen.maxlen)
        seen.append(row)
        since += 1
        out = None
        if len(seen) == seen.maxlen:
            centre = seen[self.around]
            head = next((h for h in range(3) if centre[h] >= self.thresholds[h]), None)
            if head is not None and since >= self.distance and all(centre[head] >= r[head] for r in seen):
                out, since = (("low", "mid", "high")[head], 1.0), 0
        return (seen, since), out

