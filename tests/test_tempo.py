"""Tempo figures that are known in closed form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtide.operators import tempo
from loomtide.operators.folds import TempoState
from loomtide.schema import alpha_for, frames_for_beats


def by_rule(stamps, window=6, limit=0.20):
    """Numpy's median and deviation of the last intervals between beats that don't go back."""
    kept = []
    for t, kind in stamps:
        if kind != "high" and (not kept or t >= max(kept)):
            kept.append(t)
    gaps = np.diff(kept)[-(window - 1) :]
    middle = np.median(gaps) if len(gaps) else 0
    steady = len(gaps) > 1 and gaps.mean() > 0 and gaps.std(ddof=1) / gaps.mean() <= limit
    return 60 / middle if middle > 0 else None, bool(steady)


def made_up(seed):
    """Beats about a tempo, some of them missed, late, or told out of order, and other onsets."""
    r = np.random.default_rng(seed)
    gap, t, out = r.uniform(0.25, 1.3), 0.0, []
    for _ in range(r.integers(1, 25)):
        t += gap * r.choice([1, 1, 1, 2]) * r.uniform(1 - 0.02 * seed, 1 + 0.02 * seed)
        out.append((t - (1.7 * gap if r.random() < 0.1 else 0), str(r.choice(["low", "mid"]))))
        out += [(t + gap * x, "high") for x in r.random(r.integers(0, 3))]
    return out


@pytest.mark.parametrize("seed", range(9))
def test_beat_rate_of_made_up_beats(spark, seed):
    stamps, window = made_up(seed), 3 + seed % 5
    rows = [(1, i, float(t), k) for i, (t, k) in enumerate(stamps)]
    out = tempo.beat_rate(spark.createDataFrame(rows, "track long, seq long, ts double, kind string"), window).orderBy("seq").collect()
    assert out
    for r in out:
        rate, steady = by_rule(stamps[: r["seq"] + 1], window)
        assert r["beat_rate"] == (pytest.approx(rate) if rate else None) and r["stable"] == steady
    with pytest.raises(ValueError):
        tempo.beat_rate(spark.createDataFrame(rows, "track long, seq long, ts double, kind string"), 2)


def chosen(tracker, rate):
    """What each way gives: the nearest octave is the one with the smallest gap."""
    gap = lambda x: abs(x - rate) / rate
    s = min(tempo.OCTAVES, key=lambda f: gap(tracker * f)) if tracker > 0 else 1.0
    return tracker if gap(tracker) <= 0.05 else rate, tracker * s, tracker * s if s in (0.5, 2.0) and gap(tracker * s) <= 0.05 else tracker


def test_reconciliation_about_the_edges(spark):
    """Trackers at each octave of a rate, a little within and beyond the tolerance."""
    pairs = [(rate * f * (1 + e), rate) for rate in (61.0, 97.0, 133.0, 202.0) for f in (1 / 3, 1 / 2, 1.0, 2.0, 3.0, 1.37) for e in (-0.051, -0.049, 0.0, 0.049, 0.051)] + [(0.0, 88.0)]
    df = spark.createDataFrame([(i, t, r, True) for i, (t, r) in enumerate(pairs)], "i long, t double, r double, s boolean")
    ways = ("override", "shift", "octave")
    rows = df.select("i", *[tempo.reconcile(F.col("t"), F.col("r"), F.col("s"), m).alias(m) for m in ways]).orderBy("i").collect()
    for row, (t, r) in zip(rows, pairs):
        assert [row[m]["bpm"] for m in ways] == pytest.approx(list(chosen(t, r))) and all(row[m]["trustable"] for m in ways)
    for x in df.select(tempo.reconcile(F.col("t"), F.col("r"), F.lit(False)).alias("x"), "t").collect():
        assert x["x"]["bpm"] == x["t"] and not x["x"]["trustable"]


def test_frames_and_factors():
    assert (frames_for_beats(120, 1), frames_for_beats(60, 1), frames_for_beats(120, 0.25), frames_for_beats(0, 1), frames_for_beats(9e9, 1)) == (47, 94, 12, 47, 1)
    assert alpha_for(47) ** 47 == pytest.approx(0.05)


@pytest.mark.parametrize("bpm,density", [(90.0, 0.0), (120.0, 0.0), (150.0, 14.0)])
def test_autocorrelation_hears_a_click_track(bpm, density):
    """At 150, the prior prefers 75; many onsets a second tell the octave."""
    fold = tempo.Autocorrelation()
    state, found = fold.start(), []
    every = 60.0 / bpm / tempo.HOP_SECONDS
    for n in range(1500):
        state, out = fold.step(state, (1.0 if int((n + 1) / every) > int(n / every) else 0.0, density))
        found += [out] if out else []
    assert found[-1][0] == pytest.approx(bpm, rel=0.03)
    assert found[-1][1] > 0.3


def test_hint_sets_the_state():
    fold = TempoState()
    assert fold.hint(fold.start(), 160.0)["bpm"] == 160.0
    assert fold.hint(fold.start(), 30.0) == fold.start()


def test_percival_and_pulse_train():
    fold = tempo.Percival()
    state, found = fold.start(), []
    every = 60.0 / 120.0 / tempo.HOP_SECONDS
    for n in range(1200):
        state, out = fold.step(state, (1.0 if int((n + 1) / every) > int(n / every) else 0.0,))
        found += [out] if out else []
    assert found[-1][0] == pytest.approx(120.0, rel=0.04)
    x = np.zeros(100)
    x[3::10] = 1
    assert tempo.pulse_train(x, 10)[2] == 3
    assert tempo.pulse_train(x, 1) == (0.0, 0.0, 0)
