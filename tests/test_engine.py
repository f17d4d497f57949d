"""Signal operators against numpy, and batch against stream."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtide.functions import arrays as A
from loomtide.operators import engine, evals, frames, models, onsets, stability
from loomtide.operators.folds import Agc, Break, Ema, Mode, Novelty
from loomtide.operators.scan import scan
from loomtide.plans import evals as plans
from loomtide.schema import BANDS, Band, check_bands
from loomtide.sources import feed, sinks
from loomtide.streaming.folds import event_density, scan_stream


def test_bands():
    assert check_bands(BANDS) == BANDS
    with pytest.raises(ValueError):
        Band("x", "energy", 5, 5)
    with pytest.raises(ValueError):
        check_bands((*BANDS, BANDS[0]))
    with pytest.raises(ValueError):
        check_bands((Band("a", "detection", 1, 2), Band("b", "detection", 3, 4)))
    assert A.a_weight(1000) == pytest.approx(1.0)
    assert A.a_weight(50) < 0.1 and A.a_weight(15000) < 1


def run(fold, rows):
    state, out = fold.start(), []
    for r in rows:
        state, told = fold.step(state, r)
        out.append(told)
    return out


def test_agc_settles_and_holds_in_silence():
    rms = 0.5 / math.sqrt(2)
    out = run(Agc(seconds=1.0), [(1024, rms)] * 235 + [(1024, None)] * 235)
    assert out[234][0] == pytest.approx(rms, abs=0.02) and out[234][1] < 1
    assert out[-1][0] == out[234][0]
    assert run(Agc(floor=0.01), [(1024, 0.005)] * 9)[-1][0] == 0.1


def test_mode_and_breaks_by_the_clock():
    out = [m for (m,) in run(Mode(), [(0.05, 0.1, 0.0)] * 10 + [(0.9, 0.1, 0.0)] * 1100 + [(0.0, 0.0, 0.0)] * 1900)]
    assert out[0] == "beat" and out[1000] == "energy" and out[-1] == "idle"
    loud = [(1.0, i % 20 == 0, 120.0, False) for i in range(600)]
    out = run(Break(), loud + [(0.0, False, 120.0, False)] * 170 + [(1.0, True, 120.0, False)])
    on = [b for b, _ in out]
    assert not any(on[:690]) and on[700] and not on[-1]
    assert out[-2][1] == 1.0


def test_novelty_is_zero_for_the_same_shape():
    assert run(Novelty(0.9), [([1.0, 2.0],), ([2.0, 4.0],), ([3.0, 6.0],)])[-1][0] == pytest.approx(0.0)
    assert run(Novelty(0.9), [([1.0, 0.0],), ([0.0, 1.0],)])[-1][0] == pytest.approx(0.1)


@pytest.mark.parametrize("n", [64, 108])
def test_stability_of_any_width(spark, n):
    r = np.random.default_rng(0)
    rows = [(1, f, r.random(n).tolist()) for f in range(1, 12)]
    df = spark.createDataFrame(rows, "track long, frame long, mag array<double>")
    got = {x["frame"]: x for x in stability.median(df, 5, 15).collect()}
    m = np.array([x[2] for x in rows])
    for f in range(1, 12):
        held = np.median(m[max(0, f - 5) : f], axis=0)
        near = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(m[f - 1], 7, mode="reflect"), 15), axis=1)
        assert np.allclose(got[f]["sustained"], held)
        assert np.allclose(got[f]["stability"], held / (held + near + 1e-10))
    for fast in ("median", "shape", "ema"):
        one = stability.composite(df, fast).first()
        assert len(one["stability"]) == len(one["slow_stability"]) == n
    assert [x["epoch"] for x in stability.epochs(df.unionByName(df.select("track", (F.col("frame") + 50).alias("frame"), F.slice("mag", 1, 9).alias("mag")))).orderBy("frame").collect()][-1] == 1


def test_silence_gives_no_onsets(spark):
    quiet = spark.createDataFrame([(1, f, 0.0) for f in range(1, 80)], "track long, frame long, x double")
    assert onsets.percentile(quiet).count() == onsets.flux(quiet).count() == 0
    hit = quiet.withColumn("x", F.when(F.col("frame") == 50, 0.5).otherwise(0.0))
    assert [r["frame"] for r in onsets.percentile(hit).collect()] == [50]
    assert onsets.detector("nonsense") is onsets.percentile


def test_refractory_is_greedy(spark):
    df = spark.createDataFrame([(1, f, 1.0, True) for f in (5, 12, 20, 24, 40)], "track long, frame long, x double, candidate boolean")
    assert sorted(r["frame"] for r in onsets._refractory(df, ["track"], 12).collect()) == [12, 24, 40]


def test_constant_q_peaks_at_the_tone():
    cq = models.ConstantQ(octaves=1)
    f = cq.freqs[5]
    t = np.arange(6000) / 48000
    z = np.abs(cq.bins([np.sin(2 * np.pi * f * t)]))
    assert int(z.argmax()) == 5
    assert sorted(cq.freqs)[0] == pytest.approx(8372.018, abs=0.01)


def test_resampler_keeps_a_low_tone():
    run_ = frames.resampler()
    x = np.sin(2 * np.pi * 500 * np.arange(512) / 48000)
    y = run_(x)
    assert len(y) == 236
    want = np.sin(2 * np.pi * 500 * np.arange(236) / 22050)
    assert np.abs(y - want)[30:-30].max() < 0.02


def test_half_band_passes_low_and_stops_high():
    fold = frames.HalfBand()
    power = []
    for f in (0.05, 0.4):
        x = np.sin(2 * np.pi * f * np.arange(4096))
        power.append(np.mean(np.square(fold.step(fold.start(), (x.tolist(),))[1][0][200:])))
    assert power[0] == pytest.approx(0.5, rel=0.01) and power[1] < 1e-6
    # A stream of hops gives what one long hop gives.
    state, parts = fold.start(), []
    for a in range(0, 4096, 512):
        state, (y,) = fold.step(state, (x[a : a + 512].tolist(),))
        parts += y
    assert np.allclose(parts, fold.step(fold.start(), (x.tolist(),))[1][0])


def test_models_match_plain_numpy(spark, sf):
    rows = plans.rnn_input(spark, sf).where("track = 3").orderBy("frame").collect()
    layout, flat = plans.DEEP, plans.seeded(plans.DEEP, 2)
    fold = models.Recurrent(flat, layout)
    want = []
    for i, r in enumerate(rows):
        state = fold.start() if i % 16 == 0 else state
        state, (logits,) = fold.step(state, (r["features"],))
        want.append(logits)
    got = plans.rnn_multidepth_logits(spark, sf).where("track = 3").orderBy("frame").collect()
    assert np.allclose([[g[f"logit_{k}"] for k in range(3)] for g in got], want, atol=1e-6)
    assert (models.KNOWN[18801].size(), models.KNOWN[30451].size()) == (18801, 30451)
    with pytest.raises(ValueError):
        layout.unpack(flat[:-1])
    with pytest.raises(ValueError):
        models.layout_of(7)


def test_gru_step_of_zeros_halves_the_state():
    h = models.gru(np.ones(2), np.ones(3), np.zeros((3, 2, 3)), np.zeros((3, 3, 3)), np.zeros((6, 3)))
    assert np.allclose(h, 0.5)


def test_particles_never_leak():
    fold = models.Particles(300)
    out = run(fold, [(0.9,)] * 300)
    assert all(n == 300 for _, _, n, _ in out)
    r = np.random.default_rng(0)
    moved = fold.hint(np.zeros(300, np.int64), 120.0, r)
    assert len(moved) == 300 and (moved > 0).sum() == 150


def test_resampling_counts(spark):
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate([0.5, 0.0, 0.25, 0.25])] + [(2, 0, 0.0), (2, 1, 0.0)], "track long, frame long, weight double")
    out = models.resample(df, 8, 0.5)
    n = {(r["track"], r["frame"]): r["count"] for r in out.groupBy("track", "frame").count().collect()}
    assert n == {(1, 0): 4, (1, 2): 2, (1, 3): 2, (2, 0): 4, (2, 1): 4}


def test_published_record_round_trips():
    snap = {"spectrum": [float(i) for i in range(108)], "bpm": 120.5, "mode": "beat", "tempo_saturated": True, "bands": {"low": {"rms": 0.5}, "mid": {}}}
    back = sinks.unpack(sinks.pack(snap, 108, 7))
    assert back["seq"] == 7 and back["spectrum"] == snap["spectrum"] and back["mode"] == "beat" and back["tempo_saturated"]
    assert back["bpm"] == 120.5 and back["bands"]["low"]["rms"] == 0.5 and list(back["bands"]) == ["low", "mid"]
    schema = sinks.record_schema(108, ["low"], range(108))
    assert json.loads(json.dumps(schema))["bin_freqs"][3] == 3.0
    with pytest.raises(ValueError):
        sinks.layout(2000)


def test_state_and_settings_files(tmp_path):
    sinks.save_level(tmp_path / "a.json", 0.3)
    assert sinks.load_level(tmp_path / "a.json") == 0.3
    (tmp_path / "b.json").write_text('{"slow_rms": -42}')
    assert sinks.load_level(tmp_path / "b.json") == sinks.load_level(tmp_path / "none") == 0.1
    (tmp_path / "s.toml").write_text("[tempo]\ndefault = 90\n")
    assert feed.settings(tmp_path / "s.toml").tempo["default"] == 90 and feed.settings().tempo["default"] == 120.0
    np.savez(tmp_path / "w.npz", weights=np.zeros(5), hidden=np.array(48))
    flat, dims = feed.weights(tmp_path / "w.npz")
    assert len(flat) == 5 and dims == {"hidden": 48}


def test_golden_routing_metrics(spark):
    counted = spark.createDataFrame([("808_plus_hihat", 4, 2, 3), ("fast_kicks", 1, 1, 3), ("high_hihat_pattern", 3, 2, 3), ("kick_over_sustained_bass", 1, 2, 3), ("kick_over_vocal", 1, 1, 4), ("low_sine_80hz", 1, 1, 1), ("slow_kicks", 3, 3, 2)], "name string, low long, mid long, high long").withColumn("total", F.col("low") + F.col("mid") + F.col("high"))
    got = {r["metric"]: r["value"] for r in evals.metrics(evals.breakdown(plans.stimuli(spark), counted)).collect()}
    assert got["recall_low"] == got["recall_high"] == got["stimuli_with_any_event"] == 1.0
    assert got["recall_mid"] == 0.0 and got["density_ranking_fast_vs_slow"] == 0.25


def test_drift_and_baseline(spark, tmp_path):
    evals.save_baseline(tmp_path / "b.json", {"a": 1.0, "b": 2.0, "gone": 1.0})
    now = spark.createDataFrame([("a", 1.04), ("b", 2.5), ("fresh", 1.0)], "metric string, value double")
    got = {r["metric"]: r["status"] for r in evals.drift(now, evals.load_baseline(spark, tmp_path / "b.json"), spark.createDataFrame([], "metric string, tol double")).collect()}
    assert got == {"a": "ok", "b": "drift", "gone": "missing", "fresh": "new"}


def test_instruments_and_voices():
    for name in ("kick", "snare", "hihat", "deep_kick", "sub_kick", "low_hihat", "clap"):
        x = evals.instrument(name)
        assert np.abs(x).max() <= 1.2 and np.array_equal(x, evals.instrument(name))
    assert len(evals.voice(0.5)) == len(evals.speech(0.5)) == 24000
    with pytest.raises(ValueError):
        evals.instrument("harp")


def test_clap_is_four_bursts_of_one_noise():
    rng, n = np.random.default_rng(55), 1920
    want = np.zeros(n)
    for i in range(4):
        part = evals.limited(rng.standard_normal(144), 200, 2000)
        want[240 * i : 240 * i + 144] = part / np.abs(part).max() * 0.8**i
    want *= evals.envelope(n)
    assert np.allclose(evals.instrument("clap"), want / np.abs(want).max(), atol=1e-6)


def test_pattern_library(spark):
    """Rendered samples against the hits laid one by one, and what is mixed under them."""
    hits = evals.pattern(evals.library(spark)).collect()
    kits = {p[0]: evals.KITS[p[-1]] for p in evals.PATTERNS}
    assert len(kits) == 12
    for name in ("6/8 compound", "trap 808"):
        x = evals.render(name)
        want = np.zeros(len(x))
        for h in hits:
            if h["track"] == name:
                a, y = int(h["t"] * 48000 + 1e-6), h["amp"] * evals.instrument(kits[name][h["kind"]])
                want[a : a + len(y)] += y[: len(x) - a]
        # A start may be a sample off where the time falls on one exactly.
        assert abs(np.abs(x).sum() / np.abs(np.clip(want, -1, 1)).sum() - 1) < 0.01
    plain, noisy = evals.render("3/4 waltz"), evals.render("3/4 waltz", noise_db=20.0)
    assert np.sqrt(((noisy - plain) ** 2).mean()) == pytest.approx(0.1 * np.sqrt((plain**2).mean()), rel=0.05)
    faded = evals.render("3/4 waltz", vocal=0.2, spoken=0.1, gains=[(0.0, 1.0), (2.0, 0.0)])
    assert not faded[96_001:].any() and np.abs(faded[:4000]).max() > 0.1
    got = {(r["track"], r["frame"]): r["pcm"] for r in evals.rendered(spark).where("track = '4/4 rock'").collect()}
    assert np.allclose(np.concatenate([got["4/4 rock", k] for k in range(len(got))]), evals.render("4/4 rock")[: len(got) * 512])


def test_octaves_are_halved_one_after_the_other(spark):
    rng = np.random.default_rng(3)
    rows = [(t, f, rng.standard_normal(64).tolist()) for t in (1, 2) for f in range(1, 6)]
    out = frames.octaves(spark.createDataFrame(rows, "track long, frame long, pcm array<double>"), 4).orderBy("track", "frame").collect()
    for t in (1, 2):
        halves = [(h := frames.HalfBand(), h.start()) for _ in range(3)]
        for r in (r for r in out if r["track"] == t):
            x = r["octave_0"]
            for k, (h, state) in enumerate(halves):
                state, (x,) = h.step(state, (x,))
                halves[k] = (h, state)
                assert r[f"octave_{k + 1}"] == pytest.approx(x)


def test_teeth_and_jumps():
    rng = np.random.default_rng(4)
    for n in (1, 7, 100):
        share = rng.random(30) * (rng.random(30) < 0.7)
        comb = (0.4 + np.arange(n)) / n
        upto = np.cumsum(share / share.sum())
        upto[-1] = 1.0
        assert models.teeth(share, n, 0.4).tolist() == np.bincount(np.searchsorted(upto, comb), minlength=30).tolist()
    assert models.teeth(np.zeros(4), 8, 0.5).tolist() == [2, 2, 2, 2]
    chances = np.array([[0.0, 1.0, 0.0], [0.25, 0.25, 0.5], [1.0, 0.0, 0.0]])
    jumps = models.Jumps(np.array([2, 6, 11]), np.array([0, 3, 7]), chances)
    assert jumps(np.array([0, 1, 5, 10, 2, 11]), rng).tolist() == [1, 2, 6, 11, 3, 0]
    went = np.unique(jumps(np.full(20_000, 6), rng), return_counts=True)
    assert went[0].tolist() == [0, 3, 7] and np.allclose(went[1] / 20_000, chances[1], atol=0.02)


def test_beats_and_downbeats():
    """A click every 25 frames, each third one a downbeat, is told so after a while."""
    fold = models.Particles(600, meters=(3, 4))
    state, told = fold.start(), []
    for f in range(2000):
        on, down = f % 25 == 0, f % 75 == 0
        state, out = fold.step(state, (0.05 if down else 0.95 if on else 0.01, 0.95 if down else 0.02))
        assert out[2] == 600 and len(state[1]) == 250
        told.append(out[3])
    late = [(f, k) for f, k in enumerate(told) if k and f > 500]
    assert 40 <= len(late) <= 70 and all(min(f % 25, 25 - f % 25) <= 4 for f, _ in late)
    assert np.mean([min(f % 75, 75 - f % 75) <= 4 for f, k in late if k == 1]) > 0.9 and sum(k == 1 for _, k in late) > 10


def test_batch_equals_stream(spark, tmp_path):
    rows = [(t, f, float((f * 7 + t) % 5)) for t in (1, 2) for f in range(1, 21)]
    schema = "track long, frame long, x double"
    for i, (a, b) in enumerate(((1, 7), (8, 13), (14, 20))):
        spark.createDataFrame([r for r in rows if a <= r[1] <= b], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = scan_stream(stream, Ema(0.9), ["x"]).writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM folded").collect())
    want = sorted(tuple(r) for r in scan(spark.createDataFrame(rows, schema), Ema(0.9), ["x"]).collect())
    assert got == want and len(got) == 40


def test_windowed_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "low", i * 0.25) for i in range(12)], "track long, kind string, s double").select("track", "kind", F.timestamp_seconds("s").alias("ts"))
    df.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    q = event_density(stream).writeStream.format("memory").queryName("dens").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.sql("SELECT * FROM dens").collect()) == [4, 4, 4]


def test_empty_and_null_rows(spark):
    empty = spark.createDataFrame([], "track long, frame long, x double")
    assert scan(empty, Ema(0.5), ["x"]).count() == 0 and onsets.percentile(empty).count() == 0
    odd = spark.createDataFrame([(None, 1, 2.0), (None, 2, None), (1, 1, 4.0), (1, 1, 4.0)], "track long, frame long, x double")
    assert sorted(r["y"] for r in scan(odd, Ema(0.5), ["x"]).collect()) == [1.0, 1.0, 2.0, 3.0]


def drums(seconds=8.0, bpm=120.0):
    x = np.zeros(int(48000 * seconds))
    for name, beats in (("kick", 1.0), ("hihat", 0.5)):
        hit = evals.instrument(name) * (0.8 if name == "kick" else 0.3)
        for a in np.arange(0.5, seconds - 0.2, 60.0 / bpm * beats):
            i = int(a * 48000)
            x[i : i + len(hit)] += hit[: len(x) - i]
    return x + 0.002 * np.sin(2 * np.pi * 300 * np.arange(len(x)) / 48000)


def test_engine_hears_drums():
    fold = engine.Engine()
    state, out = fold.start(), []
    x = drums()
    for a in range(0, len(x) - 511, 512):
        state, told = fold.step(state, (x[a : a + 512].tolist(),))
        out.append(told)
    names = [c.split()[0] for c in fold.out.split(", ")][:14]
    kinds = [(i * 512 / 48000, e["kind"]) for i, o in enumerate(out) for e in o[-1]]
    lows = [t for t, k in kinds if k == "low"]
    assert len(lows) >= 8
    grid = [abs((t - 0.5) / 0.5 - round((t - 0.5) / 0.5)) for t in lows]
    assert np.median(grid) < 0.15
    last = dict(zip(names, out[-1]))
    assert last["effective_bpm"] == pytest.approx(120, rel=0.05) and last["gain"] > 0.1
    quiet = fold.step(state, ([0.0] * 512,))[1]
    assert quiet[-1] == [] and dict(zip(names, quiet))["percussiveness"] == 0.5
    assert dict(zip(names, fold.step(fold.hint(state, 90.0), (x[:512].tolist(),))[1]))["effective_bpm"] == 90.0
    assert fold.restart(state)["of"]["mode"][0] == "energy"


def test_engine_in_batch_and_stream(spark, tmp_path):
    x = drums(1.0)
    rows = [(t, f, (x[f * 512 : f * 512 + 512] * (1 if t else 0)).tolist()) for t in (0, 1) for f in range(60)]
    hops = feed.given(spark, rows)
    batch = scan(hops, engine.Engine(), ["pcm"]).select("track", "frame", "mode", "centroid", F.size("events").alias("n"))
    want = sorted(tuple(r) for r in batch.collect())
    assert len(want) == 120 and {r[2] for r in want if r[0] == 0} == {"idle"}
    for a in (0, 20, 40):
        hops.where(f"frame >= {a} and frame < {a + 20}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{a}"))
    stream = spark.readStream.schema(hops.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = scan_stream(stream, engine.Engine(), ["pcm"]).select("track", "frame", "mode", "centroid", F.size("events").alias("n"))
    q = out.writeStream.format("memory").queryName("engine").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM engine").collect()) == want


def test_chunks_of_a_long_track_change_nothing(spark):
    r = np.random.default_rng(1)
    df = spark.createDataFrame([(t, f, float(r.random() ** 8), r.random(20).tolist()) for t, n in ((1, 700), (2, 30)) for f in range(1, n + 1)], "track long, frame long, x double, mag array<double>")
    for a, b in ((onsets.percentile(df.drop("mag")), onsets.percentile(df.drop("mag"), chunk=64)), (stability.median(df, 20, 7), stability.median(df, 20, 7, chunk=50))):
        assert a.columns == b.columns
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    with pytest.raises(ValueError):
        stability.median(df, 60, 7, chunk=50)
