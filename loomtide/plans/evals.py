"""Queries over models, evaluation tables and made-up rhythms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loomtide.functions import arrays as A
from loomtide.operators import engine, evals, frames, models
from loomtide.operators.scan import scan
from loomtide.plans.spectra import by_frame
from loomtide.plans.tables import PCM_HOP, SIGNAL, r6, samples, signal, spectra

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def seeded(layout: models.Layout, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal(layout.size()) * 0.2


def rnn_input(spark, sf):
    g = F.transform("mag", lambda m: F.log1p(F.lit(770.0) * m))
    df = spectra(spark, sf).withColumn("g", g)
    return df.select("track", "frame", F.concat("g", A.rises(F.col("g"), F.lag("g").over(by_frame()))).alias("features"))


SINGLE = models.Layout(128, 16, 12, 1, 3)
DEEP = models.Layout(128, 16, 12, 3, deep=True)


@query()
def rnn_logits(spark, sf):
    """One GRU layer with made-up weights; checked against numpy in the tests."""
    out = models.recurrent(rnn_input(spark, sf), seeded(SINGLE, 1), SINGLE)
    return out.select("track", "frame", *[r6(F.get("logits", F.lit(k))).alias(f"logit_{k}") for k in range(3)])


@query()
def rnn_multidepth_logits(spark, sf):
    """Three layers, each with a head, cleared every 16 frames."""
    out = models.recurrent(rnn_input(spark, sf), seeded(DEEP, 2), DEEP, reset_every=16)
    return out.select("track", "frame", *[r6(F.get("logits", F.lit(k))).alias(f"logit_{k}") for k in range(3)])


def conv_weights(seed: int = 3, width: int = 128, hidden: int = 10) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    flat = 2 * ((width - 9) // 2)
    shapes = {"conv.w": (2, 10), "conv.b": (2,), "in.w": (hidden, flat), "in.b": (hidden,), "out.w": (3, hidden), "out.b": (3,)}
    for k in range(2):
        shapes |= {f"lstm{k}.w_in": (4 * hidden, hidden), f"lstm{k}.w_rec": (4 * hidden, hidden), f"lstm{k}.b_in": (4 * hidden,), f"lstm{k}.b_rec": (4 * hidden,)}
    return {n: rng.standard_normal(s) * 0.2 for n, s in shapes.items()}


@query()
def conv_lstm_probabilities(spark, sf):
    out = models.conv_lstm(rnn_input(spark, sf), conv_weights())
    return out.select("track", "frame", *[r6(F.get("probabilities", F.lit(k))).alias(n) for k, n in enumerate(("beat", "downbeat", "neither"))])


@query()
def log_filterbank(spark, sf):
    """Features of each hop of 64 samples, from windows of 128 and 12 filters."""
    bank = np.abs(np.random.default_rng(4).standard_normal((64, 12)))
    out = scan(frames.hops(samples(spark, sf), PCM_HOP), models.LogFilterbank(bank, 128), ["pcm"])
    return out.select("track", "frame", F.size("features").alias("n"), r6(A.total(F.col("features"))).alias("total"))


@query()
def constant_q(spark, sf):
    """Two octaves of 12 bins of each hop, from the sliding transform."""
    cq = models.ConstantQ(octaves=2)
    out = models.constant_q(frames.octaves(frames.hops(samples(spark, sf), PCM_HOP), 2), cq)
    return out.select("track", "frame", r6(A.total(F.col("magnitude"))).alias("magnitude"), r6(A.total(F.col("flux"))).alias("flux"))


@query()
def engine_snapshots(spark, sf):
    """The whole engine over hops of 64 samples, with four octaves."""
    out = scan(frames.hops(samples(spark, sf), PCM_HOP), engine.Engine(4, hop=PCM_HOP), ["pcm"])
    return out.select("track", "frame", "mode", *[r6(c).alias(c) for c in ("centroid", "spectral_novelty", "effective_bpm", "break_intensity", "gain")], F.size("events").alias("n_events"), r6(F.col("bands")["high"]["rms"]).alias("high_rms"))


@query()
def particle_filter(spark, sf):
    df = signal(spark, sf).select("track", "frame", F.least(F.lit(1.0), F.col("x") / 490.0).alias("a"))
    return scan(df, models.Particles(200), ["a"]).select("track", "frame", r6("bpm").alias("bpm"), r6("confidence").alias("confidence"), "n_particles")


@query(f"""
WITH {SIGNAL}, s AS (SELECT track, frame, event_id, x / sum(x) OVER (PARTITION BY track) AS share, count(*) OVER (PARTITION BY track) AS n FROM signal), c AS (
  SELECT *, CASE WHEN frame = n THEN 1 ELSE sum(share) OVER (PARTITION BY track ORDER BY frame) END AS hi FROM s
), b AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY track ORDER BY frame), -1) AS lo FROM c)
SELECT track, event_id, k.range AS k FROM b JOIN range(100) k ON (k.range + 0.37) / 100 > lo AND (k.range + 0.37) / 100 <= hi
""")
def systematic_resampling(spark, sf):
    """100 draws of each user's events by value, with a fixed offset."""
    return models.resample(signal(spark, sf).withColumn("weight", F.col("x")), 100, 0.37).select("track", "event_id", "k")


@query(f"""
WITH {SIGNAL}, p AS (SELECT track, CAST(floor(x) AS BIGINT) AS state, 14 + CAST(floor(x / 50) AS BIGINT) AS interval FROM signal),
m AS (SELECT track, CAST(floor(quantile_cont(state, 0.5)) AS BIGINT) AS m, count(*) AS n FROM p GROUP BY 1),
o AS (SELECT p.track, n, arg_max(interval, state) AS own FROM p JOIN m ON m.track = p.track AND state <= m GROUP BY ALL)
SELECT p.track, round(3000.0 / own, 6) AS bpm, round(count(*) FILTER (WHERE interval = own) / n, 6) AS confidence, n AS n_particles FROM p JOIN o USING (track) GROUP BY p.track, own, n
""")
def particle_summary(spark, sf):
    p = signal(spark, sf).select("track", F.floor("x").alias("state"), (F.lit(14) + F.floor(F.col("x") / 50)).alias("interval"))
    return models.particle_tempo(p).select("track", r6("bpm").alias("bpm"), r6("confidence").alias("confidence"), "n_particles")


@query(f"""
WITH {SIGNAL}, c AS (SELECT track, 2 + CAST(floor(x) AS BIGINT) % 3 AS beats, count(*) AS n FROM signal GROUP BY ALL)
SELECT track, arg_max(beats, (n, -beats)) AS beats_per_bar, round(max(n) / sum(n), 6) AS confidence, CAST(sum(n) AS BIGINT) AS n_particles FROM c GROUP BY track
""")
def meter_summary(spark, sf):
    p = signal(spark, sf).select("track", (F.lit(2) + F.floor("x") % 3).alias("beats"))
    return models.meter(p).select("track", "beats_per_bar", r6("confidence").alias("confidence"), "n_particles")


@query("SELECT event_type AS component, round(avg(value), 4) AS mean_ms, round(quantile_cont(value, 0.95), 4) AS p95_ms, round(quantile_cont(value, 0.99), 4) AS p99_ms, round(max(value), 4) AS max_ms FROM (SELECT event_type, value / 1000 * 1000 AS value FROM events) GROUP BY 1")
def latency_summary(spark, sf):
    steps = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("component"), (F.col("value") / 1000).alias("seconds"))
    out = models.latency(steps)
    return out.select("component", *[F.round(c, 4).alias(c) for c in ("mean_ms", "p95_ms", "p99_ms", "max_ms")])


# What each made-up stimulus should and shouldn't trigger.
STIMULI = [
    ("low_sine_80hz", ["low"], []), ("kick_over_vocal", ["low"], []), ("kick_over_sustained_bass", ["low"], []), ("high_hihat_pattern", ["high"], ["low"]),
    ("808_plus_hihat", ["low", "high"], ["mid"]), ("fast_kicks", ["low"], []), ("slow_kicks", ["low"], []),
]


def stimuli(spark):
    return spark.createDataFrame(STIMULI, "name string, expected array<string>, forbidden array<string>")


_STIM = "stim AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {e}, CAST({f} AS VARCHAR[]))" for n, e, f in STIMULI) + ") t(name, expected, forbidden))"
_FIRED = f"""{SIGNAL}, fired AS (SELECT name, kind FROM signal JOIN (SELECT name, row_number() OVER () - 1 AS i FROM stim) s ON s.i = track % 7 WHERE x > 200), n AS (
  SELECT name, count(*) FILTER (WHERE kind = 'low') AS low, count(*) FILTER (WHERE kind = 'mid') AS mid, count(*) FILTER (WHERE kind = 'high') AS high, count(*) AS total FROM fired GROUP BY 1
), b AS (SELECT s.*, coalesce(low, 0) AS low, coalesce(mid, 0) AS mid, coalesce(high, 0) AS high, coalesce(total, 0) AS total FROM stim s LEFT JOIN n USING (name))"""


def _counts(spark, sf):
    names = F.array(*[F.lit(n) for n, _, _ in STIMULI])
    return evals.counts(signal(spark, sf).where("x > 200").select(F.get(names, (F.col("track") % 7).cast("int")).alias("name"), "kind"))


@query(f"""
WITH {_STIM}, {_FIRED}, w AS (SELECT *, CASE WHEN 'low' IN expected THEN low ELSE 0 END + CASE WHEN 'mid' IN expected THEN mid ELSE 0 END + CASE WHEN 'high' IN expected THEN high ELSE 0 END AS e FROM b)
SELECT name, low, mid, high, total, e AS expected_count, total - e AS other_count FROM w
""".replace("'low' IN expected", "list_contains(expected, 'low')").replace("'mid' IN expected", "list_contains(expected, 'mid')").replace("'high' IN expected", "list_contains(expected, 'high')"))
def routing_breakdown(spark, sf):
    return evals.breakdown(stimuli(spark), _counts(spark, sf)).drop("expected", "forbidden")


@query(f"""
WITH {_STIM}, {_FIRED}, d AS (
  SELECT greatest(CASE WHEN list_contains(expected, 'low') THEN low END, CASE WHEN list_contains(expected, 'mid') THEN mid END, CASE WHEN list_contains(expected, 'high') THEN high END) AS e,
    greatest(CASE WHEN list_contains(forbidden, 'low') THEN low END, CASE WHEN list_contains(forbidden, 'mid') THEN mid END, CASE WHEN list_contains(forbidden, 'high') THEN high END) AS f FROM b WHERE len(forbidden) > 0)
SELECT 'recall_low' AS metric, round(coalesce(avg(CAST(low > 0 AS INTEGER)) FILTER (WHERE list_contains(expected, 'low')), 0), 6) AS value FROM b UNION ALL
SELECT 'recall_mid', round(coalesce(avg(CAST(mid > 0 AS INTEGER)) FILTER (WHERE list_contains(expected, 'mid')), 0), 6) FROM b UNION ALL
SELECT 'recall_high', round(coalesce(avg(CAST(high > 0 AS INTEGER)) FILTER (WHERE list_contains(expected, 'high')), 0), 6) FROM b UNION ALL
SELECT 'dominance_correct_rate', round(avg(CAST(e > f AS INTEGER)), 6) FROM d UNION ALL
SELECT 'stimuli_with_any_event', round(avg(CAST(total > 0 AS INTEGER)), 6) FROM b UNION ALL
SELECT 'density_ranking_fast_vs_slow', round(max(low) FILTER (WHERE name = 'fast_kicks') / (max(low) FILTER (WHERE name = 'slow_kicks') + 1), 6) FROM b
""")
def routing_metrics(spark, sf):
    return evals.metrics(evals.breakdown(stimuli(spark), _counts(spark, sf))).withColumn("value", r6("value"))


@query("""
WITH a AS (SELECT c_mktsegment AS metric, avg(c_acctbal) AS now FROM customer WHERE c_nationkey < 12 GROUP BY 1), b AS (
  SELECT c_mktsegment AS metric, avg(c_acctbal) AS base FROM customer WHERE c_nationkey >= 12 AND c_mktsegment <> 'BUILDING' GROUP BY 1
), j AS (SELECT metric, now, base, CASE metric WHEN 'MACHINERY' THEN 0.5 ELSE 0.05 END AS tol FROM a FULL JOIN b USING (metric))
SELECT metric, round(now, 4) AS now, round(base, 4) AS base, round((now - base) / greatest(abs(base), 1e-9), 6) AS delta_rel,
  CASE WHEN base IS NULL THEN 'new' WHEN now IS NULL THEN 'missing' WHEN abs((now - base) / greatest(abs(base), 1e-9)) <= tol THEN 'ok' ELSE 'drift' END AS status FROM j
""")
def metric_drift(spark, sf):
    """Balances by segment, of some nations against the others as a baseline."""
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_mktsegment").alias("metric"), "c_nationkey", "c_acctbal")
    now = c.where("c_nationkey < 12").groupBy("metric").agg(F.avg("c_acctbal").alias("value"))
    base = c.where("c_nationkey >= 12 AND metric <> 'BUILDING'").groupBy("metric").agg(F.avg("c_acctbal").alias("value"))
    out = evals.drift(now, base, spark.createDataFrame([("MACHINERY", 0.5)], "metric string, tol double"))
    return out.select("metric", F.round("now", 4).alias("now"), F.round("base", 4).alias("base"), r6("delta_rel").alias("delta_rel"), "status")


_HITS = """hits AS (
  SELECT n_nationkey AS track, b.kind, CAST((bar.range * 4 + p.v - 1) * 60 / CAST(90 + n_nationkey * 2 AS DOUBLE) AS DOUBLE) AS t, b.amp FROM nation CROSS JOIN range(2) bar
  CROSS JOIN (SELECT * FROM (VALUES ('low', [1.0, 3.0], 0.8), ('high', [1.0, 1.5, 2.0, 2.5], 0.3)) t(kind, ats, amp)) b, unnest(b.ats) p(v))"""


def _hits(spark, sf):
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), A.literal(at).alias("at"), F.lit(amp).alias("amp")) for k, at, amp in (("low", [1.0, 3.0], 0.8), ("high", [1.0, 1.5, 2.0, 2.5], 0.3))])
    nations = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("track"), (F.lit(90.0) + F.col("n_nationkey") * 2).alias("bpm"), F.lit(2).alias("bars"), F.lit(4).alias("beats"))
    return evals.pattern(nations.withColumn("part", F.explode(kinds)).select("track", "bpm", "bars", "beats", "part.*"))


@query(f"WITH {_HITS} SELECT CAST(track AS BIGINT) AS track, kind, round(t, 6) AS t, CAST(amp AS DOUBLE) AS amp FROM hits")
def drum_patterns(spark, sf):
    return _hits(spark, sf).withColumn("t", r6("t"))


@query(f"""
WITH {_HITS}, sounds AS (SELECT b.kind, k.range AS k, (b.len - k.range) / CAST(b.len AS DOUBLE) AS y FROM (SELECT * FROM (VALUES ('low', 40), ('high', 10)) t(kind, len)) b JOIN range(40) k ON k.range < b.len),
s AS (SELECT track, CAST(floor(t * 100) AS BIGINT) + k AS n, sum(CAST(amp AS DOUBLE) * y) AS x FROM hits JOIN sounds USING (kind) GROUP BY ALL)
SELECT CAST(track AS BIGINT) AS track, n, round(least(1, greatest(-1, x * CASE WHEN n / 100.0 <= 0 THEN 1 WHEN n / 100.0 < 2 THEN 1 + n / 100.0 * -0.25 WHEN n / 100.0 < 5 THEN 0.5 + (n / 100.0 - 2) * (CAST(0.5 AS DOUBLE) / 3) ELSE 1 END)), 6) AS x FROM s WHERE n < 450
""")
def rendered_patterns(spark, sf):
    """Hits overlaid at 100 samples a second, with a gain that falls and rises."""
    decays = [("low", k, (40 - k) / 40) for k in range(40)] + [("high", k, (10 - k) / 10) for k in range(10)]
    mixed = evals.overlay(_hits(spark, sf), spark.createDataFrame(decays, "kind string, k long, y double"), 450, 100.0)
    out = evals.interpolate(mixed.withColumn("t", F.col("n") / 100.0), [(0.0, 1.0), (2.0, 0.5), (5.0, 1.0)])
    return out.select("track", "n", r6(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("x") * F.col("gain")))).alias("x"))


@query()
def instrument_levels(spark, sf):
    """RMS of each made-up instrument."""
    kit = {n: n for n in ("kick", "snare", "hihat", "deep_kick", "sub_kick", "low_hihat", "clap")}
    return evals.sounds(spark, kit).groupBy("kind").agg(F.count("*").alias("n"), r6(F.sqrt(F.avg(F.col("y") * F.col("y")))).alias("rms"))


_LIBRARY = ", ".join(
    f"('{name}', '{kit}', CAST({bpm} AS DOUBLE), {bars}, {beats}, '{kind}', {[float(x) for x in at]}, CAST({amp} AS DOUBLE))"
    for name, bpm, bars, beats, *ats, amps, kit in evals.PATTERNS for kind, at, amp in zip(evals.BANDS, ats, amps)
)


@query(f"""
WITH p AS (SELECT * FROM (VALUES {_LIBRARY}) t(track, kit, bpm, bars, beats, kind, ats, amp)),
bar AS (SELECT *, unnest(range(bars)) AS bar FROM p), hit AS (SELECT *, unnest(ats) AS beat FROM bar)
SELECT track, kind, round((bar * beats + CAST(beat AS DOUBLE) - 1) * 60 / bpm, 6) AS t, amp FROM hit
""")
def pattern_library(spark, sf):
    """The hits of all patterns of the library."""
    return evals.pattern(evals.library(spark)).withColumn("t", r6("t"))


@query()
def pattern_hops(spark, sf):
    """Level of each hop of the rendered library, with noise 20 dB below; checked against numpy in the tests."""
    return evals.rendered(spark, noise_db=20.0).select("track", "frame", r6(A.rms(F.col("pcm"))).alias("rms"))
