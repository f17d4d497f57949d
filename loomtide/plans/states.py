"""Queries over samples, states and sinks."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

from loomtide.operators import frames, states
from loomtide.operators.folds import Ema
from loomtide.operators.scan import scan
from loomtide.plans.tables import PCM_HOP, SAMPLES, SIGNAL, r6, samples, signal
from loomtide.sources import metronome, sinks

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_HOPS = f"{SAMPLES}, hops AS (SELECT track, n // 64 AS frame, list(x ORDER BY n) AS pcm FROM samples GROUP BY ALL HAVING count(*) = 64)"
_GATED = "gated AS (SELECT track, frame, list_transform(pcm, lambda x: CASE WHEN abs(x) < 0.1 THEN 0 ELSE x END) AS pcm FROM hops)"


def _hops(spark, sf):
    return frames.hops(samples(spark, sf), PCM_HOP)


def _sum(c):
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


@query(f"WITH {_HOPS} SELECT track, CAST(frame AS BIGINT) AS frame, round(pcm[1], 6) AS first, round(pcm[64], 6) AS last, round(list_sum(pcm), 6) AS total FROM hops")
def hop_frames(spark, sf):
    return _hops(spark, sf).select("track", "frame", r6(F.get("pcm", F.lit(0))).alias("first"), r6(F.element_at("pcm", -1)).alias("last"), r6(_sum(F.col("pcm"))).alias("total"))


@query(f"""
WITH {_HOPS}, w AS (SELECT track, frame, flatten(list(pcm) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS w FROM hops)
SELECT track, CAST(frame AS BIGINT) AS frame, round(w[1], 6) AS first, round(list_sum(w), 6) AS total FROM w WHERE len(w) = 256
""")
def overlapped_windows(spark, sf):
    return frames.overlapping(_hops(spark, sf)).select("track", "frame", r6(F.get("window", F.lit(0))).alias("first"), r6(_sum(F.col("window"))).alias("total"))


@query(f"""
WITH {_HOPS}, {_GATED}
SELECT track, CAST(frame AS BIGINT) AS frame, CAST(len(list_filter(pcm, lambda x: x <> 0)) AS BIGINT) AS sounding,
  round(sqrt(list_sum(list_transform(pcm, lambda x: x * x)) / len(list_filter(pcm, lambda x: x <> 0))), 6) AS rms FROM gated
""")
def noise_gate_rms(spark, sf):
    g = frames.gate(F.col("pcm"), 0.1)
    return _hops(spark, sf).withColumn("pcm", g).select("track", "frame", F.size(F.filter("pcm", lambda x: x != 0)).cast("long").alias("sounding"), r6(frames.sounding_rms(F.col("pcm"))).alias("rms"))


_AGC = 1.0 - math.exp(-(64 / 48000) / 0.02)


@query(f"""
WITH RECURSIVE {_HOPS}, {_GATED}, r AS (
  SELECT track, frame, sqrt(list_sum(list_transform(pcm, lambda x: x * x)) / nullif(len(list_filter(pcm, lambda x: x <> 0)), 0)) AS rms, pcm FROM gated
), s AS (
  SELECT track, frame, CASE WHEN rms > 0.1 THEN (1 - {_AGC!r}) * 0.1 + {_AGC!r} * rms ELSE CAST(0.1 AS DOUBLE) END AS slow, pcm FROM r WHERE frame = 0
  UNION ALL
  SELECT r.track, r.frame, CASE WHEN r.rms > 0.1 THEN (1 - {_AGC!r}) * slow + {_AGC!r} * r.rms ELSE slow END, r.pcm FROM s JOIN r ON r.track = s.track AND r.frame = s.frame + 1
)
SELECT track, CAST(frame AS BIGINT) AS frame, round(slow, 6) AS slow_rms, round(0.1 / greatest(slow, 0.1), 6) AS gain, round(pcm[1] * (0.1 / greatest(slow, 0.1)), 6) AS first FROM s
""")
def agc(spark, sf):
    out = frames.agc(_hops(spark, sf), floor=0.1, seconds=0.02)
    return out.select("track", "frame", r6("slow_rms").alias("slow_rms"), r6("gain").alias("gain"), r6(F.get("pcm", F.lit(0))).alias("first"))


@query(f"""
WITH {_HOPS}, g AS (SELECT track, frame, list_transform(pcm, lambda x: CASE WHEN abs(x) < 0.97 THEN 0 ELSE x END) AS pcm FROM hops)
SELECT track, CAST(frame AS BIGINT) AS frame, round(CASE WHEN len(list_filter(pcm, lambda x: x <> 0)) > 0 THEN list_sum(list_transform(pcm, lambda x: abs(x))) ELSE 0 END, 6) AS level,
  CASE WHEN len(list_filter(pcm, lambda x: x <> 0)) > 0 THEN CAST(1 AS DOUBLE) ELSE 0.5 END AS percussiveness FROM g
""")
def silence_gate(spark, sf):
    """Silent hops skip the features and come back with idle values."""
    h = _hops(spark, sf).withColumn("pcm", frames.gate(F.col("pcm"), 0.97))
    features = h.where(frames.sounding(h)).select("track", "frame", r6(_sum(F.transform("pcm", F.abs))).alias("level"), F.lit(1.0).alias("percussiveness"))
    return frames.with_idle(h, features, {"level": 0.0, "percussiveness": 0.5})


@query(f"""
WITH {_HOPS}
SELECT track, CAST(frame AS BIGINT) AS frame, round(len(list_filter(range(1, 64), lambda i: (pcm[i] < 0) <> (pcm[i + 1] < 0))) / 64.0, 6) AS zcr FROM hops
""")
def zero_crossing_rate(spark, sf):
    return _hops(spark, sf).select("track", "frame", r6(frames.zero_crossings(F.col("pcm"))).alias("zcr"))


@query(f"WITH {SAMPLES} SELECT track, n, round(lag(x, 3) OVER (PARTITION BY track ORDER BY n), 6) AS held FROM samples")
def ring_buffer_delay(spark, sf):
    df = samples(spark, sf)
    return df.select("track", "n", r6(frames.delayed(df, "x", 3, order="n")).alias("held"))


_AT, _RE = (math.exp(-64 / (48000 * ms / 1000.0)) for ms in (5.0, 50.0))


@query(f"""
WITH RECURSIVE {SAMPLES}, b AS (SELECT track, n // 64 AS frame, max(abs(x)) AS level FROM samples GROUP BY ALL), e AS (
  SELECT track, frame, CASE WHEN level > 0 THEN (1 - {_AT!r}) * level ELSE CAST(0 AS DOUBLE) END AS env FROM b WHERE frame = 0
  UNION ALL SELECT b.track, b.frame, CASE WHEN level > env THEN {_AT!r} * env + (1 - {_AT!r}) * level ELSE {_RE!r} * env + (1 - {_RE!r}) * level END FROM e JOIN b ON b.track = e.track AND b.frame = e.frame + 1
), p AS (SELECT track, max(level) AS peak, max(level) * pow(10, -12 / 20.0) AS thr FROM b GROUP BY 1), g AS (
  SELECT track, frame, peak, pow(10, -(CASE WHEN env > thr THEN 0.75 * 20 * log10(env / thr + 1e-10) ELSE 0 END) / 20) AS gain FROM e JOIN p USING (track)
), y AS (SELECT s.track, n, peak, x * gain AS y FROM samples s JOIN g ON g.track = s.track AND g.frame = s.n // 64)
SELECT track, n, round(y * peak / max(abs(y)) OVER (PARTITION BY track), 6) AS x FROM y
""")
def range_compressor(spark, sf):
    return frames.compress(samples(spark, sf)).withColumn("x", r6("x"))


@query()
def resampled(spark, sf):
    """48 kHz to 22.05 kHz by hops; checked against numpy in the tests."""
    run = frames.resampler()
    @F.pandas_udf("array<double>")
    def down(pcm: pd.Series) -> pd.Series:
        return pcm.map(lambda x: run(x).tolist())

    return _hops(spark, sf).select("track", "frame", down("pcm").alias("p")).select("track", "frame", F.size("p").alias("n"), r6(_sum(F.col("p"))).alias("total"))


@query()
def octave_filterbank(spark, sf):
    """Six rates of each hop, from all-pass half-bands."""
    out = frames.octaves(_hops(spark, sf), 6)
    return out.select("track", "frame", *[r6(_sum(F.transform(f"octave_{k}", lambda x: x * x))).alias(f"power_{k}") for k in range(6)])


_STATES = "st AS (SELECT track, frame, x / 1500 AS novelty, CASE WHEN frame % 7 < 3 THEN 0 ELSE x END AS rms, (frame % 10) / CAST(10 AS DOUBLE) AS c FROM signal)"


@query(f"""
WITH RECURSIVE {SIGNAL}, {_STATES}, s AS (
  SELECT track, CAST(0 AS BIGINT) AS frame, 'idle' AS mode, CAST(0 AS DOUBLE) AS y, 0 AS musical, 0 AS other, 0 AS quiet FROM (SELECT DISTINCT track FROM st)
  UNION ALL
  SELECT track, frame, CASE mode WHEN 'idle' THEN CASE WHEN silent THEN 'idle' WHEN music THEN 'beat' ELSE 'energy' END
      WHEN 'energy' THEN CASE WHEN musical >= 3 THEN 'beat' WHEN quiet >= 3 THEN 'idle' ELSE mode END
      ELSE CASE WHEN quiet >= 3 OR (other >= 4 AND silent) THEN 'idle' WHEN other >= 4 THEN 'energy' ELSE mode END END, y, musical, other, quiet
  FROM (SELECT *, CASE WHEN music AND NOT silent THEN m0 + 1 ELSE 0 END AS musical, CASE WHEN music AND NOT silent THEN 0 ELSE o0 + 1 END AS other, CASE WHEN silent THEN q0 + 1 ELSE 0 END AS quiet FROM (
    SELECT *, CASE WHEN mode = 'beat' THEN y < 0.13 OR c > 0.7 ELSE y < 0.10 OR (y < 0.13 AND c > 0.7) END AS music FROM (
      SELECT st.track, st.frame, mode, musical AS m0, other AS o0, quiet AS q0, c, 0.95 * y + (1 - 0.95) * st.novelty AS y, st.rms < 1e-4 AS silent FROM s JOIN st ON st.track = s.track AND st.frame = s.frame + 1)))
)
SELECT track, frame, mode FROM s WHERE frame > 0
""")
def mode_states(spark, sf):
    """The mode machine with short times, as users have few frames."""
    df = signal(spark, sf).select("track", "frame", (F.col("x") / 1500.0).alias("novelty"), F.when(F.col("frame") % 7 < 3, 0.0).otherwise(F.col("x")).alias("rms"), ((F.col("frame") % 10) / 10.0).alias("confidence"))
    return states.mode(df, enter=3, leave=4, idle=3)


def _breaking(level: str, ratio: float, need: int) -> str:
    return f"""
WITH RECURSIVE {SIGNAL}, st AS (SELECT track, frame, {level} AS level, kind = 'low' AND x > 120 AS low, frame % 13 = 0 AS drifting FROM signal), s AS (
  SELECT track, CAST(0 AS BIGINT) AS frame, CAST(0 AS DOUBLE) AS mean, CAST(0 AS DOUBLE) AS wait, 0 AS quiet, 0 AS lows, false AS breaking, 0 AS since FROM (SELECT DISTINCT track FROM st)
  UNION ALL
  SELECT track, frame, mean, wait, quiet, lows, breaking OR go, CASE WHEN go THEN quiet ELSE since END FROM (
    SELECT *, frame >= 5 AND NOT breaking AND quiet >= {need} AND lows > 1 AND wait <= 0 AND NOT drifting AS go FROM (
      SELECT track, frame, mean, drifting, since, CASE WHEN frame >= 5 AND breaking AND ended THEN CAST(0.05 AS DOUBLE) ELSE wait END AS wait,
        CASE WHEN frame < 5 THEN quiet WHEN ended THEN 0 ELSE quiet + 1 END AS quiet, CASE WHEN frame >= 5 AND low THEN lows + 1 ELSE lows END AS lows, breaking AND NOT (frame >= 5 AND ended) AS breaking FROM (
        SELECT *, low OR NOT (level < mean * {ratio} AND mean > 1e-6) AS ended FROM (
          SELECT st.track, st.frame, st.level, st.low, st.drifting, 0.97 * mean + 0.03 * st.level AS mean, CASE WHEN wait > 0 THEN wait - {1 / 93.75!r} ELSE wait END AS wait, quiet, lows, breaking, since
          FROM s JOIN st ON st.track = s.track AND st.frame = s.frame + 1))))
)
SELECT track, frame, breaking, round(CASE WHEN breaking THEN least(1, (quiet - since) / 60.0) ELSE 0 END, 6) AS intensity FROM s WHERE frame > 0"""


def _break_input(spark, sf, level):
    return signal(spark, sf).select("track", "frame", level.alias("level"), ((F.col("kind") == "low") & (F.col("x") > 120)).alias("low"), F.lit(5625.0).alias("bpm"), (F.col("frame") % 13 == 0).alias("drifting"))


@query(_breaking("x", 0.8, 2))
def break_states(spark, sf):
    """Centroid level dropping out; a beat is one frame at this tempo."""
    return states.breaks(_break_input(spark, sf, F.col("x")), "level", ratio=0.8, beats=2.0, lows=1, cooldown=0.05, warmup=5).withColumn("intensity", r6("intensity"))


@query(_breaking("x * x / 500", 0.5, 2))
def bass_break_states(spark, sf):
    return states.breaks(_break_input(spark, sf, F.col("x") * F.col("x") / 500.0), "level", ratio=0.5, beats=1.5, lows=1, cooldown=0.05, warmup=5).withColumn("intensity", r6("intensity"))


@query(f"WITH {SIGNAL} SELECT track, frame, round(CASE WHEN frame % 3 = 0 THEN greatest(x, 100) ELSE 0 END, 6) AS intensity FROM signal")
def break_intensity(spark, sf):
    mode = F.when(F.col("frame") % 3 == 0, "beat").otherwise("energy")
    return signal(spark, sf).select("track", "frame", r6(states.intensity(mode, F.col("x"), F.lit(100.0))).alias("intensity"))


@query(f"""
WITH RECURSIVE {SIGNAL}, n AS (SELECT *, sum(CASE WHEN x > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY frame) AS session FROM signal),
o AS (SELECT *, row_number() OVER (PARTITION BY track, session ORDER BY frame) AS k FROM n), s AS (
  SELECT track, session, k, frame, {1 - 1 / 3!r} * x AS y FROM o WHERE k = 1
  UNION ALL SELECT o.track, o.session, o.k, o.frame, {1 / 3!r} * s.y + {1 - 1 / 3!r} * o.x FROM s JOIN o ON o.track = s.track AND o.session = s.session AND o.k = s.k + 1
)
SELECT track, CAST(session AS BIGINT) AS session, frame, round(y, 6) AS y FROM s
""")
def song_sessions(spark, sf):
    """Song starts reset what is remembered: here, an average."""
    df = states.sessions(signal(spark, sf), F.col("x") > 300)
    return scan(df, Ema(1 / 3), ["x"], keys=["track", "session"]).withColumn("y", r6("y"))


@query(f"WITH {SIGNAL} SELECT track, frame, event_id, round(x, 6) AS x FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY frame DESC) AS r FROM signal) WHERE r = 1")
def latest_snapshot(spark, sf):
    return sinks.latest(signal(spark, sf).select("track", "frame", "event_id", r6("x").alias("x")))


@query(f"WITH {SIGNAL} SELECT track, frame AS seq, (frame - 1) % 32 AS slot, CASE kind WHEN 'low' THEN 0 WHEN 'mid' THEN 1 WHEN 'high' THEN 2 ELSE 255 END AS kind_id FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY frame DESC) AS r FROM signal) WHERE r <= 32")
def event_ring(spark, sf):
    return sinks.ring(signal(spark, sf).select("track", F.col("frame").alias("seq"), "kind")).select("track", "seq", "slot", "kind_id")


@query(f"WITH {SIGNAL} SELECT track, frame AS seq, kind FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY frame DESC) AS r FROM signal WHERE frame > 40) WHERE r <= 32")
def new_events(spark, sf):
    return sinks.unseen(signal(spark, sf).select("track", F.col("frame").alias("seq"), "kind"), 40)


@query(f"WITH {SIGNAL}, l AS (SELECT *, lag(kind) OVER (PARTITION BY track ORDER BY frame) AS was FROM signal) SELECT track, frame, kind FROM l WHERE kind IS DISTINCT FROM was")
def mode_changes(spark, sf):
    return sinks.changes(signal(spark, sf), "kind").select("track", "frame", "kind")


@query("""
WITH f AS (SELECT * FROM (VALUES ('seq', 8), ('n_bins', 4), ('spectrum', 432), ('stability', 432), ('sustained', 432), ('centroid', 4), ('centroid_delta', 4), ('centroid_rms', 4),
  ('centroid_harmonic_rms', 4), ('slow_centroid_harmonic_rms', 4), ('percussiveness', 4), ('spectral_novelty', 4), ('section_change', 4), ('bpm', 4), ('effective_bpm', 4),
  ('tempo_confidence', 4), ('tempo_saturated', 1), ('mode', 3), ('break_intensity', 4), ('n_bands', 4), ('bands', 320), ('event_head', 4), ('event_ring', 768)) t(field, size)),
n AS (SELECT *, row_number() OVER () AS pos FROM f)
SELECT field, CAST(sum(size) OVER (ORDER BY pos) - size AS BIGINT) AS place FROM n
""")
def record_layout(spark, sf):
    """Byte offsets of the published record for 108 bins."""
    return spark.createDataFrame(list(sinks.layout(108).items()), "field string, place long").where("field <> 'total'")


@query("""
SELECT band, frame, ts FROM (
  SELECT b.band, f.range AS frame, f.range * 512 / CAST(48000 AS DOUBLE) AS ts, floor(f.range * 512 / CAST(48000 AS DOUBLE) / b.step) AS k, floor((f.range - 1) * 512 / CAST(48000 AS DOUBLE) / b.step) AS p
  FROM range(4000) f CROSS JOIN (SELECT * FROM (VALUES ('low', 0.5), ('mid', 1.0), ('high', 0.25)) t(band, step)) b)
WHERE frame > 0 AND k > p
""")
def metronome_events(spark, sf):
    return metronome.events(spark, 4000).select("band", "frame", "ts")


