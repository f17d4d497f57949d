"""Queries over scalar signals: onsets, density and tempo."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtide.functions import arrays as A
from loomtide.operators import density, onsets, tempo
from loomtide.operators.folds import AdaptiveBand, Deadband, SpringBand
from loomtide.operators.scan import scan
from loomtide.plans.spectra import by_frame
from loomtide.plans.tables import AXIS, BINNED, FREQS, SIGNAL, SPECTRA, r6, signal, spectra

QUERIES: dict = {}
SQL: dict = {}
DAY = 86_400_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Greedy choice among candidates c(track, frame, ...): at each step, a track's
#: first candidate that is far enough from the last one chosen.
_CHOSEN = """first AS (
  SELECT track, min(frame) AS frame FROM c WHERE frame - ({last}) >= {cd} GROUP BY track
), chosen AS (
  SELECT track, frame FROM first
  UNION ALL
  SELECT g.track, (SELECT min(c.frame) FROM c WHERE c.track = g.track AND c.frame - g.frame >= {cd}) AS frame FROM chosen g WHERE g.frame IS NOT NULL
)"""


@query(f"""
WITH RECURSIVE {SIGNAL}, t AS (
  SELECT *, quantile_cont(x, 0.99) OVER w AS thr, count(*) OVER w AS n FROM signal WINDOW w AS (PARTITION BY track ORDER BY frame ROWS BETWEEN 43 PRECEDING AND 1 PRECEDING)
), c AS (SELECT * FROM t WHERE n >= 10 AND x > 1e-7 AND CASE WHEN thr < 1e-7 THEN x > 1e-4 ELSE x > thr END), {_CHOSEN.format(last="0", cd=12)}
SELECT c.track, c.frame, c.event_id, round(CASE WHEN thr < 1e-7 THEN 1 ELSE least(1, (x - thr) / (thr + 1e-10)) END, 6) AS energy FROM c JOIN chosen USING (track, frame)
""")
def onset_percentile(spark, sf):
    """Percentile detector, the default one: each user is a track."""
    return onsets.percentile(signal(spark, sf)).select("track", "frame", "event_id", r6("energy").alias("energy"))


@query(f"""
WITH RECURSIVE {SIGNAL}, t AS (
  SELECT *, avg(x) OVER w AS mean, count(*) OVER w AS n, quantile_cont(x, 0.5) OVER s AS pre, count(*) OVER s AS k FROM signal
  WINDOW w AS (PARTITION BY track ORDER BY frame ROWS BETWEEN 43 PRECEDING AND 1 PRECEDING), s AS (PARTITION BY track ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT * FROM t WHERE n >= 10 AND x > 1e-7 AND (k < 4 OR pre <= 1e-7 OR x / pre >= 1 + 2 / (1 + pre * 10)) AND CASE WHEN mean < 1e-7 THEN x > 1e-4 ELSE x > mean * 1.5 END
), {_CHOSEN.format(last="0", cd=12)}
SELECT c.track, c.frame, c.event_id, round(CASE WHEN mean < 1e-7 THEN 1 ELSE least(1, (x / mean - 1.5) / 1.5) END, 6) AS energy FROM c JOIN chosen USING (track, frame)
""")
def onset_flux(spark, sf):
    """Mean-flux detector with the sharpness gate."""
    return onsets.flux(signal(spark, sf)).select("track", "frame", "event_id", r6("energy").alias("energy"))


@query(f"""
WITH RECURSIVE {SIGNAL}, t AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM signal WINDOW w AS (PARTITION BY track ORDER BY frame)),
c AS (SELECT * FROM t WHERE x >= a AND x >= b AND x >= 100), {_CHOSEN.format(last="-1099511627776", cd=5)}
SELECT c.track, c.frame, c.event_id FROM c JOIN chosen USING (track, frame)
""")
def peak_pick(spark, sf):
    return onsets.peaks(signal(spark, sf), threshold=100.0, distance=5).select("track", "frame", "event_id")


_ACT = "act AS (SELECT track, frame, least(1, x / 490) AS b, CASE WHEN kind = 'low' THEN least(1, x / 490) * 0.9 ELSE 0.1 END AS d, least(1, x / 245) AS o FROM signal)"


def _activations(spark, sf):
    x = F.least(F.lit(1.0), F.col("x") / 490.0)
    return signal(spark, sf).select("track", "frame", x.alias("beat"), F.when(F.col("kind") == "low", x * 0.9).otherwise(F.lit(0.1)).alias("downbeat"), F.least(F.lit(1.0), F.col("x") / 245.0).alias("onset"))


@query(f"""
WITH RECURSIVE {SIGNAL}, {_ACT}, t AS (SELECT *, lag(b) OVER w AS b2, lag(b, 2) OVER w AS b1, lag(d) OVER w AS d2 FROM act WINDOW w AS (PARTITION BY track ORDER BY frame)),
c AS (SELECT * FROM t WHERE b1 IS NOT NULL AND b2 >= 0.3 AND b2 > b1 AND b2 >= b), {_CHOSEN.format(last="-1099511627776", cd=3)}
SELECT c.track, c.frame, CASE WHEN 2 * d2 > b2 AND d2 >= 0.15 THEN 'low' ELSE 'mid' END AS kind, round(b2, 6) AS energy FROM c JOIN chosen USING (track, frame)
""")
def beat_peaks(spark, sf):
    """Activation peaks; a downbeat's own distance is never shorter than a beat's."""
    return onsets.beat_peaks(_activations(spark, sf)).withColumn("energy", r6("energy"))


@query(f"""
WITH RECURSIVE {SIGNAL}, {_ACT}, t AS (
  SELECT track, frame + 9 AS frame, b, d, o, count(*) OVER w AS n, max(b) OVER w AS mb, max(d) OVER w AS md, max(o) OVER w AS mo FROM act
  WINDOW w AS (PARTITION BY track ORDER BY frame ROWS BETWEEN 9 PRECEDING AND 9 FOLLOWING)
), h AS (SELECT *, CASE WHEN d >= 0.15 THEN 'low' WHEN b >= 0.3 THEN 'mid' WHEN o >= 0.3 THEN 'high' END AS kind FROM t WHERE n = 19),
c AS (SELECT * FROM h WHERE CASE kind WHEN 'low' THEN d >= md WHEN 'mid' THEN b >= mb WHEN 'high' THEN o >= mo END), {_CHOSEN.format(last="-1099511627776", cd=9)}
SELECT c.track, c.frame, kind, CAST(1 AS DOUBLE) AS energy FROM c JOIN chosen USING (track, frame)
""")
def head_peaks(spark, sf):
    return onsets.head_peaks(_activations(spark, sf))


@query(f"WITH {SIGNAL} SELECT track, frame, event_id, kind FROM signal WHERE kind IN ('low', 'mid') AND x > 200")
def onset_filter_chain(spark, sf):
    return onsets.accept(signal(spark, sf), lambda e: e.kind.isin("low", "mid"), lambda e: e.x > 200).select("track", "frame", "event_id", "kind")


@query(f"""
WITH {SIGNAL}, d AS (SELECT *, count(*) OVER (PARTITION BY track, kind ORDER BY ts RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW) AS n FROM signal)
SELECT event_id, track, kind, round(n / 7.0, 6) AS density FROM d
""")
def density_rate(spark, sf):
    """Onsets a day over a week: the gaps of users are hours, not frames."""
    return density.rate(signal(spark, sf), 7 * DAY, seconds=7.0).select("event_id", "track", "kind", r6("raw").alias("density"))


@query(f"""
WITH RECURSIVE {SIGNAL}, d AS (
  SELECT event_id, track, kind, ts, count(*) OVER (PARTITION BY track, kind ORDER BY ts RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW) / 7.0 AS raw,
    row_number() OVER (PARTITION BY track, kind ORDER BY ts, event_id) AS n FROM signal
), e AS (
  SELECT event_id, track, kind, ts, n, 0.2 * raw AS fast, 0.05 * raw AS slow FROM d WHERE n = 1
  UNION ALL SELECT d.event_id, d.track, d.kind, d.ts, d.n, 0.8 * fast + 0.2 * d.raw, 0.95 * slow + 0.05 * d.raw FROM e JOIN d ON d.track = e.track AND d.kind = e.kind AND d.n = e.n + 1
), w AS (
  SELECT *, count(*) OVER w AS k, first_value(fast) OVER w AS old FROM e WINDOW w AS (PARTITION BY track, kind ORDER BY ts RANGE BETWEEN 1209600 PRECEDING AND CURRENT ROW)
)
SELECT event_id, track, kind, round(fast, 6) AS fast, round(slow, 6) AS slow, round(CASE WHEN k < 2 THEN 0 ELSE fast - old END, 6) AS delta FROM w
""")
def density_trend(spark, sf):
    rates = density.rate(signal(spark, sf), 7 * DAY, seconds=7.0)
    out = density.delta(density.smoothed(rates, 0.8, 0.95), 14 * DAY)
    return out.select("event_id", "track", "kind", r6("fast").alias("fast"), r6("slow").alias("slow"), r6("delta").alias("delta"))


@query(f"""
WITH RECURSIVE {SIGNAL}, d AS (
  SELECT event_id, track, kind, ts, count(*) OVER (PARTITION BY track, kind ORDER BY ts RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW) / 7.0 AS raw,
    row_number() OVER (PARTITION BY track, kind ORDER BY ts, event_id) AS n FROM signal
), e AS (
  SELECT event_id, track, kind, ts, n, 0.05 * raw AS slow FROM d WHERE n = 1
  UNION ALL SELECT d.event_id, d.track, d.kind, d.ts, d.n, 0.95 * slow + 0.05 * d.raw FROM e JOIN d ON d.track = e.track AND d.kind = e.kind AND d.n = e.n + 1
)
SELECT event_id, track, round(coalesce(last_value(CASE WHEN kind = 'low' THEN slow END IGNORE NULLS) OVER w, 0) + coalesce(last_value(CASE WHEN kind = 'mid' THEN slow END IGNORE NULLS) OVER w, 0)
  + coalesce(last_value(CASE WHEN kind = 'high' THEN slow END IGNORE NULLS) OVER w, 0), 6) AS total
FROM e WINDOW w AS (PARTITION BY track ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def density_total(spark, sf):
    """Sum over bands of each band's smoothed density."""
    rates = density.rate(signal(spark, sf), 7 * DAY, seconds=7.0)
    out = density.total(density.smoothed(rates, 0.8, 0.95), ["low", "mid", "high"])
    return out.select("event_id", "track", r6("total").alias("total"))


_RATE = f"""{SIGNAL}, kept AS (SELECT *, ts / 3600 AS h FROM signal WHERE kind IN ('low', 'mid')), i AS (
  SELECT *, h - lag(h) OVER (PARTITION BY track ORDER BY frame) AS ibi FROM kept
), r AS (
  SELECT *, quantile_cont(ibi, 0.5) OVER w AS med, avg(ibi) OVER w AS mean, stddev_samp(ibi) OVER w AS sd, count(ibi) OVER w AS n FROM i
  WINDOW w AS (PARTITION BY track ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
), br AS (
  SELECT event_id, track, frame, x, CASE WHEN med > 0 THEN 60 / med END AS rate, coalesce(n >= 2 AND mean > 0 AND sd / mean <= 0.8, false) AS stable FROM r
)"""


def _beat_rate(spark, sf):
    """Beats by the hour; intervals vary so much that stable means 0.8 here."""
    beats = signal(spark, sf).withColumn("seq", F.col("frame")).withColumn("ts", F.col("ts") / 3600.0)
    return tempo.beat_rate(beats, 6, 0.8)


@query(f"WITH {_RATE} SELECT event_id, track, round(rate, 6) AS beat_rate, stable FROM br")
def beat_rate(spark, sf):
    return _beat_rate(spark, sf).select("event_id", "track", r6("beat_rate").alias("beat_rate"), "stable")


_OCT = "s AS (SELECT *, CASE WHEN x <= 0 THEN 1.0 ELSE (SELECT arg_min(f, (abs(x * f - rate) / greatest(rate, 1e-6), i)) FROM (VALUES (1, CAST(1 AS DOUBLE) / 3), (2, 0.5), (3, 1.0), (4, 2.0), (5, 3.0)) o(i, f)) END AS f FROM br)"
_GAP = "abs({0} - rate) / greatest(rate, 1e-6) <= 0.05"


def _reconciled(spark, sf, method):
    df = _beat_rate(spark, sf)
    return df.select("event_id", tempo.reconcile(F.col("x"), F.col("beat_rate"), F.col("stable"), method).alias("r")).select("event_id", r6("r.bpm").alias("bpm"), "r.trustable", r6("r.octave_factor").alias("octave_factor"), "r.tracker_agreed")


@query(f"""
WITH {_RATE}, k AS (SELECT *, rate IS NOT NULL AND stable AS ok FROM br)
SELECT event_id, round(CASE WHEN ok AND NOT ({_GAP.format("x")}) THEN rate ELSE x END, 6) AS bpm, ok AS trustable, CAST(1 AS DOUBLE) AS octave_factor, ok AND {_GAP.format("x")} AS tracker_agreed FROM k
""")
def reconcile_override(spark, sf):
    return _reconciled(spark, sf, "override")


@query(f"""
WITH {_RATE}, {_OCT}, k AS (SELECT *, rate IS NOT NULL AND stable AS ok FROM s)
SELECT event_id, round(CASE WHEN ok THEN x * f ELSE x END, 6) AS bpm, ok AS trustable, round(CASE WHEN ok THEN f ELSE 1 END, 6) AS octave_factor, ok AND f = 1 AS tracker_agreed FROM k
""")
def reconcile_octave_shift(spark, sf):
    return _reconciled(spark, sf, "shift")


@query(f"""
WITH {_RATE}, {_OCT}, k AS (SELECT *, rate IS NOT NULL AND stable AS ok, f IN (0.5, 2) AND {_GAP.format("x * f")} AS act FROM s)
SELECT event_id, round(CASE WHEN ok AND act THEN x * f ELSE x END, 6) AS bpm, ok AS trustable, CASE WHEN ok AND act THEN CAST(f AS DOUBLE) ELSE 1 END AS octave_factor, ok AND NOT act AS tracker_agreed FROM k
""")
def reconcile_octave_only(spark, sf):
    return _reconciled(spark, sf, "octave")


#: A short window, so that users' few frames give estimates: lags 2 to 10 of 24 frames.
_ACF = {"hop": 0.1, "seconds": 2.45, "interval": 0.4, "min_bpm": 60.0, "max_bpm": 300.0}


@query(f"""
WITH RECURSIVE {SIGNAL}, pad AS (
  SELECT track, frame, x, CAST(frame % 5 AS DOUBLE) AS density FROM signal UNION ALL
  SELECT track, 1 - k, 0, 0 FROM (SELECT DISTINCT track FROM signal) CROSS JOIN (SELECT range AS k FROM range(1, 24))
), win AS (
  SELECT track, frame, density, list(x) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS v FROM pad
), a AS (
  SELECT track, frame, density, list_avg(v) AS mu, v FROM win WHERE frame >= 12 AND frame % 4 = 0
), z AS (
  SELECT track, frame, density, list_transform(v, lambda q: q - mu) AS v, sqrt(list_avg(list_transform(v, lambda q: (q - mu) * (q - mu)))) AS sd FROM a
), n AS (SELECT track, frame, density, list_transform(v, lambda q: q / sd) AS v FROM z WHERE sd >= 1e-10),
acf AS (
  SELECT track, frame, density, k, list_sum(list_transform(range(1, 25 - k), lambda i: v[i] * v[i + k])) AS c FROM n CROSS JOIN (SELECT range AS k FROM range(24))
), rel AS (SELECT a.track, a.frame, a.density, a.k, a.c / (b.c + 1e-10) AS c FROM acf a JOIN acf b ON b.track = a.track AND b.frame = a.frame AND b.k = 0),
lag_ AS (SELECT range AS k, 60 / (range * 0.1) AS bpm, exp(-0.5 * pow(log2(60 / (range * 0.1) / 110) / 1.4, 2)) AS prior FROM range(2, 11)),
score AS (
  SELECT r.track, r.frame, r.density, r.k, bpm, r.c, r.c * prior + coalesce(r2.c * prior * 0.25, 0) + coalesce(r3.c * prior * (CAST(0.5 AS DOUBLE) / 3), 0) AS s FROM rel r JOIN lag_ USING (k)
  LEFT JOIN rel r2 ON r2.track = r.track AND r2.frame = r.frame AND r2.k = 2 * r.k LEFT JOIN rel r3 ON r3.track = r.track AND r3.frame = r.frame AND r3.k = 3 * r.k
), best AS (SELECT track, frame, density, arg_max(k, (s, -k)) AS k, max(s) AS s FROM score GROUP BY ALL),
top AS (SELECT track, frame, avg(s) AS m FROM (SELECT *, row_number() OVER (PARTITION BY track, frame ORDER BY s DESC) AS r FROM score) WHERE r <= 3 GROUP BY ALL),
pick AS (
  SELECT b.track, b.frame, CASE WHEN h.s > 0.3 * b.s AND b.density > o.bpm / 60 * 3.5 * 1.5 THEN h.k ELSE b.k END AS k FROM best b
  JOIN score o ON o.track = b.track AND o.frame = b.frame AND o.k = b.k LEFT JOIN score h ON h.track = b.track AND h.frame = b.frame AND h.k = b.k // 2
)
SELECT p.track, p.frame, round(bpm, 6) AS raw_bpm, round(least(1, c * 2 * least(CASE WHEN m > 0 THEN s / m ELSE 1 END, 3)), 6) AS confidence
FROM pick p JOIN score USING (track, frame, k) JOIN top USING (track, frame)
""")
def tempo_autocorrelation(spark, sf):
    df = signal(spark, sf).withColumn("strength", F.col("x")).withColumn("density", (F.col("frame") % 5).cast("double"))
    return tempo.autocorrelation(df, **_ACF).select("track", "frame", r6("raw_bpm").alias("raw_bpm"), r6("confidence").alias("confidence"))


@query(f"""
WITH RECURSIVE {SIGNAL}, t AS (SELECT track, frame, x AS raw, least(1, x / 200) AS c FROM signal), s AS (
  SELECT track, frame, raw, c, CASE WHEN c >= 0.15 THEN raw ELSE CAST(0 AS DOUBLE) END AS bpm, c >= 0.15 AS has,
    CASE WHEN c >= 0.3 THEN [raw] ELSE CAST([] AS DOUBLE[]) END AS recent, CAST(0 AS DOUBLE) AS temporal, CASE WHEN c >= 0.15 THEN c ELSE 0 END AS conf,
    CASE WHEN c >= 0.5 THEN raw ELSE 120 END AS last, CASE WHEN c >= 0.15 THEN 0.7 * raw ELSE 0 END AS fast, CASE WHEN c >= 0.15 THEN 0.15 * raw ELSE 0 END AS slow FROM t WHERE frame = 1
  UNION ALL
  SELECT track, frame, raw, c, bpm, has, recent, temporal, conf, CASE WHEN go AND conf >= 0.5 THEN bpm ELSE last END,
    CASE WHEN go THEN 0.3 * fast + 0.7 * bpm ELSE fast END, CASE WHEN go THEN 0.85 * slow + 0.15 * bpm ELSE slow END
  FROM (SELECT *, CASE WHEN go THEN greatest(c, least(temporal, c * 2.5)) ELSE was END AS conf FROM (
    SELECT *, CASE WHEN go AND len(recent) >= 3 THEN least(1, greatest(0, 1 - 10 * sqrt(list_avg(list_transform(recent, lambda q: (q - mean) * (q - mean)))) / mean)) ELSE old END AS temporal FROM (
      SELECT *, list_avg(recent) AS mean FROM (
        SELECT t.track, t.frame, t.raw, t.c, s.has OR t.c >= 0.15 AS go, s.has OR t.c >= 0.15 AS has, s.conf AS was, s.temporal AS old, s.last, s.fast, s.slow,
          CASE WHEN NOT (s.has OR t.c >= 0.15) THEN s.bpm WHEN NOT s.has THEN t.raw
            WHEN (t.raw / s.bpm > 0.45 AND t.raw / s.bpm < 0.55) OR (t.raw / s.bpm > 1.9 AND t.raw / s.bpm < 2.1) THEN CASE WHEN t.c > s.conf * 1.5 THEN t.raw ELSE s.bpm END
            ELSE 0.8 * s.bpm + (1 - CAST(0.8 AS DOUBLE)) * t.raw END AS bpm,
          CASE WHEN (s.has OR t.c >= 0.15) AND t.c >= 0.3 THEN list_concat(s.recent, [t.raw])[-10:] ELSE s.recent END AS recent
        FROM s JOIN t ON t.track = s.track AND t.frame = s.frame + 1))))
)
SELECT track, frame, floor(bpm * 1e6 + 0.5) / 1e6 AS bpm, floor(conf * 1e6 + 0.5) / 1e6 AS confidence, floor(CASE WHEN has THEN last * (1 - conf) + bpm * conf ELSE last END * 1e6 + 0.5) / 1e6 AS effective_bpm, floor((fast - slow) * 1e6 + 0.5) / 1e6 AS bpm_delta FROM s
""")
def tempo_smoothing(spark, sf):
    df = signal(spark, sf).select("track", "frame", F.col("x").alias("raw_bpm"), F.least(F.lit(1.0), F.col("x") / 200.0).alias("confidence"))
    return tempo.smoothed(df).select("track", "frame", *[(F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in ("bpm", "confidence", "effective_bpm", "bpm_delta")])


@query(f"""
WITH RECURSIVE {SIGNAL}, t AS (SELECT track, frame, x AS raw, (frame % 11) / CAST(10 AS DOUBLE) AS c FROM signal), k AS (SELECT CAST(512 AS DOUBLE) / 48000 AS hop), s AS (
  SELECT track, 0 AS frame, CAST(120 AS DOUBLE) AS bpm, CAST(0 AS DOUBLE) AS delta, 0 AS railed FROM (SELECT DISTINCT track FROM t)
  UNION ALL
  SELECT t.track, CAST(t.frame AS INTEGER), CASE WHEN c < 0.05 THEN bpm ELSE (1 - hop / 2) * bpm + hop / 2 * raw END,
    CASE WHEN c < 0.05 THEN (1 - hop / 5) * delta ELSE (1 - hop / 5) * delta + hop / 5 * (((1 - hop / 2) * bpm + hop / 2 * raw) - bpm) / hop END,
    CASE WHEN c < 0.05 THEN railed WHEN raw <= 55.5 OR raw >= 214.5 THEN least(railed + 1, 100) ELSE greatest(0, railed - 1) END
  FROM s JOIN t ON t.track = s.track AND t.frame = s.frame + 1, k
)
SELECT track, CAST(frame AS BIGINT) AS frame, round(bpm, 6) AS bpm, round(delta, 6) AS bpm_delta, railed > 30 AS saturated FROM s WHERE frame > 0
""")
def particle_tempo(spark, sf):
    df = signal(spark, sf).select("track", "frame", F.col("x").alias("bpm"), ((F.col("frame") % 11) / 10.0).alias("confidence"))
    return tempo.particle(df).select("track", "frame", r6("bpm").alias("bpm"), r6("bpm_delta").alias("bpm_delta"), "saturated")


@query(f"""
WITH RECURSIVE {SIGNAL}, s AS (
  SELECT track, frame, CASE WHEN abs(x) > 50 THEN x ELSE CAST(0 AS DOUBLE) END AS last, abs(x) > 50 AS sent FROM signal WHERE frame = 1
  UNION ALL SELECT n.track, n.frame, CASE WHEN abs(n.x - s.last) > 50 THEN n.x ELSE s.last END, abs(n.x - s.last) > 50 FROM s JOIN signal n ON n.track = s.track AND n.frame = s.frame + 1
)
SELECT track, frame, round(last, 6) AS sent FROM s WHERE sent
""")
def tempo_deadband(spark, sf):
    return scan(signal(spark, sf), Deadband(50.0), ["x"]).withColumn("sent", r6("sent"))


@query()
def tempo_percival(spark, sf):
    df = signal(spark, sf).withColumn("strength", F.col("x") / 490.0)
    return tempo.percival(df, hop=0.1, min_bpm=60.0, max_bpm=300.0, seconds=3.2, interval=0.8).select("track", "frame", r6("raw_bpm").alias("raw_bpm"), r6("confidence").alias("confidence"), r6("bpm").alias("bpm"), "phase")


@query("SELECT event_id FROM events WHERE event_id % 100 = 0 AND value / 1000 < 0.10 AND value / 50 >= 0.50 AND value > 0")
def tracker_hints(spark, sf):
    """Hops at which a sure tempo is passed on to an unsure filter."""
    x = F.col("x")
    return signal(spark, sf).where(tempo.hint_due(F.col("event_id"), x / 1000.0, x / 50.0, x)).select("event_id")


def _with_flux(spark, sf):
    return spectra(spark, sf).withColumn("flux", A.rises(F.col("mag"), F.lag("mag").over(by_frame())))


@query()
def adaptive_band(spark, sf):
    """Weights of the mid band that follow its flux, and the flux they give."""
    allowed = [1.0 if 150 <= f < 2000 else 0.0 for f in FREQS]
    out = scan(_with_flux(spark, sf), AdaptiveBand(A.uniform_weights(FREQS, 200, 1000), allowed), ["flux"])
    return out.select("track", "frame", r6(A.total(F.col("weights"))).alias("mass"), r6("band_flux").alias("band_flux"))


_DB, _DA = 0.05, 0.95


@query(f"""
WITH RECURSIVE {BINNED}, {AXIS}, fl AS (
  SELECT track, frame, list(d ORDER BY bin) AS d FROM (SELECT track, frame, bin, greatest(m - coalesce(lag(m) OVER (PARTITION BY track, bin ORDER BY frame), m), 0) AS d FROM binned) GROUP BY ALL
), fs AS (SELECT list(CASE WHEN f >= 150 AND f < 2000 THEN f END ORDER BY bin) AS f FROM axis), tick AS (SELECT track, frame // 9 AS n, d FROM fl WHERE frame % 9 = 0), s AS (
  SELECT track, 0 AS n, CAST(600 AS DOUBLE) AS centre, list_transform(range(64), lambda i: CAST(0 AS DOUBLE)) AS slow FROM (SELECT DISTINCT track FROM fl)
  UNION ALL
  SELECT track, n, greatest(550, least(1600, centre + 0.3 * (600 - centre) + 0.5 * (CASE WHEN mass >= 1e-10 THEN fm / mass ELSE 600 END - centre))), slow FROM (
    SELECT *, list_sum(list_transform(list_zip(slow, f), lambda q: CASE WHEN q[2] IS NULL THEN 0 ELSE q[1] END)) AS mass,
      list_sum(list_transform(list_zip(slow, f), lambda q: CASE WHEN q[2] IS NULL THEN 0 ELSE q[1] * q[2] END)) AS fm FROM (
      SELECT t.track, CAST(t.n AS INTEGER) AS n, centre, f, list_transform(list_zip(slow, t.d), lambda q: {_DA} * q[1] + CAST({_DB} AS DOUBLE) * q[2]) AS slow
      FROM s JOIN tick t ON t.track = s.track AND t.n = s.n + 1, fs))
)
SELECT fl.track, fl.frame, round(centre, 4) AS centre FROM fl JOIN s ON s.track = fl.track AND s.n = fl.frame // 9
""")
def spring_band(spark, sf):
    """The mid band's centre without neighbours and in unsteady sound."""
    df = _with_flux(spark, sf).withColumn("calm", F.transform("mag", lambda m: F.lit(0.0))).withColumn("others", F.lit(None).cast("array<double>"))
    return scan(df, SpringBand(FREQS, 200.0, 1000.0, (150.0, 2000.0)), ["flux", "calm", "others"]).withColumn("centre", F.round("centre", 4))
