"""Queries over spectra: transforms, stability and energy features."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtide.functions import arrays as A
from loomtide.functions import timing
from loomtide.operators import stability as S
from loomtide.operators.folds import Centroid, ComplexDifference, Ema, Energy, Novelty
from loomtide.operators.scan import scan
from loomtide.plans.tables import AXIS, BINNED, FREQS, SPECTRA, per_bin, r6, spectra
from loomtide.schema import BANDS, alpha_for, alpha_for_seconds

WEIGHTS = A.a_weights(FREQS)
QUERIES: dict = {}
SQL: dict = {}


def by_frame():
    return Window.partitionBy("track").orderBy("frame")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {BINNED} SELECT track, frame, bin, round(ln(1 + 1000 * m) / ln(1001), 6) AS log_mag FROM binned")
def spectrum_log_magnitude(spark, sf):
    return per_bin(spectra(spark, sf).withColumn("log_mag", A.log_magnitude(F.col("mag"))), "log_mag")


@query(f"WITH {BINNED} SELECT track, frame, bin, round(greatest(m - coalesce(lag(m) OVER (PARTITION BY track, bin ORDER BY frame), m), 0), 6) AS flux FROM binned")
def spectrum_flux(spark, sf):
    return per_bin(spectra(spark, sf).withColumn("flux", A.rises(F.col("mag"), F.lag("mag").over(by_frame()))), "flux")


@query(f"""
WITH RECURSIVE {BINNED}, raw AS (
  SELECT track, frame, bin, CASE WHEN p2 IS NOT NULL THEN sqrt(pow(greatest(m - m1, 0), 2) + pow(m * sin(d - 2 * pi() * floor((d + pi()) / (2 * pi()))), 2)) END AS raw
  FROM (SELECT *, p - 2 * p1 + p2 AS d FROM (
    SELECT track, frame, bin, m, p, lag(m) OVER w AS m1, lag(p) OVER w AS p1, lag(p, 2) OVER w AS p2 FROM binned WINDOW w AS (PARTITION BY track, bin ORDER BY frame)))
), s AS (
  SELECT track, frame, bin, raw, raw AS mu FROM raw WHERE frame = 3
  UNION ALL
  SELECT r.track, r.frame, r.bin, r.raw, s.mu + 0.05 * (r.raw - s.mu) FROM s JOIN raw r ON r.track = s.track AND r.bin = s.bin AND r.frame = s.frame + 1
)
SELECT r.track, r.frame, r.bin, round(coalesce(greatest(s.raw - s.mu, 0), 0), 6) AS flux FROM raw r LEFT JOIN s USING (track, frame, bin)
""")
def spectrum_complex_difference(spark, sf):
    return per_bin(scan(spectra(spark, sf), ComplexDifference(), ["mag", "phase"]), "flux")


@query(f"""
WITH {BINNED}
SELECT track, frame, bin, round(greatest(m - coalesce(lag(m, 12) OVER w / 2, 0) - coalesce(lag(m, 19) OVER w / 4, 0) - coalesce(lag(m, 24) OVER w / 8, 0)
  - coalesce(lag(m, 28) OVER w / 16, 0) - coalesce(lag(m, 31) OVER w / 32, 0), 0), 6) AS collapsed
FROM binned WINDOW w AS (PARTITION BY track, frame ORDER BY bin)
""")
def spectrum_f0_collapse(spark, sf):
    return per_bin(spectra(spark, sf).withColumn("collapsed", A.collapse_harmonics(F.col("mag"))), "collapsed")


@query(f"WITH {AXIS} SELECT CAST(bin AS BIGINT) AS bin, round(f, 6) AS freq, round(w, 6) AS weight FROM axis")
def axis_a_weights(spark, sf):
    return spark.range(len(FREQS)).select(F.col("id").alias("bin"), r6(F.get(A.literal(FREQS), F.col("id").cast("int"))).alias("freq"), r6(F.get(A.literal(WEIGHTS), F.col("id").cast("int"))).alias("weight"))


_BANDS = "bands AS (SELECT * FROM (VALUES ('subbass', 20.0, 200.0), ('low', 30.0, 200.0), ('mid', 200.0, 1000.0), ('high', 1000.0, 24000.0)) t(band, lo, hi))"


@query(f"WITH {AXIS}, {_BANDS} SELECT band, CAST(bin AS BIGINT) AS bin, round(1.0 / count(*) OVER (PARTITION BY band), 6) AS weight FROM bands JOIN axis ON f >= lo AND f < hi")
def band_masks(spark, sf):
    """Range join of the axis with the bands; both are fixed small tables."""
    rows = [(b.name, i, w) for b in BANDS for i, w in enumerate(A.uniform_weights(FREQS, b.lo, b.hi)) if w]
    return spark.createDataFrame(rows, "band string, bin long, weight double").withColumn("weight", r6("weight"))


@query(f"""
WITH {BINNED}, t AS (SELECT *, ln(1 + 770 * m) AS g FROM binned), d AS (
  SELECT *, greatest(g - coalesce(lag(g) OVER (PARTITION BY track, bin ORDER BY frame), g), 0) AS r FROM t)
SELECT track, frame, bin, round(g, 6) AS feature FROM d UNION ALL SELECT track, frame, bin + 64, round(r, 6) FROM d
""")
def rnn_features(spark, sf):
    g = F.transform("mag", lambda m: F.log1p(F.lit(770.0) * m))
    df = spectra(spark, sf).withColumn("g", g)
    return per_bin(df.withColumn("feature", F.concat("g", A.rises(F.col("g"), F.lag("g").over(by_frame())))), "feature")


_VARIABILITY = """v AS (
  SELECT track, frame, bin, m, {b} * m AS mean, {a} * 0 + {b} * m * (m - {b} * m) AS var FROM {t} WHERE frame = 1
  UNION ALL
  SELECT n.track, n.frame, n.bin, n.m, {a} * v.mean + {b} * n.m, {a} * v.var + {b} * (n.m - v.mean) * (n.m - ({a} * v.mean + {b} * n.m))
  FROM v JOIN {t} n ON n.track = v.track AND n.bin = v.bin AND n.frame = v.frame + 1
)"""
_EMA_ALPHA = alpha_for(23.4375)
_STABLE = _VARIABILITY.format(a=repr(_EMA_ALPHA), b=repr(1 - _EMA_ALPHA), t="binned")


@query(f"WITH RECURSIVE {BINNED}, {_STABLE} SELECT track, frame, bin, round(mean, 6) AS mean, round(var, 6) AS variance, round(1 / (1 + sqrt(var) / (mean + 1e-10)), 6) AS stability FROM v")
def stability_ema(spark, sf):
    return per_bin(S.ema(spectra(spark, sf), _EMA_ALPHA), "mean", "variance", "stability")


@query(f"""
WITH {BINNED}, near AS (
  SELECT a.track, a.frame, a.bin, median(b.m) AS p FROM binned a
  JOIN (SELECT range AS k FROM range(-7, 8)) o ON true
  JOIN binned b ON b.track = a.track AND b.frame = a.frame AND b.bin = CASE WHEN a.bin + k < 0 THEN -(a.bin + k) WHEN a.bin + k > 63 THEN 126 - (a.bin + k) ELSE a.bin + k END
  GROUP BY ALL
), held AS (
  SELECT track, frame, bin, quantile_cont(m, 0.5) OVER (PARTITION BY track, bin ORDER BY frame ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS h FROM binned
)
SELECT track, frame, bin, round(h, 6) AS sustained, round(CASE WHEN h + p > 1e-10 THEN h / (h + p + 1e-10) ELSE 1 END, 6) AS stability
FROM held JOIN near USING (track, frame, bin)
""")
def stability_median(spark, sf):
    """Causal median HPSS over 31 frames."""
    return per_bin(S.median(spectra(spark, sf), 31, 15), "sustained", "stability")


@query(f"""
WITH RECURSIVE {BINNED}, e AS (
  SELECT track, frame, bin, m, m AS after FROM binned WHERE frame = 1
  UNION ALL
  SELECT n.track, n.frame, n.bin, n.m, 0.95 * e.after + (1 - 0.95) * n.m FROM e JOIN binned n ON n.track = e.track AND n.bin = e.bin AND n.frame = e.frame + 1
), pair AS (
  SELECT track, frame, bin, m, lag(after) OVER (PARTITION BY track, bin ORDER BY frame) AS slow FROM e
), patch AS (
  SELECT a.track, a.frame, a.bin, sum(b.m * b.slow) AS d, sqrt(sum(b.m * b.m)) AS na, sqrt(sum(b.slow * b.slow)) AS nb FROM pair a
  JOIN (SELECT range AS k FROM range(-3, 4)) o ON true
  JOIN pair b ON b.track = a.track AND b.frame = a.frame AND b.bin = CASE WHEN a.bin + k < 0 THEN -(a.bin + k) WHEN a.bin + k > 63 THEN 126 - (a.bin + k) ELSE a.bin + k END
  GROUP BY ALL
)
SELECT track, frame, bin, round(CASE WHEN frame = 1 THEN 0.5 WHEN na < 1e-8 AND nb < 1e-8 THEN 1 ELSE 1 / (1 + exp(-40 * (least(1, greatest(0, d / (na * nb + 1e-10))) - 0.95))) END, 6) AS stability FROM patch
""")
def stability_shape(spark, sf):
    return per_bin(S.shape(spectra(spark, sf)), "stability")


@query()
def stability_composite(spark, sf):
    """Median stability beside a memory of two seconds, and what sustains."""
    out = S.composite(spectra(spark, sf).drop("phase"), "median")
    return per_bin(out, "stability", "slow_stability", "sustained")


@query(f"""
WITH RECURSIVE {BINNED}, {_STABLE}, {AXIS}, {_BANDS}, per AS (
  SELECT track, frame, band, avg(mean) AS m, avg(var) AS s, sqrt(avg(pow(v.m / (1 + sqrt(var) / (mean + 1e-10)), 2))) AS h
  FROM v JOIN axis USING (bin) JOIN bands ON f >= lo AND f < hi GROUP BY ALL
)
SELECT track, frame, band, round(CASE WHEN m < 1e-10 THEN 1 ELSE 1 / (1 + sqrt(s) / (m + 1e-10)) END, 6) AS stability, round(h, 6) AS harmonic_rms FROM per
""")
def band_stability(spark, sf):
    df = S.ema(spectra(spark, sf), _EMA_ALPHA, keep=["track", "frame", "mag"])
    each = [F.struct(F.lit(b.name).alias("band"), S.band_variability(F.col("mean"), F.col("variance"), FREQS, b).alias("stability"), S.harmonic_rms(F.col("mag"), F.col("stability"), FREQS, b).alias("harmonic_rms")) for b in BANDS]
    return df.select("track", "frame", F.explode(F.array(*each)).alias("e")).select("track", "frame", "e.band", r6("e.stability").alias("stability"), r6("e.harmonic_rms").alias("harmonic_rms"))


@query(f"""
WITH RECURSIVE {BINNED}, {_STABLE}, k AS (SELECT track, frame, bin, m, 1 / (1 + sqrt(var) / (mean + 1e-10)) AS s FROM v), x AS (
  SELECT *, greatest(m - coalesce(lag(m) OVER (PARTITION BY track, bin ORDER BY frame), m), 0) AS fl FROM k)
SELECT track, frame, bin, round(m * s, 6) AS harmonic_mag, round(fl * s, 6) AS harmonic_flux, round(m * (1 - s), 6) AS percussive_mag, round(fl * sqrt(1 - s), 6) AS percussive_flux FROM x
""")
def masked_spectra(spark, sf):
    """Harmonic and percussive parts by the stability mask."""
    df = S.ema(spectra(spark, sf), _EMA_ALPHA, keep=["track", "frame", "mag"]).withColumn("flux", A.rises(F.col("mag"), F.lag("mag").over(by_frame())))
    s = F.col("stability")
    df = df.withColumn("harmonic_mag", A.harmonic(F.col("mag"), s)).withColumn("harmonic_flux", A.harmonic(F.col("flux"), s))
    df = df.withColumn("percussive_mag", A.percussive(F.col("mag"), s)).withColumn("percussive_flux", A.percussive_flux(F.col("flux"), s))
    return per_bin(df, "harmonic_mag", "harmonic_flux", "percussive_mag", "percussive_flux")


_A, _UP, _DOWN = (alpha_for_seconds(x) for x in (0.1, 2.0, 0.5))


def _slow(y: str, x: str) -> str:
    return f"CASE WHEN {x} > {y} THEN {_UP!r} * {y} + {1 - _UP!r} * {x} ELSE {_DOWN!r} * {y} + {1 - _DOWN!r} * {x} END"


@query(f"""
WITH RECURSIVE {BINNED}, {_STABLE}, {AXIS}, {_BANDS}, raw AS (
  SELECT track, frame, band, sqrt(avg(v.m * v.m)) AS x, sqrt(avg(pow(v.m / (1 + sqrt(var) / (mean + 1e-10)), 2))) AS h
  FROM v JOIN axis USING (bin) JOIN bands ON f >= lo AND f < hi GROUP BY ALL
), e AS (
  SELECT track, frame, band, {1 - _A!r} * x AS rms, {_slow('0', f'({1 - _A!r} * x)')} AS slow_rms, {1 - _A!r} * h AS hr, {_slow('0', f'({1 - _A!r} * h)')} AS slow_hr FROM raw WHERE frame = 1
  UNION ALL
  SELECT r.track, r.frame, r.band, {_A!r} * e.rms + {1 - _A!r} * r.x, {_slow('e.slow_rms', f'({_A!r} * e.rms + {1 - _A!r} * r.x)')},
    {_A!r} * e.hr + {1 - _A!r} * r.h, {_slow('e.slow_hr', f'({_A!r} * e.hr + {1 - _A!r} * r.h)')}
  FROM e JOIN raw r ON r.track = e.track AND r.band = e.band AND r.frame = e.frame + 1
)
SELECT track, frame, band, round(rms, 6) AS rms, round(slow_rms, 6) AS slow_rms, round(hr, 6) AS harmonic_rms, round(slow_hr, 6) AS slow_harmonic_rms FROM e
""")
def energy_bands(spark, sf):
    """Band levels, their slow envelopes, and both for the harmonic part."""
    df = S.ema(spectra(spark, sf), _EMA_ALPHA, keep=["track", "frame", "mag"])
    each = [F.struct(F.lit(b.name).alias("band"), A.rms(A.band(F.col("mag"), FREQS, b)).alias("x"), S.harmonic_rms(F.col("mag"), F.col("stability"), FREQS, b).alias("h")) for b in BANDS]
    long = df.select("track", "frame", F.explode(F.array(*each)).alias("e")).select("track", "frame", "e.band", "e.x", "e.h")
    out = scan(long, Energy(), ["x", "h"], keys=["track", "band"], order=["frame"])
    return out.select("track", "frame", "band", *[r6(c).alias(c) for c in ("rms", "slow_rms", "harmonic_rms", "slow_harmonic_rms")])


_FAST, _SLOW15 = alpha_for_seconds(2.0), alpha_for_seconds(15.0)


@query(f"""
WITH RECURSIVE {BINNED}, {_STABLE}, {AXIS}, raw AS (
  SELECT track, frame, sum(f * v.m * w) / sum(v.m * w) AS c, sum(v.m * w) AS mass, list(struct_pack(f := f, m := v.m, h := v.m / (1 + sqrt(var) / (mean + 1e-10)))) AS z
  FROM v JOIN axis USING (bin) GROUP BY track, frame
), c AS (
  SELECT track, frame, CAST({_A!r} AS DOUBLE) * CAST(1000 AS DOUBLE) + {1 - _A!r} * c AS c, CAST(1000 AS DOUBLE) AS was, mass, z FROM raw WHERE frame = 1
  UNION ALL SELECT r.track, r.frame, {_A!r} * c.c + {1 - _A!r} * r.c, c.c, r.mass, r.z FROM c JOIN raw r ON r.track = c.track AND r.frame = c.frame + 1
), near AS (
  SELECT track, frame, c, was, (log2(greatest(c, 20)) - log2(20)) / log2(1000) AS place, mass / 1024 AS loud,
    list_transform(list_filter(z, lambda q: q.f >= c / 2 AND q.f <= c * 2), lambda q: q.m * q.m) AS mm,
    list_transform(list_filter(z, lambda q: q.f >= c / 2 AND q.f <= c * 2), lambda q: q.h * q.h) AS hh FROM c
), n AS (SELECT *, sqrt(list_avg(mm)) AS x, sqrt(list_avg(hh)) AS h FROM near), e AS (
  SELECT track, frame, c, was, {1 - _A!r} * x AS level, {1 - _A!r} * h AS hl, {_slow('0', 'h')} AS shl,
    {_FAST!r} * 0.5 + {1 - _FAST!r} * place AS cf, {_SLOW15!r} * 0.5 + {1 - _SLOW15!r} * place AS cs, {1 - _FAST!r} * loud AS ef, {1 - _SLOW15!r} * loud AS es FROM n WHERE frame = 1
  UNION ALL
  SELECT n.track, n.frame, n.c, n.was, {_A!r} * level + {1 - _A!r} * n.x, {_A!r} * hl + {1 - _A!r} * n.h, {_slow('shl', 'n.h')},
    {_FAST!r} * cf + {1 - _FAST!r} * n.place, {_SLOW15!r} * cs + {1 - _SLOW15!r} * n.place, {_FAST!r} * ef + {1 - _FAST!r} * n.loud, {_SLOW15!r} * es + {1 - _SLOW15!r} * n.loud
  FROM e JOIN n ON n.track = e.track AND n.frame = e.frame + 1
)
SELECT track, frame, round(c, 4) AS centroid, round(abs(c - was), 4) AS centroid_delta, round(level, 6) AS centroid_rms, round(hl, 6) AS harmonic_centroid_rms,
  round(shl, 6) AS slow_harmonic_centroid_rms, round(sqrt(pow(cf - cs, 2) + pow(ef - es, 2)), 6) AS section_change FROM e
""")
def energy_centroid(spark, sf):
    """The centroid, levels around it, and section change."""
    df = S.ema(spectra(spark, sf), _EMA_ALPHA, keep=["track", "frame", "mag"])
    out = scan(df, Centroid(FREQS, WEIGHTS), ["mag", "stability"])
    return out.select("track", "frame", F.round("centroid", 4).alias("centroid"), F.round("centroid_delta", 4).alias("centroid_delta"), *[r6(c).alias(c) for c in ("centroid_rms", "harmonic_centroid_rms", "slow_harmonic_centroid_rms", "section_change")])


_N = alpha_for(round(0.5 * 46.875))


@query(f"""
WITH RECURSIVE {SPECTRA}, unit AS (
  SELECT track, frame, list_transform(mag, lambda q: q / k) AS x FROM (SELECT *, sqrt(list_sum(list_transform(mag, lambda q: q * q))) AS k FROM spectra)
), e AS (
  SELECT track, frame, x AS shape, CAST(0 AS DOUBLE) AS y FROM unit WHERE frame = 1
  UNION ALL
  SELECT track, frame, list_transform(moved, lambda q: q / sqrt(list_sum(list_transform(moved, lambda r: r * r)))), {_N!r} * y + {1 - _N!r} * least(1, greatest(0, 1 - dist))
  FROM (
    SELECT u.track, u.frame, e.y, list_sum(list_transform(list_zip(e.shape, u.x), lambda q: q[1] * q[2])) AS dist,
      list_transform(list_zip(e.shape, u.x), lambda q: {_N!r} * q[1] + {1 - _N!r} * q[2]) AS moved
    FROM e JOIN unit u ON u.track = e.track AND u.frame = e.frame + 1)
)
SELECT track, frame, round(y, 6) AS novelty FROM e
""")
def spectral_novelty(spark, sf):
    return scan(spectra(spark, sf), Novelty(_N), ["mag"]).withColumn("novelty", r6("novelty"))


@query(f"""
WITH RECURSIVE {BINNED}, {AXIS}, fl AS (SELECT *, greatest(m - coalesce(lag(m) OVER (PARTITION BY track, bin ORDER BY frame), m), 0) AS d FROM binned), raw AS (
  SELECT track, frame, sum(d) / sum(m * w) AS x FROM fl JOIN axis USING (bin) GROUP BY ALL
), e AS (
  SELECT track, frame, {_N!r} * 0.5 + {1 - _N!r} * x AS y FROM raw WHERE frame = 1
  UNION ALL SELECT r.track, r.frame, {_N!r} * y + {1 - _N!r} * r.x FROM e JOIN raw r ON r.track = e.track AND r.frame = e.frame + 1
)
SELECT track, frame, round(y, 6) AS percussiveness FROM e
""")
def flux_percussiveness(spark, sf):
    mag = F.col("mag")
    mass = A.dot(mag, A.literal(WEIGHTS))
    df = spectra(spark, sf).withColumn("x", F.when(mass > 1e-10, A.total(A.rises(mag, F.lag("mag").over(by_frame()))) / mass))
    return scan(df, Ema(_N, 0.5), ["x"]).select("track", "frame", r6("y").alias("percussiveness"))


@query(f"""
WITH {BINNED}, {AXIS}, {_BANDS}, fl AS (SELECT *, greatest(m - coalesce(lag(m) OVER (PARTITION BY track, bin ORDER BY frame), m), 0) AS d FROM binned)
SELECT track, frame, band, round(avg(d), 6) AS flux FROM fl JOIN axis USING (bin) JOIN bands ON f >= lo AND f < hi WHERE band <> 'subbass' GROUP BY ALL
""")
def band_flux(spark, sf):
    df = spectra(spark, sf).withColumn("flux", A.rises(F.col("mag"), F.lag("mag").over(by_frame())))
    each = [F.struct(F.lit(b.name).alias("band"), A.mean(A.band(F.col("flux"), FREQS, b)).alias("flux")) for b in BANDS if b.kind == "detection"]
    return df.select("track", "frame", F.explode(F.array(*each)).alias("e")).select("track", "frame", "e.band", r6("e.flux").alias("flux"))


@query(f"""
WITH {BINNED}, {AXIS}, fl AS (SELECT *, greatest(m - coalesce(lag(m) OVER (PARTITION BY track, bin ORDER BY frame), m), 0) AS d FROM binned)
SELECT track, frame, round(sum(d * w), 6) AS strength FROM fl JOIN axis USING (bin) GROUP BY ALL
""")
def onset_strength(spark, sf):
    df = spectra(spark, sf)
    return df.select("track", "frame", r6(A.dot(A.rises(F.col("mag"), F.lag("mag").over(by_frame())), A.literal(WEIGHTS))).alias("strength"))


@query("""
WITH t AS (SELECT event_id, value AS bpm, CASE WHEN value > 0 THEN 60 / value ELSE 0.5 END * 93.75 AS own FROM events)
SELECT event_id, CAST(greatest(1, round_even(1.0 * own, 0)) AS BIGINT) AS frames, round(pow(0.05, 1 / greatest(own, 1)), 6) AS alpha,
  round(pow(0.05, 1 / greatest(0.5 * (0.95 * 0.5 * 93.75 + 0.05 * own), 1)), 6) AS novelty_alpha, round(10 + 10 / (1 + exp(-0.03 * (bpm - 120))), 6) AS blend
FROM t
""")
def tempo_scaler(spark, sf):
    """Frames and smoothing of a beat at each value taken as a tempo."""
    bpm = F.col("value")
    own = timing.beat_frames(bpm)
    return spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", timing.frames(1.0, own).alias("frames"), r6(timing.alpha(own)).alias("alpha"), r6(timing.novelty_alpha(bpm)).alias("novelty_alpha"), r6(timing.blend(F.lit(10.0), F.lit(20.0), bpm)).alias("blend"))


