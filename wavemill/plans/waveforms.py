"""Queries on windows, resampling, quality, spectra and channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavemill.functions import names, signals
from wavemill.operators import spectral, windows

from . import carriers as K
from .registry import query


def _indexed(spark, sf_dir):
    return windows.sample_index(K.table(spark, sf_dir, "events"), "user_id", "ts", "event_id")


def _windowed_sql(size: int, stride: int) -> str:
    return f"""WITH {K.INDEXED_SQL}, w AS (SELECT user_id, value, i, unnest(range(0, length - {size - 1}, {stride})) AS start FROM indexed)
SELECT user_id, start, count(*) AS samples, round(sum(value), 4) AS total, round(max(value), 4) AS peak FROM w WHERE i >= start AND i < start + {size} GROUP BY ALL"""


def _windowed(spark, sf_dir, size, stride):
    rows = windows.sliding_windows_long(_indexed(spark, sf_dir), "user_id", size, stride)
    return rows.groupBy("user_id", "start").agg(F.count("*").alias("samples"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 4).alias("peak"))


@query(_windowed_sql(16, 16))
def sliding_windows_tumbling(spark, sf_dir):
    return _windowed(spark, sf_dir, 16, 16)


@query(_windowed_sql(16, 8))
def sliding_windows_overlap(spark, sf_dir):
    return _windowed(spark, sf_dir, 16, 8)


@query(
    f"""WITH {K.INDEXED_SQL}
SELECT user_id, max(length) AS length, ((max(length) - 20) // 12 + 1)::BIGINT AS windows, (max(length) - ((max(length) - 20) // 12 * 12 + 20))::BIGINT AS dropped
FROM indexed WHERE length >= 20 GROUP BY user_id"""
)
def window_drop_partial(spark, sf_dir):
    """Array form: starts of whole windows only, and the samples after the last."""
    lengths = K.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("length"))
    starts = windows.window_starts(F.col("length").cast("int"), F.lit(20), F.lit(12))
    rows = lengths.withColumn("_starts", starts).filter(F.size("_starts") > 0)
    return rows.select("user_id", "length", F.size("_starts").cast("long").alias("windows"), (F.col("length") - F.array_max("_starts") - 20).cast("long").alias("dropped"))


@query(
    f"""WITH {K.INDEXED_SQL}, m AS (SELECT user_id, event_id AS marker, i AS start FROM indexed WHERE event_type = 'error')
SELECT m.user_id, marker, count(*) AS samples, round(sum(value), 4) AS total FROM m JOIN indexed x ON x.user_id = m.user_id AND x.i >= m.start AND x.i < m.start + 8 GROUP BY ALL"""
)
def event_windows(spark, sf_dir):
    rows = _indexed(spark, sf_dir)
    markers = rows.filter("event_type = 'error'").select("user_id", F.col("i").alias("at"), F.col("event_id").alias("marker"))
    found = windows.event_windows_long(rows.select("user_id", "i", "value"), markers, "user_id", 8)
    return found.groupBy("user_id", "marker").agg(F.count("*").alias("samples"), F.round(F.sum("value"), 4).alias("total"))


def _kernel_rows(spark, points, target):
    kernel = signals.resample_kernel(points, target)
    return spark.createDataFrame([(i, j, float(kernel[j, i])) for j in range(target) for i in range(points)], "sample int, out int, weight double")


#: The kernel in SQL: with an even number of points below the target, its
#: Nyquist term is shared, so weights are sums of cosines.
_RESAMPLE_SQL = f"""WITH {K.SAMPLES_SQL}, k AS (
  SELECT s AS sample, o AS out, (1 + 2 * (SELECT sum(cos(2 * pi() * f * (o / 20.0::DOUBLE - s / 16.0::DOUBLE))) FROM range(1, 8) t(f)) + cos(2 * pi() * 8 * (o / 20.0::DOUBLE - s / 16.0::DOUBLE))) / 16 AS weight
  FROM range(0, 16) a(s), range(0, 20) b(o))
SELECT vec_id, channel::INT AS channel, out::INT AS sample, round(sum(value * weight), 4) + 0.0 AS value FROM samples JOIN k USING (sample) GROUP BY vec_id, channel, out"""


@query(_RESAMPLE_SQL)
def resample_relational(spark, sf_dir):
    """16 samples to 20, by a join with the resampling kernel (320 rows)."""
    rows = K.samples(spark, sf_dir).join(F.broadcast(_kernel_rows(spark, 16, 20)), "sample")
    return rows.groupBy("vec_id", "channel", F.col("out").alias("sample")).agg((F.round(F.sum(F.col("value") * F.col("weight")), 4) + 0.0).alias("value"))


@query()
def resample_udf(spark, sf_dir):
    """The same by FFT over Arrow batches, in float32: checked against the
    relational form in tests."""
    rows = K.trials(spark, sf_dir).select("vec_id", F.posexplode(signals.resample(4.0, 5.0)("signal")).alias("channel", "_v"))
    return rows.select("vec_id", "channel", F.posexplode("_v").alias("sample", "value"))


@query(
    f"""WITH {K.SAMPLES_SQL}, c AS (SELECT vec_id, channel, stddev_pop(value) AS s, max(abs(value)) AS m FROM samples WHERE TRUE GROUP BY ALL)
SELECT vec_id, array_to_string(list_filter([CASE WHEN bool_or(s * (vec_id % 4) < 1e-6) THEN 'flat_channel' END, CASE WHEN max(m * (vec_id % 4)) * 1000 > 2000 THEN 'extreme_amplitude' END], lambda f: f IS NOT NULL), ',') AS flags
FROM c GROUP BY vec_id"""
)
def quality_flags(spark, sf_dir):
    """Signals times 0, 1000, 2000 or 3000, so that each flag is met."""
    rows = K.trials(spark, sf_dir).withColumn("signal", F.transform("signal", lambda c: F.transform(c, lambda v: v.cast("double") * (F.col("vec_id") % 4) * 1000)))
    return rows.select("vec_id", F.array_join(signals.quality_flags(F.col("signal")), ",").alias("flags"))


@query(
    f"""WITH {K.SAMPLES_SQL}, c AS (SELECT vec_id, split, channel, stddev_pop(value) AS s, max(abs(value)) AS m FROM samples GROUP BY ALL)
SELECT split, count(*) AS channels, count(*) FILTER (s < 0.1) AS quiet, round(avg(s), 6) AS mean_std, round(max(m), 6) AS peak FROM c GROUP BY split"""
)
def quality_summary(spark, sf_dir):
    rows = K.samples(spark, sf_dir).groupBy("vec_id", "split", "channel").agg(F.stddev_pop("value").alias("s"), F.max(F.abs("value")).alias("m"))
    return rows.groupBy("split").agg(F.count("*").alias("channels"), F.count_if(F.col("s") < 0.1).alias("quiet"), F.round(F.avg("s"), 6).alias("mean_std"), F.round(F.max("m"), 6).alias("peak"))


@query(
    """SELECT doc_id, trim(replace(replace(trim(name), ' ', ''), 'EEG', ''), '-_') AS channel
FROM (SELECT doc_id, concat(CASE WHEN doc_id % 2 = 0 THEN 'EEG ' ELSE ' EEG-' END, upper(lang), doc_id % 9, CASE WHEN doc_id % 3 = 0 THEN '_ ' ELSE '-Ref' END) AS name FROM documents)"""
)
def normalize_channels(spark, sf_dir):
    start = F.when(F.col("doc_id") % 2 == 0, "EEG ").otherwise(" EEG-")
    name = F.concat(start, F.upper("lang"), (F.col("doc_id") % 9).cast("string"), F.when(F.col("doc_id") % 3 == 0, "_ ").otherwise("-Ref"))
    return K.table(spark, sf_dir, "documents").select("doc_id", names.normalize_channel(name).alias("channel"))


@query(
    f"""WITH {K.TRIALS_SQL}
SELECT vec_id, r.name AS channel, r.k IS NOT NULL AS present, round(coalesce(list_sum(list_transform(embedding[r.k * 16 + 1:r.k * 16 + 16], lambda v: v::DOUBLE)), 0), 5) + 0.0 AS total
FROM trials, (VALUES ('PZ', 3), ('Oz', NULL), ('c3', 0)) r(name, k)"""
)
def select_channels_mask(spark, sf_dir):
    wanted, have = F.array(*[F.lit(c) for c in ("PZ", "Oz", "c3")]), F.array(*[F.lit(c) for c in K.CHANNELS])
    rows = K.trials(spark, sf_dir).select("vec_id", F.explode(F.arrays_zip(wanted.alias("name"), signals.channel_mask(have, wanted).alias("there"), signals.select_channels(F.col("signal"), have, wanted).alias("v"))).alias("c"))
    return rows.select("vec_id", F.col("c.name").alias("channel"), F.col("c.there").alias("present"), (F.round(F.aggregate("c.v", F.lit(0.0), lambda a, x: a + x.cast("double")), 5) + 0.0).alias("total"))


@query(
    f"""WITH {K.SAMPLES_SQL}
SELECT split, channel::INT AS channel, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
  round(quantile_cont(value, 0.001), 6) AS p0_1, round(quantile_cont(value, 0.999), 6) AS p99_9 FROM samples GROUP BY ALL"""
)
def signal_stats(spark, sf_dir):
    rows = spectral.signal_stats(K.samples(spark, sf_dir), "value", ["split", "channel"])
    return rows.withColumns({c: F.round(c, 6) for c in ("min", "max", "mean", "std", "p0_1", "p99_9")})


@query(f"WITH {K.SAMPLES_SQL} SELECT vec_id, round(sqrt(avg(value * value)), 6) AS rms, round(max(abs(value)), 6) AS absolute_peak FROM samples GROUP BY vec_id ORDER BY max(abs(value)) DESC, vec_id LIMIT 10")
def trial_rms_topk(spark, sf_dir):
    rows = spectral.rms_and_peak(K.samples(spark, sf_dir), "value", ["vec_id"]).orderBy(F.desc("absolute_peak"), "vec_id").limit(10)
    return rows.withColumns({c: F.round(c, 6) for c in ("rms", "absolute_peak")})


@query(
    f"""WITH {K.SAMPLES_SQL} SELECT a.channel::INT AS channel_a, b.channel::INT AS channel_b, round(corr(a.value, b.value), 5) + 0.0 AS correlation
FROM samples a JOIN samples b ON a.vec_id = b.vec_id AND a.sample = b.sample AND a.channel <= b.channel GROUP BY ALL"""
)
def channel_correlation(spark, sf_dir):
    rows = spectral.channel_correlation(K.samples(spark, sf_dir), ["vec_id", "sample"], "channel", "value")
    return rows.withColumn("correlation", F.round("correlation", 5) + 0.0)


_SPECTRUM_SQL = f"""{K.SAMPLES_SQL}, spectrum AS (
  SELECT vec_id, label, channel, f AS bin, sqrt(pow(sum(value * cos(2 * pi() * f * sample / 16)), 2) + pow(sum(value * sin(2 * pi() * f * sample / 16)), 2)) / 16 AS amplitude
  FROM samples, range(0, 9) t(f) GROUP BY vec_id, label, channel, f)"""


def _spectrum(spark, sf_dir):
    """Amplitudes of 16-sample channels, an FFT each; nothing is shuffled."""
    rows = K.trials(spark, sf_dir).select("vec_id", "label", F.posexplode("signal").alias("channel", "_values"))
    return rows.select("vec_id", "label", F.col("channel").cast("int").alias("channel"), F.posexplode(signals.spectrum()("_values")).alias("bin", "amplitude"))


@query(f"WITH {_SPECTRUM_SQL} SELECT label, channel::INT AS channel, bin::INT AS bin, round(avg(amplitude), 6) AS amplitude FROM spectrum GROUP BY ALL")
def patch_spectrum(spark, sf_dir):
    return _spectrum(spark, sf_dir).groupBy("label", "channel", "bin").agg(F.round(F.avg("amplitude"), 6).alias("amplitude"))


_DENSITY_SQL = f"{_SPECTRUM_SQL}, density AS (SELECT vec_id, label, channel, bin * 4.0::DOUBLE AS frequency, pow(amplitude, 2) AS power FROM spectrum)"
_BANDS_SQL = f"""{_DENSITY_SQL}, b AS (SELECT d.*, band, lead(frequency) OVER w AS f2, lead(power) OVER w AS p2
  FROM density d JOIN (VALUES ('delta', 0.5, 4.0), ('theta', 4.0, 8.0), ('alpha', 8.0, 13.0), ('beta', 13.0, 30.0), ('gamma', 30.0, 45.0)) t(band, low, high) ON frequency >= low AND frequency < high
  WINDOW w AS (PARTITION BY vec_id, channel, band ORDER BY frequency)),
bands AS (SELECT vec_id, label, channel, band, coalesce(sum((f2 - frequency) * (p2 + power) / 2), 0) AS power FROM b GROUP BY ALL)"""


def _bands(spark, sf_dir):
    density = _spectrum(spark, sf_dir).select("vec_id", "label", "channel", (F.col("bin") * 4.0).alias("frequency"), F.pow("amplitude", F.lit(2)).alias("power"))
    return spectral.band_power(density, ["vec_id", "label", "channel"])


@query(f"WITH {_BANDS_SQL} SELECT label, band, count(*) AS channels, round(avg(power), 6) AS power FROM bands GROUP BY ALL")
def band_power(spark, sf_dir):
    return _bands(spark, sf_dir).groupBy("label", "band").agg(F.count("*").alias("channels"), F.round(F.avg("power"), 6).alias("power"))


@query(f"WITH {_BANDS_SQL} SELECT band, round(avg(power) FILTER (label = 0), 6) AS label_0, round(avg(power) FILTER (label = 1), 6) AS label_1 FROM bands GROUP BY band")
def pivot_band_label(spark, sf_dir):
    rows = _bands(spark, sf_dir).groupBy("band").pivot("label", [0, 1]).agg(F.avg("power"))
    return rows.select("band", F.round("0", 6).alias("label_0"), F.round("1", 6).alias("label_1"))


@query(
    f"""WITH {K.SAMPLES_SQL}, m AS (SELECT vec_id, label, channel, sample, value - avg(value) OVER (PARTITION BY vec_id, channel) AS v, 0.5 - 0.5 * cos(2 * pi() * sample / 16) AS w FROM samples),
p AS (SELECT vec_id, label, channel, f, (pow(sum(v * w * cos(2 * pi() * f * sample / 16)), 2) + pow(sum(v * w * sin(2 * pi() * f * sample / 16)), 2)) / (4 * sum(w * w)) * CASE WHEN f IN (0, 8) THEN 1 ELSE 2 END AS power
  FROM m, range(0, 9) t(f) GROUP BY vec_id, label, channel, f)
SELECT label, channel::INT AS channel, f * 0.25::DOUBLE AS frequency, round(avg(power), 6) AS power FROM p GROUP BY label, channel, f"""
)
def welch_psd(spark, sf_dir):
    """Channels of 16 samples are one Hann segment; longer ones are checked
    against NumPy in tests."""
    rows = K.trials(spark, sf_dir).select("vec_id", "label", F.posexplode("signal").alias("channel", "_v")).withColumn("_p", signals.welch(4.0)(F.col("_v").cast("array<double>")))
    bins = rows.select("label", "channel", F.posexplode("_p").alias("bin", "power"))
    return bins.groupBy("label", "channel", (F.col("bin") * 0.25).alias("frequency")).agg(F.round(F.avg("power"), 6).alias("power"))


@query(
    """WITH b AS (SELECT min(value) AS low, max(value) AS high FROM events)
SELECT least(19, floor((value - low) / (high - low) * 20))::INT AS bin, count(*) AS count FROM events, b GROUP BY 1"""
)
def histogram(spark, sf_dir):
    return spectral.histogram(K.table(spark, sf_dir, "events"), "value", 20)


@query(
    f"""WITH {K.SAMPLES_SQL}, c AS (SELECT vec_id, channel, avg(value) AS m, stddev_pop(value) AS s FROM samples GROUP BY ALL)
SELECT vec_id, channel::INT AS channel, sample::INT AS sample, round((value - m) / (s + 1e-8), 5) + 0.0 AS z FROM samples JOIN c USING (vec_id, channel)"""
)
def zscore_display(spark, sf_dir):
    rows = K.trials(spark, sf_dir).select("vec_id", F.posexplode("signal").alias("channel", "_v")).select("vec_id", "channel", F.posexplode(signals.zscore(F.col("_v"))).alias("sample", "_z"))
    return rows.select("vec_id", "channel", "sample", (F.round("_z", 5) + 0.0).alias("z"))
