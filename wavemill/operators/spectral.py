"""Exploration of signals: statistics, spectra, correlation, histograms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavemill.operators import ordered
from wavemill.session import kept

# Bands in Hz, lower bound included.
BANDS = {"delta": (0.5, 4.0), "theta": (4.0, 8.0), "alpha": (8.0, 13.0), "beta": (13.0, 30.0), "gamma": (30.0, 45.0)}


def signal_stats(samples: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """min, max, mean, population std and the 0.1 and 99.9 percentiles."""
    found = samples.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    tails = ordered.quantiles(samples, value, by, (0.001, 0.999)).groupBy(*by).agg(F.max(F.when(F.col("share") < 0.5, F.col("quantile"))).alias("p0_1"), F.max(F.when(F.col("share") > 0.5, F.col("quantile"))).alias("p99_9"))
    return found.join(tails, list(by)) if by else found.crossJoin(tails)  # one row each


def rms_and_peak(samples: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return samples.groupBy(*by).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.max(F.abs(value)).alias("absolute_peak"))


def channel_correlation(samples: DataFrame, key: Sequence[str], channel: str, value: str) -> DataFrame:
    """Pearson correlation of every two channels, sample by sample.

    The samples of one instant (one row a channel) are gathered; each task adds
    up products of channels over its instants, as matrices, about the first
    value it meets of each channel.  What leaves a task is a count, two means
    and three co-moments of two channels, and these are merged about the mean
    of all, so a large offset cancels nowhere.
    """
    kind = dict(samples.dtypes)[channel]
    instants = samples.groupBy(*key).agg(F.collect_list(F.struct(F.col(channel).alias("c"), F.col(value).cast("double").alias("v"))).alias("_all"))
    parts = ["n", "a", "b", "aa", "bb", "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[object, int] = {}
        total, shift = np.zeros((6, 0, 0)), np.zeros(0)
        for batch in batches:
            every = batch.column(0)
            flat = every.flatten()
            rows = np.repeat(np.arange(len(every)), np.diff(every.offsets.to_numpy()))
            columns = np.array([place.setdefault(c, len(place)) for c in flat.field("c").to_pylist()], np.int64)
            v = flat.field("v").to_numpy(zero_copy_only=False)
            m = len(place)
            total = np.pad(total, ((0, 0), (0, m - total.shape[1]), (0, m - total.shape[1])))
            there = ~np.isnan(v)
            shift = np.pad(shift, (0, m - len(shift)), constant_values=np.nan)
            new, first = np.unique(columns[there], return_index=True)
            shift[new] = np.where(np.isnan(shift[new]), v[there][first], shift[new])
            x, mask = np.zeros((len(every), m)), np.zeros((len(every), m))
            x[rows[there], columns[there]], mask[rows[there], columns[there]] = v[there] - shift[columns[there]], 1
            total += np.stack([mask.T @ mask, x.T @ mask, mask.T @ x, (x * x).T @ mask, mask.T @ (x * x), x.T @ x])
        if not place:
            return
        names = pa.array(list(place), flat.field("c").type)
        i, j = (k.ravel() for k in np.indices((len(names), len(names))))
        n, a, b, aa, bb, ab = total
        with np.errstate(invalid="ignore", divide="ignore"):
            moments = [n, shift[:, None] + a / n, shift[None, :] + b / n, aa - a * a / n, bb - b * b / n, ab - a * b / n]
        some = n.ravel() > 0
        yield pa.RecordBatch.from_pydict({"channel_a": names.take(pa.array(i[some])), "channel_b": names.take(pa.array(j[some]))} | {s: x.ravel()[some] for s, x in zip(parts, moments, strict=True)})

    found = instants.select("_all").mapInArrow(run, f"channel_a {kind}, channel_b {kind}, " + ", ".join(f"{s} double" for s in parts))
    return merged_correlation(found.filter("channel_a <= channel_b"), ["channel_a", "channel_b"])


def merged_correlation(moments: DataFrame, by: Sequence[str]) -> DataFrame:
    """``correlation`` of parts (n, means a and b, co-moments aa, bb and ab),
    merged: what is within parts, and what is between their means."""
    moments = kept(moments)  # a row for two channels and a task
    means = moments.groupBy(*by).agg(F.min("a").alias("_a0"), F.min("b").alias("_b0"), F.sum("n").alias("_n"))
    about = moments.join(means, list(by)).withColumns({"_a": F.col("a") - F.col("_a0"), "_b": F.col("b") - F.col("_b0")})
    n, within = F.sum("n"), lambda x: F.sum(x)
    between = lambda x, y: F.sum(F.col("n") * F.col(x) * F.col(y)) - F.sum(F.col("n") * F.col(x)) * F.sum(F.col("n") * F.col(y)) / n
    found = about.groupBy(*by).agg((within("aa") + between("_a", "_a")).alias("aa"), (within("bb") + between("_b", "_b")).alias("bb"), (within("ab") + between("_a", "_b")).alias("ab"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("aa"))) * F.sqrt(F.greatest(F.lit(0.0), F.col("bb")))
    return found.select(*by, F.try_divide(F.col("ab"), spread).alias("correlation"))


def band_power(density: DataFrame, by: Sequence[str], frequency: str = "frequency", power: str = "power", bands: dict[str, tuple[float, float]] = BANDS) -> DataFrame:
    """The integral over each band [low, high) by trapezoids."""
    known = F.array(*[F.struct(F.lit(n).alias("band"), F.lit(lo).alias("low"), F.lit(hi).alias("high")) for n, (lo, hi) in bands.items()])
    rows = density.select(*by, frequency, power, F.explode(known).alias("_b")).filter((F.col(frequency) >= F.col("_b.low")) & (F.col(frequency) < F.col("_b.high")))
    order = Window.partitionBy(*by, "_b.band").orderBy(frequency)
    area = (F.lead(frequency).over(order) - F.col(frequency)) * (F.lead(power).over(order) + F.col(power)) / 2
    return rows.select(*by, F.col("_b.band").alias("band"), area.alias("_area")).groupBy(*by, "band").agg(F.coalesce(F.sum("_area"), F.lit(0.0)).alias("power"))


def histogram(rows: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts in ``bins`` equal bins from the least to the greatest value; the
    last bin includes its upper end.  Two passes, each a partial aggregation."""
    bounds = rows.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    if by:
        placed = rows.join(F.broadcast(bounds) if bounds.count() <= ordered.BROADCAST_ROWS else bounds, list(by))
    else:
        placed = rows.crossJoin(F.broadcast(bounds))  # one row
    k = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * bins))
    return placed.groupBy(*by, F.coalesce(k, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("count"))
