"""Signals ([channels][samples] arrays) as column expressions.

All are built-in higher-order functions, but for what needs FFTs, which are
Arrow UDFs over whole batches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the quality rules.
FLAT_STD, EXTREME = 1e-6, 2000.0
PATCH = 200


def mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return total / F.size(values)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: what a lambda mentions is
    otherwise computed again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def std_pop(values: Column) -> Column:
    spread = lambda c: F.aggregate(values, F.lit(0.0), lambda a, x: a + (x.cast("double") - c) * (x.cast("double") - c))
    return F.sqrt(once(mean(values), spread) / F.size(values))


def rms(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size(values))


def quality_flags(signal: Column) -> Column:
    """non_finite, flat_channel (any population std below 1e-6) and
    extreme_amplitude (any magnitude above 2000), in this order."""
    bad = F.exists(signal, lambda c: F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    flat = F.exists(signal, lambda c: std_pop(c) < FLAT_STD)
    extreme = F.coalesce(F.array_max(F.transform(F.flatten(signal), lambda v: F.abs(v))) > EXTREME, F.lit(False))
    flags = F.array(F.when(bad, "non_finite"), F.when(flat, "flat_channel"), F.when(extreme, "extreme_amplitude"))
    return F.filter(flags, lambda f: f.isNotNull())


def flags_of_batch(batch: pa.Array) -> pa.Array:
    """``quality_flags`` of a batch of signals, over its flat values."""
    channels = batch.flatten()
    values = pc.fill_null(channels.flatten(), float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    lengths, counts = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (channels, batch))
    full = np.flatnonzero(lengths)

    def each(x: np.ndarray, starts: np.ndarray, kind: np.ufunc) -> np.ndarray:
        return kind.reduceat(x, starts) if len(starts) else x[:0]

    def of_windows(x: np.ndarray) -> np.ndarray:
        out, some = np.zeros(len(counts), bool), np.flatnonzero(counts)
        out[some] = each(x, (np.cumsum(counts) - counts)[some], np.logical_or)
        return out

    starts, n = (np.cumsum(lengths) - lengths)[full], lengths[full]
    with np.errstate(invalid="ignore", over="ignore"):
        centre = each(values, starts, np.add) / n
        spread = np.sqrt(each((values - np.repeat(centre, n)) ** 2, starts, np.add) / n)
    bad, flat, extreme = (np.zeros(len(lengths), bool) for _ in range(3))
    bad[full], flat[full] = each(~np.isfinite(values), starts, np.logical_or), spread < FLAT_STD
    extreme[full] = each(~(np.abs(values) <= EXTREME), starts, np.logical_or)
    marks = zip(*(of_windows(x).tolist() for x in (bad, flat, extreme)), batch.is_valid().to_pylist(), strict=True)
    names = ("non_finite", "flat_channel", "extreme_amplitude")
    return pa.array([[k for k, on in zip(names, m[:3], strict=True) if on] if m[3] else None for m in marks], pa.list_(pa.string()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def batch_flags(signal: pa.Array) -> pa.Array:
    """``quality_flags`` where there are millions of samples: without a lambda a sample."""
    return flags_of_batch(signal)


def scale(signal: Column, by: Column) -> Column:
    return F.transform(signal, lambda c: F.transform(c, lambda v: (v / by).cast("float")))


def zscore(values: Column, eps: float = 1e-8) -> Column:
    both = F.struct(mean(values).alias("centre"), (std_pop(values) + F.lit(eps)).alias("spread"))
    return once(both, lambda b: F.transform(values, lambda v: (v - b["centre"]) / b["spread"]))


def select_channels(signal: Column, names: Column, requested: Column) -> Column:
    """Requested channels in their order; those missing are rows of zeros."""
    lower = F.transform(names, lambda n: F.lower(n))
    zeros = F.transform(F.get(signal, F.lit(0)), lambda v: F.lit(0.0).cast("float"))
    return F.transform(requested, lambda r: F.coalesce(F.get(signal, F.array_position(lower, F.lower(r)).cast("int") - 1), zeros))


def channel_mask(names: Column, requested: Column) -> Column:
    lower = F.transform(names, lambda n: F.lower(n))
    return F.transform(requested, lambda r: F.array_contains(lower, F.lower(r)))


def patches(values: Column, size: int = PATCH) -> Column:
    """Consecutive pieces of a channel; its length must be a multiple."""
    n = F.size(values)
    checked = F.when(n % size == 0, n).otherwise(F.raise_error(F.lit(f"length is not a multiple of {size}")).cast("int"))
    return F.transform(F.sequence(F.lit(0), (checked / size).cast("int") - 1), lambda i: F.slice(values, i * size + 1, size))


@lru_cache(maxsize=64)
def resample_kernel(points: int, target: int) -> np.ndarray:
    """The matrix K for which FFT resampling of x is K @ x.

    The spectrum is cut or padded at the smaller length; where that is even,
    its Nyquist term is shared between both signs.
    """
    small = min(points, target)
    spectrum = np.fft.rfft(np.eye(points), axis=0)[: small // 2 + 1].copy()
    if small % 2 == 0 and points != target:
        spectrum[small // 2] *= 2.0 if target < points else 0.5
    padded = np.zeros((target // 2 + 1, points), complex)
    padded[: len(spectrum)] = spectrum
    return np.fft.irfft(padded, target, axis=0) * (target / points)


def fft_resample(x: np.ndarray, target: int) -> np.ndarray:
    """The same along the last axis by FFT, for signals too long for a matrix."""
    points = x.shape[-1]
    small = min(points, target)
    spectrum = np.fft.rfft(x, axis=-1)[..., : small // 2 + 1]
    if small % 2 == 0 and points != target:
        spectrum[..., small // 2] *= 2.0 if target < points else 0.5
    return np.fft.irfft(spectrum, target, axis=-1) * (target / points)


#: Points from which a signal is resampled by FFT rather than by a matrix.
LONG = 4096


def target_points(points: int, original: float, target: float) -> int:
    """Halves go to the even number."""
    return int(round(points * target / original))


def resample(original: float, target: float):
    """A UDF that resamples array<array<float>> signals by FFT."""

    @F.pandas_udf("array<array<float>>")
    def run(signals: pd.Series) -> pd.Series:
        rates = (pd.Series(np.full(len(signals), r)) for r in (original, target))
        return _resampled(signals, *rates)

    return run


def _resampled(values: pd.Series, original: pd.Series, target: pd.Series) -> pd.Series:
    out: list = [None] * len(values)
    alike: dict[tuple, list[int]] = {}
    for k, (signal, a, b) in enumerate(zip(values, original, target, strict=True)):
        if signal is not None and len(signal):
            alike.setdefault((len(signal), len(signal[0]), float(a), float(b)), []).append(k)
    for (channels, points, a, b), rows in alike.items():
        x = np.stack([np.stack(values.iloc[k]) for k in rows]).astype(np.float64)
        if not np.isclose(a, b):
            # one product (or FFT) for all signals of one shape and rate
            target, x = target_points(points, a, b), x.reshape(-1, points)
            x = fft_resample(x, target) if max(points, target) >= LONG else x @ resample_kernel(points, target).T
        for k, y in zip(rows, x.reshape(len(rows), channels, -1).astype(np.float32), strict=True):
            out[k] = list(y)
    return pd.Series(out)


def resample_to(signal: Column | str, original: Column | str, target: Column | str) -> Column:
    """Signals resampled by FFT from one rate to another, both columns."""
    rate = F.col(target) if isinstance(target, str) else target
    checked = F.when(rate > 0, rate).otherwise(F.raise_error(F.lit("sampling rates must be positive")).cast("double"))
    have = F.col(signal) if isinstance(signal, str) else signal
    run = F.pandas_udf(_resampled, "array<array<float>>")
    return run(have, F.coalesce(F.col(original) if isinstance(original, str) else original, F.lit(1.0)).cast("double"), F.when(have.isNull(), 1.0).otherwise(checked).cast("double"))


def spectrum():
    """A UDF for amplitudes of the real FFT divided by the length."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else np.abs(np.fft.rfft(np.asarray(x, float))) / len(x))

    return run


def welch(rate: float, segment: int = 500):
    """A UDF for the one-sided power density by averaged Hann segments that
    overlap by half, each without its mean."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            x = np.asarray(x, float)
            n = min(segment, len(x))
            window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
            step = n - n // 2
            pieces = np.stack([x[i : i + n] for i in range(0, len(x) - n + 1, step)])
            power = np.abs(np.fft.rfft((pieces - pieces.mean(1, keepdims=True)) * window, axis=1)) ** 2 / (rate * (window**2).sum())
            power[:, 1 : None if n % 2 else -1] *= 2
            return power.mean(0)

        return values.map(one)

    return run


def encode():
    """A UDF for float32 bytes, channel after channel."""

    @F.pandas_udf("binary")
    def run(signals: pd.Series) -> pd.Series:
        return signals.map(lambda s: None if s is None else np.stack([np.asarray(c, np.float32) for c in s]).tobytes())

    return run


def decode(channels: int):
    """A UDF that turns such bytes into a signal."""

    @F.pandas_udf("array<array<float>>")
    def run(payload: pd.Series) -> pd.Series:
        return payload.map(lambda b: None if b is None else list(np.frombuffer(b, np.float32).reshape(channels, -1)))

    return run
