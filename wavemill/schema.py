"""The window schema, its version, and validation as ordered predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
SCHEMA_VERSION = "1.0"
PREPROCESSING_VERSION = "harmonized-eeg-v1"
SPLITS = ("train", "val", "test")

_REQUIRED = "sample_id dataset_id subject_id shard_path record_batch row_in_batch sampling_rate_hz num_channels num_samples channel_names channel_mask start_seconds duration_seconds source_uri source_format preprocessing_version amplitude_scale quality_flags metadata_json".split()

#: One row for each window; all but the signal make up the manifest.
WINDOW = T.StructType(
    [
        T.StructField(name, kind, name not in _REQUIRED)
        for name, kind in (
            ("sample_id", T.StringType()),
            ("dataset_id", T.StringType()),
            ("subject_id", T.StringType()),
            ("session_id", T.StringType()),
            ("task", T.StringType()),
            ("split", T.StringType()),
            ("shard_path", T.StringType()),
            ("record_batch", T.IntegerType()),
            ("row_in_batch", T.IntegerType()),
            ("sampling_rate_hz", T.FloatType()),
            ("num_channels", T.IntegerType()),
            ("num_samples", T.IntegerType()),
            ("channel_names", T.ArrayType(T.StringType())),
            ("channel_mask", T.ArrayType(T.BooleanType())),
            ("label", T.IntegerType()),
            ("start_seconds", T.DoubleType()),
            ("duration_seconds", T.DoubleType()),
            ("source_uri", T.StringType()),
            ("source_format", T.StringType()),
            ("preprocessing_version", T.StringType()),
            ("amplitude_scale", T.FloatType()),
            ("quality_flags", T.ArrayType(T.StringType())),
            ("metadata_json", T.StringType()),
            ("signal", T.ArrayType(T.ArrayType(T.FloatType()))),
        )
    ]
)
MANIFEST = T.StructType([f for f in WINDOW if f.name != "signal"])

#: A continuous recording, before windowing.
RECORDING = T.StructType(
    [
        T.StructField("recording_id", T.StringType(), False),
        T.StructField("dataset_id", T.StringType(), False),
        T.StructField("subject_id", T.StringType(), False),
        T.StructField("session_id", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("sampling_rate_hz", T.FloatType(), False),
        T.StructField("channel_names", T.ArrayType(T.StringType()), False),
        T.StructField("signal", T.ArrayType(T.ArrayType(T.FloatType())), False),
        T.StructField("source_uri", T.StringType(), False),
        T.StructField("source_format", T.StringType(), False),
        T.StructField("metadata_json", T.StringType(), False),
    ]
)

_NOT_FINITE = "exists(signal, c -> exists(c, v -> v is null or isnan(v) or abs(v) = double('Infinity')))"

#: (what is wrong, when); the first that holds is the row's error.
RECORDING_RULES: tuple[tuple[str, str], ...] = (
    ("signal has no channels", "signal is null or size(signal) = 0"),
    ("channel names do not match the signal", "size(channel_names) <> size(signal)"),
    ("channels differ in length", "exists(signal, c -> size(c) <> size(signal[0]))"),
    ("signal has no samples", "size(signal[0]) = 0"),
    ("sampling rate is not positive", "not coalesce(sampling_rate_hz > 0, false)"),
    ("signal is not finite", _NOT_FINITE),
    ("subject is empty", "coalesce(subject_id, '') = ''"),
)
WINDOW_RULES: tuple[tuple[str, str], ...] = (
    *RECORDING_RULES[:3],
    ("channel mask does not match the signal", "size(channel_mask) <> size(signal)"),
    *RECORDING_RULES[3:5],
    ("duration is not positive", "not coalesce(duration_seconds > 0, false)"),
    ("amplitude scale is not positive", "not coalesce(amplitude_scale > 0, false)"),
    RECORDING_RULES[5],
    ("split is unknown", "split is not null and split not in ('train', 'val', 'test')"),
    ("sample id is empty", "coalesce(sample_id, '') = ''"),
    RECORDING_RULES[6],
)


def first_error(rules: Sequence[tuple[str, str]]) -> Column:
    """The first broken rule of each row; null where all hold."""
    return F.coalesce(*[F.when(F.expr(when), F.lit(what)) for what, when in rules])


def validate(rows: DataFrame, rules: Sequence[tuple[str, str]] = WINDOW_RULES, strict: bool = False) -> DataFrame:
    """Adds ``error``.  ``strict``: rows with one raise when they are computed."""
    error = first_error(rules)
    if strict:
        error = F.when(error.isNotNull(), F.raise_error(error)).otherwise(F.lit(None).cast("string"))
    return rows.withColumn("error", error)
