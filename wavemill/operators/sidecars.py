"""Joining recordings with their channel, event and JSON sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Channel types of sidecars, and what they become.
CHANNEL_TYPES = {"EEG": "eeg", "EOG": "eog", "ECG": "ecg", "EMG": "emg", "TRIG": "stim", "STIM": "stim", "MISC": "misc"}


def sidecar(path: Column, suffix: str) -> Column:
    """The sidecar's path beside ``..._eeg.<ext>``."""
    return F.regexp_replace(path, r"_eeg\.[^./]*$", suffix)


def event_file(recordings: DataFrame, files: DataFrame, path: str = "path", root: str = "events_root") -> DataFrame:
    """Adds ``event_path``: beside the recording, else in the events folder,
    else in its ``events`` folder; null where there is none."""
    name = F.regexp_extract(sidecar(F.col(path), "_events.tsv"), r"([^/]*)$", 1)
    tried = F.array(sidecar(F.col(path), "_events.tsv"), F.concat_ws("/", F.col(root), name), F.concat_ws("/", F.col(root), F.lit("events"), name))
    ranked = recordings.select(F.col(path).alias("_path"), F.posexplode(tried).alias("_rank", "_tried"))
    found = ranked.join(files.select(F.col("path").alias("_tried")).distinct(), "_tried").groupBy("_path").agg(F.min_by("_tried", "_rank").alias("event_path"))
    return recordings.join(found, F.col(path) == F.col("_path"), "left").drop("_path")


def merge_metadata(inherited: Column, own: Column) -> Column:
    """Two JSON objects (text) as a map; own keys win, what is no object is empty."""
    kind = "map<string,string>"
    a, b = (F.coalesce(F.from_json(x, kind), F.create_map().cast(kind)) for x in (inherited, own))
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def normalize_events(events: DataFrame) -> DataFrame:
    """Nulls to 0, durations at least 0, type from trial_type, value or "event",
    and values that are no numbers to null."""
    nan = F.lower(F.trim(F.col("value"))).isin("nan", "n/a", "")
    value = F.when(~nan, F.col("value"))
    return events.withColumns(
        {
            "onset": F.coalesce("onset", F.lit(0.0)),
            "duration": F.greatest(F.lit(0.0), F.coalesce("duration", F.lit(0.0))),
            "event_type": F.coalesce(F.col("trial_type"), value, F.lit("event")),
            "value": value,
        }
    )


def event_structs(rows: Column) -> Column:
    """The same for rows of an event file, as an array of structs."""
    number = lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))
    known = lambda x: F.when(~F.lower(F.trim(x)).isin("nan", "n/a", ""), x)
    return F.transform(
        rows,
        lambda e: F.struct(
            number(e.getItem("onset")).alias("onset_seconds"),
            F.greatest(F.lit(0.0), number(e.getItem("duration"))).alias("duration_seconds"),
            F.coalesce(e.getItem("trial_type"), known(e.getItem("value")), F.lit("event")).alias("event_type"),
            known(e.getItem("value")).alias("value"),
        ),
    )


def channel_kinds(channels: DataFrame, sidecar_rows: DataFrame, by: str = "recording_id") -> DataFrame:
    """Channels with the kind their sidecar states (eeg if none) and ``picked``:
    of kind eeg and not marked bad."""
    pairs = [x for k, v in CHANNEL_TYPES.items() for x in (F.lit(k), F.lit(v))]
    stated = sidecar_rows.select(by, F.col("name").alias("channel"), F.try_element_at(F.create_map(*pairs), F.upper("type")).alias("_kind"), F.coalesce(F.col("status") == "bad", F.lit(False)).alias("_bad"))
    rows = channels.join(stated, [by, "channel"], "left").withColumn("kind", F.coalesce("_kind", F.lit("eeg")))
    return rows.withColumn("picked", (F.col("kind") == "eeg") & ~F.coalesce("_bad", F.lit(False))).drop("_kind", "_bad")


def normalize_labels_by_file(trials: DataFrame, file: str = "source_uri", label: str = "label") -> DataFrame:
    """Labels 1 and 2 to 0 and 1, where a file's least is 1 and greatest 2."""
    bounds = trials.groupBy(file).agg(F.min(label).alias("_low"), F.max(label).alias("_high"))
    rows = trials.join(bounds, file)
    return rows.withColumn(label, F.when((F.col("_low") == 1) & (F.col("_high") == 2), F.col(label) - 1).otherwise(F.col(label))).drop("_low", "_high")


def normalize_label_by_event(value: Column) -> Column:
    return F.when(value.isin(1, 2), value - 1).otherwise(value)
