"""Names, ids and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entity keys of file names, and the subjects of each split.
ENTITIES = ("sub", "ses", "task", "run", "acq", "recording")
# Module names of released checkpoints and what they are called
# here, in the order in which they are replaced.
CHECKPOINT_KEYS = (
    ("patch_embedding.proj_in.", "patch_embedding.time_projection."),
    ("patch_embedding.spectral_proj.", "patch_embedding.spectral_projection."),
    ("patch_embedding.positional_encoding.0.", "patch_embedding.positional_encoding."),
    ("encoder.layers.", "encoder."),
    (".self_attn_s.", ".spatial_attention."),
    (".self_attn_t.", ".temporal_attention."),
    ("proj_out.0.", "proj_out."),
)
SPLIT_SUBJECTS = {"train": (1, 15), "val": (16, 20), "test": (21, 25)}


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]*)$", 1))


def entity(path: Column, key: str) -> Column:
    """The value of a file-name entity, as in ``sub-01``; null if absent."""
    return F.nullif(F.regexp_extract(file_name(path), rf"(?:^|_){key}[-_]([^_]+)", 1), F.lit(""))


def entities(path: Column) -> Column:
    """All entities of a file name as a map without absent ones."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), entity(path, k).alias("value")) for k in ENTITIES])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def recording_id(path: Column) -> Column:
    return F.regexp_replace(stem(path), "_eeg$", "")


def normalize_channel(name: Column) -> Column:
    """Without outer white space, spaces, "EEG", and outer dashes and underscores."""
    bare = F.replace(F.replace(F.trim(name), F.lit(" "), F.lit("")), F.lit("EEG"), F.lit(""))
    return F.regexp_replace(bare, "^[-_]+|[-_]+$", "")


def subject_number(name: Column, alias_out_of_range: bool = False) -> Column:
    """The subject (1 to 25) that a file name states; null if none.

    ``alias_out_of_range``: as a last resort takes any 1-25 followed by no
    digit, so that ``sub-026`` gives 6.
    """
    one_to_25 = r"(25|2[0-4]|1\d|[1-9])"
    stated = F.nullif(F.regexp_extract(F.lower(name), rf"sub(?:ject)?[-_ ]*0*{one_to_25}(?:\D|$)", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(name, rf"(?:^|\D)0*{one_to_25}(?:\D|$)", 1), F.lit(""))
    loose = F.nullif(F.regexp_extract(name, rf"{one_to_25}(?:\D|$)", 1), F.lit(""))
    explicit = F.lower(name).rlike(r"sub(?:ject)?[-_ ]*\d")
    return F.coalesce(stated, loose if alias_out_of_range else F.when(~explicit, bare)).cast("int")


def session_number(name: Column) -> Column:
    """The session a file name states, else its second number, else -1."""
    stated = F.nullif(F.regexp_extract(F.lower(name), r"(?:session|sess|ses)[-_ ]*0*(\d+)", 1), F.lit(""))
    second = F.try_element_at(F.regexp_extract_all(name, F.lit(r"\d+"), F.lit(0)), F.lit(2))
    return F.coalesce(stated, second, F.lit("-1")).cast("int")


def digits(name: Column) -> Column:
    """All digits of a name as one number; null if there are none."""
    return F.nullif(F.regexp_replace(name, r"\D", ""), F.lit("")).cast("int")


def subject_split(subject: Column) -> Column:
    """The split of a subject number; raises for one of no split."""
    out = None
    for name, (low, high) in SPLIT_SUBJECTS.items():
        out = F.when(subject.between(low, high), name) if out is None else out.when(subject.between(low, high), name)
    return out.otherwise(F.raise_error(F.concat(F.lit("no split has subject "), F.coalesce(subject.cast("string"), F.lit("null")))).cast("string"))


def trial_sample_id(dataset: str, subject: Column, session: Column, trial: Column) -> Column:
    return F.format_string(f"{dataset}:sub-%03d:ses-%02d:trial-%04d", subject, session, trial)


def window_sample_id(dataset: Column, recording: Column, subject: Column, session: Column, task: Column, start: Column) -> Column:
    """Of the recording if it is known, else of subject, session and task."""
    place = F.coalesce(recording, F.concat_ws(":", subject, F.coalesce(session, F.lit("none")), F.coalesce(task, F.lit("none"))))
    return F.format_string("%s:%s:sample-%09d", dataset, place, start)


def rate_or_source(value: Column, source: Column) -> Column:
    """A target rate given as text: ``auto`` is the source's; must be positive."""
    rate = F.when(F.lower(F.trim(value)) == "auto", source.cast("double")).otherwise(value.try_cast("double"))
    return F.when(rate > 0, rate).otherwise(F.raise_error(F.concat(F.lit("not a sampling rate: "), F.coalesce(value, F.lit("null")))).cast("double"))


def split_or_unspecified(split: Column) -> Column:
    return F.coalesce(F.nullif(split, F.lit("")), F.lit("unspecified"))


def sorted_json(entries: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def checkpoint_key(name: Column) -> Column:
    """A parameter's name with its modules called as they are here."""
    for old, new in CHECKPOINT_KEYS:
        name = F.replace(name, F.lit(old), F.lit(new))
    return name
