"""Recordings from files of any store that Spark reads.

Files are listed and read by Spark's ``binaryFile`` source, one row each, and
parsed in Arrow batches on the executors.  A file that cannot be read or
parsed becomes a row with ``error`` and no signal; strict readers raise.

A *source* (``MatSource``, ``EdfSource``, ``BidsSource``) discovers recordings
and turns any of them into *outcomes*: canonical windows, and for a recording
that fails one row with ``error_type`` and ``error`` and no sample.  Both come
from one parse of each file.  A recording is taken whole or not at all.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass
from fnmatch import fnmatch

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill import schema
from wavemill.functions import names, signals
from wavemill.operators import sidecars, windows
from wavemill.sources import edf, mat5, ranged

# Suffixes of recordings, the failures that skip a recording
# rather than end the job, and the channels of the 32-channel motor-imagery
# montage in the order of its files.
SUFFIXES = (".edf", ".bdf", ".set")
SKIPPED = (OSError, ValueError, RuntimeError, KeyError)
MONTAGE = tuple("Fp1 Fp2 Fz F3 F4 F7 F8 FC1 FC2 FC5 FC6 Cz C3 C4 T3 T4 A1 A2 CP1 CP2 CP5 CP6 Pz P3 P4 T5 T6 PO3 PO4 Oz O1 O2".split())

#: Paths up to this many rows are broadcast, others joined by shuffle.
BROADCAST_ROWS = 100_000

_PARSED = "path string, rate double, channel_names array<string>, signal array<array<float>>, error_type string, error string"
_TABLE = "array<map<string,string>>"


def files(spark: SparkSession, root: str, pattern: str = "*", content: bool = True, empty: bool = True) -> DataFrame:
    """path, length, modified and, if asked for, content of the files under
    ``root``, in any depth.

    Spark's source leaves out files without a byte; those are listed here, so
    that they are found and fail like other unreadable recordings.  For
    sidecars (``empty=False``) that is not asked.
    """
    columns = ["path", "length", F.col("modificationTime").alias("modified"), *(["content"] if content else [])]
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root).select(*columns)
    if not empty:
        return found
    void = [(p, 0, None, *([bytearray()] if content else [])) for p in _without_bytes(spark, root) if fnmatch(p.rsplit("/", 1)[-1], pattern)]
    return found.unionByName(spark.createDataFrame(void, found.schema)) if void else found


def _without_bytes(spark: SparkSession, root: str) -> list[str]:
    """Paths of zero-byte files, listed on the driver."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store, out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), []
    listed = store.listFiles(path, True)
    while listed.hasNext():
        status = listed.next()
        if status.getLen() == 0:
            out.append(status.getPath().toString())
    return out


def _few(rows: DataFrame) -> DataFrame:
    """Rows without contents, broadcast if there are few (counted)."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def discover_mat(spark: SparkSession, root: str) -> DataFrame:
    """``*_eeg.mat`` files, or all ``*.mat`` where there are none; two of one
    subject and session are an error."""
    found = files(spark, root, "*.mat", content=False)
    named = found.filter(F.col("path").endswith("_eeg.mat"))
    found = found if named.isEmpty() else named
    name = names.file_name(F.col("path"))
    keyed = found.select("path", "length", "modified", names.subject_number(name).alias("subject"), names.session_number(name).alias("session"))
    twice = keyed.groupBy("subject", "session").agg(F.sort_array(F.collect_list("path")).alias("paths")).filter(F.size("paths") > 1).limit(10).collect()
    if twice:
        raise ValueError("recordings of one subject and session: " + "; ".join(", ".join(r.paths) for r in twice))
    return keyed


def discover_edf(spark: SparkSession, root: str) -> DataFrame:
    """``*_eeg.edf`` files."""
    return files(spark, root, "*_eeg.edf", content=False)


def discover_bids(spark: SparkSession, root: str, subjects: Sequence[str] = (), tasks: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """``*_eeg`` recordings with their entities; the limit comes after filters,
    in order of path."""
    path = F.col("path")
    found = files(spark, root, "*_eeg.*", content=False).filter(names.suffix(path).isin(*SUFFIXES))
    found = found.select("path", "length", "modified", names.recording_id(path).alias("recording_id"), *[names.entity(path, k).alias(k) for k in ("sub", "ses", "task", "run")])
    if subjects:
        found = found.filter(F.col("sub").isin([s.removeprefix("sub-") for s in subjects]))
    if tasks:
        found = found.filter(F.col("task").isin([t.removeprefix("task-") for t in tasks]))
    return found if limit is None else found.orderBy("path").limit(limit)


def tables(contents: DataFrame) -> DataFrame:
    """``path`` and ``rows`` of tab-separated files, each by its own header;
    an empty cell is null, and rows are null where a file is no table."""

    def read(data: bytes) -> list[dict[str, str | None]] | None:
        try:
            return [{k: v or None for k, v in row.items() if k is not None and not isinstance(v, list)} for row in csv.DictReader(io.StringIO(data.decode("utf-8-sig")), delimiter="\t")]
        except (UnicodeDecodeError, csv.Error):
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "rows": [read(bytes(c)) for c in batch["content"]]})

    return contents.select("path", "content").mapInPandas(run, f"path string, rows {_TABLE}")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """What the files of ``root`` hold, without their samples: path, length,
    channels, rate, samples, duration and any error; for MAT files trials too.

    Only headers are read, by range: those of EDF and BDF files, the SET file
    beside its data file, and the first bytes of each variable of a MAT file.
    A SET file with its samples inside is read whole, as its labels come last.
    """
    found = files(spark, root, content=False).filter(names.suffix(F.col("path")).isin(*SUFFIXES, ".mat", ".fdt"))
    mats = found.filter(names.suffix(F.col("path")) == ".mat").select("path", "length")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, length in zip(batch["path"], batch["length"], strict=True):
                try:
                    data = ranged.Bytes(path)
                    shapes = mat5.shapes(data.read, data.size)
                    trials, channels, samples = shapes["data"]
                    out.append((path, length, channels, None, samples, trials, None, None))
                except SKIPPED as error:
                    out.append((path, length, None, None, None, None, type(error).__name__, str(error)))
            yield pd.DataFrame(out, columns=["path", "length", "channels", "rate", "samples", "trials", "error_type", "error"]).astype({k: "Int64" for k in ("channels", "samples", "trials")})

    trials = mats.mapInPandas(run, "path string, length long, channels long, rate double, samples long, trials long, error_type string, error string")
    others = ranged.headers(_with_data_files(spark, root, found.filter(names.suffix(F.col("path")) != ".mat"), "path", "length"))
    others = others.select("path", "length", F.size("channel_names").cast("long").alias("channels"), "rate", "samples", F.lit(None).cast("long").alias("trials"), "error_type", "error")
    others = others.withColumn("channels", F.when(F.col("error").isNull(), F.col("channels")))
    return trials.unionByName(others).withColumn("duration_seconds", F.col("samples") / F.col("rate"))


def _with_data_files(spark: SparkSession, root: str, found: DataFrame, *columns: str) -> DataFrame:
    """Recordings with ``extra``, the path of the data file beside a SET; where
    tasks cannot open the store, also with the bytes of both."""
    stem = F.regexp_replace("path", r"(?i)\.(set|fdt)$", "")
    data = found.filter(F.lower("path").endswith(".fdt")).groupBy(stem.alias("_stem")).agg(F.min("path").alias("extra"))
    rows = found.filter(names.suffix(F.col("path")).isin(*SUFFIXES)).withColumn("_stem", stem).join(_few(data), "_stem", "left").select(*columns, "extra")
    if ranged.scheme(root) in ranged.STORES:
        return rows
    contents = files(spark, root).select("path", "content")
    rows = rows.join(contents, "path")
    return rows.join(contents.select(F.col("path").alias("extra"), F.col("content").alias("more")), "extra", "left")


def file_hashes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, length and SHA-256 of files."""
    return files(spark, root, pattern).select("path", "length", F.sha2("content", 256).alias("sha256"))


def _parse(data: bytes, suffix: str, extra: bytes | None) -> tuple[float, list[str], np.ndarray]:
    """Rate, names and microvolts of a recording."""
    if suffix in (".edf", ".bdf"):
        found = edf.read(data)
        return found.rate, found.names, found.volts() * 1e6
    eeg = mat5.read(data)
    eeg = eeg.get("EEG", eeg)
    values = eeg["data"]
    count, points = int(np.ravel(eeg["nbchan"])[0]), int(np.ravel(eeg["pnts"])[0])
    if isinstance(values, str):
        if extra is None:
            raise OSError(f"missing data file {values}")
        values = np.frombuffer(extra, "<f4").reshape(count, points, order="F")
    places = eeg.get("chanlocs")
    places = [places] if isinstance(places, dict) else places
    labels = [p["labels"] for p in places] if isinstance(places, list) and places else [f"E{k + 1}" for k in range(count)]
    return float(np.ravel(eeg["srate"])[0]), labels, np.asarray(values, float)


def _guarded(run: Callable[..., tuple], *args: object) -> tuple:
    try:
        rate, labels, values = run(*args)
        return rate, labels, list(np.asarray(values, np.float32)), None, None
    except SKIPPED as error:
        return None, None, None, type(error).__name__, str(error)


def parse_recordings(contents: DataFrame) -> DataFrame:
    """Parsed EDF, BDF and SET recordings; a ``.set`` finds the ``.fdt`` beside it."""
    data = contents.filter(F.lower("path").endswith(".fdt")).select(F.regexp_replace("path", r"(?i)\.fdt$", "").alias("_stem"), F.col("content").alias("_extra"))
    main = contents.filter(names.suffix(F.col("path")).isin(*SUFFIXES)).withColumn("_stem", F.regexp_replace("path", r"(?i)\.set$", ""))
    rows = main.join(data, "_stem", "left").select("path", names.suffix(F.col("path")).alias("suffix"), "content", "_extra")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(r.path, *_guarded(_parse, r.content, r.suffix, r._3)) for r in batch.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["path", "rate", "channel_names", "signal", "error_type", "error"])

    return rows.mapInPandas(run, _PARSED)


def parse_trials(contents: DataFrame, channels: int = 32) -> DataFrame:
    """Trials of pre-segmented MAT files: path, trial_index, label and signal.

    ``data`` is [trial][channel][sample] with ``channels`` channels and
    ``labels`` has one of 1 and 2 (or 0 and 1) for each trial.
    """

    def one(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        found = mat5.read(data)
        values, labels = np.asarray(found["data"]), np.ravel(found["labels"]).astype(int)
        if values.ndim != 3:
            raise ValueError(f"data has {values.ndim} dimensions, not 3")
        if len(labels) != len(values):
            raise ValueError(f"{len(values)} trials but {len(labels)} labels")
        if values.shape[1] != channels:
            raise ValueError(f"{values.shape[1]} channels, not {channels}")
        if len(labels) and labels.min() == 1 and labels.max() == 2:
            labels = labels - 1
        if not len(labels):
            raise ValueError("recording produced no windows")
        if not np.isin(labels, (0, 1)).all():
            raise ValueError("labels are not binary")
        return values.astype(np.float32), labels

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                try:
                    values, labels = one(r.content)
                    out = [(r.path, k, int(label), list(v), None, None) for k, (v, label) in enumerate(zip(values, labels, strict=True))]
                except SKIPPED as error:
                    out = [(r.path, None, None, None, type(error).__name__, str(error))]
                yield pd.DataFrame(out, columns=["path", "trial_index", "label", "signal", "error_type", "error"]).astype({"trial_index": "Int32", "label": "Int32"})

    return contents.select("path", "content").mapInPandas(run, "path string, trial_index int, label int, signal array<array<float>>, error_type string, error string")


def failures(parsed: DataFrame, strict: bool = False) -> DataFrame:
    """Recordings that could not be read; ``strict``: raises if there are any."""
    bad = parsed.filter("error is not null").select("path", "error_type", "error")
    if strict and (first := bad.limit(10).collect()):
        raise ValueError("unreadable recordings: " + "; ".join(f"{r.path}: {r.error}" for r in first))
    return bad


#: Columns of outcomes: those of windows, and what failed.
OUTCOME = [f.name for f in schema.WINDOW] + ["error_type", "error"]


def _outcomes(rows: DataFrame, **columns: Column) -> DataFrame:
    """Canonical outcomes; columns not given are taken from ``rows`` or null."""
    good, out = F.col("error").isNull(), []
    fixed = {"shard_path": F.lit(""), "record_batch": F.lit(0), "row_in_batch": F.lit(0), "preprocessing_version": F.lit(schema.PREPROCESSING_VERSION)}
    for field in schema.WINDOW:
        value = columns.get(field.name, fixed.get(field.name, F.col(field.name) if field.name in rows.columns else F.lit(None)))
        whose = field.name in ("source_uri", "dataset_id")
        out.append((value if whose else F.when(good, value)).cast(field.dataType).alias(field.name))
    return rows.select(*out, "error_type", "error")


def _fail(rows: DataFrame, *rules: tuple[Column, str, Column | str]) -> DataFrame:
    """Adds the first failure that holds (when, type, message) to rows without one."""
    kind, what = F.col("error_type"), F.col("error")
    for when, name, message in rules:
        holds = what.isNull() & F.coalesce(when, F.lit(False))
        kind, what = F.when(holds, name).otherwise(kind), F.when(holds, message if isinstance(message, Column) else F.lit(message)).otherwise(what)
    return rows.withColumns({"error_type": kind, "error": what})


def _contents(spark: SparkSession, root: str, pattern: str, paths: DataFrame) -> DataFrame:
    return files(spark, root, pattern).join(_few(paths.select("path")), "path", "left_semi")


@dataclass(frozen=True)
class MatSource:
    """MAT sessions of pre-segmented trials, one window a trial."""

    root: str
    rate: float = 200.0
    original_rate: float = 250.0
    scale: float = 100.0
    channels: int = 32
    dataset: str = "shu-mi"
    kind: str = "shu-mat"

    def settings(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    def discover(self, spark: SparkSession) -> DataFrame:
        return discover_mat(spark, self.root)

    def outcomes(self, spark: SparkSession, paths: DataFrame) -> DataFrame:
        known = discover_mat(spark, self.root).select("path", "subject", "session")
        rows = parse_trials(_contents(spark, self.root, "*.mat", paths), self.channels).join(_few(known), "path")
        wrong = F.col("subject").isNull() | ~F.col("subject").between(1, 25)
        rows = _fail(rows, (wrong, "ValueError", F.concat(F.lit("no subject in "), "path")), (F.col("signal").isNull(), "ValueError", "recording produced no windows"))
        rows = rows.withColumn("signal", F.when(F.col("error").isNull(), signals.resample(self.original_rate, self.rate)("signal")))
        points = F.size(F.col("signal")[0])
        labels = MONTAGE if self.channels == len(MONTAGE) else tuple(f"C{k:02d}" for k in range(self.channels))
        return _outcomes(
            rows,
            sample_id=names.trial_sample_id(self.dataset, F.col("subject"), F.col("session"), F.col("trial_index")),
            dataset_id=F.lit(self.dataset),
            subject_id=F.format_string("sub-%03d", "subject"),
            session_id=F.when(F.col("session") >= 0, F.format_string("ses-%02d", "session")),
            task=F.lit("motorimagery"),
            split=F.when(F.col("subject").between(1, 25), names.subject_split(F.when(F.col("subject").between(1, 25), F.col("subject")).otherwise(1))),
            sampling_rate_hz=F.lit(self.rate),
            num_channels=F.size("signal"),
            num_samples=points,
            channel_names=F.array(*[F.lit(c) for c in labels]),
            channel_mask=F.transform("signal", lambda _: F.lit(True)),
            start_seconds=F.col("trial_index") * points / F.lit(self.rate),
            duration_seconds=points / F.lit(self.rate),
            source_uri=F.col("path"),
            source_format=F.lit("mat"),
            amplitude_scale=F.lit(self.scale),
            quality_flags=signals.batch_flags(F.col("signal")),
            metadata_json=F.to_json(F.struct("trial_index")),
        )


@dataclass(frozen=True)
class EdfSource:
    """Continuous EDFs cut at the events of their TSV files.

    Positions count from 1 and durations are in samples.  The event file is
    beside the recording, in ``events_root``, or in ``events_root/events``; one
    event that is out of bounds or has no position fails its recording.
    """

    root: str
    events_root: str = ""
    rate: float | str = 200.0
    scale: float = 100.0
    dataset: str = "shu-mi"
    kind: str = "shu-edf"

    def settings(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    def discover(self, spark: SparkSession) -> DataFrame:
        return discover_edf(spark, self.root)

    def outcomes(self, spark: SparkSession, paths: DataFrame) -> DataFrame:
        events_root = self.events_root or self.root
        found = files(spark, events_root, "*_events.tsv", empty=False)
        if events_root != self.root:
            found = found.unionByName(files(spark, self.root, "*_events.tsv", empty=False)).dropDuplicates(["path"])
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(events_root)
        where = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
        beside = sidecars.event_file(paths.select("path", F.lit(where).alias("events_root")), found.select("path")).select("path", "event_path")
        chosen = files(spark, self.root, "*_eeg.edf", content=False).join(_few(paths.select("path")), "path", "left_semi")
        plan = _with_data_files(spark, self.root, chosen, "path")
        parsed = ranged.headers(plan).join(_few(beside), "path")
        read = tables(found).select(F.col("path").alias("event_path"), F.col("rows").alias("events"))
        rows = _with_bytes(parsed.join(read, "event_path", "left"), plan)
        events = F.transform("events", lambda e: e.getItem("sample"))
        number = lambda x: F.rint(x.try_cast("double")).cast("long")
        has = lambda k: F.exists("events", lambda e: F.map_contains_key(e, k))
        position = lambda e: F.when(F.map_contains_key(e, F.lit("sample")), e.getItem("sample")).otherwise(e.getItem("onset"))
        cuts = F.transform("events", lambda e, i: F.struct(i.alias("trial"), (number(position(e)) - 1).alias("start"), number(e.getItem("duration")).alias("length"), number(e.getItem("value")).alias("value"), e.getItem("trial_type").alias("trial_type")))
        rows = rows.withColumn("trials", cuts).withColumnRenamed("samples", "points")
        inside = lambda c: (c["start"] >= 0) & (c["length"] > 0) & (c["start"] + c["length"] <= F.col("points"))
        name = names.file_name(F.col("path"))
        rows = rows.withColumn("subject", names.subject_number(name)).withColumn("session", names.session_number(name))
        rows = _fail(
            rows,
            (F.col("subject").isNull(), "ValueError", F.concat(F.lit("no subject in "), "path")),
            (F.col("event_path").isNull(), "FileNotFoundError", F.concat(F.lit("no event file for "), "path")),
            (events.isNull(), "ParserError", F.concat(F.lit("not a table: "), "event_path")),
            ((F.size("events") > 0) & ~(has("duration") & has("value") & (has("sample") | has("onset"))), "ValueError", "events lack duration, value or position"),
            (F.exists("trials", lambda c: ~F.coalesce(inside(c), F.lit(False))), "ValueError", "event outside its recording"),
            (F.exists("trials", lambda c: ~F.coalesce(sidecars.normalize_label_by_event(c["value"]).isin(0, 1), F.lit(False))), "ValueError", "labels are not binary"),
            (F.size("trials") < 1, "ValueError", "recording produced no windows"),
        )
        rate = F.col("rate") if self.rate == "auto" else F.lit(float(self.rate))
        rows = rows.drop("events").withColumn("to", rate).withColumn("keep", F.sequence(F.lit(0), F.size("channel_names") - 1))
        good = rows.filter("error is null").withColumn("cuts", F.transform("trials", lambda c: F.struct(c["start"].alias("start"), c["length"].cast("int").alias("length"))))
        rows = _read_or_failed(good, rows)
        rows = rows.withColumn("cut", F.get("trials", F.col("cut"))).withColumn("signal", signals.resample_to("signal", "rate", "to"))
        return _outcomes(
            rows,
            sample_id=names.trial_sample_id(self.dataset, F.col("subject"), F.col("session"), F.col("cut.trial")),
            dataset_id=F.lit(self.dataset),
            subject_id=F.format_string("sub-%03d", "subject"),
            session_id=F.when(F.col("session") >= 0, F.format_string("ses-%02d", "session")),
            task=F.lit("motorimagery"),
            split=names.subject_split(F.coalesce("subject", F.lit(1))),
            sampling_rate_hz=F.col("to"),
            num_channels=F.size("signal"),
            num_samples=F.size(F.col("signal")[0]),
            channel_mask=F.transform("signal", lambda _: F.lit(True)),
            label=sidecars.normalize_label_by_event(F.col("cut.value")),
            start_seconds=F.col("cut.start") / F.col("rate"),
            duration_seconds=F.col("cut.length") / F.col("rate"),
            source_uri=F.col("path"),
            source_format=F.lit("edf"),
            amplitude_scale=F.lit(self.scale),
            quality_flags=signals.batch_flags(F.col("signal")),
            metadata_json=F.to_json(F.struct(F.col("event_path").alias("event_file"), F.col("cut.trial").alias("trial_index"), F.col("cut.trial_type").alias("trial_type"))),
        )


def _read_or_failed(good: DataFrame, rows: DataFrame, resample: bool = False) -> DataFrame:
    """The cuts of good recordings with their signals, and one row for each of
    the others."""
    read = ranged.read_cuts(good, resample)
    failed = rows.filter("error is not null").withColumns({"cut": F.lit(None).cast("int"), "start_index": F.lit(None).cast("long"), "signal": F.lit(None).cast("array<array<float>>")})
    return read.unionByName(failed.select(read.columns))


def _with_bytes(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows with the bytes of their files, where tasks cannot open them."""
    return rows.join(plan.select("path", "content", "more"), "path") if "content" in plan.columns else rows


def _bids_plan(spark: SparkSession, root: str, paths: DataFrame | None, chosen: dict[str, object]) -> DataFrame:
    """BIDS recordings by their headers and sidecars, without a sample: what
    ``bids_recordings`` tells of each, with ``rate``, ``samples``, ``extra`` and
    ``keep``, the channels that stay."""
    found = discover_bids(spark, root, **chosen)
    if paths is not None:
        found = found.join(_few(paths.select("path")), "path", "left_semi")
    kept = found.drop("length", "modified")
    listed = files(spark, root, "*_eeg.*", content=False)
    plan = _with_data_files(spark, root, listed, "path").join(_few(kept.select("path")), "path", "left_semi")
    rows = ranged.headers(plan).join(_few(kept), "path")
    beside = {"_channels.tsv": "channel_rows", "_events.tsv": "event_rows", "_eeg.json": "own_json"}
    for suffix, column in beside.items():
        at = files(spark, root, f"*{suffix}", empty=False)
        at = at.select("path", F.col("content").cast("string").alias("rows")) if suffix.endswith("json") else tables(at)
        rows = rows.join(at.select(F.col("path").alias("_at"), F.col("rows").alias(column)), sidecars.sidecar(F.col("path"), suffix) == F.col("_at"), "left")
        rows = rows.withColumn("events_path", F.col("_at")).drop("_at") if suffix == "_events.tsv" else rows.drop("_at")
    task = files(spark, root, "task-*_eeg.json", empty=False).select(F.regexp_extract("path", r"/task-([^/]*)_eeg\.json$", 1).alias("task"), F.regexp_replace("path", "/[^/]*$", "").alias("_folder"), F.col("content").cast("string").alias("task_json"))
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    where = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    rows = rows.join(task.filter(F.col("_folder") == where).drop("_folder"), "task", "left")
    pairs = [x for k, v in sidecars.CHANNEL_TYPES.items() for x in (F.lit(k), F.lit(v))]
    kinds, stated = F.create_map(*pairs), F.coalesce("channel_rows", F.array().cast(_TABLE))
    own = lambda c: F.get(F.filter(stated, lambda r: r.getItem("name") == c), F.lit(0))
    eeg = lambda c: (F.coalesce(F.try_element_at(kinds, F.upper(own(c).getItem("type"))), F.lit("eeg")) == "eeg") & ~F.coalesce(own(c).getItem("status") == "bad", F.lit(False))
    rows = rows.withColumn("_kept", F.filter(F.sequence(F.lit(0), F.size("channel_names") - 1), lambda k: eeg(F.get("channel_names", k))))
    rows = rows.withColumn("channel_names", F.transform("_kept", lambda k: names.normalize_channel(F.get("channel_names", k))))
    lower = F.transform("channel_names", lambda c: F.lower(c))
    rows = _fail(
        rows,
        (F.col("sub").isNull(), "ValueError", F.concat(F.lit("no subject in "), "path")),
        (F.col("recording_id") == "", "ValueError", F.concat(F.lit("no recording id in "), "path")),
        (F.size("_kept") == 0, "ValueError", F.concat(F.lit("no EEG channels in "), "path")),
        (F.size(F.array_distinct(lower)) < F.size(lower), "ValueError", "two channels have one name"),
    )
    events = sidecars.event_structs(F.coalesce("event_rows", F.array().cast(_TABLE)))
    merged = sidecars.merge_metadata(F.col("task_json"), F.col("own_json"))
    metadata = F.to_json(F.struct(stated.alias("channels"), "events_path", "recording_id", F.map_from_entries(F.array_sort(F.map_entries(merged))).alias("recording_json"), F.col("run").alias("run_id")))
    told = rows.select(
        "path",
        "extra",
        "recording_id",
        F.concat(F.lit("sub-"), "sub").alias("subject_id"),
        F.concat(F.lit("ses-"), "ses").alias("session_id"),
        F.concat(F.lit("task-"), "task").alias("task"),
        F.col("rate").cast("float").alias("sampling_rate_hz"),
        "channel_names",
        F.col("path").alias("source_uri"),
        F.regexp_replace(names.suffix(F.col("path")), r"^\.", "").alias("source_format"),
        metadata.alias("metadata_json"),
        events.alias("events"),
        "rate",
        "samples",
        F.col("_kept").alias("keep"),
        "error_type",
        "error",
    )
    return _with_bytes(told, plan)


def bids_recordings(spark: SparkSession, root: str, dataset: str = "hbn", paths: DataFrame | None = None, **chosen: object) -> DataFrame:
    """Recordings of a BIDS tree: their EEG channels not marked bad, events and
    the merged JSON of their sidecars; and ``error`` where one cannot be read,
    has no subject, no EEG channel, or two channels of one name.

    A recording is one row here; ``BidsSource`` cuts windows without that.
    """
    rows = _bids_plan(spark, root, paths, chosen).withColumns({"dataset_id": F.lit(dataset), "to": F.col("rate")})
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("samples").cast("int").alias("length")))
    out = _read_or_failed(rows.filter("error is null").withColumn("cuts", whole), rows)
    return out.select("recording_id", "dataset_id", "subject_id", "session_id", "task", "sampling_rate_hz", "channel_names", "signal", "source_uri", "source_format", "metadata_json", "events", "error_type", "error")


@dataclass(frozen=True)
class BidsSource:
    """BIDS recordings cut into sliding windows.

    ``policy`` keeps all EEG channels (``preserve``) or takes ``channels`` in
    their order (``select``; a missing one fails the recording, unless
    ``allow_missing``, which puts zeros and a false mask there).
    """

    root: str
    dataset: str = "hbn"
    subjects: Sequence[str] = ()
    tasks: Sequence[str] = ()
    limit: int | None = None
    window: float = 4.0
    stride: float = 4.0
    rate: float | str = "auto"
    policy: str = "preserve"
    channels: Sequence[str] = ()
    allow_missing: bool = False
    kind: str = "bids"

    def __post_init__(self) -> None:
        if self.policy not in ("preserve", "select"):
            raise ValueError(f"unknown channel policy {self.policy}")
        if self.policy == "select" and not self.channels:
            raise ValueError("the policy select needs channels")
        if self.window <= 0 or self.stride <= 0:
            raise ValueError("window and stride must be positive")

    def settings(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if k not in ("subjects", "tasks", "limit")}, sort_keys=True)

    def discover(self, spark: SparkSession) -> DataFrame:
        return discover_bids(spark, self.root, self.subjects, self.tasks, self.limit)

    def outcomes(self, spark: SparkSession, paths: DataFrame) -> DataFrame:
        rows = _bids_plan(spark, self.root, paths, {}).withColumn("dataset_id", F.lit(self.dataset))
        rows = rows.withColumn("channel_mask", F.transform("channel_names", lambda _: F.lit(True)))
        if self.policy == "select":
            asked = F.array(*[names.normalize_channel(F.lit(c)) for c in self.channels])
            have = F.transform("channel_names", lambda c: F.lower(c))
            missing = F.filter(asked, lambda c: ~F.array_contains(have, F.lower(c)))
            if not self.allow_missing:
                rows = _fail(rows, (F.size(missing) > 0, "KeyError", F.concat(F.lit("missing channels "), F.array_join(missing, ", "))))
            at = F.transform(asked, lambda c: F.coalesce(F.get("keep", F.array_position(have, F.lower(c)).cast("int") - 1), F.lit(-1)))
            rows = rows.withColumns({"keep": at, "channel_mask": signals.channel_mask(F.col("channel_names"), asked)}).withColumn("channel_names", asked)
        rate = F.col("rate") if self.rate == "auto" else F.lit(float(self.rate))
        rows = rows.withColumn("to", rate).withColumn("sampling_rate_hz", rate.cast("float"))
        size, stride = (windows.points(x, F.col("sampling_rate_hz").cast("double")) for x in (self.window, self.stride))
        length = F.rint(F.col("samples") * F.col("to") / F.col("rate")).cast("long")
        starts = windows.window_starts(length, size.cast("long"), stride.cast("long"))
        rows = rows.withColumn("_size", size).withColumn("_cuts", F.transform(starts, lambda s: F.struct(s.alias("start"), F.col("_size").alias("length"))))
        rows = _fail(rows, (F.coalesce(F.size("_cuts"), F.lit(0)) < 1, "ValueError", "recording produced no windows"))
        good = rows.filter("error is null").withColumnRenamed("_cuts", "cuts")
        rows = _read_or_failed(good, rows.drop("_cuts"), resample=self.rate != "auto")
        return _outcomes(
            rows,
            sample_id=names.window_sample_id(F.col("dataset_id"), F.col("recording_id"), F.col("subject_id"), F.col("session_id"), F.col("task"), F.col("start_index")),
            num_channels=F.size("signal"),
            num_samples=F.col("_size"),
            start_seconds=F.col("start_index") / F.col("sampling_rate_hz").cast("double"),
            duration_seconds=F.lit(float(self.window)),
            amplitude_scale=F.lit(1.0),
            quality_flags=signals.batch_flags(F.col("signal")),
        )
