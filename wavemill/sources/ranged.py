"""Recordings read by range: headers first, then only the samples of the cuts.

A recording is never a row.  Its header (some kilobytes) becomes one; sidecars,
channels and failures are settled on such rows, and what is left is read as
*cuts* (first sample, number of samples) of chosen channels.  A task walks
through the cuts of its part of a recording in blocks and keeps, between two
blocks, only the samples that both need.  So files may be of any size.

``RecordingSource`` is the same as a Spark data source, ``recordings``: files
are parts by size, subjects, sessions, tasks and paths prune files, times prune
records and channels prune bytes, all by filters that are pushed down.
"""

from __future__ import annotations

import fnmatch
import math
import os
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from wavemill.functions.signals import fft_resample
from wavemill.sources import edf, mat5

#: What a part of a recording reads, and what a block of it holds, in bytes.
PART_BYTES, BLOCK_BYTES = 64 << 20, 8 << 20

#: Failures of a file; a file that cannot be read is a row with an error.
SKIPPED = (OSError, ValueError, RuntimeError, KeyError)

#: Stores that tasks open by themselves.
STORES = ("", "file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")


def scheme(path: str) -> str:
    found = re.match(r"([a-z][a-z0-9+.-]*):", path)
    return found[1] if found else ""


class Bytes:
    """A file of a store, read by range; ``taken`` counts the bytes."""

    def __init__(self, path: str, content: bytes | None = None) -> None:
        self.taken, self._content, kind = 0, content, scheme(path)
        if content is not None:
            self.size = len(content)
        elif kind in ("", "file"):
            self._file = open(re.sub(r"^file:/*", "/", path), "rb")
            self.size = os.fstat(self._file.fileno()).st_size
        else:
            store, place = pa.fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", path))
            self._file = store.open_input_file(place)
            self.size = self._file.size()

    def read(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        self.taken += n
        if self._content is not None:
            return self._content[at : at + n]
        self._file.seek(at)
        return self._file.read(n)

    def close(self) -> None:
        if self._content is None:
            self._file.close()


class _Edf:
    """EDF and BDF: records of all signals, one after another."""

    def __init__(self, data: Bytes) -> None:
        self.data = data
        first = data.read(0, 256)
        count = first[252:256].strip()
        h = edf.header(first + data.read(256, 256 * int(count)) if count.isdigit() else first)
        self.width, self.start = h["width"], h["size"]
        counts = np.array([int(x) for x in h["samples"]])
        self.cuts = np.concatenate([[0], np.cumsum(counts)])
        self.record = int(counts.sum()) * self.width
        if self.record <= 0:
            raise ValueError("EDF file has no samples in a record")
        own = [i for i, name in enumerate(h["label"]) if "Annotations" not in name and name != "Status"]
        if not own:
            raise ValueError("EDF file has no signals")
        self.points = int(counts[own[0]])
        if any(counts[i] != self.points for i in own):
            raise ValueError("EDF signals differ in rate")
        there = (data.size - self.start) // self.record
        records = h["records"] if h["records"] >= 0 else there
        if records > there:
            raise ValueError("EDF file ends early")
        self.own, self.names, self.rate, self.samples = own, [h["label"][i] for i in own], self.points / h["seconds"], records * self.points
        low, high, dlow, dhigh = (np.array([float(h[k][i]) for i in own]) for k in ("phys_min", "phys_max", "dig_min", "dig_max"))
        if (dhigh == dlow).any():
            raise ValueError("EDF signal has no digital range")
        volts = np.array([edf.UNITS.get(h["unit"][i].strip().lower(), 1.0) for i in own]) * 1e6
        self.gain, self.offset = (high - low) / (dhigh - dlow) * volts, (low - dlow * (high - low) / (dhigh - dlow)) * volts

    def _values(self, raw: bytes) -> np.ndarray:
        if self.width == 2:
            return np.frombuffer(raw, "<i2")
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        values = parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16
        return np.where(values >= 1 << 23, values - (1 << 24), values)

    def read(self, low: int, high: int, channels: Sequence[int]) -> np.ndarray:
        first, last = low // self.points, -(-high // self.points)
        out = np.empty((len(channels), (last - first) * self.points), np.float32)
        size = self.points * self.width
        if len(channels) * size * 4 <= self.record:  # few of the channels: only their bytes
            for k, c in enumerate(channels):
                at = self.start + int(self.cuts[self.own[c]]) * self.width
                raw = b"".join(self.data.read(at + r * self.record, size) for r in range(first, last))
                out[k] = self._values(raw) * self.gain[c] + self.offset[c]
        else:
            values = self._values(self.data.read(self.start + first * self.record, (last - first) * self.record)).reshape(last - first, -1)
            for k, c in enumerate(channels):
                at = int(self.cuts[self.own[c]])
                out[k] = values[:, at : at + self.points].ravel() * self.gain[c] + self.offset[c]
        return out[:, low - first * self.points : high - first * self.points]


class _Set:
    """A SET file, its samples in frames of the ``.fdt`` beside it or within."""

    def __init__(self, data: Bytes, extra: Bytes | None) -> None:
        eeg = mat5.read(data.read(0, data.size))
        eeg = eeg.get("EEG", eeg)
        self.count, self.samples, self.rate = int(np.ravel(eeg["nbchan"])[0]), int(np.ravel(eeg["pnts"])[0]), float(np.ravel(eeg["srate"])[0])
        places = eeg.get("chanlocs")
        places = [places] if isinstance(places, dict) else places
        self.names = [p["labels"] for p in places] if isinstance(places, list) and places else [f"E{k + 1}" for k in range(self.count)]
        self.values, self.extra = eeg["data"], extra
        if isinstance(self.values, str):
            if extra is None:
                raise OSError(f"missing data file {self.values}")
            if extra.size < 4 * self.count * self.samples:
                raise ValueError("data file ends early")
        else:
            self.values = np.asarray(self.values)
            if self.values.shape != (self.count, self.samples):
                raise ValueError(f"data has shape {self.values.shape}, not {(self.count, self.samples)}")
        if len(self.names) != self.count:
            raise ValueError(f"{len(self.names)} channel labels for {self.count} channels")

    def read(self, low: int, high: int, channels: Sequence[int]) -> np.ndarray:
        if not isinstance(self.values, str):
            return self.values[list(channels), low:high].astype(np.float32)
        frames = np.frombuffer(self.extra.read(4 * self.count * low, 4 * self.count * (high - low)), "<f4").reshape(-1, self.count)
        return np.ascontiguousarray(frames[:, list(channels)].T)


def open_recording(path: str, extra: str | None = None, content: bytes | None = None, more: bytes | None = None) -> Any:
    """A recording: rate, names, samples and read(low, high, channels), in
    microvolts.  ``content`` and ``more``: the bytes of both files, if a task
    cannot open them."""
    data = Bytes(path, content)
    if path.lower().endswith(".set"):
        return _Set(data, None if extra is None and more is None else Bytes(extra or "", more))
    return _Edf(data)


def _resampled(recording: Any, channels: Sequence[int], rate: float) -> np.ndarray:
    """All of a recording at another rate, as its whole spectrum needs."""
    points = int(round(recording.samples * rate / recording.rate))
    out = np.empty((len(channels), points), np.float32)
    for k, c in enumerate(channels):
        out[k] = fft_resample(recording.read(0, recording.samples, [c])[0].astype(np.float64), points)
    return out


def walk(recording: Any, channels: Sequence[int], cuts: Sequence[tuple[int, int]], rate: float | None = None, block: int = BLOCK_BYTES) -> Iterator[list[np.ndarray]]:
    """The signals of the cuts (in order of their first sample), some at a time.

    A channel of -1 is zeros.  With a ``rate`` other than the recording's, the
    recording is resampled first, and cuts count in its samples.
    """
    real = [c for c in channels if c >= 0]
    place = np.array([real.index(c) if c >= 0 else -1 for c in channels])
    whole = _resampled(recording, real, rate) if rate is not None and not np.isclose(rate, recording.rate) else None
    width, held, begin = 4 * max(len(channels), 1), np.empty((len(real), 0), np.float32), 0

    def taken(low: int, n: int) -> np.ndarray:
        part = held[:, low - begin : low - begin + n]
        out = np.zeros((len(channels), n), np.float32)
        out[place >= 0] = part[place[place >= 0]]
        return out

    k = 0
    while k < len(cuts):
        low, high, size, stop = cuts[k][0], 0, 0, k
        while stop < len(cuts) and (stop == k or (size + cuts[stop][1] * width <= block and (cuts[stop][0] - low) * width <= block)):
            high, size, stop = max(high, cuts[stop][0] + cuts[stop][1]), size + cuts[stop][1] * width, stop + 1
        if whole is not None:
            held, begin = whole, 0
        else:
            end = begin + held.shape[1]
            if begin <= low < end:  # what both blocks need is kept
                tail = held[:, low - begin :].copy()
                held = np.concatenate([tail, recording.read(end, high, real)], 1) if high > end else tail
            else:
                held = recording.read(low, high, real)
            begin = low
        yield [taken(*cut) for cut in cuts[k:stop]]
        k = stop


def signal_column(signals: Sequence[np.ndarray]) -> pa.Array:
    """Signals as array<array<float>>."""
    values = np.concatenate([s.ravel() for s in signals]) if signals else np.zeros(0, np.float32)
    lengths = np.concatenate([np.full(len(s), s.shape[1]) for s in signals]) if signals else np.zeros(0, int)
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, pa.float32()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in signals])]), pa.int32()), inner)


HEADER = "rate double, channel_names array<string>, samples long, error_type string, error string"


def headers(rows: DataFrame) -> DataFrame:
    """The rows (``path``; ``extra``, the data file beside a SET; and ``content``
    and ``more`` where tasks cannot open them) with what their headers say, or
    ``error``; the bytes of files are left out."""
    names = [c for c in rows.columns if c not in ("content", "more")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                try:
                    r = open_recording(row["path"], row["extra"], row.get("content"), row.get("more"))
                    found.append((r.rate, r.names, r.samples, None, None))
                except SKIPPED as error:
                    found.append((None, None, None, type(error).__name__, str(error)))
            kinds = (pa.float64(), pa.list_(pa.string()), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *[pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)]], [*names, "rate", "channel_names", "samples", "error_type", "error"])

    return rows.mapInArrow(run, f"{_ddl(rows, names)}, {HEADER}")


def _ddl(rows: DataFrame, names: Iterable[str]) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


def in_parts(rows: DataFrame, bytes_: int = PART_BYTES) -> DataFrame:
    """The rows once for each part of their ``cuts`` (array of start, length),
    dealt over tasks; those resampled whole (``to`` is not ``rate``) are one part."""
    each = F.aggregate("cuts", F.lit(0).cast("long"), lambda a, c: a + c["length"]) * F.size("keep") * 4
    parts = F.when(F.abs(F.col("to") - F.col("rate")) > 1e-5 * F.col("rate"), F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(each / bytes_))).cast("int")
    rows = rows.withColumn("_parts", F.least(parts, F.greatest(F.size("cuts"), F.lit(1)))).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    low, high = (F.floor(F.size("cuts") * (F.col("_part") + k) / F.col("_parts")).cast("int") for k in (0, 1))
    rows = rows.withColumn("_first", low).withColumn("cuts", F.slice("cuts", low + 1, high - low))
    # a number of tasks is named, or adaptive execution would join rows that are small only until they are read
    session = rows.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "path", "_part").drop("_parts", "_part")


def read_cuts(rows: DataFrame, resample: bool = False) -> DataFrame:
    """The rows (``path``, ``extra``, ``keep``, ``cuts``, ``rate``, ``to``; see
    ``headers`` for ``content``) once for each cut, with ``cut`` (its number),
    ``start_index`` and ``signal`` in place of ``cuts``.  ``resample``: the whole
    recording goes to the rate ``to`` first."""
    dealt = in_parts(rows if resample else rows.withColumn("_to", F.col("to")).withColumn("to", F.col("rate")))
    names = [c for c in dealt.columns if c not in ("content", "more", "cuts", "_first")]
    kept = [c for c in names if c not in ("keep", "extra")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row = one.select([c for c in one.schema.names if c in ("path", "extra", "keep", "cuts", "_first", "to", "content", "more")]).to_pylist()[0]
                recording = open_recording(row["path"], row["extra"], row.get("content"), row.get("more"))
                cuts, at = [(c["start"], c["length"]) for c in row["cuts"]], row["_first"]
                order = sorted(range(len(cuts)), key=cuts.__getitem__)
                done = 0
                for signals in walk(recording, row["keep"], [cuts[i] for i in order], row["to"] if resample else None):
                    own = order[done : done + len(signals)]
                    done += len(signals)
                    same = pa.array(np.zeros(len(own), np.int64))
                    fields = [one.column(n).take(same) for n in kept]
                    yield pa.RecordBatch.from_arrays([*fields, pa.array([at + i for i in own], pa.int32()), pa.array([cuts[i][0] for i in own], pa.int64()), signal_column(signals)], [*kept, "cut", "start_index", "signal"])

    out = dealt.mapInArrow(run, f"{_ddl(dealt, kept)}, cut int, start_index long, signal array<array<float>>")
    return out if resample else out.withColumn("to", F.col("_to")).drop("_to")


# --- the data source ---------------------------------------------------------

WINDOWS = "path string, subject string, session string, task string, channel string, rate double, start_index long, start_seconds double, num_samples int, values array<float>"
_TIME = "start_seconds"


@dataclass
class _Part(InputPartition):
    path: str
    extra: str | None
    part: int
    parts: int
    names: dict[str, str | None] = field(default_factory=dict)


def _entity(path: str, key: str) -> str | None:
    found = re.search(rf"(?:^|_){key}[-_]([^_]+)", path.rsplit("/", 1)[-1])
    return found[1] if found else None


class _Reader(DataSourceReader):
    """Windows of single channels; see ``RecordingSource``."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.seconds = float(options.get("window", "4"))
        self.stride = float(options.get("stride", self.seconds))
        self.part_bytes = int(options.get("partbytes", PART_BYTES))
        if self.seconds <= 0 or self.stride <= 0:
            raise ValueError("window and stride must be positive")
        self.wanted: dict[str, set] = {}
        self.low, self.high = 0.0, math.inf

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equalities on names prune files and channels, bounds of start_seconds
        prune records.  Spark need not look at those again."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("path", "subject", "session", "task", "channel") and isinstance(f, EqualTo | In):
                given = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, given) & given
            elif column == _TIME and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value)
                if isinstance(f, GreaterThan):
                    yield f
            elif column == _TIME and isinstance(f, LessThan | LessThanOrEqual):
                self.high = min(self.high, f.value)
                if isinstance(f, LessThan):
                    yield f
            else:
                yield f

    def _files(self) -> Iterator[tuple[str, int]]:
        if scheme(self.root) in ("", "file"):
            for folder, _, names in os.walk(re.sub(r"^file:/*", "/", self.root)):
                for name in names:
                    path = os.path.join(folder, name)
                    yield path, os.path.getsize(path)
        else:
            store, place = pa.fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", self.root))
            start = self.root[: len(self.root.rstrip("/")) - len(place.rstrip("/"))]
            for info in store.get_file_info(pa.fs.FileSelector(place, recursive=True)):
                if info.is_file:
                    yield start + info.path, info.size

    def partitions(self) -> Sequence[InputPartition]:
        sizes = {p: n for p, n in self._files() if fnmatch.fnmatch(p.lower(), "*_eeg.*")}
        out = []
        for path in sorted(sizes):
            stem, kind = os.path.splitext(path)
            if kind.lower() not in (".edf", ".bdf", ".set"):
                continue
            names = {"path": path} | {k: _entity(path, e) for k, e in (("subject", "sub"), ("session", "ses"), ("task", "task"))}
            if any(names[k] not in w for k, w in self.wanted.items() if k in names):
                continue
            extra = next((stem + x for x in (".fdt", ".FDT") if stem + x in sizes), None) if kind.lower() == ".set" else None
            size = sizes[extra] if extra else 0 if kind.lower() == ".set" else sizes[path]
            parts = max(1, -(-size // self.part_bytes))
            out += [_Part(path, extra, k, parts, names) for k in range(parts)]
        return out

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        r = open_recording(partition.path, partition.extra)
        size, step = int(round(self.seconds * r.rate)), max(1, int(round(self.stride * r.rate)))
        total = (r.samples - size) // step + 1 if r.samples >= size > 0 else 0
        first, last = (total * (partition.part + k) // partition.parts for k in (0, 1))
        starts = [s for s in range(first * step, last * step, step) if self.low <= s / r.rate <= self.high]
        channels = [k for k, name in enumerate(r.names) if "channel" not in self.wanted or name in self.wanted["channel"]]
        if not starts or not channels:
            return
        labels = pa.array([r.names[c] for c in channels], pa.string())
        done = 0
        for signals in walk(r, channels, [(s, size) for s in starts]):
            own, n = starts[done : done + len(signals)], len(signals) * len(channels)
            done += len(signals)
            at = np.repeat(np.array(own, np.int64), len(channels))
            values = np.concatenate([s.ravel() for s in signals])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * size + 1, size), pa.int32()), pa.array(values, pa.float32()))
            fixed = [pa.array([partition.names[k]] * n, pa.string()) for k in ("path", "subject", "session", "task")]
            columns = [*fixed, labels.take(pa.array(np.tile(np.arange(len(channels)), len(signals)))), pa.array(np.full(n, r.rate)), pa.array(at), pa.array(at / r.rate), pa.array(np.full(n, size, np.int32)), lists]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in WINDOWS.split(", ")])


class RecordingSource(DataSource):
    """Windows of single channels of the ``*_eeg`` EDF, BDF and SET files under
    a path.  Options: ``window`` and ``stride`` in seconds, ``partbytes``."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return WINDOWS

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(dict(self.options))


def recordings(spark: SparkSession, root: str, window: float = 4.0, stride: float | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """The data source over ``root``, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordingSource)
    return spark.read.format("recordings").option("window", str(window)).option("stride", str(stride or window)).option("partbytes", str(part_bytes)).load(root)
