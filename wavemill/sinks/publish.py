"""Publishing windows: staged, validated, then moved into place at once.

A dataset is a folder with ``windows`` (Parquet, all columns; the manifest is
its projection), ``failures`` (JSON lines), ``source_audit.json`` and
``summary.json``.  It is written to a staging folder beside its place, checked
as a whole, and renamed; what was there is moved aside first and deleted last.
A plan file says what is being moved, so that an interrupted publication can be
finished or undone.  All paths go through Hadoop's file systems.

``harmonize`` runs a source in jobs.  A finished job leaves its outcomes and a
marker of each recording's fingerprint (path, size, time of change, settings)
in ``_work``; a resumed run takes over what still agrees and runs the rest.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill import schema
from wavemill.operators import audit, layout
from wavemill.session import kept as stored


class PublicationError(RuntimeError):
    """What stands in the way of publishing."""


class UnreadableError(PublicationError, ValueError):
    """Recordings or windows that a strict publication does not accept."""


class Store:
    """The few file operations that publication needs, on any store."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.root = root.rstrip("/")

    def _at(self, name: str) -> Any:
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def move(self, old: str, new: str) -> None:
        if not self._fs.rename(self._at(old), self._at(new)):
            raise PublicationError(f"cannot move {old} to {new}")

    def write_text(self, name: str, text: str) -> None:
        """By way of a temporary file that then takes the name, in one step: a
        reader sees the old text or the new one, and a crash leaves one."""
        temporary = self._temporary(name, text)
        self._files().rename(self._at(temporary), self._at(name), self._options(self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE))

    def put_if_absent(self, name: str, text: str) -> bool:
        """Writes a file unless there is one of the name, in one step; whether it did."""
        temporary = self._temporary(name, text)
        try:
            if self._fs.getUri().getScheme() == "file":  # here a rename would replace
                return self._linked(temporary, name)
            self._files().rename(self._at(temporary), self._at(name), self._options())
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in str(error.java_exception):
                return False
            raise
        finally:
            self.delete(temporary)

    def _temporary(self, name: str, text: str) -> str:
        folder, _, last = name.rpartition("/")
        temporary = f"{folder}/.{last}.{uuid.uuid4().hex}.tmp".lstrip("/")
        out = self._fs.create(self._at(temporary), True)
        out.write(bytearray(text.encode()))
        out.close()
        return temporary

    def _linked(self, temporary: str, name: str) -> bool:
        try:
            os.link(*[self._at(x).toUri().getPath() for x in (temporary, name)])
        except FileExistsError:
            return False
        return True

    def _files(self) -> Any:
        return self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf())

    def _options(self, *given: Any) -> Any:
        out = SparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, len(given))
        for k, x in enumerate(given):
            out[k] = x
        return out

    def names(self, name: str, times: bool = False) -> list:
        """What a folder holds; with ``times``, and when each was changed (in seconds)."""
        if not self.exists(name):
            return []
        found = self._fs.listStatus(self._at(name))
        return [(x.getPath().getName(), x.getModificationTime() / 1000) if times else x.getPath().getName() for x in found]

    def write_json(self, name: str, value: object) -> None:
        self.write_text(name, json.dumps(value, indent=2, sort_keys=True, default=str))

    def read_json(self, name: str) -> Any:
        stream = self._fs.open(self._at(name))
        try:
            value = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        if not isinstance(value, dict):
            raise ValueError(f"{name} is not a JSON object")
        return value


_PLAN, _STAGED, _FINAL, _BEFORE, _WORK = "_PUBLICATION_PLAN.json", "_staged", "windows", "_previous", "_work"

#: Failures that source_audit.json lists; all are in ``failures``.
LISTED = 1000


def recover(store: Store) -> None:
    """Finishes or undoes what an interrupted publication has left."""
    if store.exists(_PLAN):
        if store.exists(_STAGED) and store.exists(_FINAL):
            store.delete(_STAGED)  # nothing was moved yet
        elif store.exists(_STAGED):
            store.move(_STAGED, _FINAL)
        elif not store.exists(_FINAL) and store.exists(_BEFORE):
            store.move(_BEFORE, _FINAL)
        store.delete(_BEFORE)
        store.delete(_PLAN)
    elif store.exists(_STAGED):
        raise PublicationError("staged windows without a plan: not deleting them")


def _replace(store: Store) -> None:
    """Moves what is staged into place, or leaves everything as it was."""
    store.write_json(_PLAN, {"move": [{"source": _STAGED, "final": _FINAL}]})
    try:
        if store.exists(_FINAL):
            store.move(_FINAL, _BEFORE)
        store.move(_STAGED, _FINAL)
    except Exception:
        if store.exists(_BEFORE) and not store.exists(_FINAL):
            store.move(_BEFORE, _FINAL)
        store.delete(_STAGED)
        store.delete(_PLAN)
        raise
    store.delete(_BEFORE)


def _may_write(store: Store, overwrite: bool, resume: bool) -> None:
    if overwrite and resume:
        raise ValueError("overwrite and resume exclude each other")
    if store.exists(_FINAL) and not (overwrite or resume):
        raise FileExistsError(store.root)


def layout_of(windows: DataFrame, rows_per_batch: int, batches_per_shard: int) -> DataFrame:
    """``sample_id`` and place of every window.

    Only ids are ordered, subject by subject; shards are numbered over all.
    """
    bundle = F.concat_ws("\x1f", "dataset_id", "subject_id").alias("bundle")
    keys = layout.shard_layout(windows.select("sample_id", bundle), "bundle", ["sample_id"], rows_per_batch, batches_per_shard)
    return layout.renumber_shards(keys, "bundle").select("sample_id", "shard_path", "record_batch", "row_in_batch")


def publish(
    outcomes: DataFrame,
    output: str,
    failures: DataFrame | None = None,
    overwrite: bool = False,
    resume: bool = False,
    strict: bool = False,
    rows_per_batch: int = 256,
    batches_per_shard: int = 16,
    report: dict[str, Any] | None = None,
    began: float | None = None,
) -> dict[str, Any]:
    """Validates and publishes windows; returns the summary.

    ``outcomes`` are windows, or those and failures (``error_type``, ``error``
    of a ``source_uri``); ``failures`` are more of them (path, error_type,
    error).  Windows that break a rule are rejected: they are counted, and with
    ``strict`` nothing is published if there is any failure.  Two windows of
    one id, or no window at all, are errors.
    """
    spark, started = outcomes.sparkSession, time.time()
    began = began or started
    store = Store(spark, output)
    _may_write(store, overwrite, resume)
    if resume:
        recover(store)
    if "error" not in outcomes.columns:
        outcomes = outcomes.withColumns({"error_type": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    good = outcomes.filter("error is null").drop("error", "error_type")
    checked = schema.validate(good)
    kept = checked.filter("error is null").drop("error")
    try:
        # all but the signals, with what is wrong: signals are read here and when they are written
        marked = stored(checked.drop("signal"))
        fine = marked.filter("error is null")
        bad = outcomes.filter("error is not null").select(F.col("source_uri").alias("path"), "error_type", "error").distinct()
        bad = bad if failures is None else bad.unionByName(failures.select("path", "error_type", "error"))
        bad.write.mode("overwrite").json(f"{store.root}/failures")
        unread = spark.read.schema("path string, error_type string, error string").json(f"{store.root}/failures")
        n_unread = unread.count()
        rejected = marked.filter("error is not null").groupBy("error").agg(F.count("*").alias("n"), F.min("source_uri").alias("first")).collect()
        counts = {"strict": strict, "skipped_recordings": n_unread, "report_path": f"{store.root}/source_audit.json"} | (report or {})
        listed = unread.orderBy("path").limit(LISTED).collect()
        store.write_json(
            "source_audit.json",
            counts | {"failures": [r.asDict() for r in listed], "failures_path": f"{store.root}/failures", "rejected": [{"error": r.error, "windows": r.n, "first": r.first} for r in rejected]},
        )
        if strict and (n_unread or rejected):
            first = "; ".join(f"{r.path}: {r.error}" for r in listed[:10])
            raise UnreadableError(f"{n_unread} unreadable recordings, {sum(r.n for r in rejected)} rejected windows: {first}")
        twice = fine.groupBy("sample_id").agg(F.count("*").alias("n"), F.min("source_uri").alias("a"), F.max("source_uri").alias("b")).filter("n > 1").limit(10).collect()
        if twice:
            raise ValueError("sample ids occur twice: " + ", ".join(f"{r.sample_id} ({r.a}, {r.b})" for r in twice))
        laid = kept.drop("shard_path", "record_batch", "row_in_batch").join(layout_of(fine, rows_per_batch, batches_per_shard), "sample_id")
        laid = laid.select(*schema.WINDOW.names).repartition("shard_path").sortWithinPartitions("shard_path", "record_batch", "row_in_batch")
        laid.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_batch * batches_per_shard).parquet(f"{store.root}/{_STAGED}")
        staged = spark.read.parquet(f"{store.root}/{_STAGED}")
        totals = audit.manifest_summary(staged.drop("signal")).first()
        if not totals.examples:
            raise ValueError("there is no window to publish")
        splits = {r.split: r.examples for r in audit.split_counts(staged).collect()}
    except BaseException:
        store.delete(_STAGED)
        raise
    merging = time.time()
    _replace(store)
    now = time.time()
    seconds = max(now - began, 1e-12)
    done = counts.get("processed_recordings")
    summary = totals.asDict() | {
        "output_dir": output,
        "schema_version": schema.SCHEMA_VERSION,
        "split_examples": splits,
        "source_audit": "source_audit.json",
        "fingerprint": counts.get("fingerprint"),
        "timing": {
            "wall_seconds": seconds,
            "processing_seconds": max(started - began, 0.0),
            "merge_seconds": max(now - merging, 0.0),
            "recordings_per_second": None if done is None else done / seconds,
            "examples_per_second": totals.examples / seconds,
            "mib_per_second": totals.signal_bytes / seconds / 2**20,
        },
    }
    store.write_json("summary.json", summary)
    store.delete(_PLAN)
    return summary


def planned(source: Any, spark: SparkSession) -> DataFrame:
    """Recordings of a source with their sizes and fingerprints."""
    found = source.discover(spark).select("path", "length", "modified")
    return found.withColumn("fingerprint", layout.fingerprint(F.col("path"), F.col("length").cast("string"), F.coalesce(F.col("modified").cast("string"), F.lit("")), F.lit(source.settings())))


def harmonize(spark: SparkSession, source: Any, output: str, overwrite: bool = False, resume: bool = False, strict: bool = False, job_bytes: int = 64 << 30, **layout_options: int) -> dict[str, Any]:
    """Runs a source and publishes its windows; returns the summary.

    Recordings are dealt over jobs of about ``job_bytes``.  A resumed run with
    the same recordings and settings as the published one returns its summary.
    """
    if job_bytes <= 0:
        raise ValueError("jobs must hold at least one byte")
    began, store = time.time(), Store(spark, output)
    _may_write(store, overwrite, resume)
    if not resume:
        store.delete(_WORK)
    else:
        recover(store)
    plan = planned(source, spark).cache()
    try:
        totals = plan.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.coalesce(F.bit_xor(F.xxhash64("fingerprint")), F.lit(0)).alias("hash")).first()
        fingerprint = f"{totals.n}-{totals.hash & (1 << 64) - 1:016x}"
        if resume and store.exists(_FINAL) and store.exists("summary.json"):
            summary = store.read_json("summary.json")
            if summary.get("fingerprint") == fingerprint:
                return summary
        if not totals.n:
            raise ValueError("no recording was found")
        keys, marks = ["path", "fingerprint"], f"{store.root}/{_WORK}/done"
        marked = store.exists(f"{_WORK}/done")
        todo = layout.pending(plan, spark.read.parquet(marks), keys) if marked else plan
        resumed = totals.n - todo.count() if marked else 0
        size = todo.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        jobs, run = max(1, math.ceil(size / job_bytes)), uuid.uuid4().hex[:12]
        todo = todo.withColumn("job", F.concat(F.lit(f"{run}-"), F.pmod(F.xxhash64("path"), F.lit(jobs)).cast("string")))
        for k in range(jobs):
            part = todo.filter(F.col("job") == f"{run}-{k}")
            source.outcomes(spark, part.select("path")).write.parquet(f"{store.root}/{_WORK}/outcomes/{run}-{k}")
            part.select(*keys, "job").write.mode("append").parquet(marks)
        done = layout.reusable(spark.read.parquet(marks), plan, keys)
        names = [r.job for r in done.select("job").distinct().collect()]  # a few jobs
        outcomes = spark.read.parquet(*[f"{store.root}/{_WORK}/outcomes/{n}" for n in names])
        outcomes = outcomes.join(done.select(F.col("path").alias("source_uri")).distinct(), "source_uri", "left_semi").select(*outcomes.columns)
        silent = done.select("path").distinct().join(outcomes.select(F.col("source_uri").alias("path")), "path", "left_anti")
        silent = silent.select("path", F.lit("ValueError").alias("error_type"), F.lit("recording produced no windows").alias("error"))
        failed = outcomes.filter("error is not null").select("source_uri").distinct().count() + silent.count()
        report = {
            "source_kind": source.kind,
            "jobs": jobs,
            "num_workers": spark.sparkContext.defaultParallelism,
            "discovered_recordings": totals.n,
            "processed_recordings": totals.n - failed,
            "resumed_recordings": resumed,
            "fingerprint": fingerprint,
        }
        summary = publish(outcomes, output, silent, overwrite or resume, False, strict, report=report, began=began, **layout_options)
    finally:
        plan.unpersist()
    store.delete(_WORK)
    return summary
