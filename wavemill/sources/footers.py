"""A catalogue of Parquet footers: schemas and ranges of files, read by tasks.

A footer is some kilobytes at the end of a file, so a dataset of any size is
catalogued without a row of it.  The catalogue tells which fragments are of
another schema before they are put together, and which files can hold an id
before any is opened.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.sources import ranged

#: Bytes read from the end of a file at first; a longer footer is read again.
TAIL = 64 << 10
#: Files that a lookup may open by name; beyond, the filter alone must do.
OPENED = 10_000

_COLUMNS = "path string, rows long, fields string, fingerprint string, low string, high string, nulls long, error_type string, error string"


def footer(data: ranged.Bytes) -> pq.FileMetaData:
    """The footer of a file, from its last bytes."""
    tail = data.read(max(0, data.size - TAIL), TAIL)
    if tail[-4:] != b"PAR1" or len(tail) < 12:
        raise ValueError("not a Parquet file")
    need = int.from_bytes(tail[-8:-4], "little") + 8
    if need > len(tail):
        tail = data.read(data.size - need, need)
    return pq.read_metadata(io.BytesIO(b"PAR1" + tail[-need:]))


def _described(path: str, key: str) -> tuple:
    data = ranged.Bytes(path)
    try:
        meta = footer(data)
    finally:
        data.close()
    fields = sorted(f"{meta.schema.column(k).path} {meta.schema.column(k).physical_type} {meta.schema.column(k).logical_type}" for k in range(meta.num_columns))
    text, low, high, nulls, known = "\n".join(fields), None, None, 0, True
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        column = next((group.column(k) for k in range(group.num_columns) if group.column(k).path_in_schema == key), None)
        stats = column.statistics if column is not None else None
        if stats is None or not stats.has_min_max:
            # a group of nothing but nulls has no range, and needs none
            known &= stats is not None and stats.null_count == group.num_rows
            nulls += stats.null_count if stats is not None and stats.null_count else 0
            continue
        low = stats.min if low is None else min(low, stats.min)
        high = stats.max if high is None else max(high, stats.max)
        nulls += stats.null_count or 0
    if not known:
        low = high = None
        nulls = -1  # unknown: such a file may hold anything
    return path, meta.num_rows, text, hashlib.sha256(text.encode()).hexdigest(), None if low is None else str(low), None if high is None else str(high), nulls, None, None


def catalogue(spark: SparkSession, root: str | Sequence[str], key: str = "sample_id") -> DataFrame:
    """A row for each Parquet file under ``root`` (or several): its rows, schema fingerprint,
    and the range of ``key`` (a text column); ``nulls`` is -1 where the range is
    not known.  A file that is no Parquet file has an error instead."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(root if isinstance(root, str) else list(root)).select("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path in batch["path"]:
                try:
                    out.append(_described(path, key))
                except Exception as error:  # pyarrow's errors for broken footers are of many kinds; the row tells which
                    out.append((path, None, None, None, None, None, None, type(error).__name__, str(error)))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _COLUMNS.split(", ")])
            yield frame.astype({"rows": "Int64", "nulls": "Int64"})

    return found.mapInPandas(run, _COLUMNS)


def union(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """The rows of several fragments, which must be of one schema: those of
    another are named, by files, before a row is read."""
    every = None
    for root in roots:
        own = catalogue(spark, root).select(F.lit(root).alias("root"), "path", "fingerprint", "fields", "error")
        every = own if every is None else every.unionByName(own)
    if every is None:
        raise ValueError("there must be a fragment")
    bad = every.filter("error is not null").limit(5).collect()
    if bad:
        raise ValueError("unreadable fragments: " + "; ".join(f"{r.path}: {r.error}" for r in bad))
    kinds = every.groupBy("fingerprint").agg(F.count("*").alias("files"), F.min("path").alias("path"), F.min("fields").alias("fields")).orderBy(F.desc("files"), "path").limit(3).collect()
    if len(kinds) > 1:
        first, other = (set(k.fields.split("\n")) for k in kinds[:2])
        raise ValueError(f"fragments differ in schema: {kinds[1].path} ({kinds[1].files} files) has {sorted(other - first)} where {kinds[0].path} ({kinds[0].files} files) has {sorted(first - other)}")
    return spark.read.parquet(*roots)


def lookup(spark: SparkSession, root: str, ids: Sequence[str], key: str = "sample_id", known: DataFrame | None = None) -> DataFrame:
    """The rows of some ids, from the files whose range can hold one; ``known``
    is a catalogue that is kept, so that footers are not read again."""
    wanted = F.array(*[F.lit(str(i)) for i in ids]) if ids else F.array().cast("array<string>")
    may = (F.col("nulls") < 0) | F.exists(wanted, lambda i: (i >= F.col("low")) & (i <= F.col("high")))
    files = (known if known is not None else catalogue(spark, root, key)).filter(F.col("error").isNull() & may).select("path")
    some = [r.path for r in files.limit(OPENED + 1).collect()]  # names of files, up to a bound
    rows = spark.read.parquet(root)
    if len(some) <= OPENED:
        rows = spark.read.schema(rows.schema).parquet(*some) if some else rows.limit(0)
    return rows.filter(F.col(key).isin([str(i) for i in ids]))
