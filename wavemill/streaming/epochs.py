"""Published windows as a stream of epochs, with offsets to go on from.

An epoch is every row of every shard (Parquet file) once, in a seeded order:
shards are ordered by md5 of seed, epoch and path and dealt to ranks in turn,
row groups and the rows within them are permuted.  A place in that order is an
offset (epoch, shard, row), so a stream that died goes on where it was, whatever
its batches were, and a place that was kept elsewhere (``place``) can be started
from without the stream's own checkpoint.

The shards are settled once, by ``prepare``: tasks read their footers, and a
small table of paths and row counts is what a stream is opened on.  The driver
holds that table; a task holds one row group.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.streaming import StreamingQuery

from wavemill.sinks.snapshots import Log
from wavemill.sources import footers
from wavemill.sources.ranged import scheme

#: Where a row is: these columns follow the windows' own.
PLACE = {"epoch": T.LongType(), "shard": T.StringType(), "position": T.LongType()}


def prepare(spark: SparkSession, root: str, plan: str, snapshot: int | None = None) -> int:
    """Writes the shards under ``root`` (of a snapshot of its log) to the table
    ``plan``, which must not be there yet; returns the number of rows."""
    folders: Sequence[str] = [root]
    if snapshot is not None:
        folders = [f"{root.rstrip('/')}/{f}" for f in Log(spark, root).at(snapshot).folders]
        if not folders:
            raise ValueError(f"snapshot {snapshot} is empty")
    found = footers.catalogue(spark, folders)
    found.select("path", "rows", "fingerprint", "error").write.parquet(plan)
    shards = spark.read.parquet(plan)
    bad = shards.filter("error is not null").limit(5).collect()
    if bad:
        raise ValueError("unreadable shards: " + "; ".join(f"{r.path}: {r.error}" for r in bad))
    kinds = shards.select("fingerprint").distinct().count()
    if kinds > 1:
        raise ValueError(f"shards are of {kinds} schemas")
    return shards.agg({"rows": "sum"}).first()[0] or 0


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    if scheme(path) in ("", "file"):
        return pa.fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return pa.fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", path))


def _draw(seed: int, epoch: int, path: str) -> str:
    return hashlib.md5(f"{seed}:{epoch}:{path}".encode()).hexdigest()


@dataclass
class _Piece(InputPartition):
    """Rows ``low`` to ``high`` of a shard, in the order of its epoch."""

    path: str
    rows: int
    epoch: int
    low: int
    high: int


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: T.StructType) -> None:
        self.plan, self.schema, self.start = options["plan"], schema, options.get("start")
        self.seed, self.epochs = int(options.get("seed", 0)), int(options.get("epochs", 1))
        self.rank, self.world = int(options.get("rank", 0)), int(options.get("world", 1))
        self.step, self.shuffled = int(options.get("batchrows", 0)), options.get("shuffled", "true") == "true"
        if self.epochs < 0 or self.step < 0:
            raise ValueError("epochs and batch rows must not be negative")
        if not 0 <= self.rank < self.world:
            raise ValueError(f"rank {self.rank} is not one of {self.world}")
        self.at: dict[str, Any] | None = None
        self._dealt: tuple[int, list[tuple[str, int]]] = (-1, [])

    @functools.cached_property
    def _shards(self) -> list[tuple[str, int]]:
        return sorted(_shards(self.plan))

    @functools.cached_property
    def _of(self) -> str:
        """What an offset belongs to; one of other shards or another order is no place here."""
        return hashlib.md5(json.dumps([self._shards, self.seed, self.rank, self.world, self.shuffled]).encode()).hexdigest()

    def _deal(self, epoch: int) -> list[tuple[str, int]]:
        """This rank's shards of an epoch, in order."""
        if self._dealt[0] != epoch:
            every = sorted(self._shards, key=lambda s: (_draw(self.seed, epoch, s[0]), s[0])) if self.shuffled else self._shards
            self._dealt = epoch, [s for s in every[self.rank :: self.world] if s[1]]
        return self._dealt[1]

    def _offset(self, epoch: int, shard: int, row: int) -> dict[str, Any]:
        while epoch < self.epochs and shard >= len(self._deal(epoch)):
            epoch, shard, row = epoch + 1, 0, 0
        return {"of": self._of, "epoch": epoch, "shard": shard, "row": row}

    def _known(self, offset: dict[str, Any]) -> tuple[int, int, int]:
        if offset["of"] != self._of:
            raise ValueError("the offset is of other shards, another seed or another rank")
        return offset["epoch"], offset["shard"], offset["row"]

    def initialOffset(self) -> dict[str, Any]:
        return self._offset(*self._known(json.loads(self.start))) if self.start else self._offset(0, 0, 0)

    def latestOffset(self) -> dict[str, Any]:
        """``batchrows`` rows after the last batch that was planned."""
        if not self.step:
            return self._offset(self.epochs, 0, 0)
        epoch, shard, row = self._known(self.at or self.initialOffset())
        left = self.step
        while left and epoch < self.epochs:
            deal = self._deal(epoch)
            if shard >= len(deal):
                epoch, shard, row = epoch + 1, 0, 0
                continue
            take = min(left, deal[shard][1] - row)
            left, row = left - take, row + take
            if row >= deal[shard][1]:
                shard, row = shard + 1, 0
        return self._offset(epoch, shard, row)

    def partitions(self, start: dict[str, Any], end: dict[str, Any]) -> Sequence[InputPartition]:
        # also called with the last offset that was logged, twice, when a stream goes on
        (epoch, shard, row), stop, out = self._known(start), self._known(end), []
        while (epoch, shard, row) < stop:
            deal = self._deal(epoch)
            if shard >= len(deal):
                epoch, shard, row = epoch + 1, 0, 0
                continue
            path, rows = deal[shard]
            high = stop[2] if (epoch, shard) == stop[:2] else rows
            out.append(_Piece(path, rows, epoch, row, high))
            shard, row = (shard + 1, 0) if high == rows else (shard, high)
        self.at = end
        return out

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        p, draw = partition, int(_draw(self.seed, partition.epoch, partition.path), 16)
        store, place = _store(p.path)
        target = to_arrow_schema(self.schema)
        with store.open_input_file(place) as opened:
            file = pq.ParquetFile(opened)
            if file.metadata.num_rows != p.rows:
                raise ValueError(f"{p.path} has {file.metadata.num_rows} rows, not {p.rows}")
            groups, at = np.arange(file.num_row_groups), 0
            for g in np.random.default_rng(draw).permutation(groups) if self.shuffled else groups:
                n = file.metadata.row_group(int(g)).num_rows
                low, high = max(p.low - at, 0), min(p.high - at, n)
                if low < high:
                    rows = file.read_row_group(int(g), columns=[c for c in target.names if c not in PLACE])
                    order = np.random.default_rng([draw, int(g)]).permutation(n) if self.shuffled else np.arange(n)
                    rows = rows.take(order[low:high])
                    own = {"epoch": np.full(high - low, p.epoch), "shard": [p.path] * (high - low), "position": np.arange(at + low, at + high)}
                    for name, values in own.items():
                        rows = rows.append_column(name, pa.array(values, target.field(name).type))
                    yield from rows.select(target.names).cast(target).combine_chunks().to_batches(max_chunksize=4096)
                at += n


def _shards(plan: str) -> list[tuple[str, int]]:
    store, place = _store(plan)
    found = pa.dataset.dataset(place, filesystem=store, format="parquet").to_table(columns=["path", "rows"])
    return list(zip(found["path"].to_pylist(), found["rows"].to_pylist(), strict=True))


class EpochSource(DataSource):
    """Options: ``plan``, ``seed``, ``epochs``, ``rank``, ``world``, ``batchrows``
    (0: all at once), ``shuffled``, ``start`` (an offset), ``columns`` (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "window_epochs"

    def schema(self) -> T.StructType:
        shards = _shards(self.options["plan"])
        if not shards:
            raise ValueError("there are no shards")
        store, place = _store(shards[0][0])
        with store.open_input_file(place) as opened:
            own = from_arrow_schema(pq.ParquetFile(opened).schema_arrow)
        wanted = json.loads(self.options.get("columns", "[]")) or own.names
        clash = sorted(set(PLACE) & set(wanted))
        if clash:
            raise ValueError(f"columns clash with the place of a row: {clash}; name the columns to read")
        return T.StructType([own[c] for c in wanted] + [T.StructField(k, t) for k, t in PLACE.items()])

    def streamReader(self, schema: T.StructType) -> _Reader:
        return _Reader(dict(self.options), schema)


def epochs(spark: SparkSession, plan: str, count: int = 1, seed: int = 0, rank: int = 0, world: int = 1, batch_rows: int = 0, shuffled: bool = True, columns: Sequence[str] = (), start: dict[str, Any] | None = None) -> DataFrame:
    """A stream over ``count`` epochs of the shards of ``plan``: the windows with
    ``epoch``, ``shard`` and ``position``, a row's place within its shard's epoch.

    ``batch_rows`` is the size of a micro-batch, whose rows then do not depend on
    anything else; 0 takes all epochs in one.  A trigger of what is available now
    takes one micro-batch only; ``consume`` takes all.  Of more ranks than shards
    some have no rows.  ``start`` is a ``place`` of the same shards, seed and rank.
    """
    spark.dataSource.register(EpochSource)
    options = {"plan": plan, "seed": seed, "epochs": count, "rank": rank, "world": world, "batchrows": batch_rows, "shuffled": str(shuffled).lower(), "columns": json.dumps(list(columns))}
    if start is not None:
        options["start"] = json.dumps(start)
    return spark.readStream.format("window_epochs").options(**options).load()


def consume(rows: DataFrame, use: Callable[[DataFrame, int], None], checkpoint: str) -> dict[str, Any] | None:
    """Gives ``use`` each micro-batch with its number, until the epochs end; the
    last place, or None if there was nothing left.

    A batch that failed, or whose end was not recorded, comes again with the
    same number and the same rows, so what ``use`` writes by number is written once.
    """
    query = rows.writeStream.foreachBatch(use).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
        return place(query)
    finally:
        query.stop()


def place(query: StreamingQuery) -> dict[str, Any] | None:
    """Where a stream is: the end of the last micro-batch that it finished."""
    last = query.lastProgress
    end = json.loads(last.json)["sources"][0]["endOffset"] if last is not None else None
    return json.loads(end) if isinstance(end, str) else end
