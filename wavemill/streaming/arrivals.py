"""Recordings that arrive in pieces: repeats dropped, each closed when it is done.

Two stateful steps.  Ids are dropped where they come again, by the built-in
operator, whose state is spread by id and goes with the watermark.  Then each
recording's pieces grow into sessions, whose state is four numbers for each one
that is open; a session leaves as soon as it has all that was expected of it, or
when its timer says that nothing more can come.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What keeps lists and timers; the default provider does not.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Entries of state in a partition, and partitions of a stream's state at the least.
STATE_ROWS, LEAST_PARTITIONS = 100_000, 8

_SETTING = "spark.sql.streaming.stateStore.providerClass"
_STATE = "start long, end long, n long, expected long"


def session_for_state(spark: SparkSession, most: int | None = None) -> SparkSession:
    """A session of the same application whose streams keep lists and timers;
    the settings of ``spark`` are left alone.

    ``most``: how many ids and recordings are held at a time, at the most.  A
    stream's state keeps the number of partitions that it starts with, and each
    is a store of several megabytes however little it holds, so there are as many
    as that needs (``STATE_ROWS`` each) in place of ``spark.sql.shuffle.partitions``.
    """
    own = spark.newSession()
    own.conf.set(_SETTING, PROVIDER)
    if most is not None:
        own.conf.set("spark.sql.shuffle.partitions", str(max(LEAST_PARTITIONS, -(-most // STATE_ROWS))))
    return own


def pieces(times: np.ndarray, gap: int) -> list[list[int]]:
    """Start, end and size of the runs of sorted times with no step of ``gap``."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(times) >= gap) + 1, [len(times)]])
    return [[int(times[a]), int(times[b - 1]), int(b - a)] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def merged(runs: list[list[int]], gap: int) -> list[list[int]]:
    """Runs, of which those less than ``gap`` apart become one."""
    out: list[list[int]] = []
    for start, end, n in sorted(runs):
        if out and start < out[-1][1] + gap:
            out[-1][1], out[-1][2] = max(out[-1][1], end), out[-1][2] + n
        else:
            out.append([start, end, n])
    return out


class _Sessions(StatefulProcessor):
    """Times are in microseconds."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getListState("open", _STATE)

    def _load(self) -> tuple[list[list[int]], int | None]:
        held = list(self.open.get()) if self.open.exists() else []
        return [list(h[:3]) for h in held], next((h[3] for h in held if h[3] is not None), None)

    def _keep(self, runs: list[list[int]], expected: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if runs:
            self.open.put([(*r, expected) for r in runs])
            self.handle.registerTimer(-(-(min(r[1] for r in runs) + self.gap) // 1000))
        else:
            self.open.clear()

    def _rows(self, key: tuple, runs: list[list[int]], expected: int | None) -> Iterator[pd.DataFrame]:
        if runs:
            out = {"recording": [key[0]] * len(runs)} | {name: [r[k] for r in runs] for k, name in enumerate(("start", "end", "n"))}
            yield pd.DataFrame(out | {"complete": [None if expected is None else r[2] >= expected for r in runs]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        runs, expected = self._load()
        for chunk in rows:
            runs = merged(runs + pieces(np.sort(chunk["micros"].to_numpy(np.int64)), self.gap), self.gap)
            stated = chunk["wanted"].dropna()
            if len(stated):
                expected = max(int(stated.max()), expected or 0)
        done = [r for r in runs if expected is not None and r[2] >= expected]
        self._keep([r for r in runs if r not in done], expected)
        yield from self._rows(key, done, expected)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        runs, expected = self._load()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        done = [r for r in runs if r[1] + self.gap <= now]
        self._keep([r for r in runs if r not in done], expected)
        yield from self._rows(key, done, expected)

    def close(self) -> None:
        pass


def closed_sessions(rows: DataFrame, by: list[str], number: list[str], time: str, gap_seconds: float, late: str, expected: str | None = None) -> DataFrame:
    """Sessions of the recordings ``by`` in a stream of ``rows``, each once and
    when it is closed: ``start``, ``end`` (times of its first and last row),
    ``n`` and ``complete`` (null where nothing was expected).

    Rows of one ``by`` and ``number`` count once while the watermark, which is
    ``late`` behind the newest time, has not passed them; rows behind it are
    dropped.  A session closes in the batch that brings it to ``expected`` rows
    (a column; the greatest value known counts), or when the watermark is
    ``gap_seconds`` past its last row, as then no row can join it.  What comes
    after a complete session begins another.  Rows without a time are dropped;
    null keys are a recording like others.  A hot recording is walked through in
    batches of Arrow by one task; its state does not grow.  The stream's session
    must be one of ``session_for_state``.
    """
    if gap_seconds <= 0:
        raise ValueError("the gap must be positive")
    if rows.sparkSession.conf.get(_SETTING) != PROVIDER:
        raise ValueError("the stream needs a session that keeps lists and timers: see session_for_state")
    clash = sorted({"start", "end", "n", "complete"} & set(by))
    if clash:
        raise ValueError(f"keys clash with columns of the result: {clash}")
    # keys travel as JSON: as values of Python, a null id would be a number unlike itself
    form = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    key, item = F.to_json(F.struct(*by), form), F.to_json(F.struct(*number), form)
    wanted = F.col(expected).cast("long") if expected else F.lit(None).cast("long")
    slim = rows.filter(F.col(time).isNotNull()).select(key.alias("recording"), item.alias("item"), F.col(time).alias("instant"), F.unix_micros(time).alias("micros"), wanted.alias("wanted"))
    once = slim.withWatermark("instant", late).dropDuplicatesWithinWatermark(["recording", "item"]).drop("item")
    found = once.groupBy("recording").transformWithStateInPandas(_Sessions(int(gap_seconds * 1_000_000)), "recording string, start long, end long, n long, complete boolean", "append", "eventTime")
    names = F.from_json("recording", T.StructType([rows.schema[c] for c in by]), form)
    return found.select(names.alias("recording"), *[F.timestamp_micros(c).alias(c) for c in ("start", "end")], "n", "complete").select(*[F.col("recording")[c].alias(c) for c in by], "start", "end", "n", "complete")
