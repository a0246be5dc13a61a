"""Incremental ingest: recordings arrive as files, valid windows are published.

Each micro-batch is validated and split into windows and dead letters, which
are appended under a folder named by the batch.  A batch that is run again
after a failure overwrites its own folder, so rows are published once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from wavemill import schema
from wavemill.operators.windows import sliding_windows


def ingest(spark: SparkSession, inbox: str, output: str, checkpoint: str, window_seconds: float, stride_seconds: float, recordings: StructType = schema.RECORDING, trigger: dict | None = None) -> StreamingQuery:
    """Starts ingest of Parquet recordings; by default all there are, then ends."""

    def publish(batch: DataFrame, number: int) -> None:
        checked = schema.validate(batch, schema.RECORDING_RULES)
        good = sliding_windows(checked.filter("error is null").drop("error"), window_seconds, stride_seconds)
        good.write.mode("overwrite").parquet(f"{output}/windows/batch={number}")
        bad = checked.filter("error is not null").select("recording_id", "source_uri", "error")
        bad.write.mode("overwrite").parquet(f"{output}/failures/batch={number}")

    source = spark.readStream.schema(recordings).parquet(inbox)
    return source.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, time: str, length: str, slide: str, late: str | None = None, by: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and means by event time; on streams, late data up to ``late``."""
    rows = events.withWatermark(time, late) if late else events
    found = rows.groupBy(F.window(time, length, slide), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n", "mean")


def sessions(events: DataFrame, time: str, gap: str, by: str, late: str | None = None) -> DataFrame:
    """Runs of events of one key with no gap as long as ``gap``."""
    rows = events.withWatermark(time, late) if late else events
    found = rows.groupBy(by, F.session_window(time, gap)).agg(F.count("*").alias("n"))
    return found.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def running_progress(events: DataFrame, key: str, number: str, value: str) -> DataFrame:
    """A stream's progress by key: rows seen, those seen before (``number`` not
    above the highest so far) and the greatest value, updated with each batch.

    State is three numbers a key, so it grows with keys and not with rows.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, again, highest, top = state.get if state.exists else (0, 0, None, None)
        rows = pd.concat(list(batches)).sort_values(number)  # one key's rows of one batch
        for n, v in zip(rows[number].tolist(), rows[value].tolist(), strict=True):
            seen += 1
            if highest is not None and n <= highest:
                again += 1
            else:
                highest = n
            if v is not None and not pd.isna(v) and (top is None or v > top):
                top = v
        state.update((seen, again, highest, top))
        yield pd.DataFrame({key: [group[0]], "seen": [seen], "repeated": [again], "highest": [highest], "top": [top]})

    kinds = dict(events.dtypes)
    out = f"{key} {kinds[key]}, seen long, repeated long, highest {kinds[number]}, top {kinds[value]}"
    kept = f"seen long, repeated long, highest {kinds[number]}, top {kinds[value]}"
    return events.groupBy(key).applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.NoTimeout)
