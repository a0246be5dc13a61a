"""Cutting recordings into windows, as arrays and as long-form rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions.signals import once


def points(seconds: float | Column, rate: Column) -> Column:
    """Samples in a time span; halves go to the even number."""
    return F.rint((F.lit(seconds) if not isinstance(seconds, Column) else seconds) * rate).cast("int")


def window_starts(length: Column, size: Column, stride: Column) -> Column:
    """0, stride, ... while a whole window fits; the partial tail is dropped."""
    whole = F.sequence(F.lit(0).cast("long"), (length - size).cast("long"), stride.cast("long"))
    return F.when((length >= size) & (size > 0), F.transform(whole, lambda s: s.cast("int"))).otherwise(F.array().cast("array<int>"))


def sliding_windows(recordings: DataFrame, window_seconds: float, stride_seconds: float) -> DataFrame:
    """One row for each window of each recording (``signal``, array form).

    Windows are cut before rows are made of them, so a row has its window and
    never the recording; readers cut from files without either (``ranged``).
    """
    if window_seconds <= 0 or stride_seconds <= 0:
        raise ValueError("window and stride must be positive")
    rate = F.col("sampling_rate_hz").cast("double")
    rows = recordings.withColumn("_size", points(window_seconds, rate)).withColumn("_stride", points(stride_seconds, rate))
    starts = lambda x: window_starts(F.size(x[0]), F.col("_size"), F.col("_stride"))
    cuts = once(F.col("signal"), lambda x: F.transform(starts(x), lambda s: F.struct(s.alias("start"), F.transform(x, lambda c: F.slice(c, s + 1, F.col("_size"))).alias("signal"))))
    rows = rows.withColumn("_cut", cuts).drop("signal").withColumn("_cut", F.explode("_cut"))
    columns = [c for c in recordings.columns if c != "signal"]
    return rows.select(
        *columns,
        F.col("_cut.signal").alias("signal"),
        F.col("_cut.start").alias("start_index"),
        (F.col("_cut.start") / rate).alias("start_seconds"),
        F.lit(float(window_seconds)).alias("duration_seconds"),
        F.col("_size").alias("num_samples"),
    )


def sample_index(samples: DataFrame, key: str, *order: str) -> DataFrame:
    """Long-form samples with ``i``, their place from 0 in their recording."""
    return samples.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def sliding_windows_long(indexed: DataFrame, key: str, size: int, stride: int) -> DataFrame:
    """Long-form samples, once for each window they are in (``start``).

    A sample knows its windows by arithmetic, so nothing is joined; the length
    of the recording comes from the same partitioning as its order.
    """
    if size <= 0 or stride <= 0:
        raise ValueError("window and stride must be positive")
    rows = indexed.withColumn("_length", F.count("*").over(Window.partitionBy(key)))
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / stride)).cast("long")
    last = F.least(F.floor(F.col("i") / stride), F.floor((F.col("_length") - size) / stride)).cast("long")
    rows = rows.filter(F.col("_length") >= size).withColumn("_first", first).withColumn("_last", last)
    return rows.filter("_first <= _last").withColumn("start", F.explode(F.sequence("_first", "_last"))).withColumn("start", F.col("start") * stride).drop("_length", "_first", "_last")


def event_windows(signals: DataFrame, events: DataFrame, key: str, position: str = "position", duration: str = "duration", base: int = 1) -> DataFrame:
    """The samples [position, position + duration) of each event of a recording.

    ``signals`` has ``key`` and ``signal``; positions count from ``base``.  An
    event that is not wholly inside its recording raises.
    """
    at = F.struct((F.col(position).cast("long") - base).alias("start"), F.col(duration).cast("long").alias("length"), F.struct(*[c for c in events.columns if c != key]).alias("event"))
    each = events.groupBy(key).agg(F.collect_list(at).alias("_events"))  # an event is some numbers
    inside = lambda x, e: (e["start"] >= 0) & (e["length"] > 0) & (e["start"] + e["length"] <= F.size(x[0]))
    start = lambda x, e: F.when(inside(x, e), e["start"]).otherwise(F.raise_error(F.lit("event outside its recording")).cast("long"))
    cut = lambda x, e: F.transform(x, lambda c: F.slice(c, e["start"].cast("int") + 1, e["length"].cast("int")))
    cuts = once(F.col("signal"), lambda x: F.transform("_events", lambda e: F.struct(start(x, e).alias("start_index"), cut(x, e).alias("signal"), e["event"].alias("event"))))
    rows = signals.join(each, key).withColumn("_cuts", cuts).drop("signal", "_events").withColumn("_cut", F.explode("_cuts")).drop("_cuts")
    own = [c for c in signals.columns if c not in (key, "signal")]
    return rows.select(key, *[F.col(f"_cut.event.{c}") for c in events.columns if c != key], *own, "_cut.signal", "_cut.start_index")


def event_windows_long(indexed: DataFrame, markers: DataFrame, key: str, length: int) -> DataFrame:
    """The ``length`` samples from each marker (``marker`` at index ``at``) on.

    The interval join is an equi-join: a sample meets the one block of
    ``length`` starts before it or the one it is in.
    """
    at = markers.select(F.col(key), F.col("at"), F.col("marker"), F.floor(F.col("at") / length).alias("_block"))
    blocks = F.array(F.floor(F.col("i") / length), F.floor(F.col("i") / length) - 1)
    rows = indexed.withColumn("_block", F.explode(blocks)).join(at, [key, "_block"])
    return rows.filter((F.col("i") >= F.col("at")) & (F.col("i") < F.col("at") + length)).withColumn("offset", F.col("i") - F.col("at")).drop("_block")


def pre_segmented(files: DataFrame, data: str = "data", labels: str = "labels") -> DataFrame:
    """Trials of files that hold them as [trial][channel][sample]."""
    rows = files.select("*", F.posexplode(data).alias("trial_index", "signal"))
    return rows.withColumn("label", F.get(labels, F.col("trial_index"))).drop(data, labels)


def long_form(windows: DataFrame, *keys: str) -> DataFrame:
    """``keys``, channel, sample and value of every sample."""
    rows = windows.select(*keys, F.posexplode("signal").alias("channel", "_values"))
    return rows.select(*keys, "channel", F.posexplode("_values").alias("sample", "value"))
