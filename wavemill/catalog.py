"""Reading published windows back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.functions import signals
from wavemill.sinks.snapshots import Log


def load_windows(
    spark: SparkSession,
    path: str,
    split: str | None = None,
    datasets: Sequence[str] = (),
    tasks: Sequence[str] = (),
    rate: float | None = None,
    channels: int | None = None,
    samples: int | None = None,
    require_labels: bool = False,
    with_signal: bool = True,
    snapshot: int | None = None,
    ids: Sequence[str] = (),
    verified: bool = False,
) -> DataFrame:
    """The windows that fit, their signals divided by the amplitude scale.

    Every condition is a plain predicate, so it is pushed down to the Parquet
    scan; without the signal its column is not read.  A view without windows,
    or one with unlabelled ones where labels are required, is an error.

    ``snapshot`` reads that of a log of snapshots.  ``ids`` are looked up by
    their range in the files' footers.  ``verified``: a window whose payload is
    not what its manifest says raises when it is read.
    """
    if snapshot is not None:
        rows = Log(spark, path).read(snapshot)
    else:
        rows = spark.read.parquet(f"{path.rstrip('/')}/windows")
    if ids:
        rows = rows.filter(F.col("sample_id").isin(list(ids)))
    for name, value in (("split", split), ("sampling_rate_hz", None if rate is None else F.lit(rate).cast("float")), ("num_channels", channels), ("num_samples", samples)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    for name, values in (("dataset_id", datasets), ("task", tasks)):
        if values:
            rows = rows.filter(F.col(name).isin(list(values)))
    found = rows.agg(F.count("*").alias("n"), F.count_if(F.col("label").isNull()).alias("unlabelled")).first()
    if not found.n:
        raise ValueError("no window fits")
    if require_labels and found.unlabelled:
        raise ValueError(f"{found.unlabelled} windows have no label")
    rows = rows.withColumn("label", F.coalesce("label", F.lit(-1)))
    if verified and with_signal:
        right = (F.size("signal") == F.col("num_channels")) & F.forall("signal", lambda c: F.size(c) == F.col("num_samples")) & (F.length("sample_id") > 0)
        wrong = F.raise_error(F.concat(F.lit("payload is not what the manifest says: "), F.coalesce("sample_id", F.lit("?"))))
        rows = rows.withColumn("signal", F.when(F.coalesce(right, F.lit(False)), F.col("signal")).otherwise(wrong.cast("array<array<float>>")))
    return rows.withColumn("signal", signals.scale(F.col("signal"), F.col("amplitude_scale"))) if with_signal else rows.drop("signal")
