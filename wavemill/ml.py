"""A trainable classifier over window features, evaluated with our metrics."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.functions import signals
from wavemill.operators import layout, ranking

METRICS = ("balanced_accuracy", "auprc", "auroc")


def features(windows: DataFrame) -> DataFrame:
    """Mean, standard deviation and RMS of each channel as a vector."""
    each = [F.transform("signal", f) for f in (signals.mean, signals.std_pop, signals.rms)]
    return windows.select("sample_id", "split", F.col("label").cast("double").alias("label"), array_to_vector(F.concat(*each)).alias("features"))


def train(rows: DataFrame, iterations: int = 30, regularization: float = 0.01) -> LogisticRegressionModel:
    """A fit on the features of split train."""
    return LogisticRegression(maxIter=iterations, regParam=regularization).fit(rows.filter("split = 'train'"))


def scores(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select("sample_id", "split", F.col("label").cast("int").alias("label"), vector_to_array("probability")[1].alias("score"))


def train_and_evaluate(windows: DataFrame, iterations: int = 30, regularization: float = 0.01) -> DataFrame:
    """Fits on split train; binary metrics of the splits val and test."""
    rows = features(windows.filter("label is not null"))
    scored = scores(train(rows, iterations, regularization), rows.filter("split in ('val', 'test')"))
    return ranking.binary_metrics(scored, "score", "label", ["split"])


def reproduce(windows: DataFrame, seeds: Sequence[int], part: float = 0.8, iterations: int = 30, regularization: float = 0.01) -> DataFrame:
    """``seed``, ``metric`` and ``value`` on split test of one run a seed, each
    fitted on its own share of split train, drawn by hash."""
    rows = features(windows.filter("label is not null"))
    out = None
    for seed in seeds:
        drawn = F.conv(F.substring(layout.shuffle_key(seed, 0, "sample_id"), 1, 8), 16, 10).cast("double") / float(1 << 32) < part
        found = ranking.binary_metrics(scores(train(rows.filter(drawn), iterations, regularization), rows.filter("split = 'test'")), "score", "label")
        long = found.select(F.lit(seed).alias("seed"), F.stack(F.lit(len(METRICS)), *[x for m in METRICS for x in (F.lit(m), F.col(m))]).alias("metric", "value"))
        out = long if out is None else out.unionByName(long)
    if out is None:
        raise ValueError("there must be a seed")
    return out


def latencies(model: LogisticRegressionModel, rows: DataFrame, batches: Sequence[int], warm_up: int = 2, repeats: int = 10) -> DataFrame:
    """``batch`` and ``seconds`` of scoring jobs over so many rows."""
    if min(*batches, repeats) <= 0 or warm_up < 0:
        raise ValueError("batches and repeats must be positive")
    spark, times = rows.sparkSession, []
    for size in batches:
        part = rows.limit(size).cache()
        part.count()
        for k in range(warm_up + repeats):
            began = time.perf_counter()
            scores(model, part).write.format("noop").mode("overwrite").save()
            if k >= warm_up:
                times.append((size, time.perf_counter() - began))
        part.unpersist()
    return spark.createDataFrame(times, "batch int, seconds double")
