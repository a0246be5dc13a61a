"""Runs, seeds, schedules and model comparison."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Mean and standard deviation that a publication reports.
PUBLISHED = {"balanced_accuracy": (0.6370, 0.0151), "auprc": (0.7139, 0.0088), "auroc": (0.6988, 0.0068)}


def seed_summary(runs: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """mean, sample std (0 for one run), min, max and count of each metric."""
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("num_runs"))


def delta_from(summary: DataFrame, published: dict[str, tuple[float, float]] = PUBLISHED, metric: str = "metric") -> DataFrame:
    """Adds ``delta``, the mean less a published one; null for other metrics."""
    pairs = [x for name, (mean, _) in published.items() for x in (F.lit(name), F.lit(mean))]
    return summary.withColumn("delta", F.col("mean") - F.try_element_at(F.create_map(*pairs), F.col(metric)))


def compare_models(a: DataFrame, b: DataFrame, key: str = "metric") -> DataFrame:
    """Summaries of two models side by side; a tie goes to the first."""
    both = a.select(key, F.col("mean").alias("mean_a"), F.col("std").alias("std_a")).join(b.select(key, F.col("mean").alias("mean_b"), F.col("std").alias("std_b")), key)
    return both.withColumn("difference", F.col("mean_b") - F.col("mean_a")).withColumn("winner", F.when(F.col("mean_b") > F.col("mean_a"), "b").otherwise("a"))


def paired_wins(a: DataFrame, b: DataFrame, value: str, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Of runs paired by ``keys``: mean difference (a - b) and wins of each."""
    pairs = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), list(keys))
    return pairs.groupBy(*by).agg(
        F.count("*").alias("pairs"),
        F.avg(F.col("_a") - F.col("_b")).alias("mean_difference"),
        F.count_if(F.col("_a") > F.col("_b")).alias("wins_a"),
        F.count_if(F.col("_b") > F.col("_a")).alias("wins_b"),
    )


def early_stopping(history: DataFrame, value: str, patience: int, by: Sequence[str] = ("run",), epoch: str = "epoch") -> DataFrame:
    """Per run the first epoch of the best value before training stops, which it
    does once ``patience`` epochs in a row bring nothing better."""
    order = Window.partitionBy(*by).orderBy(epoch)
    before = F.max(value).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = history.withColumn("_better", before.isNull() | (F.col(value) > before))
    rows = rows.withColumn("_best", F.max(F.when(F.col("_better"), F.col(epoch))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_stop", F.min(F.when(F.col(epoch) - F.col("_best") >= patience, F.col(epoch))).over(Window.partitionBy(*by)))
    seen = rows.filter(F.col("_stop").isNull() | (F.col(epoch) <= F.col("_stop")))
    return seen.groupBy(*by).agg(F.max("_best").alias("best_epoch"), F.max(value).alias("best_value"), F.max(epoch).alias("last_epoch"))


def weighted_loss(batches: DataFrame, loss: str, size: str, by: Sequence[str]) -> DataFrame:
    return batches.groupBy(*by).agg((F.sum(F.col(loss) * F.col(size)) / F.greatest(F.lit(1), F.sum(size))).alias("loss"))


def learning_rate(step: Column, base: float, total: int, kind: str, least: float = 0.0, every: int = 1, factor: float = 0.1) -> Column:
    """``none``, ``step`` (times ``factor`` every ``every``) or ``cosine``."""
    if kind == "none":
        return F.lit(base)
    if kind == "step":
        return base * F.pow(F.lit(factor), F.floor(step / every))
    if kind == "cosine":
        return least + (base - least) * (1 + F.cos(step / F.lit(float(total)) * math.pi)) / 2
    raise ValueError(f"unknown schedule {kind}")


def latency_summary(times: DataFrame, seconds: str, batch: str) -> DataFrame:
    """Per batch size: mean, median, 95th percentile (linear) and throughput."""
    return times.groupBy(batch).agg(
        F.avg(seconds).alias("mean_seconds"),
        F.percentile(seconds, 0.5).alias("median_seconds"),
        F.percentile(seconds, 0.95).alias("p95_seconds"),
        (F.first(batch) / F.avg(seconds)).alias("examples_per_second"),
    )


def parameter_counts(parameters: DataFrame, by: Sequence[str] = (), size: str = "size", item: str = "item_bytes", trainable: str = "trainable") -> DataFrame:
    """Parameters, trainable ones and state bytes of models, a row a tensor."""
    return parameters.groupBy(*by).agg(
        F.sum(size).cast("long").alias("parameters"),
        F.coalesce(F.sum(F.when(F.col(trainable), F.col(size))), F.lit(0)).cast("long").alias("trainable_parameters"),
        F.sum(F.col(size) * F.col(item)).cast("long").alias("state_bytes"),
    )


def best_epoch_summary(best: DataFrame, by: Sequence[str], epoch: str = "best_epoch") -> DataFrame:
    """Mean, median and sample std of the epochs at which runs were best.

    One row a run, so the exact median is over few values.
    """
    return best.groupBy(*by).agg(F.avg(epoch).alias("mean"), F.percentile(epoch, 0.5).alias("median"), F.coalesce(F.stddev_samp(epoch), F.lit(0.0)).alias("std"))


def generalisation_gap(runs: DataFrame, value: str, by: Sequence[str], split: str = "split") -> DataFrame:
    """Mean of splits val and test, the gap between them, and its percentage."""
    mean = lambda s: F.avg(F.when(F.col(split) == s, F.col(value)))
    rows = runs.groupBy(*by).agg(mean("val").alias("val_mean"), mean("test").alias("test_mean"), F.stddev_pop(value).alias("std_pop"))
    gap = F.col("val_mean") - F.col("test_mean")
    return rows.withColumn("gap", gap).withColumn("deficit_pct", 100 * F.try_divide(gap, F.col("val_mean")))
