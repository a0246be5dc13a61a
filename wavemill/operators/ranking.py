"""Classification metrics over any number of rows, by aggregation.

Ranking metrics first collapse the rows to one for each distinct score (a
partial aggregation), and only those are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.operators import ordered


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-80.0), F.least(F.lit(80.0), logit))))


def two_class_probability(logits: Column) -> Column:
    """Of the second class, from two logits."""
    return sigmoid(logits[1] - logits[0])


def checked(rows: DataFrame, target: str) -> Column:
    """The target, raising where it is neither 0 nor 1."""
    return F.when(F.col(target).isin(0, 1), F.col(target)).otherwise(F.raise_error(F.lit("targets must be 0 or 1")).cast("int"))


def confusion(rows: DataFrame, score: str, target: str, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """tn, fp, fn and tp; a score at the threshold counts as positive."""
    predicted, truth = F.col(score) >= threshold, F.col(target) == 1
    return rows.groupBy(*by).agg(
        F.count_if(~predicted & ~truth).alias("tn"),
        F.count_if(predicted & ~truth).alias("fp"),
        F.count_if(~predicted & truth).alias("fn"),
        F.count_if(predicted & truth).alias("tp"),
    )


def balanced_accuracy() -> Column:
    """Of a row of ``confusion``; null where a class is missing."""
    recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    specificity = F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))
    return (recall + specificity) / 2


def rates(counts: DataFrame) -> DataFrame:
    """Adds the rates of a frame of ``confusion``: predicted positives, true
    positives among positives, true negatives among negatives."""
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return counts.withColumns(
        {
            "predicted_positive_rate": F.try_divide(F.col("tp") + F.col("fp"), total),
            "true_positive_rate": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")),
            "true_negative_rate": F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")),
        }
    )


def curve(rows: DataFrame, score: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """One row for each score, from the top: tp, fp, precision, recall, and the
    point before it (precision 1 and recall 0 before the first).

    Scores are dealt by ranges of a sample, so parts are of about equal size
    however they are spread; only the parts' totals are ordered as a whole.
    """
    points = rows.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(F.col(target) == 1).alias("p"), F.count_if(F.col(target) == 0).alias("n"))
    found = ordered.running_sums(points, by, [F.col("score").desc()], {"tp": F.col("p"), "fp": F.col("n")}, {"tp": "positives", "fp": "negatives"})
    tp, seen = F.col("tp") - F.col("p"), F.col("tp") + F.col("fp") - F.col("p") - F.col("n")
    return found.select(
        *by,
        *["score", "p", "n", "tp", "fp", "positives", "negatives"],
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide("tp", "positives").alias("recall"),
        F.when(seen > 0, tp / seen).otherwise(1.0).alias("precision_before"),
        F.when(seen > 0, F.try_divide(tp, F.col("positives"))).otherwise(0.0).alias("recall_before"),
    )


def ranking_metrics(rows: DataFrame, score: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """auroc (ties count half), auprc (trapezoids) and average_precision."""
    step = F.col("recall") - F.col("recall_before")
    return (
        curve(rows, score, target, by)
        .groupBy(*by)
        .agg(
            F.try_divide(F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)), F.first("positives") * F.first("negatives")).alias("auroc"),
            F.sum(step * (F.col("precision") + F.col("precision_before")) / 2).alias("auprc"),
            F.sum(step * F.col("precision")).alias("average_precision"),
            (F.first("positives") + F.first("negatives")).alias("num_examples"),
        )
    )


def binary_metrics(rows: DataFrame, score: str, target: str, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """All of the above in one row for each group."""
    counts = confusion(rows, score, target, by, threshold).withColumn("balanced_accuracy", balanced_accuracy())
    ranks = ranking_metrics(rows, score, target, by)
    return counts.join(ranks, list(by)) if by else counts.crossJoin(F.broadcast(ranks))  # one row each


def smoothed(target: Column, smoothing: float) -> Column:
    return target * (1 - smoothing) + 0.5 * smoothing if smoothing > 0 else target * F.lit(1.0)
