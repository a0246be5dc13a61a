"""Manifest summaries, protocol audits, and parity of two backends."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.functions import names
from wavemill.operators import ordered

# What a publication reports of its data.
PAPER_EXAMPLES, PAPER_CHANNELS, PAPER_POINTS = 11_988, 32, 800


def manifest_summary(manifest: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts over a manifest, in one aggregation."""
    return manifest.groupBy(*by).agg(
        F.count("*").alias("examples"),
        F.array_join(F.sort_array(F.collect_set("dataset_id")), ",").alias("datasets"),
        F.countDistinct("dataset_id", "subject_id").alias("subjects"),
        F.count("label").alias("labeled"),
        F.count_if(F.size("quality_flags") > 0).alias("flagged"),
        F.countDistinct("shard_path").alias("shards"),
        F.sum(F.col("num_channels").cast("long") * F.col("num_samples") * 4).alias("signal_bytes"),
    )


def split_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy(names.split_or_unspecified(F.col("split")).alias("split")).agg(F.count("*").alias("examples"))


def shape_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy(F.concat_ws("x", "num_channels", "num_samples").alias("shape")).agg(F.count("*").alias("examples"))


def protocol_audit(manifest: DataFrame, subject: str = "subject_id", expected: dict[str, tuple[int, int]] = names.SPLIT_SUBJECTS) -> DataFrame:
    """Per expected split: examples, class counts, subjects, those missing and
    those that belong elsewhere, labels that are not binary, and ``ok``."""
    spark = manifest.sparkSession
    wanted = spark.createDataFrame([(s, low, high) for s, (low, high) in expected.items()], "split string, low int, high int")
    number = names.digits(F.col(subject).cast("string"))
    found = manifest.groupBy("split").agg(
        F.count("*").alias("examples"),
        F.count_if(F.col("label") == 0).alias("negatives"),
        F.count_if(F.col("label") == 1).alias("positives"),
        F.count_if(F.col("label").isNull() | ~F.col("label").isin(0, 1)).alias("not_binary"),
        F.collect_set(number).alias("_subjects"),
    )
    rows = F.broadcast(wanted).join(found, "split", "left")
    have = F.coalesce("_subjects", F.array().cast("array<int>"))
    all_ = F.sequence("low", "high")
    rows = rows.withColumn("subjects", F.size(have)).withColumn("missing", F.array_join(F.sort_array(F.array_except(all_, have)).cast("array<string>"), ",")).withColumn("foreign", F.array_join(F.sort_array(F.array_except(have, all_)).cast("array<string>"), ","))
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("examples", "negatives", "positives", "not_binary")]
    ok = (F.col("missing") == "") & (F.col("foreign") == "") & (F.coalesce("negatives", F.lit(0)) > 0) & (F.coalesce("positives", F.lit(0)) > 0) & (F.coalesce("not_binary", F.lit(0)) == 0)
    return rows.select("split", *counts, "subjects", "missing", "foreign", ok.alias("ok"))


def protocol_report(manifest: DataFrame, dataset: str | None = "shu-mi", strict: bool = False, classes_first: bool = False) -> dict[str, Any]:
    """The audit of a whole manifest, with its warnings in order.

    Errors: no rows, another dataset, ids that occur twice, several shapes,
    subjects of another split, labels that are not binary, rows of no split,
    and with ``strict`` a protocol that is not met.  ``classes_first`` warns of
    missing classes before missing subjects, as the preprocessed table does.
    """
    shape = F.struct("num_channels", "num_samples")
    all_ = manifest.agg(
        F.count("*").alias("examples"),
        F.count_if(~F.col("dataset_id").eqNullSafe(dataset) if dataset else F.lit(False)).alias("elsewhere"),
        F.min(shape).alias("least"),
        F.max(shape).alias("most"),
        F.count_if(~F.coalesce(F.col("split").isin(*names.SPLIT_SUBJECTS), F.lit(False))).alias("no_split"),
    ).first()
    if not all_.examples:
        raise ValueError("the manifest is empty")
    if all_.elsewhere:
        raise ValueError(f"{all_.elsewhere} examples are not of dataset {dataset}")
    if not manifest.groupBy("sample_id").count().filter("count > 1").isEmpty():
        raise ValueError("sample ids occur twice")
    if all_.least != all_.most:
        raise ValueError(f"examples differ in shape: {tuple(all_.least)} to {tuple(all_.most)}")
    channels, points = all_.least
    by = {r.split: r for r in protocol_audit(manifest).collect()}  # one row for each expected split
    warnings: list[str] = []
    for split in names.SPLIT_SUBJECTS:
        r = by[split]
        if r.foreign:
            raise ValueError(f"subjects {r.foreign} in {split} belong elsewhere")
        if r.not_binary:
            raise ValueError(f"split {split} has labels that are not binary")
        found = [f"Split {split} is missing subjects [{r.missing.replace(',', ', ')}]"] if r.missing else []
        classes = [f"Split {split} does not contain both classes"] if r.examples and not (r.negatives and r.positives) else []
        warnings += classes + found if classes_first else found + classes
    if all_.no_split:
        raise ValueError(f"{all_.no_split} examples have no valid split")
    expected = ((all_.examples, PAPER_EXAMPLES, "examples"), (channels, PAPER_CHANNELS, "channels"), (points, PAPER_POINTS, "points"))
    warnings += [f"the protocol has {want:,} {what}; the manifest has {have}" for have, want, what in expected if have != want]
    complete = all(not r.missing for r in by.values())
    ready = complete and all(have == want for have, want, _ in expected) and all(r.negatives and r.positives for r in by.values())
    if strict and not ready:
        raise ValueError("the protocol is not met: " + "; ".join(warnings))
    return {
        "dataset": dataset,
        "examples": all_.examples,
        "channels": channels,
        "points": points,
        "split_examples": {s: by[s].examples for s in by},
        "split_subjects": {s: by[s].subjects for s in by},
        "split_class_counts": {s: {"0": by[s].negatives, "1": by[s].positives} for s in by},
        "subjects_complete": complete,
        "paper_ready": bool(ready),
        "warnings": warnings,
    }


def integrity(manifest: DataFrame, shards: DataFrame, key: Sequence[str] = ("shard_path", "record_batch", "row_in_batch")) -> DataFrame:
    """Manifest rows and stored windows that do not agree, and how.

    Both have ``sample_id`` and the key; the manifest has ``num_channels`` and
    ``num_samples`` and the shards ``num_values``, how many they store.
    """
    left = manifest.select(*key, F.col("sample_id").alias("stated_id"), (F.col("num_channels") * F.col("num_samples")).alias("_expected"))
    right = shards.select(*key, F.col("sample_id").alias("stored_id"), F.col("num_values").alias("_stored"))
    wrong = (
        F.when(F.col("_stored").isNull(), "no window is stored here")
        .when(F.col("_expected").isNull(), "no manifest row is for this window")
        .when(F.col("stated_id") != F.col("stored_id"), "another window is stored here")
        .when(F.col("_expected") != F.col("_stored"), "the payload has another size")
    )
    return left.join(right, list(key), "full_outer").select(*key, "stated_id", "stored_id", wrong.alias("error")).filter("error is not null")


def leakage(manifest: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys in more than one split."""
    found = manifest.groupBy(key).agg(F.countDistinct(split).alias("splits"), F.count("*").alias("examples"))
    return found.filter("splits > 1")


def coverage(rows: DataFrame, index: str, expected: int) -> DataFrame:
    """Whether indices 0..expected-1 are all there, once, and no others."""
    found = rows.groupBy(index).agg(F.count("*").alias("_times"))
    inside = F.col(index).between(0, expected - 1)
    return found.agg(F.count_if(inside).alias("covered"), (F.lit(expected) - F.count_if(inside)).alias("uncovered"), F.count_if(F.col("_times") > 1).alias("repeated"), F.count_if(~inside).alias("outside"))


def source_audit(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """discovered, processed, resumed and skipped recordings."""
    return results.groupBy(*by).agg(
        F.count("*").alias("discovered"),
        F.count_if(F.col("error").isNull()).alias("processed"),
        F.count_if(F.col("error").isNotNull()).alias("skipped"),
        F.sum(F.when(F.col("resumed"), 1).otherwise(0)).alias("resumed"),
    )


def parity(a: DataFrame, b: DataFrame, group: str, order: Sequence[str], value: str = "value", label: str = "label", rtol: float = 1e-6, atol: float = 1e-6, by_key: bool = False) -> DataFrame:
    """Two backends compared row by row in the order of each group.

    ``value`` is array<double>; a row missing on one side is a mismatch.  With
    ``by_key``, ``order`` names each row and rows of one name are compared;
    otherwise places in the order are counted over parts of groups, so that a
    group may be of any size.
    """

    def side(rows: DataFrame, v: str, lab: str) -> DataFrame:
        rows = rows.select(group, *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], F.col(value).alias(v), F.col(label).alias(lab))
        keys = [f"_o{k}" for k in range(len(order))]
        if by_key:
            return rows.select(group, F.struct(*keys).alias("_k"), v, lab)
        return ordered.ordinals(rows, [group], keys, "_k").drop(*keys)

    left, right = side(a, "_a", "_la"), side(b, "_b", "_lb")
    gap = F.expr("aggregate(zip_with(_a, _b, (x, y) -> abs(x - y)), double(0), (m, d) -> greatest(m, d))")
    far = F.expr(f"exists(zip_with(_a, _b, (x, y) -> coalesce(abs(x - y) > {atol}D + {rtol}D * abs(y), true)), f -> f)")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return (
        left.join(right, [group, "_k"], "full_outer")
        .groupBy(group)
        .agg(
            F.count_if(both).alias("compared"),
            F.count_if(~both).alias("unpaired"),
            F.max(F.when(both, gap)).alias("max_abs_diff"),
            F.count_if(both & far).alias("different"),
            F.count_if(both & ~F.col("_la").eqNullSafe(F.col("_lb"))).alias("labels_different"),
        )
    )


def error_stats(pairs: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation, MAE, RMSE, RMSE over the spread of a, and largest error."""
    gap = F.col(a) - F.col(b)
    return pairs.groupBy(*by).agg(
        F.count("*").alias("samples"),
        F.corr(a, b).alias("correlation"),
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.try_divide(F.sqrt(F.avg(gap * gap)), F.stddev_pop(a)).alias("nrmse"),
        F.max(F.abs(gap)).alias("max_abs_error"),
    )
