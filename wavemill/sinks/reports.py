"""Reports as JSON and Markdown, and the manifest of a run."""

from __future__ import annotations

import platform
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from wavemill import schema
from wavemill.operators import experiments
from wavemill.sinks.publish import Store

# Headings of metrics in reports.
TITLES = {"balanced_accuracy": "Balanced accuracy", "auprc": "AUC-PR", "auroc": "AUROC"}


def save_json(spark: SparkSession, value: object, folder: str, name: str) -> str:
    """Writes JSON (sorted, indented) by way of a temporary file."""
    Store(spark, folder).write_json(name, value)
    return f"{folder.rstrip('/')}/{name}"


def save_text(spark: SparkSession, text: str, folder: str, name: str) -> str:
    Store(spark, folder).write_text(name, text)
    return f"{folder.rstrip('/')}/{name}"


def table(head: Iterable[str], rows: Iterable[Iterable[object]]) -> str:
    """A Markdown table; the first column is text, the others are numbers."""
    head = list(head)
    lines = [head, ["---", *["---:"] * (len(head) - 1)], *[[str(x) for x in r] for r in rows]]
    return "\n".join(f"| {' | '.join(line)} |" for line in lines) + "\n"


def comparison(a: DataFrame, b: DataFrame, names: tuple[str, str], times: tuple[DataFrame, DataFrame] | None = None) -> dict[str, Any]:
    """Two models' metric summaries, and latencies at the batch sizes both have.

    A row for each metric and batch size, of which there are a few.
    """
    metrics = {r.metric: r.asDict() | {"winner": names[r.winner == "b"]} for r in experiments.compare_models(a, b).collect()}
    out: dict[str, Any] = {"models": list(names), "metrics": metrics}
    if times:
        left, right = (t.select("batch", *[t[c].alias(f"{c}_{k}") for c in ("mean_seconds", "examples_per_second")]) for k, t in zip("ab", times, strict=True))
        out["batches"] = [r.asDict() for r in left.join(right, "batch").orderBy("batch").collect()]
    return out


def comparison_markdown(found: Mapping[str, Any]) -> str:
    a, b = found["models"]
    metrics = [(TITLES.get(k, k), f"{m['mean_a']:.4f} ± {m['std_a']:.4f}", f"{m['mean_b']:.4f} ± {m['std_b']:.4f}", f"{m['difference']:+.4f}", m["winner"]) for k, m in sorted(found["metrics"].items())]
    out = f"# {a} and {b}\n\n" + table(("Metric", a, b, "Difference", "Winner"), metrics)
    if found.get("batches"):
        rows = [(r["batch"], f"{1000 * r['mean_seconds_a']:.3f}", f"{1000 * r['mean_seconds_b']:.3f}", f"{r['examples_per_second_a']:.1f}", f"{r['examples_per_second_b']:.1f}") for r in found["batches"]]
        out += "\n## Latency\n\n" + table(("Batch", f"{a} ms", f"{b} ms", f"{a} examples/s", f"{b} examples/s"), rows)
    return out


def run_manifest(spark: SparkSession, audit: Mapping[str, Any], **more: object) -> dict[str, Any]:
    """What a run ran on: versions, settings of the session and the audit."""
    kept = ("spark.master", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.executor.memory")
    return {
        "python": platform.python_version(),
        "platform": platform.platform(),
        "spark": spark.version,
        "schema_version": schema.SCHEMA_VERSION,
        "parallelism": spark.sparkContext.defaultParallelism,
        "settings": {k: spark.conf.get(k, None) for k in kept},
        "dataset_audit": dict(audit),
    } | more


def audit_lines(found: Mapping[str, Any]) -> list[str]:
    """The audit for the console."""
    head = f"dataset={found['dataset']} examples={found['examples']} channels={found['channels']} points={found['points']} subjects_complete={found['subjects_complete']} paper_ready={found['paper_ready']}"
    return [head, f"split_examples={found['split_examples']}", f"split_class_counts={found['split_class_counts']}", *[f"WARNING: {w}" for w in found["warnings"]]]
