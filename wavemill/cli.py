"""Command line: ``python -m wavemill.cli <verb> ...``."""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wavemill import catalog, config, ml, training
from wavemill.functions import names
from wavemill.operators import audit, experiments, layout, ranking
from wavemill.session import ship
from wavemill.sinks import reports
from wavemill.sinks.publish import Store, harmonize
from wavemill.sources import readers

Verb = Callable[[SparkSession, argparse.Namespace], dict]

#: Files that a report lists; all are checked and counted.
LISTED = 1000


def _dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/windows")


def _settings(spark: SparkSession, args: argparse.Namespace) -> config.Settings:
    """The settings of --config, or the defaults."""
    found = config.load(spark, args.config) if args.config else config.from_mapping({})
    if found.ignored:
        print("not read: " + ", ".join(found.ignored))
    return found


def _run(spark: SparkSession, args: argparse.Namespace, source: object, settings: config.Settings | None = None) -> dict:
    """Options that are given go before settings."""
    use = (settings or _settings(spark, args)).section("publish")
    use |= {k: getattr(args, k) for k in use if getattr(args, k) is not None}
    return harmonize(spark, source, args.output, args.overwrite, args.resume, args.strict, **use)


def _mat(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Harmonizes MAT sessions into a published dataset."""
    return _run(spark, args, readers.MatSource(args.input, args.rate, args.original_rate, args.scale, args.channels))


def _edf(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Harmonizes continuous EDFs and their events."""
    return _run(spark, args, readers.EdfSource(args.input, args.events or "", _rate(args.rate), args.scale))


def _bids(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Harmonizes BIDS recordings into sliding windows."""
    settings = _settings(spark, args)
    window, stride = args.window or settings["windows.seconds"], args.stride or settings["windows.stride"]
    source = readers.BidsSource(args.input, args.dataset, tuple(args.subjects), tuple(args.tasks), args.limit, window, stride, _rate(args.rate), args.channel_policy, tuple(args.channels), args.allow_missing)
    return _run(spark, args, source, settings)


def _rate(value: str) -> float | str:
    """A rate given as text: ``auto`` or a positive number."""
    if value.strip().casefold() == "auto":
        return "auto"
    rate = float(value)
    if rate <= 0:
        raise ValueError(f"not a sampling rate: {value}")
    return rate


def _preprocess(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The reference table of MAT sessions: every window has exactly the points
    that its seconds need, all of one shape; for comparison with the other."""
    source = readers.MatSource(args.input, args.rate, args.original_rate, args.scale, args.channels)
    summary = harmonize(spark, source, args.output, args.overwrite, False, True)
    rows = _dataset(spark, args.output)
    expected = args.rate * args.seconds
    other = rows.filter(F.col("num_samples") != F.lit(expected)).select("source_uri", "num_samples").limit(1).collect()
    if other:
        Store(spark, args.output).delete("windows")
        raise ValueError(f"{other[0].source_uri} has windows of {other[0].num_samples} points, not {expected:g}")
    report = audit.protocol_report(rows, classes_first=True)
    reports.save_json(spark, summary | {"audit": report}, args.output, "summary.json")
    return summary | {"audit": report}


def _inspect(spark: SparkSession, args: argparse.Namespace) -> dict:
    """What a published dataset holds."""
    rows = _dataset(spark, args.input)
    found = audit.manifest_summary(rows).first()
    if not found.examples:
        raise ValueError("the manifest is empty")
    return found.asDict() | {"splits": {r.split: r.examples for r in audit.split_counts(rows).collect()}, "shapes": {r.shape: r.examples for r in audit.shape_counts(rows).collect()}}


def _audit(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Audits the protocol; with --strict an unmet one is an error."""
    found = audit.protocol_report(_dataset(spark, args.input), args.dataset, args.strict)
    print("\n".join(reports.audit_lines(found)))
    return found


def _fit(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Iterations and regularization of a fit."""
    use = _settings(spark, args)
    return {"iterations": use["training.epochs"], "regularization": use["training.weight_decay"]}


def _train(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Trains and evaluates; with --output saves the model, metrics and run.json.
    With --by-epoch it trains by mini-batches, keeps the best epoch of split val,
    and goes on where an earlier call of the same plan has stopped."""
    if args.by_epoch:
        if not args.output:
            raise ValueError("--by-epoch needs --output")
        plan = training.Plan(**_settings(spark, args).section("training"))
        vectors = ml.features(_dataset(spark, args.input).filter("label is not null"))
        vectors = vectors.select("sample_id", "split", vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"))
        state = training.fit(vectors, plan, f"{args.output}/epochs")
        scored = training.scored(vectors.filter("split in ('val', 'test')"), state.best or state.weights)
        found = {"metrics": [r.asDict() for r in ranking.binary_metrics(scored, "score", "y", ["split"]).collect()], "best_epoch": state.best_epoch, "history": state.history}
        reports.save_json(spark, found, args.output, "metrics.json")
        return found
    rows, settings = _dataset(spark, args.input), _fit(spark, args)
    found = {"metrics": [r.asDict() for r in ml.train_and_evaluate(rows, **settings).collect()]}
    if args.output:
        model = ml.train(ml.features(rows.filter("label is not null")), **settings)
        model.write().overwrite().save(f"{args.output}/model")
        reports.save_json(spark, found, args.output, "metrics.json")
        parameters = {"parameters": model.coefficients.size + 1}
        reports.save_json(spark, reports.run_manifest(spark, audit.manifest_summary(rows).first().asDict(), **parameters), args.output, "run.json")
    return found


def _reproduce(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Runs of several seeds, and how their means differ from published ones."""
    runs = ml.reproduce(_dataset(spark, args.input), args.seeds, **_fit(spark, args)).cache()
    summary = experiments.delta_from(experiments.seed_summary(runs, "value", ["metric"]))
    found = {"num_runs": len(args.seeds), "runs": [r.asDict() for r in runs.collect()], "test_aggregate": {r.metric: r.asDict() for r in summary.collect()}}
    if args.output:
        reports.save_json(spark, found, args.output, "summary.json")
    return found


def _check(spark: SparkSession, args: argparse.Namespace) -> dict:
    """A checkpoint's SHA-256 and, from files that list them a line each, the
    parameters it lacks and those it has beyond the expected ones."""
    hashes = readers.file_hashes(spark, args.input)
    if args.sha256:  # all files are compared; ten of those that differ are named
        wrong = hashes.filter(F.col("sha256") != args.sha256)
        named = [r.path for r in wrong.orderBy("path").limit(10).collect()]
        if named:
            raise ValueError(f"{wrong.count()} files differ from {args.sha256}: {named}")
    found = {"count": hashes.count(), "files": [r.asDict() for r in hashes.orderBy("path").limit(LISTED).collect()]}
    if args.keys and args.expected:
        have = spark.read.text(args.keys).select(names.checkpoint_key(F.col("value")).alias("key"))
        want = spark.read.text(args.expected).select(F.col("value").alias("key"))
        found |= {"missing": [r.key for r in want.exceptAll(have).orderBy("key").collect()], "unexpected": [r.key for r in have.exceptAll(want).orderBy("key").collect()]}
        if found["missing"] or found["unexpected"]:
            raise ValueError(f"parameters differ: {found}")
    return found


def _latency(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Latency of scoring by batch size."""
    rows = ml.features(_dataset(spark, args.input).filter("label is not null"))
    times = ml.latencies(ml.train(rows), rows, args.batches, repeats=args.repeats)
    found = {"batches": [r.asDict() for r in experiments.latency_summary(times, "seconds", "batch").orderBy("batch").collect()]}
    if args.output:
        reports.save_json(spark, found, args.output, "benchmark.json")
    return found


def _compare(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Two summaries of ``reproduce`` side by side, as JSON and Markdown."""

    def read(folder: str) -> DataFrame:
        found = Store(spark, folder).read_json("summary.json")["test_aggregate"]
        return spark.createDataFrame([(k, float(v["mean"]), float(v["std"])) for k, v in found.items()], "metric string, mean double, std double")

    def timed(folder: str) -> DataFrame:
        found = Store(spark, folder).read_json("benchmark.json")["batches"]
        return spark.createDataFrame([(r["batch"], r["mean_seconds"], r["examples_per_second"]) for r in found], "batch int, mean_seconds double, examples_per_second double")

    times = all(Store(spark, f).exists("benchmark.json") for f in (args.input, args.other))
    found = reports.comparison(read(args.input), read(args.other), (args.input, args.other), (timed(args.input), timed(args.other)) if times else None)
    if args.output:
        reports.save_json(spark, found, args.output, "comparison.json")
        reports.save_text(spark, reports.comparison_markdown(found), args.output, "comparison.md")
    return found


def _backends(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Two datasets window by window."""
    a, b = (_dataset(spark, p).withColumn("value", F.transform(F.flatten("signal"), lambda v: v.cast("double"))) for p in (args.input, args.other))
    return {"splits": [r.asDict() for r in audit.parity(a, b, "split", ["sample_id"], by_key=True).collect()]}


def _pass(rows: DataFrame, began: float) -> dict:
    """One pass over signals to nowhere, and what was seen."""
    seen = Observation()
    rows.observe(seen, F.sum(F.size(F.flatten("signal")) * 4).alias("bytes"), F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
    seconds, n, size = max(time.perf_counter() - began, 1e-12), seen.get["n"], seen.get["bytes"] or 0
    mib = size / seconds / 2**20
    return {"examples": n, "seconds": seconds, "examples_per_second": n / seconds, "mib_per_second": mib, "gib_per_second": mib * 8 / 1024}


def _epoch(spark: SparkSession, args: argparse.Namespace) -> dict:
    """A full epoch over a dataset's signals; every example must be seen once."""
    rows = catalog.load_windows(spark, args.input, split=args.split)
    expected = rows.count()
    began = time.perf_counter()
    rows.limit(1).write.format("noop").mode("overwrite").save()
    first = time.perf_counter() - began
    found = _pass(rows, time.perf_counter())
    return found | {"expected": expected, "complete": found["examples"] == expected, "first_seconds": first, "steady_seconds": max(found["seconds"] - first, 0.0)}


def _streaming(spark: SparkSession, args: argparse.Namespace) -> dict:
    """A bounded read in the order of an epoch, by one of several workers."""
    if args.examples <= 0 or not 0 <= args.worker < args.workers:
        raise ValueError("examples must be positive and the worker one of the workers")
    rows = catalog.load_windows(spark, args.input, split=args.split)
    shards = rows.groupBy("shard_path").agg(F.count("*").alias("examples"), F.lit(0).alias("bytes"))
    own = layout.assign_workers(shards, args.seed, args.epoch, args.workers, "shard_path").filter(F.col("worker") == args.worker)
    mine = rows.join(F.broadcast(own.select("shard_path")) if own.count() < 100_000 else own.select("shard_path"), "shard_path", "left_semi")
    return _pass(layout.bounded_shuffle(mine, args.seed, args.epoch, args.buffer).limit(args.examples), time.perf_counter())


def _smoke(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Metrics of eight logits, to see that the engine runs."""
    rows = spark.createDataFrame([(x, k % 2) for k, x in enumerate((-2.0, 2.0, -1.0, 1.0, -0.5, 0.5, -3.0, 3.0))], "logit double, label int")
    return {"metrics": ranking.binary_metrics(rows.withColumn("score", ranking.sigmoid(F.col("logit"))), "score", "label").first().asDict()}


def _common(verb: argparse.ArgumentParser) -> None:
    verb.add_argument("output")
    verb.add_argument("--overwrite", action="store_true")
    verb.add_argument("--resume", action="store_true")
    verb.add_argument("--strict", action="store_true")
    verb.add_argument("--config")
    for name in ("--job-bytes", "--rows-per-batch", "--batches-per-shard"):
        verb.add_argument(name, type=int)


def _rates(verb: argparse.ArgumentParser) -> None:
    verb.add_argument("--rate", type=float, default=200.0)
    verb.add_argument("--original-rate", type=float, default=250.0)
    verb.add_argument("--scale", type=float, default=100.0)
    verb.add_argument("--channels", type=int, default=32)


# The names of the verbs, which existing scripts call.
def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="wavemill")
    verbs = out.add_subparsers(dest="verb", required=True)

    def add(name: str, run: Verb, reads: bool = True) -> argparse.ArgumentParser:
        verb = verbs.add_parser(name, help=run.__doc__)
        verb.set_defaults(run=run)
        if reads:
            verb.add_argument("input")
        return verb

    for name in ("harmonize-mat", "harmonize-shu"):
        verb = add(name, _mat)
        _common(verb)
        _rates(verb)
    verb = add("harmonize-edf", _edf)
    _common(verb)
    verb.add_argument("--events")
    verb.add_argument("--rate", default="200")
    verb.add_argument("--scale", type=float, default=100.0)
    verb = add("harmonize-bids", _bids)
    _common(verb)
    verb.add_argument("--dataset", default="hbn")
    for name in ("--subjects", "--tasks", "--channels"):
        verb.add_argument(name, nargs="*", default=())
    verb.add_argument("--limit", type=int)
    verb.add_argument("--window", type=float)
    verb.add_argument("--stride", type=float)
    verb.add_argument("--rate", default="auto")
    verb.add_argument("--channel-policy", choices=("preserve", "select"), default="preserve")
    verb.add_argument("--allow-missing", action="store_true")
    verb = add("preprocess", _preprocess)
    verb.add_argument("output")
    verb.add_argument("--overwrite", action="store_true")
    verb.add_argument("--seconds", type=float, default=4.0)
    _rates(verb)
    add("inspect-harmonized", _inspect)
    verb = add("inspect-data", _audit)
    verb.add_argument("--dataset", default="shu-mi")
    verb.add_argument("--strict", action="store_true")
    for name, run in (("train", _train), ("reproduce", _reproduce)):
        verb = add(name, run)
        verb.add_argument("--config")
        verb.add_argument("--output")
        if name == "train":
            verb.add_argument("--by-epoch", action="store_true")
        if name == "reproduce":
            verb.add_argument("--seeds", type=int, nargs="+", default=(0, 1, 2, 3, 4))
    verb = add("check-checkpoint", _check)
    for name in ("--sha256", "--keys", "--expected"):
        verb.add_argument(name)
    verb = add("benchmark", _latency)
    verb.add_argument("--batches", type=int, nargs="+", default=(1, 32, 128))
    verb.add_argument("--repeats", type=int, default=10)
    verb.add_argument("--output")
    verb = add("compare", _compare)
    verb.add_argument("other")
    verb.add_argument("--output")
    add("compare-backends", _backends).add_argument("other")
    add("benchmark-dataloader", _epoch).add_argument("--split")
    verb = add("benchmark-streaming", _streaming)
    verb.add_argument("--split")
    for name, value in (("examples", 1000), ("workers", 1), ("worker", 0), ("seed", 0), ("epoch", 0), ("buffer", 1024)):
        verb.add_argument(f"--{name}", type=int, default=value)
    add("smoke", _smoke, reads=False)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("wavemill").getOrCreate()
    ship(spark)
    result = args.run(spark, args)
    print(json.dumps(result, indent=2, sort_keys=True, default=str))
    return result


if __name__ == "__main__":
    main()
