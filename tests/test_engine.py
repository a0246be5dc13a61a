"""The recording engine: functions, windows, metrics, planning, audits."""

import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill import config, schema
from wavemill.functions import names, signals
from wavemill.operators import audit, experiments, layout, ranking, sidecars, spectral, windows


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("name, want", [("EEG Fp1-Ref", "Fp1-Ref"), ("EEG-C3_", "C3"), (" C z ", "Cz"), ("", "")])
def test_channel_names(spark, name, want):
    assert one(spark, names.normalize_channel, name) == want


def test_entities(spark):
    path = "/x/sub-NDARAA123_ses-HBNsiteRU_task-RestingState_eeg.bdf"
    assert one(spark, names.entities, path) == {"sub": "NDARAA123", "ses": "HBNsiteRU", "task": "RestingState"}
    assert one(spark, names.recording_id, path) == "sub-NDARAA123_ses-HBNsiteRU_task-RestingState"


@pytest.mark.parametrize("name, subject, session", [("sub-001_ses-01_task_motorimagery_eeg.mat", 1, 1), ("sub-001_session-1.mat", 1, 1), ("subject25_3.mat", 25, 3), ("sub-026_ses-02.mat", None, 2), ("7.mat", 7, -1)])
def test_subject_and_session(spark, name, subject, session):
    assert one(spark, names.subject_number, name) == subject
    assert one(spark, names.session_number, name) == session


def test_out_of_range_subjects_alias_only_when_asked(spark):
    assert one(spark, lambda c: names.subject_number(c, True), "sub-026_x.mat") == 6


def test_subject_split_raises_outside(spark):
    assert [one(spark, names.subject_split, k, "int") for k in (1, 15, 16, 20, 21, 25)] == ["train", "train", "val", "val", "test", "test"]
    with pytest.raises(Exception, match="no split has subject 26"):
        one(spark, names.subject_split, 26, "int")


def test_rate(spark):
    source = spark.createDataFrame([("AUTO", 250.0), ("128", 250.0)], "v string, s double")
    assert [r.y for r in source.select(names.rate_or_source(F.col("v"), F.col("s")).alias("y")).collect()] == [250.0, 128.0]
    with pytest.raises(Exception, match="not a sampling rate"):
        spark.createDataFrame([("fast", 1.0)], "v string, s double").select(names.rate_or_source(F.col("v"), F.col("s"))).collect()


def test_resampling_matches_its_kernel_and_keeps_sines(spark):
    assert signals.target_points(5, 2, 1) == 2 and signals.target_points(100_000, 250, 200) == 80_000
    for n, m in ((16, 20), (20, 16), (15, 10), (1000, 800), (7, 14)):
        t = np.arange(n) / n
        x = 1 + np.sin(2 * np.pi * 2 * t) + 0.5 * np.cos(2 * np.pi * 3 * t)
        s = np.arange(m) / m
        assert signals.resample_kernel(n, m) @ x == pytest.approx(1 + np.sin(2 * np.pi * 2 * s) + 0.5 * np.cos(2 * np.pi * 3 * s), abs=1e-9)
    out = spark.createDataFrame([([[1.0, 2.0, 3.0, 4.0]],)], "signal array<array<float>>").select(signals.resample(4, 4)("signal").alias("y")).first().y
    assert out == [[1.0, 2.0, 3.0, 4.0]]


def test_quality_flags(spark):
    cases = [([[1.0, 2.0]], []), ([[1.0, 1.0], [1.0, 2.0]], ["flat_channel"]), ([[0.0, 2000.0]], []), ([[0.0, -2000.1]], ["extreme_amplitude"]), ([[0.0, float("nan")]], ["non_finite"]), ([[0.0, 5000.0], [0.0, 0.0]], ["flat_channel", "extreme_amplitude"])]
    frame = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(cases)], "k int, signal array<array<double>>")
    found = {r.k: r.y for r in frame.select("k", signals.quality_flags(F.col("signal")).alias("y")).collect()}
    for k, (_, want) in enumerate(cases):
        assert [f for f in found[k] if f != "extreme_amplitude" or want != ["non_finite"]] == want


def test_select_channels(spark):
    row = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], ["C3", "Cz"], ["cz", "Oz"])], "s array<array<float>>, n array<string>, r array<string>")
    out = row.select(signals.select_channels(F.col("s"), F.col("n"), F.col("r")).alias("s"), signals.channel_mask(F.col("n"), F.col("r")).alias("m")).first()
    assert out.s == [[3.0, 4.0], [0.0, 0.0]] and out.m == [True, False]


def test_codec_patches_spectrum_and_welch(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    frame = spark.createDataFrame([([x.tolist(), (x * 2).tolist()],)], "signal array<array<float>>")
    back = frame.select(signals.decode(2)(signals.encode()("signal")).alias("y")).first().y
    assert np.array(back) == pytest.approx(np.stack([x, 2 * x]), rel=1e-6)
    parts = frame.select(signals.patches(F.col("signal")[0]).alias("p")).first().p
    assert len(parts) == 2 and parts[1] == pytest.approx(x[200:], rel=1e-6)
    amplitudes = frame.select(signals.spectrum()(F.col("signal")[0].cast("array<double>")).alias("y")).first().y
    assert amplitudes == pytest.approx(np.abs(np.fft.rfft(x)) / 400, rel=1e-4, abs=1e-6) and len(amplitudes) == 201
    tone = np.sin(2 * np.pi * 10 * np.arange(2000) / 200)
    power = spark.createDataFrame([(tone.tolist(),)], "v array<double>").select(signals.welch(200.0)("v").alias("y")).first().y
    assert np.argmax(power) * 200 / 500 == pytest.approx(10) and sum(power) * 200 / 500 == pytest.approx(0.5, rel=0.01)
    with pytest.raises(Exception, match="not a multiple"):
        spark.createDataFrame([([1.0] * 7,)], "v array<double>").select(signals.patches(F.col("v"), 2)).collect()


def test_sliding_windows(spark):
    rows = [("r", 4.0, [list(map(float, range(16))), [0.0] * 16]), ("short", 4.0, [[1.0] * 7])]
    frame = spark.createDataFrame(rows, "recording_id string, sampling_rate_hz float, signal array<array<float>>")
    out = sorted(windows.sliding_windows(frame, 2.0, 2.0).collect(), key=lambda r: r.start_index)
    assert [(r.recording_id, r.start_index, r.start_seconds, r.signal[0][0]) for r in out] == [("r", 0, 0.0, 0.0), ("r", 8, 2.0, 8.0)]
    assert windows.sliding_windows(frame, 2.0, 1.0).count() == 3
    with pytest.raises(ValueError):
        windows.sliding_windows(frame, 0, 1)


def test_event_windows(spark):
    s = spark.createDataFrame([("a", [[float(k) for k in range(10)]])], "rec string, signal array<array<float>>")
    e = spark.createDataFrame([("a", 3, 4)], "rec string, position long, duration long")
    assert windows.event_windows(s, e, "rec").first().signal == [[2.0, 3.0, 4.0, 5.0]]
    with pytest.raises(Exception, match="outside"):
        windows.event_windows(s, spark.createDataFrame([("a", 8, 4)], e.schema), "rec").collect()


def test_ranking_by_hand(spark):
    rows = spark.createDataFrame(list(zip([0.9, 0.8, 0.7, 0.2, 0.1], [0, 1, 0, 1, 0], strict=True)), "score double, target int")
    m = ranking.binary_metrics(rows, "score", "target").first()
    assert (m.tn, m.fp, m.fn, m.tp) == (1, 2, 1, 1)
    assert m.balanced_accuracy == pytest.approx(5 / 12)
    assert (m.auroc, m.auprc, m.average_precision) == pytest.approx((1 / 2, 1 / 3, 1 / 2))
    one_class = ranking.binary_metrics(rows.filter("target = 1"), "score", "target").first()
    assert one_class.auroc is None and one_class.balanced_accuracy is None
    ties = spark.createDataFrame([(0.5, k % 2) for k in range(10)], "score double, target int")
    assert ranking.ranking_metrics(ties, "score", "target").first().auroc == pytest.approx(0.5)


def test_experiments(spark):
    runs = spark.createDataFrame([("auroc", 1, 0.60), ("auroc", 2, 0.64), ("auprc", 1, 0.5)], "metric string, seed int, value double")
    found = {r.metric: r for r in experiments.delta_from(experiments.seed_summary(runs, "value", ["metric"])).collect()}
    assert found["auroc"].mean == pytest.approx(0.62) and found["auroc"].std == pytest.approx(0.0282843, abs=1e-6)
    assert found["auprc"].std == 0.0 and found["auroc"].delta == pytest.approx(0.62 - 0.6988)
    same = experiments.seed_summary(runs, "value", ["metric"])
    assert {r.winner for r in experiments.compare_models(same, same).collect()} == {"a"}
    history = spark.createDataFrame([(1, e, v) for e, v in enumerate([0.5, 0.7, 0.6, 0.7, 0.65, 0.9])], "run int, epoch int, value double")
    assert tuple(experiments.early_stopping(history, "value", 3).first()) == (1, 1, 0.7, 4)
    assert tuple(experiments.early_stopping(history, "value", 10).first()) == (1, 5, 0.9, 5)
    rate = spark.range(1).select(experiments.learning_rate(F.lit(50), 0.1, 100, "cosine").alias("r")).first().r
    assert rate == pytest.approx(0.05) and math.isclose(0.1, spark.range(1).select(experiments.learning_rate(F.lit(5), 0.1, 9, "none").alias("r")).first().r)


def test_bundles(spark):
    sizes = [(f"r{k}", n) for k, n in enumerate([90, 70, 40, 30, 20])]
    want = [["r0"], ["r1", "r3"], ["r2", "r4"]]
    assert layout.plan_bundles(sizes, 100, 2) == want
    assert layout.plan_bundles(sizes, 0, 2) == [[f"r{k}"] for k in range(5)]
    with pytest.raises(ValueError):
        layout.plan_bundles(sizes, 100, 0)
    frame = spark.createDataFrame([("d", *x) for x in sizes], "by string, path string, size long")
    assert sorted(r.paths for r in layout.bundle_plan(frame, "by", "path", "size", 100, 2).collect()) == want
    rng = np.random.default_rng(1)
    many = [(f"p{k:03d}", int(n)) for k, n in enumerate(rng.integers(1, 120, 60))]
    frame = spark.createDataFrame([("d", *x) for x in many], "by string, path string, size long")
    assert sorted(r.paths for r in layout.bundle_plan(frame, "by", "path", "size", 100, 4).collect()) == layout.plan_bundles(many, 100, 4)


def test_bundles_of_a_large_group(spark):
    """One group of 20,000: its plan must not be a fold over rows and bundles."""
    sizes = np.random.default_rng(2).integers(1, 120, 20_000)
    many = [(f"p{k:05d}", int(n)) for k, n in enumerate(sizes)]
    frame = spark.createDataFrame([("d", *x) for x in many], "by string, path string, size long")
    late = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        found = layout.bundle_plan(frame, "by", "path", "size", 100, 4).collect()
    finally:
        late.cancel()
    assert sorted(r.paths for r in found) == layout.plan_bundles(many, 100, 4)
    assert sum(r.bytes for r in found) == sizes.sum()


def test_bundles_of_odd_recordings(spark):
    odd = [("a", "x", 0), ("a", "x", 0), ("a", None, 60), ("a", "y", None), ("a", "z", None), ("a", "big", 150), ("a", "less", -60), (None, "n", 40), (None, "m", 40), (None, "o", 40)]
    frame = spark.createDataFrame(odd, "by string, path string, size long")
    plan = lambda target, most: sorted(((r.by, r.paths, r.bytes) for r in layout.bundle_plan(frame, "by", "path", "size", target, most).collect()), key=repr)
    want = [("a", ["big", "less"], 90), ("a", ["x", "x", None], 60), ("a", ["y"], None), ("a", ["z"], None), (None, ["m", "n"], 80), (None, ["o"], 40)]
    assert plan(100, 3) == sorted(want, key=repr)
    assert plan(0, 3) == sorted([(by, [path], size) for by, path, size in odd], key=repr)
    with pytest.raises(ValueError):
        layout.bundle_plan(frame, "by", "path", "size", 100, 0)


@pytest.mark.parametrize("block", [1, 2, 128])
def test_first_fit_by_runs(monkeypatch, block):
    monkeypatch.setattr(layout, "BLOCK", block)
    rng = np.random.default_rng(block)
    for target, most, top in [(100, 3, 60), (100, 8, 130), (20, 50, 9), (50, 1, 50), (0, 4, 9)] * 8:
        sizes = sorted(rng.integers(1, top, 150).tolist(), reverse=True)
        bundles = []
        for place, items, first, each in layout.first_fit([(x, sizes.count(x)) for x in sorted({*sizes}, reverse=True)], target, most):
            assert place == len(bundles)
            bundles += [first + k // each for k in range(items)]
        found = {}
        for k, bundle in enumerate(bundles):
            found.setdefault(bundle, []).append(f"{k:03d}")
        assert sorted(found.values()) == layout.plan_bundles([(f"{k:03d}", x) for k, x in enumerate(sizes)], target, most)
    assert list(layout.first_fit([(60, 10**9), (40, 10**9 + 1)], 100, 2)) == [(0, 10**9, 0, 1), (10**9, 10**9, 0, 1), (2 * 10**9, 1, 10**9, 1)]


def test_size_estimates(spark):
    files = spark.createDataFrame([("/a/x_eeg.set", 10), ("/a/x_eeg.fdt", 90), ("/a/y.edf", 0)], "path string, length long")
    assert {r.path: r.bytes for r in layout.size_estimates(files).collect()} == {"/a/x_eeg.set": 100, "/a/y.edf": 1}


def test_layout_and_orders(spark):
    rows = spark.range(100).select(F.lit("b").alias("bundle"), F.col("id"))
    laid = layout.shard_layout(rows, "bundle", ["id"], 17, 2)
    assert laid.select("shard", "record_batch").distinct().count() == 6 and laid.select("shard").distinct().count() == 3
    shards = spark.range(40).select(F.col("id").alias("shard"))
    orders = [[r.shard for r in layout.epoch_order(shards, 1, e, "shard").orderBy("position").collect()] for e in (0, 0, 1)]
    assert orders[0] == orders[1] != orders[2] and sorted(orders[2]) == list(range(40))
    dealt = layout.assign_workers(shards, 1, 0, 3, "shard").groupBy("worker").count().collect()
    assert sorted(r["count"] for r in dealt) == [13, 13, 14]


def test_audits(spark):
    rows = [(f"sub-{k:02d}", s, k % 2) for s, (low, high) in names.SPLIT_SUBJECTS.items() for k in range(low, high + 1) for _ in (0, 1)]
    rows = [(a, s, (k % 2)) for k, (a, s, _) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "subject_id string, split string, label int")
    assert all(r.ok for r in audit.protocol_audit(frame).collect())
    worse = frame.filter("subject_id <> 'sub-16'").unionByName(spark.createDataFrame([("sub-03", "test", 5)], frame.schema))
    found = {r.split: r for r in audit.protocol_audit(worse).collect()}
    assert found["val"].missing == "16" and found["test"].foreign == "3" and found["test"].not_binary == 1 and found["train"].ok
    assert audit.leakage(worse, "subject_id").first().subject_id == "sub-03"
    cover = audit.coverage(spark.createDataFrame([(0,), (1,), (1,), (7,)], "i long"), "i", 4).first()
    assert tuple(cover) == (2, 2, 1, 1)


def test_parity(spark):
    a = spark.createDataFrame([("s", k, [float(k), 1.0], k % 2) for k in range(10)], "g string, k int, value array<double>, label int")
    same = audit.parity(a, a, "g", ["k"]).first()
    assert (same.compared, same.unpaired, same.different, same.labels_different, same.max_abs_diff) == (10, 0, 0, 0, 0.0)
    b = a.filter("k < 9").withColumn("value", F.when(F.col("k") == 3, F.array(F.lit(3.5), F.lit(1.0))).otherwise(F.col("value")))
    off = audit.parity(a, b, "g", ["k"]).first()
    assert (off.compared, off.unpaired, off.different, off.max_abs_diff) == (9, 1, 1, 0.5)


def test_sidecars(spark):
    merged = spark.createDataFrame([('{"a": "1", "b": "2"}', '{"b": "3"}'), (None, "[1]")], "t string, r string").select(sidecars.merge_metadata(F.col("t"), F.col("r")).alias("m")).collect()
    assert [r.m for r in merged] == [{"a": "1", "b": "3"}, {}]
    events = spark.createDataFrame([(None, -1.0, None, "NaN"), (1.0, 2.0, "go", "7")], "onset double, duration double, trial_type string, value string")
    assert [(r.onset, r.duration, r.event_type, r.value) for r in sidecars.normalize_events(events).collect()] == [(0.0, 0.0, "event", None), (1.0, 2.0, "go", "7")]
    trials = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1), ("c", 0), ("c", 1)], "source_uri string, label int")
    found = {(r.source_uri, r.label) for r in sidecars.normalize_labels_by_file(trials).collect()}
    assert found == {("a", 0), ("a", 1), ("b", 1), ("c", 0), ("c", 1)}


def test_histogram_and_bands(spark):
    rows = spark.range(101).select(F.col("id").cast("double").alias("v"))
    assert {r.bin: r["count"] for r in spectral.histogram(rows, "v", 10).collect()} == {k: 10 + (k == 9) for k in range(10)}
    assert spectral.histogram(rows.limit(0), "v", 10).count() == 0
    flat = spark.range(200).select(F.lit(1).alias("k"), (F.col("id") * 0.25).alias("frequency"), F.lit(2.0).alias("power"))
    found = {r.band: r.power for r in spectral.band_power(flat, ["k"]).collect()}
    assert found["alpha"] == pytest.approx(2 * 4.75) and found["delta"] == pytest.approx(2 * 3.25)


def test_validation(spark):
    good = dict(signal=[[1.0, 2.0]], channel_names=["C3"], channel_mask=[True], sampling_rate_hz=4.0, duration_seconds=1.0, amplitude_scale=1.0, subject_id="s", split=None, sample_id="x")
    broken = [{}, {"channel_mask": [True, True]}, {"signal": [[]]}, {"signal": []}, {"sampling_rate_hz": -1.0}, {"split": "dev"}, {"sample_id": ""}, {"signal": [[float("inf"), 1.0]]}, {"subject_id": None}]
    kind = "k int, signal array<array<float>>, channel_names array<string>, channel_mask array<boolean>, sampling_rate_hz float, duration_seconds double, amplitude_scale float, subject_id string, split string, sample_id string"
    frame = spark.createDataFrame([{"k": k} | good | b for k, b in enumerate(broken)], kind)
    errors = [r.error for r in schema.validate(frame).orderBy("k").collect()]
    assert errors[0] is None and all(errors[1:])
    assert errors[1].startswith("channel mask") and errors[2] == "signal has no samples" and errors[5] == "split is unknown" and errors[7] == "signal is not finite"
    with pytest.raises(Exception, match="split is unknown"):
        schema.validate(frame.filter("k = 5"), strict=True).collect()


def test_leakage_and_missing_subjects(spark):
    rows = spark.createDataFrame([("a", "train"), ("a", "train"), ("b", "train"), ("b", "test"), (None, "val"), ("c", None)], "k string, split string")
    assert [tuple(r) for r in audit.leakage(rows, "k").collect()] == [("b", 2, 2)]
    manifest = [(f"sub-{k:02d}", "train" if k <= 15 else "val" if k <= 20 else "test", k % 2) for k in range(1, 26) if k != 7] + [("sub-03", "val", 2)]
    found = {r.split: r for r in audit.protocol_audit(spark.createDataFrame(manifest, "subject_id string, split string, label int")).collect()}
    assert (found["train"].missing, found["train"].foreign, found["train"].ok) == ("7", "", False)
    assert (found["val"].missing, found["val"].foreign, found["val"].not_binary) == ("", "3", 1) and found["test"].ok


def manifest_rows(spark, change=lambda k, row: row):
    rows = []
    for k in range(50):
        s = k % 25 + 1
        row = {"sample_id": f"w{k}", "dataset_id": "shu-mi", "subject_id": f"sub-{s:03d}", "split": "train" if s <= 15 else "val" if s <= 20 else "test", "label": k // 25, "num_channels": 32, "num_samples": 800}
        row = change(k, row)
        if row:
            rows.append(tuple(row.values()))
    return spark.createDataFrame(rows, "sample_id string, dataset_id string, subject_id string, split string, label int, num_channels int, num_samples int")


def test_protocol_report(spark, monkeypatch):
    found = audit.protocol_report(manifest_rows(spark))
    assert found["warnings"] == ["the protocol has 11,988 examples; the manifest has 50"] and found["subjects_complete"] and not found["paper_ready"]
    monkeypatch.setattr(audit, "PAPER_EXAMPLES", 50)
    assert audit.protocol_report(manifest_rows(spark), strict=True)["paper_ready"]
    partly = manifest_rows(spark, lambda k, r: None if r["subject_id"] == "sub-016" else r | {"label": 0 if r["split"] == "val" else r["label"]})
    one = ["Split val is missing subjects [16]", "Split val does not contain both classes"]
    assert audit.protocol_report(partly)["warnings"][:2] == one and audit.protocol_report(partly, classes_first=True)["warnings"][:2] == one[::-1]
    for what, change in (
        ("not of dataset", {"dataset_id": "x"}),
        ("occur twice", {"sample_id": "w1"}),
        ("differ in shape", {"num_samples": 3}),
        ("belong elsewhere", {"subject_id": "sub-025"}),
        ("not binary", {"label": None}),
        ("no valid split", {"split": "dev"}),
    ):
        with pytest.raises(ValueError, match=what):
            audit.protocol_report(manifest_rows(spark, lambda k, r, c=change: r | c if k == 0 else r))
    with pytest.raises(ValueError, match="empty"):
        audit.protocol_report(manifest_rows(spark).limit(0))
    with pytest.raises(ValueError, match="not met"):
        audit.protocol_report(partly, strict=True)


def test_settings(spark, tmp_path):
    found = config.from_mapping({"training": {"epochs": 3, "lr": 1}, "model": {"width": 3}})
    assert found["training.epochs"] == 3 and found["training.lr"] == 1.0 and found.ignored == ("model.width",)
    assert found.section("publish") == {"job_bytes": 64 << 30, "rows_per_batch": 256, "batches_per_shard": 16}
    assert config.from_mapping({}).values == {k: s.default for k, s in config.SETTINGS.items()}
    for name, setting in config.SETTINGS.items():
        section, key = name.split(".")
        assert setting.read(name, setting.default) == setting.default
        for bad in ("x", None, True, [], float("nan"), *([setting.low - 1] if setting.low is not None else []), *([setting.low] if setting.above else []), *([setting.high] if setting.high else []), *([1.5] if setting.kind is int else [])):
            with pytest.raises(ValueError, match=key):
                config.from_mapping({section: {key: bad}})
    for bad in ([], None, {"training": 3}):
        with pytest.raises(ValueError, match="mapping"):
            config.from_mapping(bad)
    (tmp_path / "c.yaml").write_text("windows: {seconds: 2}\nother: {a: 1}\n")
    assert config.load(spark, str(tmp_path / "c.yaml"))["windows.seconds"] == 2.0


def test_bounded_shuffle_yields_each_row_once(spark):
    rows = spark.range(0, 1000, 1, 3)
    for size in (1, 7, 5000):
        out = layout.bounded_shuffle(rows, 1, 0, size).withColumn("part", F.spark_partition_id()).collect()
        assert sorted(r.id for r in out) == list(range(1000))
        for part in range(3):
            own = sorted((r.position, r.id) for r in out if r.part == part)
            assert [p for p, _ in own] == list(range(len(own)))
            assert ([i for _, i in own] == sorted(i for _, i in own)) == (size == 1)
    again = layout.bounded_shuffle(rows, 1, 0, 7)
    assert again.collect() == layout.bounded_shuffle(rows, 1, 0, 7).collect() != layout.bounded_shuffle(rows, 1, 1, 7).collect()


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_ranking_metrics_over_parts(spark, parts, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.shuffle.partitions", before))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    rng = np.random.default_rng(6)
    rows = [("g" if k % 3 else None, float(np.round(rng.normal(), 1)), int(rng.integers(2))) for k in range(300)]
    out = {r.by: r for r in ranking.ranking_metrics(spark.createDataFrame(rows, "by string, score double, label int"), "score", "label", ["by"]).collect()}
    for by in ("g", None):
        own = [(s, y) for b, s, y in rows if b == by]
        ones, zeros = [s for s, y in own if y], [s for s, y in own if not y]
        assert out[by].auroc == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros]))
        precision, recall, points = [1.0], [0.0], sorted({s for s, _ in own}, reverse=True)
        for at in points:
            tp = sum(s >= at for s in ones)
            precision.append(tp / sum(s >= at for s, _ in own))
            recall.append(tp / len(ones))
        assert out[by].average_precision == pytest.approx(sum((r - q) * p for p, r, q in zip(precision[1:], recall[1:], recall, strict=False)))
        assert out[by].auprc == pytest.approx(np.trapezoid(precision, recall))


def test_correlations_with_gaps(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 3)) + rng.normal(size=(200, 1))
    rows = [(k, c, float(x[k, c])) for k in range(200) for c in range(3) if (k + c) % 5]
    out = {(r.channel_a, r.channel_b): r.correlation for r in spectral.channel_correlation(spark.createDataFrame(rows, "k long, c int, v double").repartition(5), ["k"], "c", "v").collect()}
    assert len(out) == 6
    for (a, b), value in out.items():
        both = [k for k in range(200) if (k + a) % 5 and (k + b) % 5]
        assert value == pytest.approx(np.corrcoef(x[both, a], x[both, b])[0, 1])


def test_flags_of_a_batch_are_those_of_the_expression(spark):
    rng = np.random.default_rng(3)
    rows = [rng.normal(size=(3, 50)).tolist() for _ in range(6)]
    rows[1][2] = [1.5] * 50
    rows[2][0][7] = float("nan")
    rows[3][1][0] = float("inf")
    rows[4][0][3] = -2001.0
    rows[5][1][4] = None
    frame = spark.createDataFrame([(k, r) for k, r in enumerate([*rows, None])], "id int, signal array<array<float>>")
    got = frame.select("id", signals.quality_flags(F.col("signal")).alias("a"), signals.batch_flags("signal").alias("b")).orderBy("id").collect()
    assert [r.b for r in got] == [[], ["flat_channel"], ["non_finite", "extreme_amplitude"], ["non_finite", "extreme_amplitude"], ["extreme_amplitude"], ["non_finite", "extreme_amplitude"], None]
    assert all(r.a == r.b for r in got[:5])
