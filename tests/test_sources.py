"""Files in, published datasets out."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill import catalog, cli, schema
from wavemill.sinks import publish as publishing
from wavemill.sources import edf, mat5, readers
from wavemill.streaming.ingest import ingest


def test_mat_round_trip():
    rng = np.random.default_rng(0)
    data = {"data": rng.normal(size=(3, 4, 5)).astype("f4"), "labels": np.array([[1, 2, 1]], "i8"), "EEG": {"srate": np.array([[250.0]]), "name": "rec é", "chanlocs": [{"labels": "C3"}, {"labels": "C4"}]}}
    for compress in (True, False):
        back = mat5.read(mat5.write(data, compress))
        assert (back["data"] == data["data"]).all() and (back["labels"] == data["labels"]).all()
        assert back["EEG"]["name"] == "rec é" and [c["labels"] for c in back["EEG"]["chanlocs"]] == ["C3", "C4"]
    with pytest.raises(ValueError):
        mat5.read(b"nothing")


@pytest.mark.parametrize("wide", [False, True])
def test_edf_round_trip(wide):
    x = np.random.default_rng(1).normal(size=(3, 500)) * 50
    found = edf.read(edf.write(x, 250, ["C3", "C4", "Cz"], wide=wide))
    assert found.rate == 250 and found.names == ["C3", "C4", "Cz"]
    assert np.abs(found.values - x).max() < (1e-4 if wide else 0.02)
    assert found.volts() * 1e6 == pytest.approx(found.values)
    with pytest.raises(ValueError):
        edf.read(b"")


def mat_tree(folder):
    rng = np.random.default_rng(2)
    for s in (1, 17, 22):
        trials = {"data": rng.normal(size=(3, 4, 40)).astype("f4"), "labels": np.array([[1, 2, 1]], "i8")}
        (folder / f"sub-{s:03d}_ses-01_task_motorimagery_eeg.mat").write_bytes(mat5.write(trials))
    (folder / "sub-002_ses-01_task_motorimagery_eeg.mat").write_bytes(mat5.write({"data": np.zeros((2, 4, 40), "f4")}))


def test_mat_to_published_dataset(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    mat_tree(source)
    args = ["harmonize-mat", str(source), out, "--channels", "4", "--rate", "200", "--original-rate", "250"]
    summary = cli.main(args, spark)
    assert summary["examples"] == 9 and summary["split_examples"] == {"train": 3, "val": 3, "test": 3}
    report = publishing.Store(spark, out).read_json("source_audit.json")
    assert [f["error_type"] for f in report["failures"]] == ["KeyError"]
    rows = catalog.load_windows(spark, out, split="val", rate=200.0, channels=4, samples=32, require_labels=True)
    assert rows.count() == 3 and {r.label for r in rows.collect()} == {0, 1}
    assert catalog.load_windows(spark, out, with_signal=False).count() == 9
    with pytest.raises(ValueError, match="no window"):
        catalog.load_windows(spark, out, samples=33)
    with pytest.raises(FileExistsError):
        cli.main(args, spark)
    assert cli.main([*args, "--resume"], spark)["examples"] == 9
    with pytest.raises(ValueError, match="unreadable"):
        cli.main([*args, "--overwrite", "--strict"], spark)
    assert cli.main(["inspect-harmonized", out], spark)["examples"] == 9
    assert cli.main(["compare-backends", out, out], spark)["splits"][0]["different"] == 0


def test_duplicate_sessions_are_refused(spark, tmp_path):
    for name in ("sub-001_ses-01_a_eeg.mat", "sub-001_ses-01_b_eeg.mat"):
        (tmp_path / name).write_bytes(b"x")
    with pytest.raises(ValueError, match="one subject and session"):
        readers.discover_mat(spark, str(tmp_path))


def bids_tree(folder):
    rng = np.random.default_rng(3)
    for sub, kind in (("A", "edf"), ("B", "bdf"), ("C", "set")):
        place = folder / f"sub-{sub}" / "ses-1" / "eeg"
        place.mkdir(parents=True)
        stem = f"sub-{sub}_ses-1_task-rest_run-1"
        x = rng.normal(size=(3, 1000)) * 30
        if kind == "set":
            eeg = {"nbchan": np.array([[3.0]]), "pnts": np.array([[1000.0]]), "srate": np.array([[100.0]]), "data": f"{stem}_eeg.fdt", "chanlocs": [{"labels": c} for c in ("C3", "C4", "EOG1")]}
            (place / f"{stem}_eeg.set").write_bytes(mat5.write({"EEG": eeg}))
            (place / f"{stem}_eeg.fdt").write_bytes(x.astype("<f4").tobytes(order="F"))
        else:
            (place / f"{stem}_eeg.{kind}").write_bytes(edf.write(x, 100, ["C3", "C4", "EOG1"], wide=kind == "bdf"))
        (place / f"{stem}_channels.tsv").write_text("name\ttype\nC3\tEEG\nC4\tEEG\nEOG1\tEOG\n")
    broken = folder / "sub-D" / "eeg"
    broken.mkdir(parents=True)
    (broken / "sub-D_task-rest_eeg.edf").write_bytes(b"")


def test_bids_to_windows(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    bids_tree(source)
    assert readers.discover_bids(spark, str(source)).count() == 4
    assert [r.sub for r in readers.discover_bids(spark, str(source), subjects=["sub-B", "C"], limit=1).collect()] == ["B"]
    summary = cli.main(["harmonize-bids", str(source), out, "--window", "2", "--stride", "2"], spark)
    assert summary["examples"] == 15 and summary["subjects"] == 3
    rows = spark.read.parquet(f"{out}/windows")
    assert {(r.num_channels, r.num_samples) for r in rows.select("num_channels", "num_samples").distinct().collect()} == {(2, 200)}
    assert [f["path"].rsplit("/", 1)[-1] for f in publishing.Store(spark, out).read_json("source_audit.json")["failures"]] == ["sub-D_task-rest_eeg.edf"]


def test_bids_metadata_channels_and_rates(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    bids_tree(source)
    place = source / "sub-A" / "ses-1" / "eeg"
    stem = "sub-A_ses-1_task-rest_run-1"
    (source / "task-rest_eeg.json").write_text('{"PowerLineFrequency": 60, "Site": "inherited"}')
    (place / f"{stem}_eeg.json").write_text('{"Site": "own"}')
    (place / f"{stem}_events.tsv").write_text("onset\tduration\ttrial_type\tvalue\n1.5\t-2\tgo\t3\nn/a\t1\t\tn/a\n")
    none = source / "sub-E" / "eeg"
    none.mkdir(parents=True)
    (none / "sub-E_task-rest_eeg.edf").write_bytes(edf.write(np.ones((1, 300)), 100, ["EOG1"]))
    (none / "sub-E_task-rest_channels.tsv").write_text("name\ttype\tstatus\nEOG1\tEOG\tgood\n")
    twice = source / "sub-F" / "eeg"
    twice.mkdir(parents=True)
    (twice / "sub-F_task-rest_eeg.edf").write_bytes(edf.write(np.ones((2, 300)), 100, ["EEG C3", "c3"]))
    rows = {r.source_uri.rsplit("/", 1)[-1][:5]: r for r in readers.bids_recordings(spark, str(source)).collect()}
    meta = json.loads(rows["sub-A"].metadata_json)
    assert meta["recording_json"] == {"PowerLineFrequency": "60", "Site": "own"} and meta["run_id"] == "1" and meta["events_path"].endswith("_events.tsv") and len(meta["channels"]) == 3
    assert [tuple(e) for e in rows["sub-A"].events] == [(1.5, 0.0, "go", "3"), (0.0, 1.0, "event", None)]
    assert json.loads(rows["sub-B"].metadata_json)["recording_json"] == {"PowerLineFrequency": "60", "Site": "inherited"} and rows["sub-B"].events == []
    assert rows["sub-E"].error.startswith("no EEG channels") and rows["sub-F"].error == "two channels have one name" and rows["sub-D"].error_type == "ValueError"
    args = ["harmonize-bids", str(source), out, "--window", "2", "--stride", "2", "--rate", "50", "--channel-policy", "select", "--channels", "c4", "Cz", "--allow-missing"]
    assert cli.main(args, spark)["examples"] == 15
    got = spark.read.parquet(f"{out}/windows")
    assert {(tuple(r.channel_names), tuple(r.channel_mask), r.num_samples, r.sampling_rate_hz) for r in got.collect()} == {(("c4", "Cz"), (True, False), 100, 50.0)}
    with pytest.raises(ValueError, match="no window"):
        cli.main([*[a for a in args if a != "--allow-missing"], "--overwrite"], spark)
    assert {f["error_type"] for f in publishing.Store(spark, out).read_json("source_audit.json")["failures"]} == {"KeyError", "ValueError"}
    with pytest.raises(ValueError, match="needs channels"):
        readers.BidsSource("x", policy="select")
    found = {r.path.rsplit("/", 1)[-1][:5]: r for r in readers.inventory(spark, str(source)).collect()}
    assert (found["sub-A"].channels, found["sub-A"].rate, found["sub-A"].samples, found["sub-A"].duration_seconds) == (3, 100.0, 1000, 10.0) and found["sub-C"].channels == 3 and found["sub-D"].error


def test_resume_takes_over_finished_recordings(spark, tmp_path, monkeypatch):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    mat_tree(source)
    mats = readers.MatSource(str(source), channels=4)
    real, calls = readers.MatSource.outcomes, []

    def outcomes(self, session, paths):
        calls.append(sorted(r.path[-40:] for r in paths.collect()))
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(self, session, paths)

    monkeypatch.setattr(readers.MatSource, "outcomes", outcomes)
    with pytest.raises(RuntimeError, match="lost"):
        publishing.harmonize(spark, mats, out, job_bytes=1500)
    first = calls[0]
    summary = publishing.harmonize(spark, mats, out, resume=True)
    assert summary["examples"] == 9 and sorted(calls[2] + first) == sorted({x for c in calls for x in c}) and not set(first) & set(calls[2])
    report = publishing.Store(spark, out).read_json("source_audit.json")
    assert report["resumed_recordings"] == len(first) and report["discovered_recordings"] == 4 and report["jobs"] == 1
    assert not publishing.Store(spark, out).exists("_work")
    n = len(calls)
    assert publishing.harmonize(spark, mats, out, resume=True) == summary and len(calls) == n
    # other settings: done again
    assert publishing.harmonize(spark, readers.MatSource(str(source), 100.0, channels=4), out, resume=True)["examples"] == 9 and len(calls) == n + 1


def test_reports_and_models(spark, tmp_path):
    source, out, model = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "model")
    source.mkdir()
    rng = np.random.default_rng(5)
    for s in (1, 2, 16, 21):
        labels = np.array([[1, 2] * 6], "i8")
        trials = {"data": (rng.normal(size=(12, 4, 50)) * (1 + 4 * (labels.ravel() == 2)[:, None, None])).astype("f4"), "labels": labels}
        (source / f"sub-{s:03d}_ses-01_eeg.mat").write_bytes(mat5.write(trials))
    rates = ["--channels", "4", "--rate", "200"]
    with pytest.raises(ValueError, match="points, not 800"):
        cli.main(["preprocess", str(source), out, *rates], spark)
    assert not publishing.Store(spark, out).exists("windows")
    found = cli.main(["preprocess", str(source), out, *rates, "--seconds", "0.2", "--overwrite"], spark)
    assert found["audit"]["warnings"][0].startswith("Split train is missing subjects [3, 4") and not found["audit"]["paper_ready"]
    assert cli.main(["inspect-data", out], spark)["split_class_counts"]["test"] == {"0": 6, "1": 6}
    with pytest.raises(ValueError, match="protocol is not met"):
        cli.main(["inspect-data", out, "--strict"], spark)
    (tmp_path / "c.yaml").write_text("other: {kind: x}\ntraining: {epochs: 5, weight_decay: 0.01}\n")
    for name in ("a", "b"):
        runs = cli.main(["reproduce", out, "--seeds", "1", "2", "--config", str(tmp_path / "c.yaml"), "--output", f"{model}-{name}"], spark)
        assert runs["num_runs"] == 2 and runs["test_aggregate"]["auroc"]["mean"] > 0.9
        cli.main(["benchmark", out, "--batches", "4", "8", "--repeats", "2", "--output", f"{model}-{name}"], spark)
    both = cli.main(["compare", f"{model}-a", f"{model}-b", "--output", model], spark)
    assert both["metrics"]["auroc"]["difference"] == 0 and [r["batch"] for r in both["batches"]] == [4, 8]
    assert "| AUROC |" in spark.read.text(f"{model}/comparison.md", wholetext=True).first().value
    cli.main(["train", out, "--output", model], spark)
    by_epoch = cli.main(["train", out, "--output", f"{model}-e", "--by-epoch", "--config", str(tmp_path / "c.yaml")], spark)
    assert len(by_epoch["history"]) == 5 and {m["split"] for m in by_epoch["metrics"]} == {"val", "test"} and by_epoch["best_epoch"] > 0
    assert publishing.Store(spark, model).read_json("run.json")["parameters"] == 13
    epoch = cli.main(["benchmark-dataloader", out, "--split", "train"], spark)
    assert epoch["complete"] and epoch["expected"] == 24
    assert cli.main(["benchmark-streaming", out, "--examples", "10", "--buffer", "3"], spark)["examples"] == 10
    (tmp_path / "keys").write_text("encoder.layers.0.self_attn_s.w\nproj_out.0.b\n")
    (tmp_path / "want").write_text("encoder.0.spatial_attention.w\nproj_out.b\n")
    keys = ["--keys", str(tmp_path / "keys"), "--expected", str(tmp_path / "want")]
    sha = hashlib.sha256((tmp_path / "keys").read_bytes()).hexdigest()
    assert cli.main(["check-checkpoint", str(tmp_path / "keys"), "--sha256", sha, *keys], spark)["missing"] == []
    with pytest.raises(ValueError, match="1 files differ"):
        cli.main(["check-checkpoint", str(tmp_path / "keys"), "--sha256", "0"], spark)
    assert cli.main(["smoke"], spark)["metrics"]["auroc"] == 1


def test_edf_events(spark, tmp_path):
    x = np.arange(1000, dtype=float)[None].repeat(2, 0) / 10
    (tmp_path / "sub-001_ses-01_eeg.edf").write_bytes(edf.write(x, 250, ["C3", "C4"]))
    (tmp_path / "sub-001_ses-01_events.tsv").write_text("onset\tduration\tvalue\tsample\n0\t250\t1\t1\n0\t250\t2\t501\n")
    source = readers.EdfSource(str(tmp_path), rate=250.0)
    out = sorted(source.outcomes(spark, source.discover(spark)).collect(), key=lambda r: r.start_seconds)
    assert [(r.start_seconds, r.label, len(r.signal[0]), r.split, r.sample_id) for r in out] == [(0.0, 0, 250, "train", "shu-mi:sub-001:ses-01:trial-0000"), (2.0, 1, 250, "train", "shu-mi:sub-001:ses-01:trial-0001")]
    assert out[1].signal[0][0] == pytest.approx(50.0, abs=0.01) and list(out[0].channel_names) == ["C3", "C4"]


def test_edf_failures_are_of_whole_recordings(spark, tmp_path):
    x = np.arange(1000, dtype=float)[None].repeat(2, 0) / 10
    head = "onset\tduration\tvalue\n"
    tables = {2: head + "1\t250\t1\n900\t250\t2\n", 3: "onset\tduration\n1\t250\n", 4: None, 5: head, 6: head + "1\t250\t7\n", 7: head + "1\t250\t2\n"}
    for s, text in tables.items():
        (tmp_path / f"sub-{s:03d}_ses-01_eeg.edf").write_bytes(edf.write(x, 250, ["C3", "C4"]))
        if text is not None and s != 7:
            (tmp_path / f"sub-{s:03d}_ses-01_events.tsv").write_text(text)
    (tmp_path / "events").mkdir()
    (tmp_path / "events" / "sub-007_ses-01_events.tsv").write_text(tables[7])
    (tmp_path / "sub-008_ses-01_eeg.edf").write_bytes(b"")
    out = str(tmp_path / "out")
    args = ["harmonize-edf", str(tmp_path), out, "--rate", "auto"]
    summary = cli.main(args, spark)
    assert summary["examples"] == 1 and summary["timing"]["recordings_per_second"] > 0
    report = publishing.Store(spark, out).read_json("source_audit.json")
    assert (report["discovered_recordings"], report["processed_recordings"], report["skipped_recordings"]) == (7, 1, 6)
    found = {f["path"].rsplit("/", 1)[-1][4:7]: (f["error_type"], f["error"]) for f in report["failures"]}
    assert found["002"][1] == "event outside its recording" and found["003"][1] == "events lack duration, value or position"
    assert found["004"][0] == "FileNotFoundError" and found["005"][1] == "recording produced no windows" and found["006"][1] == "labels are not binary" and found["008"][0] == "ValueError"
    assert spark.read.json(f"{out}/failures").count() == 6


def window_rows(spark, n=6, same=False):
    row = spark.range(n).select(
        F.format_string("w%d", F.lit(0) if same else F.col("id")).alias("sample_id"),
        F.lit("d").alias("dataset_id"),
        F.lit("sub-1").alias("subject_id"),
        *[F.lit(None).cast("string").alias(c) for c in ("session_id", "task")],
        F.lit("train").alias("split"),
        F.lit("").alias("shard_path"),
        F.lit(0).alias("record_batch"),
        F.lit(0).alias("row_in_batch"),
        F.lit(4.0).cast("float").alias("sampling_rate_hz"),
        F.lit(1).alias("num_channels"),
        F.lit(2).alias("num_samples"),
        F.array(F.lit("C3")).alias("channel_names"),
        F.array(F.lit(True)).alias("channel_mask"),
        F.lit(0).alias("label"),
        F.lit(0.0).alias("start_seconds"),
        F.lit(0.5).alias("duration_seconds"),
        F.lit("f").alias("source_uri"),
        F.lit("x").alias("source_format"),
        F.lit("v").alias("preprocessing_version"),
        F.lit(1.0).cast("float").alias("amplitude_scale"),
        F.array().cast("array<string>").alias("quality_flags"),
        F.lit("{}").alias("metadata_json"),
        F.array(F.array(F.col("id").cast("float"), F.lit(2.0).cast("float"))).alias("signal"),
    )
    return row.select(*schema.WINDOW.names)


def test_publication_is_all_or_nothing(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "d")
    with pytest.raises(ValueError, match="occur twice"):
        publishing.publish(window_rows(spark, same=True), out)
    store = publishing.Store(spark, out)
    assert not store.exists("windows") and not store.exists("_staged")
    with pytest.raises(ValueError, match="no window"):
        publishing.publish(window_rows(spark).limit(0), out)
    assert publishing.publish(window_rows(spark), out, rows_per_batch=2, batches_per_shard=2)["shards"] == 2
    # a crash between the plan and the move is finished on resume
    real = publishing.Store.move
    monkeypatch.setattr(publishing.Store, "move", lambda self, a, b: real(self, a, b) if a != "_staged" else (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        publishing.publish(window_rows(spark, 3), out, overwrite=True)
    # an error is rolled back to what was there
    assert spark.read.parquet(f"{out}/windows").count() == 6 and not any(store.exists(n) for n in ("_staged", "_previous", "_PUBLICATION_PLAN.json"))
    monkeypatch.setattr(publishing.Store, "move", lambda self, a, b: real(self, a, b) if a != "_staged" else (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        publishing.publish(window_rows(spark, 3), out, overwrite=True)
    monkeypatch.setattr(publishing.Store, "move", real)
    assert store.exists("_previous") and not store.exists("windows")
    publishing.recover(store)
    assert not store.exists("_previous")
    assert spark.read.parquet(f"{out}/windows").count() == 3 and not store.exists("_PUBLICATION_PLAN.json")
    window_rows(spark).write.parquet(f"{out}/_staged")
    with pytest.raises(publishing.PublicationError, match="without a plan"):
        publishing.recover(store)


def test_stream_ingest(spark, tmp_path):
    rows = window_rows(spark, 4).select(F.col("sample_id").alias("recording_id"), *[f.name for f in schema.RECORDING if f.name != "recording_id"])
    bad = rows.limit(1).withColumn("recording_id", F.lit("bad")).withColumn("sampling_rate_hz", F.lit(-1.0).cast("float"))
    rows.unionByName(bad).write.parquet(str(tmp_path / "inbox"))
    for _ in range(2):  # the second run finds nothing new
        ingest(spark, str(tmp_path / "inbox"), str(tmp_path / "out"), str(tmp_path / "cp"), 0.25, 0.25).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "windows")).count() == 8
    assert [r.error for r in spark.read.parquet(str(tmp_path / "out" / "failures")).collect()] == ["sampling rate is not positive"]
