"""Recordings read by range: the bytes, the memory, the windows and the plan."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import signals
from wavemill.operators import windows
from wavemill.sources import edf, mat5, ranged, readers


def noise(channels, samples, seed=0):
    return np.random.default_rng(seed).normal(size=(channels, samples)) * 40


def tree(folder, seconds=40):
    """An EDF, a BDF and a SET with its data file, of 3 channels at 100 Hz."""
    for sub, kind in (("A", "edf"), ("B", "bdf"), ("C", "set")):
        place = folder / f"sub-{sub}" / "eeg"
        place.mkdir(parents=True)
        x, stem = noise(3, 100 * seconds, ord(sub)), place / f"sub-{sub}_task-rest"
        if kind == "set":
            eeg = {"nbchan": np.array([[3.0]]), "pnts": np.array([[100.0 * seconds]]), "srate": np.array([[100.0]]), "data": f"sub-{sub}_task-rest_eeg.fdt", "chanlocs": [{"labels": c} for c in ("C3", "C4", "Cz")]}
            stem.with_name(stem.name + "_eeg.set").write_bytes(mat5.write({"EEG": eeg}))
            stem.with_name(stem.name + "_eeg.fdt").write_bytes(x.astype("<f4").tobytes(order="F"))
        else:
            stem.with_name(stem.name + f"_eeg.{kind}").write_bytes(edf.write(x, 100, ["C3", "C4", "Cz"], wide=kind == "bdf"))


def whole(path):
    """The recording as the parsers of whole files read it."""
    path = path.removeprefix("file:")
    extra = open(path[:-4] + ".fdt", "rb").read() if path.endswith(".set") else None
    return readers._parse(open(path, "rb").read(), path[-4:], extra)


@pytest.mark.parametrize("block", [1, 3000, 1 << 23])
@pytest.mark.parametrize("size, stride", [(200, 200), (200, 50), (70, 300), (4000, 1)])
def test_walk_is_slicing(tmp_path, block, size, stride):
    tree(tmp_path)
    for path in sorted(map(str, tmp_path.rglob("*_eeg.[ebs][dde][ft]"))):
        recording = ranged.open_recording(path, path[:-4] + ".fdt" if path.endswith("set") else None)
        values = whole(path)[2].astype(np.float32)
        cuts = [(s, size) for s in range(0, recording.samples - size + 1, stride)]
        got = [x for part in ranged.walk(recording, [2, -1, 0], cuts, block=block) for x in part]
        assert len(got) == len(cuts)
        for (s, n), x in zip(cuts, got, strict=True):
            np.testing.assert_allclose(x[[0, 2]], values[[2, 0], s : s + n], rtol=1e-5, atol=1e-4)
            assert not x[1].any()


def test_cuts_of_other_lengths_and_order_and_rates(tmp_path):
    (tmp_path / "a.edf").write_bytes(edf.write(noise(2, 1000), 100, ["C3", "C4"]))
    recording = ranged.open_recording(str(tmp_path / "a.edf"))
    values = whole(str(tmp_path / "a.edf"))[2]
    cuts = sorted([(5, 20), (5, 700), (0, 1), (990, 10), (300, 333)])
    got = [x for part in ranged.walk(recording, [0, 1], cuts, block=900) for x in part]
    for (s, n), x in zip(cuts, got, strict=True):
        np.testing.assert_allclose(x, values[:, s : s + n], rtol=1e-5, atol=1e-4)
    slow = values @ signals.resample_kernel(1000, 640).T
    got = [x for part in ranged.walk(recording, [0, 1], [(0, 320), (320, 320)], rate=64.0) for x in part]
    np.testing.assert_allclose(np.concatenate(got, 1), slow, rtol=1e-4, atol=1e-3)
    for target in (999, 1000, 1001, 250, 3000):
        np.testing.assert_allclose(signals.fft_resample(values, target), values @ signals.resample_kernel(1000, target).T, atol=1e-9)


def big(path, channels=16, rate=500, seconds=140_000):
    """A sparse EDF of more than two gigabytes, its samples zero but for some."""
    head = edf.write(np.zeros((channels, 0)), rate, [f"E{k}" for k in range(channels)])
    head = head[:236] + str(seconds).encode().ljust(8) + head[244:]
    with open(path, "wb") as f:
        f.write(head)
        f.truncate(len(head) + channels * rate * 2 * seconds)
        at = len(head) + channels * rate * 2 * (seconds - 2)
        f.seek(at)
        f.write((np.arange(channels * rate, dtype="<i2") % 100).tobytes())
    return len(head) + channels * rate * 2 * seconds


def test_files_beyond_two_gigabytes_take_little_memory_and_few_bytes(spark, tmp_path):
    size = big(str(tmp_path / "sub-1_task-x_eeg.edf"))
    assert size > 2 << 30
    recording = ranged.open_recording(str(tmp_path / "sub-1_task-x_eeg.edf"))
    assert recording.data.taken < 1e-5 * size and recording.samples == 70_000_000
    tracemalloc.start()
    seen = sum(len(part) for part in ranged.walk(recording, list(range(16)), [(s, 2000) for s in range(0, 4_000_000, 1000)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 4000 and peak < 80 << 20  # 256 MB were walked, with windows that overlap
    taken = recording.data.taken
    assert taken < 1.1 * 4_001_000 * 16 * 2  # no sample was read twice
    found = readers.inventory(spark, str(tmp_path)).first()
    assert (found.channels, found.samples, found.duration_seconds, found.error) == (16, 70_000_000, 140_000.0, None)
    rows = ranged.recordings(spark, str(tmp_path), 1.0).filter("start_seconds >= 139990 and channel = 'E3'")
    assert rows.count() == 10 and rows.filter("start_seconds = 139998").first()["values"][:3] == pytest.approx([(1500 + k) % 100 / 32767 for k in range(3)], abs=1e-6)


def test_data_source_prunes_files_channels_and_times(spark, tmp_path):
    tree(tmp_path)
    rows = ranged.recordings(spark, str(tmp_path), 2.0, 1.0, part_bytes=6000)
    assert rows.count() == 3 * 3 * 39 and rows.rdd.getNumPartitions() > 6
    some = rows.filter("subject = 'B' and channel in ('C4', 'Cz') and start_seconds >= 10 and start_seconds < 20")
    plan = spark._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [EqualTo(subject,B), In(channel, [C4,Cz]), GreaterThanOrEqual(start_seconds,10.0)]" in plan
    got = {(r.channel, r.start_index): r["values"] for r in some.collect()}
    values = whole(next(str(p) for p in tmp_path.rglob("*.bdf")))[2]
    assert sorted(got) == sorted((c, s) for c in ("C4", "Cz") for s in range(1000, 2000, 100))
    for (c, s), x in got.items():
        np.testing.assert_allclose(x, values[("C3", "C4", "Cz").index(c), s : s + 200], rtol=1e-5, atol=1e-4)
    reader = ranged._Reader({"path": str(tmp_path)})
    assert {p.names["subject"] for p in reader.partitions()} == {"A", "B", "C"}
    assert list(reader.pushFilters([ranged.EqualTo(("subject",), "C"), ranged.GreaterThan(("start_seconds",), 3.0)])) == [ranged.GreaterThan(("start_seconds",), 3.0)]
    assert [p.names["subject"] for p in reader.partitions()] == ["C"] and reader.low == 3.0
    # one channel of many: only its bytes
    (tmp_path / "many.edf").write_bytes(edf.write(noise(20, 1000), 100, [f"E{k}" for k in range(20)]))
    recording = ranged.open_recording(str(tmp_path / "many.edf"))
    before = recording.data.taken
    list(ranged.walk(recording, [7], [(0, 1000)]))
    assert recording.data.taken - before == 2000


@pytest.mark.parametrize("rate", ["auto", 50.0])
def test_windows_of_files_are_those_of_arrays(spark, tmp_path, rate, monkeypatch):
    monkeypatch.setattr(ranged, "PART_BYTES", 20_000)
    tree(tmp_path)
    source = readers.BidsSource(str(tmp_path), window=2.0, stride=0.5, rate=rate)
    got = {(r.source_uri, r.start_seconds): r for r in source.outcomes(spark, source.discover(spark)).collect()}
    assert len(got) == 3 * 77
    paths = {p for p, _ in got}
    for path in paths:
        arrays = spark.createDataFrame([(path, 100.0, whole(path)[2].astype("f4").tolist())], "path string, sampling_rate_hz double, signal array<array<float>>")
        if rate != "auto":
            arrays = arrays.withColumn("signal", signals.resample_to("signal", F.col("sampling_rate_hz"), F.lit(rate))).withColumn("sampling_rate_hz", F.lit(rate))
        for r in windows.sliding_windows(arrays, 2.0, 0.5).collect():
            np.testing.assert_allclose(got[path, r.start_seconds].signal, r.signal, rtol=1e-4, atol=2e-3)
    plan = source.outcomes(spark, source.discover(spark))._jdf.queryExecution().optimizedPlan().toString()
    before = plan[plan.index("MapInArrow") :]  # the reading of samples is the last step: no signal meets a join
    assert "Join" not in plan[: plan.index("MapInArrow")] and "Join" in before


def test_stores_that_tasks_cannot_open_are_read_by_spark(spark, tmp_path, monkeypatch):
    tree(tmp_path)
    source = readers.BidsSource(str(tmp_path), window=2.0, stride=2.0)
    want = {(r.sample_id, str(r.signal)) for r in source.outcomes(spark, source.discover(spark)).collect()}
    monkeypatch.setattr(ranged, "STORES", ())
    got = {(r.sample_id, str(r.signal)) for r in source.outcomes(spark, source.discover(spark)).collect()}
    assert got == want and len(got) == 60


def test_shapes_of_mat_variables_from_their_first_bytes():
    for compress in (True, False):
        data = mat5.write({"data": noise(30, 40_000).reshape(30, 40, 1000).astype("f4"), "labels": np.ones((1, 30), "i8")}, compress)
        taken = []
        found = mat5.shapes(lambda at, n: taken.append(n) or data[at : at + n], len(data))
        assert found == {"data": (30, 40, 1000), "labels": (1, 30)} and sum(taken) < 0.01 * len(data)
    with pytest.raises(ValueError, match="early"):
        mat5.shapes(lambda at, n: data[at : at + n], len(data) - 900)


def test_a_window_row_never_holds_its_recording(spark):
    x = noise(4, 30_000).astype("f4")
    rows = spark.createDataFrame([("r", 100.0, x.tolist())], "id string, sampling_rate_hz double, signal array<array<float>>")
    cut = windows.sliding_windows(rows, 1.0, 0.5)
    got = {r.start_index: r.signal for r in cut.collect()}
    assert len(got) == 599 and all(np.allclose(got[s], x[:, s : s + 100]) for s in got)
    assert windows.sliding_windows(rows, 400.0, 1.0).count() == 0
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    generate = next(line for line in plan.splitlines() if "Generate" in line)
    assert "signal" not in generate.split("[")[1].split("]")[0]
