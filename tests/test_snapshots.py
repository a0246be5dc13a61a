"""Snapshots: writers that race, readers in between, time travel, expiry."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from wavemill import catalog, schema
from wavemill.sinks import publish as publishing
from wavemill.sinks.snapshots import Conflict, Log, publish_snapshot


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x int").coalesce(1)


def seen(log, version=None):
    return sorted(r.x for r in log.read(version).collect())


def test_snapshots_are_kept_and_expire(spark, tmp_path):
    log = Log(spark, str(tmp_path / "d"))
    assert log.at().version == 0 and log.versions() == []
    with pytest.raises(ValueError, match="empty"):
        log.read()
    log.append(numbers(spark, 1))
    second = log.append(numbers(spark, 2), {"rows": 1})
    log.replace(numbers(spark, 9))
    assert [seen(log, v) for v in (1, 2, 3)] == [[1], [1, 2], [9]] and seen(log) == [9]
    assert log.at(before=second.written).version == 2 and log.at(2).summary == {"rows": 1} and log.at(3).parent == 2
    with pytest.raises(ValueError, match="no snapshot 7"):
        log.at(7)
    orphan = log.write(numbers(spark, 5))
    assert log.expire(keep=2) == []  # all is young
    gone = log.expire(keep=1, grace=-60)
    assert orphan in gone and len(gone) == 3 and log.versions() == [3] and seen(log) == [9]
    with pytest.raises(ValueError):
        log.expire(0)


def test_of_two_writers_on_one_snapshot_one_wins(spark, tmp_path):
    log = Log(spark, str(tmp_path / "d"))
    log.append(numbers(spark, 0))
    parent = log.at()
    log.replace(numbers(spark, 1), parent)
    with pytest.raises(Conflict):
        log.replace(numbers(spark, 2), parent)
    assert seen(log) == [1] and len(log.store.names("data")) == 2  # what lost is deleted
    done, lost, sizes = [], [], []

    def write(k):
        own = Log(spark, str(tmp_path / "d"))
        try:
            for j in range(3):
                done.append((k, own.append(numbers(spark, 10 * k + j)).version))
        except Conflict as error:
            lost.append(error)

    def read():
        own = Log(spark, str(tmp_path / "d"))
        for _ in range(8):
            sizes.append(len(seen(own)))  # a reader never meets a state with nothing in it

    threads = [threading.Thread(target=write, args=(k,)) for k in range(1, 5)] + [threading.Thread(target=read)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not lost and sorted(v for _, v in done) == list(range(3, 15))
    assert seen(log) == sorted([1] + [10 * k + j for k in range(1, 5) for j in range(3)]) and sizes == sorted(sizes) and min(sizes) >= 1


def test_put_if_absent_and_texts_that_are_replaced(spark, tmp_path):
    store = publishing.Store(spark, str(tmp_path))
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if store.put_if_absent("a/one.json", json.dumps({"by": k})) else None) for k in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and store.read_json("a/one.json") == {"by": won[0]} and store.names("a") == ["one.json"]
    for k in range(3):
        store.write_json("two.json", {"k": k})
    assert store.read_json("two.json") == {"k": 2} and sorted(x for x in store.names("") if x[0] != ".") == ["a", "two.json"]


def window_rows(spark, n=6, bad=None):
    row = dict.fromkeys(schema.WINDOW.names)
    base = row | {"dataset_id": "d", "subject_id": "s", "shard_path": "", "record_batch": 0, "row_in_batch": 0, "sampling_rate_hz": 100.0, "num_channels": 2, "num_samples": 3, "channel_names": ["a", "b"], "channel_mask": [True, True], "start_seconds": 0.0, "duration_seconds": 0.03, "source_uri": "u", "source_format": "edf", "preprocessing_version": "v", "amplitude_scale": 2.0, "quality_flags": [], "metadata_json": "{}", "split": "train", "label": 1}
    rows = [base | {"sample_id": f"w{k}", "signal": [[1.0, 2.0, float(k)]] * 2} | (bad or {}) for k in range(n)]
    return spark.createDataFrame([tuple(r[c] for c in schema.WINDOW.names) for r in rows], schema.WINDOW)


def test_windows_as_snapshots(spark, tmp_path):
    root = str(tmp_path / "d")
    first = publish_snapshot(window_rows(spark), root, rows_per_batch=2, batches_per_shard=2)
    publish_snapshot(window_rows(spark, 2), root)
    assert first.summary["examples"] == 6
    assert catalog.load_windows(spark, root, snapshot=1, verified=True).count() == 6 and catalog.load_windows(spark, root, snapshot=2).count() == 2
    assert [r.signal[0][2] for r in catalog.load_windows(spark, root, snapshot=1, ids=["w4"]).collect()] == [2.0]
    assert {(r.shard_path, r.record_batch, r.row_in_batch) for r in Log(spark, root).read(1).collect()} == {(f"shards/shard-{k // 4:06d}.arrow", k // 2 % 2, k % 2) for k in range(6)}
    for bad, what in (({"signal": [[1.0]]}, "do not match"), ({"sample_id": "same"}, "twice")):
        with pytest.raises(publishing.PublicationError, match=what):
            publish_snapshot(window_rows(spark, bad=bad), root)
    assert Log(spark, root).versions() == [1, 2]
    wrong = window_rows(spark, 3).withColumn("num_samples", F.when(F.col("sample_id") == "w1", 4).otherwise(3))
    Log(spark, root).append(wrong)
    with pytest.raises(Exception, match="payload is not what the manifest says: w1"):
        catalog.load_windows(spark, root, snapshot=3, verified=True).select("signal").collect()
