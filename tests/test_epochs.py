"""Streams of epochs: each example once, ranks, restarts, places."""

import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from wavemill.sinks.snapshots import Log
from wavemill.streaming import epochs as E


@pytest.fixture(scope="module")
def plan(spark, tmp_path_factory):
    """300 rows in 5 shards of several row groups, and one without rows."""
    root = tmp_path_factory.mktemp("epochs")
    rows = spark.range(300).select(F.format_string("s%03d", "id").alias("sample_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("signal"))
    import pyarrow.parquet as pq

    table = rows.orderBy("sample_id").toArrow()
    (root / "windows").mkdir()
    for k in range(5):
        pq.write_table(table.slice(60 * k, 60), root / "windows" / f"part-{k}.parquet", row_group_size=25)
    pq.write_table(table.slice(0, 0), root / "windows" / "part-5.parquet")
    assert E.prepare(spark, str(root / "windows"), str(root / "plan")) == 300
    return str(root / "plan")


def taken(spark, rows, folder, fail_at=None):
    """Runs a stream into one folder for each batch; the place it got to."""

    def use(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        if number == fail_at:
            raise RuntimeError("lost")

    return E.consume(rows, use, f"{folder}/checkpoint")


def seen(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/out").select("epoch", "shard", "position", "sample_id").collect()]


def test_each_rank_has_its_share_and_each_epoch_every_row_once(spark, plan, tmp_path):
    found = {}
    for rank in range(2):
        taken(spark, E.epochs(spark, plan, 2, 7, rank, 2, 70), str(tmp_path / f"r{rank}"))
        found[rank] = seen(spark, tmp_path / f"r{rank}")
    every = found[0] + found[1]
    for epoch in range(2):
        assert sorted(r[3] for r in every if r[0] == epoch) == [f"s{k:03d}" for k in range(300)]
        assert not {r[1] for r in found[0] if r[0] == epoch} & {r[1] for r in found[1] if r[0] == epoch}
    order = [[r[3] for r in sorted(every) if r[0] == e and r[1].endswith("part-0.parquet")] for e in range(2)]
    assert order[0] != order[1] and sorted(order[0]) == sorted(order[1]) == [f"s{k:03d}" for k in range(60)]
    assert {r[2] for r in every if r[1].endswith("part-0.parquet")} == set(range(60))


def test_a_lost_reader_goes_on_and_batches_do_not_change_the_order(spark, plan, tmp_path):
    one = E.epochs(spark, plan, 2, 3)
    end = taken(spark, one, str(tmp_path / "one"))
    assert (end["epoch"], end["shard"], end["row"]) == (2, 0, 0)
    for fail_at in (3,):
        folder = str(tmp_path / f"cut{fail_at}")
        with pytest.raises(StreamingQueryException):
            taken(spark, E.epochs(spark, plan, 2, 3, batch_rows=97), folder, fail_at)
        assert taken(spark, E.epochs(spark, plan, 2, 3, batch_rows=97), folder) == end
        assert sorted(seen(spark, folder)) == sorted(seen(spark, str(tmp_path / "one")))
        sizes = [r["count"] for r in spark.read.parquet(f"{folder}/out").groupBy("batch").count().orderBy("batch").collect()]
        assert sizes == [97] * (600 // 97) + [600 % 97]
        again = taken(spark, E.epochs(spark, plan, 2, 3, batch_rows=97), folder)  # nothing is left
        assert again in (None, end) and len(seen(spark, folder)) == 600


def test_a_place_is_enough_to_go_on_elsewhere(spark, plan, tmp_path):
    got = []
    with pytest.raises(StreamingQueryException):

        def use(batch, number):
            if number == 2:
                raise RuntimeError("lost")
            got.extend(r.sample_id for r in batch.collect())

        E.consume(E.epochs(spark, plan, 1, 5, batch_rows=80), use, str(tmp_path / "a"))
    log = (tmp_path / "a" / "offsets" / "1").read_text().splitlines()
    place = json.loads(log[-1])
    taken(spark, E.epochs(spark, plan, 1, 5, batch_rows=33, start=place), str(tmp_path / "b"))
    rest = [r[3] for r in seen(spark, tmp_path / "b")]
    assert len(got) == 160 and sorted(got + rest) == [f"s{k:03d}" for k in range(300)]


def test_what_does_not_fit_is_refused(spark, plan, tmp_path):
    taken(spark, E.epochs(spark, plan, 1, 1, batch_rows=200), str(tmp_path / "x"))
    with pytest.raises(StreamingQueryException, match="another seed"):
        taken(spark, E.epochs(spark, plan, 2, 2, batch_rows=200), str(tmp_path / "x"))
    with pytest.raises(Exception, match="rank 2"):
        taken(spark, E.epochs(spark, plan, rank=2, world=2), str(tmp_path / "y"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        E.prepare(spark, plan, plan)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.parquet").write_bytes(b"no table")
    with pytest.raises(ValueError, match="unreadable"):
        E.prepare(spark, str(tmp_path / "bad"), str(tmp_path / "plan_bad"))


def test_odd_streams(spark, plan, tmp_path):
    """More ranks than shards, no epochs, chosen columns, plain order, clashing names."""
    rows = []
    for rank in range(7):
        taken(spark, E.epochs(spark, plan, 1, 1, rank, 7, columns=["sample_id"]), str(tmp_path / f"r{rank}"))
        if (tmp_path / f"r{rank}" / "out").exists():
            rows += seen(spark, tmp_path / f"r{rank}")
    assert sorted(r[3] for r in rows) == [f"s{k:03d}" for k in range(300)]
    assert taken(spark, E.epochs(spark, plan, 0), str(tmp_path / "none"))["epoch"] == 0 and seen(spark, tmp_path / "none") == []
    taken(spark, E.epochs(spark, plan, shuffled=False, columns=["sample_id"]), str(tmp_path / "plain"))
    assert [r[3] for r in sorted(seen(spark, tmp_path / "plain"))] == [f"s{k:03d}" for k in range(300)]
    spark.range(3).withColumnRenamed("id", "epoch").write.parquet(str(tmp_path / "clash"))
    E.prepare(spark, str(tmp_path / "clash"), str(tmp_path / "plan_clash"))
    with pytest.raises(Exception, match="clash"):
        E.epochs(spark, str(tmp_path / "plan_clash"))


def test_a_snapshot_stays_what_it_was(spark, tmp_path):
    log = Log(spark, str(tmp_path / "d"))
    first = log.append(spark.range(10).select(F.col("id").cast("string").alias("sample_id")))
    log.append(spark.range(10, 20).select(F.col("id").cast("string").alias("sample_id")))
    assert E.prepare(spark, str(tmp_path / "d"), str(tmp_path / "p1"), snapshot=first.version) == 10
    assert E.prepare(spark, str(tmp_path / "d"), str(tmp_path / "p2"), snapshot=2) == 20
    taken(spark, E.epochs(spark, str(tmp_path / "p1")), str(tmp_path / "o"))
    assert sorted(int(r[3]) for r in seen(spark, tmp_path / "o")) == list(range(10))
    with pytest.raises(ValueError, match="empty"):
        E.prepare(spark, str(tmp_path / "d"), str(tmp_path / "p0"), snapshot=0)
