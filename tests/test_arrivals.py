"""Sessions that close: repeats, rows out of order, restarts, odd rows."""

import datetime
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavemill.streaming import arrivals as A

ROWS = "rec string, id long, ts timestamp, expected int"
T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


class Stream:
    """A folder of files, and runs over what is there, each a new query."""

    def __init__(self, spark, folder, gap=10, late="5 seconds", expected="expected"):
        self.spark, self.own, self.folder = spark, A.session_for_state(spark), str(folder)
        self.args = (gap, late, expected)
        self.files = 0

    def put(self, rows):
        made = self.spark.createDataFrame([(r, i, None if t is None else at(t), e) for r, i, t, e in rows], ROWS)
        made.coalesce(1).write.parquet(f"{self.folder}/in/{self.files:03d}")
        self.files += 1

    def run(self):
        """The rows that this run closed."""
        before = self.closed()
        source = self.own.readStream.schema(ROWS).option("recursiveFileLookup", "true").parquet(f"{self.folder}/in")
        found = A.closed_sessions(source, ["rec"], ["id"], "ts", *self.args)
        query = found.writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/ck").trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        return sorted(set(self.closed()) - set(before), key=str)

    def closed(self):
        try:
            out = self.spark.read.parquet(f"{self.folder}/out")
        except Exception:  # nothing was written yet
            return []
        return [(r.rec, r.s, r.e, r.n, r.complete) for r in out.select("rec", (F.unix_millis("start") / 1000 - T0.timestamp()).alias("s"), (F.unix_millis("end") / 1000 - T0.timestamp()).alias("e"), "n", "complete").collect()]


def test_sessions_close_by_timer_over_restarts_and_repeats_count_once(spark, tmp_path):
    s = Stream(spark, tmp_path)
    s.put([("a", 1, 0, None), ("a", 2, 4, None), ("b", 1, 1, None)])
    assert s.run() == []  # the watermark is at -1
    s.put([("a", 2, 4, None), ("a", 3, 3, None), ("b", 1, 1, None), ("b", 2, 12, None)])  # a file again, in part, and rows between
    assert s.run() == []  # at 7: a's session could go on until 14, b's two are 11 apart but open until 11 and 22
    s.put([("c", 1, 20, None)])
    assert s.run() == [("a", 0, 4, 3, None), ("b", 1, 1, 1, None)]  # at 15
    s.put([("a", 9, 2, None), ("b", 2, 12, None), ("c", 2, 40, None)])  # far too late, late and again, new
    assert s.run() == [("b", 12, 12, 1, None), ("c", 20, 20, 1, None)]
    assert s.run() == []  # nothing new


def test_what_is_complete_leaves_at_once(spark, tmp_path):
    s = Stream(spark, tmp_path)
    s.put([("a", 1, 0, 3), ("a", 2, 1, 3), ("b", 1, 0, 4), (None, 1, 0, None), (None, None, 1, None), ("x", 5, None, 1)])
    assert s.run() == []
    s.put([("a", 2, 1, 3), ("a", 3, 2, None)])
    assert s.run() == [("a", 0, 2, 3, True)]
    s.put([("a", 3, 2, 3), ("z", 1, 60, None)])  # the last row again changes nothing
    assert s.run() == [("b", 0, 0, 1, False), (None, 0, 1, 2, None)]


def test_rows_in_any_order_give_the_sessions_of_a_batch(spark, tmp_path):
    draw = random.Random(5)
    rows = [(draw.choice("ab"), k, draw.randrange(0, 400), None) for k in range(60)]
    s = Stream(spark, tmp_path, late="1000 seconds")  # nothing is late
    for k in range(2):
        part = rows[30 * k : 30 * k + 30] + draw.sample(rows[: 30 * k + 30], 10)
        s.put(draw.sample(part, len(part)))
        assert s.run() == []
    s.put([("end", 1, 5000, None)])
    expect = []
    for rec in "ab":
        mine = sorted(t for r, _, t, _ in rows if r == rec)
        run = [mine[0]]
        for t in mine[1:]:
            if t - run[-1] < 10:
                run.append(t)
            else:
                expect.append((rec, run[0], run[-1], len(run), None))
                run = [t]
        expect.append((rec, run[0], run[-1], len(run), None))
    assert s.run() == sorted(expect, key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=30), st.integers(1, 9), st.integers(1, 6))
def test_pieces_merge_as_if_they_came_at_once(times, gap, size):
    import numpy as np

    whole = A.pieces(np.sort(np.array(times)), gap)
    runs = []
    for k in range(0, len(times), size):
        runs = A.merged(runs + A.pieces(np.sort(np.array(times[k : k + size])), gap), gap)
    assert runs == whole and sum(r[2] for r in runs) == len(times)


def test_what_cannot_be_is_refused(spark):
    rows = spark.createDataFrame([], ROWS)
    with pytest.raises(ValueError, match="session_for_state"):
        A.closed_sessions(rows, ["rec"], ["id"], "ts", 1, "1 second")
    with pytest.raises(ValueError, match="positive"):
        A.closed_sessions(rows, ["rec"], ["id"], "ts", 0, "1 second")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    sized = [A.session_for_state(spark, n).conf.get("spark.sql.shuffle.partitions") for n in (None, 0, 5_000_001)]
    assert sized == [sized[0], "8", "51"] and spark.conf.get("spark.sql.shuffle.partitions") == before
    own = A.session_for_state(spark).createDataFrame([], ROWS).withColumnRenamed("rec", "n")
    with pytest.raises(ValueError, match="clash"):
        A.closed_sessions(own, ["n"], ["id"], "ts", 1, "1 second")
