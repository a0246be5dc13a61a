"""Orders and moments over groups of any size, against NumPy and the built-ins."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wavemill.operators import ordered, ranking, spectral


@pytest.mark.parametrize("bound", [100_000, 0])
def test_running_sums_are_those_of_a_window(spark, bound, monkeypatch):
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", bound)
    rng = np.random.default_rng(1)
    rows = [(["hot", "b", None][int(min(2, rng.exponential(0.4)))], int(rng.integers(50)), k, int(rng.integers(9))) for k in range(3000)]
    frame = spark.createDataFrame(rows, "g string, x int, id int, w int").repartition(5)
    got = ordered.running_sums(frame, ["g"], [F.col("x").desc(), F.col("id")], {"upto": F.col("w"), "place": F.lit(1)}, {"upto": "all"})
    order = Window.partitionBy("g").orderBy(F.col("x").desc(), "id")
    want = frame.select("*", F.sum("w").over(order).alias("upto"), F.row_number().over(order).alias("place"), F.sum("w").over(Window.partitionBy("g")).alias("all"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert ordered.ordinals(frame.limit(0), ["g"], ["x"], "k").count() == 0
    assert sorted(r.k for r in ordered.ordinals(frame, [], ["id"], "k").collect()) == list(range(1, 3001))


def test_no_part_takes_most_of_a_skewed_order(spark):
    """200,000 scores near 0 and one at 1: equal bins would put all into one."""
    scores = spark.range(200_000).select((1 / (1 + F.exp(20 + F.rand(3)))).alias("score"), (F.col("id") % 2).alias("target")).union(spark.createDataFrame([(1.0, 1)], "score double, target long"))
    points = scores.groupBy("score").agg(F.count("*").alias("n"))
    sizes = [r["count"] for r in points.repartitionByRange(8, F.col("score").desc()).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / len(sizes)
    curve = ranking.curve(scores, "score", "target")
    assert "RangePartitioning" not in curve._jdf.queryExecution().optimizedPlan().toString()  # dealt once, and kept
    assert curve.agg(F.max("tp"), F.max("fp")).first() == (100_001, 100_000)


@pytest.mark.parametrize("few", [10_000, 40])
def test_quantiles_are_exact(spark, few, monkeypatch):
    monkeypatch.setattr(ordered, "FEW", few)
    rng = np.random.default_rng(2)
    groups = {
        "normal": rng.normal(size=3000),
        "skew": np.exp(rng.normal(size=2500) * 20),
        "ties": rng.integers(0, 3, 2000).astype(float),
        "one": np.array([7.5]),
        "signs": np.concatenate([[-0.0, 0.0, 1e308, -1e308, float("inf"), float("-inf")], rng.normal(size=500)]),
        "nan": np.concatenate([rng.normal(size=300), [float("nan")] * 20]),
        "all nan": np.array([float("nan")] * 3),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("normal", None), (None, 1.0), (None, 2.0)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(6)
    shares = (0.0, 0.001, 0.25, 0.5, 0.999, 1.0)
    got = {(r.g, r.share): r["quantile"] for r in ordered.quantiles(frame, "v", ["g"], shares).collect()}
    want = frame.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(s) for s in shares])).alias("p")).collect()
    assert len(got) == len(shares) * len(want)
    for r in want:
        for share, p in zip(shares, r.p, strict=True):
            x = got[r.g, share]
            assert (math.isnan(x) and math.isnan(p)) or x == p or math.isclose(x, p, rel_tol=1e-12), (r.g, share, x, p)
    whole = {r.share: r["quantile"] for r in ordered.quantiles(frame.filter("g = 'normal'"), "v", [], (0.5,)).collect()}
    assert whole[0.5] == pytest.approx(float(np.median(groups["normal"])))
    assert ordered.quantiles(frame.limit(0), "v", ["g"], shares).count() == 0


def test_correlations_keep_at_a_large_offset(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3, 4000))
    x[1] = x[0] + 0.25 * x[1]
    x += np.array([[1e9], [1e9], [-3e8]])
    rows = [(k, c, float(x[c, k])) for k in range(4000) for c in range(3)]
    frame = spark.createDataFrame(rows, "k int, c int, v double").repartition(7)
    got = {(r.channel_a, r.channel_b): r.correlation for r in spectral.channel_correlation(frame, ["k"], "c", "v").collect()}
    want = np.corrcoef(x)
    assert all(got[a, b] == pytest.approx(want[a, b], abs=1e-9) for a in range(3) for b in range(a, 3)) and got[0, 0] == pytest.approx(1, abs=1e-12)
    wide = frame.groupBy("k").pivot("c", [0, 1]).agg(F.first("v"))
    assert got[0, 1] == pytest.approx(wide.agg(F.corr("0", "1")).first()[0], abs=1e-5)  # the built-in loses digits here
