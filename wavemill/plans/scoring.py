"""Queries on ranking metrics, runs, schedules and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavemill.operators import experiments, ranking

from . import carriers as K
from .registry import query

_CONFUSION_SQL = """c AS (SELECT source, count(*) FILTER (score < 0.5 AND target = 0) AS tn, count(*) FILTER (score >= 0.5 AND target = 0) AS fp,
  count(*) FILTER (score < 0.5 AND target = 1) AS fn, count(*) FILTER (score >= 0.5 AND target = 1) AS tp FROM scores GROUP BY source)"""

_CURVE_SQL = f"""{K.SCORES_SQL}, g AS (SELECT score, count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS n FROM scores GROUP BY score),
r AS (SELECT score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM g WINDOW w AS (ORDER BY score DESC)),
curve AS (SELECT *, tp / (tp + fp)::DOUBLE AS pr, tp / pos::DOUBLE AS re, lag(tp / (tp + fp)::DOUBLE, 1, 1.0) OVER w AS pr0, lag(tp / pos::DOUBLE, 1, 0.0) OVER w AS re0 FROM r WINDOW w AS (ORDER BY score DESC))"""


@query(f"WITH {K.SCORES_SQL}, {_CONFUSION_SQL} SELECT * FROM c")
def confusion_matrix(spark, sf_dir):
    return ranking.confusion(K.scores(spark, sf_dir), "score", "target", ["source"])


@query(f"WITH {K.SCORES_SQL}, {_CONFUSION_SQL} SELECT source, round((tp / nullif(tp + fn, 0)::DOUBLE + tn / nullif(tn + fp, 0)::DOUBLE) / 2, 9) AS balanced_accuracy FROM c")
def balanced_accuracy(spark, sf_dir):
    counts = ranking.confusion(K.scores(spark, sf_dir), "score", "target", ["source"])
    return counts.select("source", F.round(ranking.balanced_accuracy(), 9).alias("balanced_accuracy"))


@query(f"WITH {_CURVE_SQL} SELECT score, tp::BIGINT AS tp, fp::BIGINT AS fp, round(pr, 9) AS precision, round(re, 9) AS recall FROM curve")
def pr_curve(spark, sf_dir):
    rows = ranking.curve(K.scores(spark, sf_dir), "score", "target")
    return rows.select("score", "tp", "fp", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def _rank(spark, sf_dir, name):
    return ranking.ranking_metrics(K.scores(spark, sf_dir), "score", "target").select(F.round(name, 9).alias(name), "num_examples")


@query(f"WITH {_CURVE_SQL} SELECT round(sum(n * (tp - p / 2.0::DOUBLE)) / (max(pos) * max(neg)), 9) AS auroc, (max(pos) + max(neg))::BIGINT AS num_examples FROM curve")
def auroc(spark, sf_dir):
    return _rank(spark, sf_dir, "auroc")


@query(f"WITH {_CURVE_SQL} SELECT round(sum((re - re0) * (pr + pr0) / 2), 9) AS auprc, (max(pos) + max(neg))::BIGINT AS num_examples FROM curve")
def auprc_trapezoid(spark, sf_dir):
    return _rank(spark, sf_dir, "auprc")


@query(f"WITH {_CURVE_SQL} SELECT round(sum((re - re0) * pr), 9) AS average_precision, (max(pos) + max(neg))::BIGINT AS num_examples FROM curve")
def average_precision(spark, sf_dir):
    return _rank(spark, sf_dir, "average_precision")


@query(
    """SELECT event_id, round(1 / (1 + exp(-greatest(-80, least(80, (value - 250) / 2)))), 9) AS probability,
  1 / (1 + exp(-greatest(-80, least(80, (value - 250) / 2)))) >= 0.5 AS positive FROM events"""
)
def sigmoid_threshold(spark, sf_dir):
    p = ranking.sigmoid((F.col("value") - 250) / 2)
    return K.table(spark, sf_dir, "events").select("event_id", F.round(p, 9).alias("probability"), (p >= 0.5).alias("positive"))


_SUMMARY_SQL = f"""{K.RUNS_SQL}, s AS (SELECT model, metric, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS std, min(value) AS low, max(value) AS high, count(value) AS num_runs FROM runs GROUP BY ALL)"""


@query(f"WITH {_SUMMARY_SQL} SELECT model, metric, round(mean, 6) AS mean, round(std, 6) AS std, round(low, 6) AS min, round(high, 6) AS max, num_runs FROM s")
def seed_aggregate(spark, sf_dir):
    rows = experiments.seed_summary(K.runs(spark, sf_dir), "value", ["model", "metric"])
    return rows.withColumns({c: F.round(c, 6) for c in ("mean", "std", "min", "max")})


@query(f"WITH {_SUMMARY_SQL} SELECT model, metric, round(mean - CASE metric WHEN 'balanced_accuracy' THEN 0.6370 WHEN 'auprc' THEN 0.7139 ELSE 0.6988 END, 6) AS delta FROM s")
def paper_delta(spark, sf_dir):
    rows = experiments.delta_from(experiments.seed_summary(K.runs(spark, sf_dir), "value", ["model", "metric"]))
    return rows.select("model", "metric", F.round("delta", 6).alias("delta"))


@query(f"WITH {_SUMMARY_SQL} SELECT metric, round(b.mean - a.mean, 6) + 0.0 AS difference, CASE WHEN b.mean > a.mean THEN 'b' ELSE 'a' END AS winner FROM s a JOIN s b USING (metric) WHERE a.model = 'a' AND b.model = 'b'")
def model_compare_winner(spark, sf_dir):
    rows = experiments.seed_summary(K.runs(spark, sf_dir), "value", ["model", "metric"])
    both = experiments.compare_models(rows.filter("model = 'a'"), rows.filter("model = 'b'"))
    return both.select("metric", (F.round("difference", 6) + 0.0).alias("difference"), "winner")


@query(
    f"""WITH {K.RUNS_SQL}, m AS (SELECT seed, metric, model, avg(value) AS v FROM runs GROUP BY ALL)
SELECT metric, count(*) AS pairs, round(avg(a.v - b.v), 6) + 0.0 AS mean_difference, count(*) FILTER (a.v > b.v) AS wins_a, count(*) FILTER (b.v > a.v) AS wins_b
FROM m a JOIN m b USING (seed, metric) WHERE a.model = 'a' AND b.model = 'b' GROUP BY metric"""
)
def paired_seed_wins(spark, sf_dir):
    means = K.runs(spark, sf_dir).groupBy("seed", "metric", "model").agg(F.avg("value").alias("v"))
    rows = experiments.paired_wins(means.filter("model = 'a'"), means.filter("model = 'b'"), "v", ["seed", "metric"], ["metric"])
    return rows.withColumn("mean_difference", F.round("mean_difference", 6) + 0.0)


@query(
    """WITH h AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value FROM events),
b AS (SELECT *, coalesce(value > max(value) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM h),
c AS (SELECT *, max(CASE WHEN better THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS best FROM b),
d AS (SELECT *, min(CASE WHEN epoch - best >= 5 THEN epoch END) OVER (PARTITION BY run) AS stop FROM c)
SELECT run, max(best) AS best_epoch, max(value) AS best_value, max(epoch) AS last_epoch FROM d WHERE stop IS NULL OR epoch <= stop GROUP BY run"""
)
def best_epoch_early_stop(spark, sf_dir):
    from wavemill.operators.windows import sample_index

    history = sample_index(K.table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select(F.col("user_id").alias("run"), (F.col("i") + 1).cast("long").alias("epoch"), "value")
    return experiments.early_stopping(history, "value", 5)


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / greatest(1, sum(l_quantity)), 9) AS loss FROM lineitem GROUP BY 1")
def weighted_loss(spark, sf_dir):
    rows = experiments.weighted_loss(K.table(spark, sf_dir, "lineitem"), "l_discount", "l_quantity", ["l_returnflag"])
    return rows.withColumn("loss", F.round("loss", 9))


@query(
    """SELECT step, round(0.001::DOUBLE, 9) AS none, round(0.001 * pow(0.1::DOUBLE, floor(step / 30)), 9) AS step_rate, round(0.00001 + (0.001 - 0.00001) * (1 + cos(step / 100.0::DOUBLE * pi())) / 2, 9) AS cosine
FROM range(0, 101) t(step)"""
)
def lr_schedule(spark, sf_dir):
    step = F.col("id")
    rates = {"none": experiments.learning_rate(step, 0.001, 100, "none"), "step_rate": experiments.learning_rate(step, 0.001, 100, "step", every=30), "cosine": experiments.learning_rate(step, 0.001, 100, "cosine", least=0.00001)}
    return spark.range(101).select(step.alias("step"), *[F.round(v, 9).alias(k) for k, v in rates.items()])


@query(
    """SELECT l_linenumber AS batch, round(avg(t), 9) AS mean_seconds, round(quantile_cont(t, 0.5), 9) AS median_seconds, round(quantile_cont(t, 0.95), 9) AS p95_seconds, round(l_linenumber / avg(t), 6) AS examples_per_second
FROM (SELECT l_linenumber, l_extendedprice / 1000000 AS t FROM lineitem) GROUP BY l_linenumber"""
)
def latency_percentiles(spark, sf_dir):
    times = K.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("batch"), (F.col("l_extendedprice") / 1000000).alias("t"))
    rows = experiments.latency_summary(times, "t", "batch")
    digits = {"mean_seconds": 9, "median_seconds": 9, "p95_seconds": 9, "examples_per_second": 6}
    return rows.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    f"""WITH {K.SCORES_SQL} SELECT source, round(avg(CASE WHEN score >= 0.5 THEN 1.0::DOUBLE ELSE 0 END), 9) AS predicted_positive, round(avg(CASE WHEN target = 1 THEN CASE WHEN score >= 0.5 THEN 1.0::DOUBLE ELSE 0 END END), 9) AS tpr,
  round(avg(CASE WHEN target = 0 THEN CASE WHEN score < 0.5 THEN 1.0::DOUBLE ELSE 0 END END), 9) AS tnr FROM scores GROUP BY source"""
)
def prediction_rates(spark, sf_dir):
    hit, miss = F.when(F.col("score") >= 0.5, 1.0).otherwise(0.0), F.when(F.col("score") < 0.5, 1.0).otherwise(0.0)
    return K.scores(spark, sf_dir).groupBy("source").agg(F.round(F.avg(hit), 9).alias("predicted_positive"), F.round(F.avg(F.when(F.col("target") == 1, hit)), 9).alias("tpr"), F.round(F.avg(F.when(F.col("target") == 0, miss)), 9).alias("tnr"))


@query()
def lr_train_eval(spark, sf_dir):
    """A fitted classifier: tested against chance on held-out trials."""
    from wavemill.ml import train_and_evaluate

    return train_and_evaluate(K.windows(spark, sf_dir))
