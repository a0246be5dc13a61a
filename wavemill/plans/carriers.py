"""The driver tables as recordings, windows, manifests and scores.

``embeddings`` are labelled trials of 4 channels of 16 samples at 4 Hz,
``events`` of one user are the samples of a recording, ``documents`` are files
with sizes, ``lineitem`` and ``orders`` are a large manifest, and ``labels``
with the lengths of ``documents`` are targets with tied scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill import schema
from wavemill.functions import names, signals

CHANNELS = ("C3", "C4", "Cz", "Pz")

#: The same trials in SQL.
TRIALS_SQL = """
trials AS (
  SELECT vec_id, (vec_id % 25 + 1)::INT AS subject, (vec_id // 25)::INT AS session,
    printf('emb:sub-%03d:ses-%02d:trial-%04d', vec_id % 25 + 1, vec_id // 25, vec_id) AS sample_id,
    (label % 2)::INT AS label,
    CASE WHEN vec_id % 25 < 15 THEN 'train' WHEN vec_id % 25 < 20 THEN 'val' ELSE 'test' END AS split,
    label AS category, embedding
  FROM embeddings
)"""

#: Samples of the trials, one a row.
SAMPLES_SQL = (
    TRIALS_SQL
    + """, samples AS (
  SELECT vec_id, split, label, (k - 1) // 16 AS channel, (k - 1) % 16 AS sample, embedding[k]::DOUBLE AS value
  FROM (SELECT *, unnest(range(1, 65)) AS k FROM trials)
)"""
)

#: Values of each user's events in order, with their place.
INDEXED_SQL = """
indexed AS (
  SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
    count(*) OVER (PARTITION BY user_id) AS length
  FROM events
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled trials with their ids, splits and signals."""
    rows = table(spark, sf_dir, "embeddings")
    subject, session = (F.col("vec_id") % 25 + 1).cast("int"), F.expr("cast(vec_id div 25 as int)")
    return rows.select(
        "vec_id",
        subject.alias("subject"),
        session.alias("session"),
        names.trial_sample_id("emb", subject, session, F.col("vec_id")).alias("sample_id"),
        (F.col("label") % 2).cast("int").alias("label"),
        names.subject_split(subject).alias("split"),
        F.col("label").alias("category"),
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.slice("embedding", c * 16 + 1, 16)).alias("signal"),
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trials as canonical windows; 64 rows to a batch, 4 batches a shard."""
    rows = trials(spark, sf_dir)
    place = F.col("vec_id")
    out = rows.select(
        "sample_id",
        F.lit("emb").alias("dataset_id"),
        F.format_string("sub-%02d", "subject").alias("subject_id"),
        F.format_string("ses-%02d", "session").alias("session_id"),
        F.lit("motorimagery").alias("task"),
        "split",
        F.format_string("shards/shard-%06d.arrow", F.expr("vec_id div 256")).alias("shard_path"),
        F.expr("cast(vec_id div 64 % 4 as int)").alias("record_batch"),
        (place % 64).cast("int").alias("row_in_batch"),
        F.lit(4.0).cast("float").alias("sampling_rate_hz"),
        F.size("signal").alias("num_channels"),
        F.size(F.col("signal")[0]).alias("num_samples"),
        F.array(*[F.lit(c) for c in CHANNELS]).alias("channel_names"),
        F.array_repeat(F.lit(True), 4).alias("channel_mask"),
        "label",
        (F.col("session") * 4.0).alias("start_seconds"),
        F.lit(4.0).alias("duration_seconds"),
        F.lit("embeddings").alias("source_uri"),
        F.lit("parquet").alias("source_format"),
        F.lit(schema.PREPROCESSING_VERSION).alias("preprocessing_version"),
        F.lit(100.0).cast("float").alias("amplitude_scale"),
        signals.quality_flags(F.col("signal")).alias("quality_flags"),
        F.to_json(F.struct("vec_id")).alias("metadata_json"),
        "signal",
    )
    return out.select(*[F.col(f.name).cast(f.dataType) for f in schema.WINDOW])


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each trial, channel and sample."""
    rows = trials(spark, sf_dir).select("vec_id", "split", "label", F.posexplode("signal").alias("channel", "_v"))
    return rows.select("vec_id", "split", "label", "channel", F.posexplode("_v").alias("sample", "_x")).select("vec_id", "split", "label", "channel", "sample", F.col("_x").cast("double").alias("value"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with tied scores in [0, 1]."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    return rows.select("doc_id", F.col("quality").alias("target"), "source", F.least(F.lit(1.0), F.floor(F.col("n_chars") / 500) / 10.0).alias("score"))


SCORES_SQL = """
scores AS (
  SELECT doc_id, quality AS target, source, least(1.0::DOUBLE, floor(n_chars / 500) / 10.0::DOUBLE) AS score
  FROM labels JOIN documents USING (doc_id)
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs: seed, model, metric and value."""
    rows = table(spark, sf_dir, "orders")
    metric = F.element_at(F.array(*[F.lit(m) for m in ("balanced_accuracy", "auprc", "auroc")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return rows.select(
        (F.expr("o_orderkey div 6") % 50).alias("seed"),
        F.when(F.expr("o_orderkey div 3 % 2") == 0, "a").otherwise("b").alias("model"),
        metric.alias("metric"),
        (F.col("o_totalprice") / 1000000).alias("value"),
        F.col("o_orderkey"),
    )


RUNS_SQL = """
runs AS (
  SELECT (o_orderkey // 6) % 50 AS seed, CASE WHEN (o_orderkey // 3) % 2 = 0 THEN 'a' ELSE 'b' END AS model,
    (['balanced_accuracy', 'auprc', 'auroc'])[o_orderkey % 3 + 1] AS metric, o_totalprice / 1000000 AS value, o_orderkey
  FROM orders
)"""
