"""Queries on sidecars, validation, failures, labels and event time."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from wavemill import schema
from wavemill.operators import audit, sidecars
from wavemill.streaming import arrivals, epochs, ingest

from . import carriers as K
from .registry import query


@query(
    """SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, 'task' AS origin, event_type AS task
FROM (SELECT * FROM events)"""
)
def sidecar_metadata_merge(spark, sf_dir):
    """The recording's JSON (props and task) over what the task's JSON states."""
    rows = K.table(spark, sf_dir, "events")
    inherited = F.lit('{"origin": "task", "task": "unknown", "k": "none"}')
    own = F.concat(F.expr("coalesce(regexp_replace(props, '}\\\\s*$', ''), '{\"x\": 0')"), F.lit(', "task": "'), F.col("event_type"), F.lit('"}'))
    merged = sidecars.merge_metadata(inherited, own)
    return rows.select("event_id", merged.alias("m")).select("event_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("k", "origin", "task")])


_FILES_SQL = """rec AS (SELECT doc_id, concat('/d/r', doc_id, '_eeg.edf') AS path FROM documents),
files AS (SELECT CASE doc_id % 4 WHEN 0 THEN concat('/d/r', doc_id, '_events.tsv') WHEN 1 THEN concat('/e/r', doc_id, '_events.tsv') WHEN 2 THEN concat('/e/events/r', doc_id, '_events.tsv') END AS path FROM documents
  UNION ALL SELECT concat('/e/events/r', doc_id, '_events.tsv') FROM documents WHERE doc_id % 4 < 2)"""


@query(
    f"""WITH {_FILES_SQL}, t AS (SELECT doc_id, r, concat((['/d', '/e', '/e/events'])[r], '/r', doc_id, '_events.tsv') AS tried FROM rec, range(1, 4) x(r))
SELECT rec.path, min_by(f.path, r) AS event_path FROM rec JOIN t USING (doc_id) LEFT JOIN files f ON f.path = tried GROUP BY rec.path"""
)
def event_file_fallback(spark, sf_dir):
    docs = K.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("d"))
    recordings = docs.select(F.concat(F.lit("/d/r"), "d", F.lit("_eeg.edf")).alias("path"), F.lit("/e").alias("events_root"))
    name = F.concat(F.lit("/r"), "d", F.lit("_events.tsv"))
    place = F.element_at(F.array(F.lit("/d"), F.lit("/e"), F.lit("/e/events"), F.lit(None).cast("string")), (F.col("doc_id") % 4 + 1).cast("int"))
    files = docs.select(F.concat(place, name).alias("path")).unionByName(docs.filter("doc_id % 4 < 2").select(F.concat(F.lit("/e/events"), name).alias("path")))
    return sidecars.event_file(recordings, files).select("path", "event_path")


@query(
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE value END AS onset, greatest(0, coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value - 250 END, 0)) AS duration,
  CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 4 = 0 THEN 'event' ELSE (event_id % 2 + 1)::VARCHAR END AS event_type,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id % 2 + 1)::VARCHAR END AS value FROM events"""
)
def event_normalize(spark, sf_dir):
    k = F.col("event_id")
    rows = K.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(k % 7 != 0, F.col("value")).alias("onset"),
        F.when(k % 5 != 0, F.col("value") - 250).alias("duration"),
        F.when(k % 3 == 0, F.col("event_type")).alias("trial_type"),
        F.when(k % 4 == 0, "n/a").otherwise((k % 2 + 1).cast("string")).alias("value"),
    )
    return sidecars.normalize_events(rows).select("event_id", "onset", "duration", "event_type", "value")


_KINDS = ("EEG", "EOG", "TRIG", "eeg", "MISC", "other")


@query(
    f"""WITH s AS (SELECT user_id, event_type AS channel, count(*) AS n FROM events GROUP BY ALL),
k AS (SELECT *, ({list(_KINDS)})[(n % 7 + 1)::INT] AS type, CASE WHEN n % 5 = 0 THEN 'bad' ELSE 'good' END AS status FROM s)
SELECT user_id::VARCHAR AS recording_id, channel, CASE upper(type) WHEN 'EOG' THEN 'eog' WHEN 'TRIG' THEN 'stim' WHEN 'MISC' THEN 'misc' ELSE 'eeg' END AS kind,
  (type IS NULL OR upper(type) IN ('EEG', 'OTHER')) AND (n % 5 <> 0) AS picked FROM k"""
)
def channel_type_pick(spark, sf_dir):
    rows = K.table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("recording_id"), F.col("event_type").alias("channel")).agg(F.count("*").alias("n"))
    kind = F.try_element_at(F.array(*[F.lit(x) for x in _KINDS]), (F.col("n") % 7 + 1).cast("int"))
    stated = rows.select("recording_id", F.col("channel").alias("name"), kind.alias("type"), F.when(F.col("n") % 5 == 0, "bad").otherwise("good").alias("status"))
    return sidecars.channel_kinds(rows.drop("n"), stated).select("recording_id", "channel", "kind", "picked")


@query(
    """WITH t AS (SELECT l_suppkey AS file, l_linenumber % 2 + CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END AS label FROM lineitem),
b AS (SELECT file, min(label) AS low, max(label) AS high FROM t GROUP BY file)
SELECT file, (CASE WHEN low = 1 AND high = 2 THEN label - 1 ELSE label END)::INT AS label, count(*) AS n FROM t JOIN b USING (file) GROUP BY ALL"""
)
def label_normalize_file(spark, sf_dir):
    label = F.col("l_linenumber") % 2 + F.when(F.col("l_suppkey") % 2 == 0, 1).otherwise(0)
    rows = K.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file"), label.cast("int").alias("label"))
    return sidecars.normalize_labels_by_file(rows, "file").groupBy("file", "label").agg(F.count("*").alias("n"))


@query("SELECT l_linenumber AS raw, (CASE WHEN l_linenumber IN (1, 2) THEN l_linenumber - 1 ELSE l_linenumber END)::INT AS label, count(*) AS n FROM lineitem GROUP BY ALL")
def label_normalize_event(spark, sf_dir):
    rows = K.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("raw"))
    return rows.withColumn("label", sidecars.normalize_label_by_event(F.col("raw"))).groupBy("raw", "label").agg(F.count("*").alias("n"))


def _damaged(spark, sf_dir):
    """Windows of which some are broken in one way or another."""
    k = F.get_json_object("metadata_json", "$.vec_id").cast("long")
    rows = K.windows(spark, sf_dir).withColumn("k", k)
    return (
        rows.withColumn("signal", F.when(k % 11 == 0, F.transform("signal", lambda c: F.transform(c, lambda v: F.lit(float("nan")).cast("float")))).otherwise(F.col("signal")))
        .withColumn("channel_mask", F.when(k % 13 == 0, F.array(F.lit(True))).otherwise(F.col("channel_mask")))
        .withColumn("split", F.when(k % 17 == 0, "dev").otherwise(F.col("split")))
        .withColumn("sample_id", F.when(k % 19 == 0, "").otherwise(F.col("sample_id")))
        .withColumn("sampling_rate_hz", F.when(k % 23 == 0, F.lit(0.0).cast("float")).otherwise(F.col("sampling_rate_hz")))
    )


_ERRORS_SQL = """e AS (SELECT vec_id, CASE WHEN vec_id % 13 = 0 THEN 'channel mask does not match the signal' WHEN vec_id % 23 = 0 THEN 'sampling rate is not positive' WHEN vec_id % 11 = 0 THEN 'signal is not finite'
  WHEN vec_id % 17 = 0 THEN 'split is unknown' WHEN vec_id % 19 = 0 THEN 'sample id is empty' END AS error, vec_id % 25 + 1 AS subject FROM embeddings)"""


@query(f"WITH {_ERRORS_SQL} SELECT vec_id, error FROM e")
def validate_windows(spark, sf_dir):
    return schema.validate(_damaged(spark, sf_dir)).select(F.col("k").alias("vec_id"), "error")


@query(f"WITH {_ERRORS_SQL} SELECT error AS error_type, count(*) AS n, min(vec_id) AS first FROM e WHERE error IS NOT NULL GROUP BY 1")
def dead_letter_failures(spark, sf_dir):
    rows = schema.validate(_damaged(spark, sf_dir)).filter("error is not null")
    return rows.groupBy(F.col("error").alias("error_type")).agg(F.count("*").alias("n"), F.min("k").alias("first"))


@query(f"WITH {_ERRORS_SQL} SELECT printf('sub-%02d', subject) AS subject_id, count(*) AS discovered, count(*) FILTER (error IS NULL) AS processed, count(*) FILTER (error IS NOT NULL) AS skipped, count(*) FILTER (vec_id % 2 = 0) AS resumed FROM e GROUP BY 1")
def source_audit(spark, sf_dir):
    rows = schema.validate(_damaged(spark, sf_dir)).withColumn("resumed", F.col("k") % 2 == 0)
    return audit.source_audit(rows, ["subject_id"])


@query(
    """WITH w AS (SELECT event_type, value, unnest([date_trunc('hour', ts) - CASE WHEN minute(ts) >= 30 THEN INTERVAL 0 MINUTE ELSE INTERVAL 30 MINUTE END, date_trunc('hour', ts) + CASE WHEN minute(ts) >= 30 THEN INTERVAL 30 MINUTE ELSE INTERVAL 0 MINUTE END]) AS "start" FROM events)
SELECT epoch("start")::BIGINT AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM w GROUP BY ALL"""
)
def event_time_windows(spark, sf_dir):
    rows = ingest.windowed_counts(K.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "30 minutes")
    return rows.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


@query(
    """WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 6 HOUR, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, floor(epoch(max(ts)))::BIGINT + 21600 AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_windows(spark, sf_dir):
    rows = ingest.sessions(K.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", "user_id")
    return rows.select("user_id", F.unix_timestamp("start").alias("start"), F.unix_timestamp("end").alias("end"), "n")


@query()
def stream_ingest_available_now(spark, sf_dir):
    """A stream over the trials as recordings, run until all are ingested.

    Streams are not for SQL: the rows are checked in tests.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    folder = f"{(shared or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/ingest-{os.urandom(8).hex()}"
    rows = K.windows(spark, sf_dir).select(F.col("sample_id").alias("recording_id"), *[f.name for f in schema.RECORDING if f.name != "recording_id"])
    rows.write.parquet(f"{folder}/inbox")
    ingest.ingest(spark, f"{folder}/inbox", f"{folder}/out", f"{folder}/checkpoint", 2.0, 1.0).awaitTermination()
    found = spark.read.parquet(f"{folder}/out/windows")
    return found.groupBy("subject_id").agg(F.count("*").alias("windows"), F.max("num_samples").alias("num_samples"))


@query("SELECT user_id, count(*) AS seen, 0::BIGINT AS repeated, max(event_id) AS highest, max(value) AS top FROM events GROUP BY 1")
def stream_running_progress(spark, sf_dir):
    """A stateful stream over the events of the users, in order of file."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{shared.rstrip('/')}/progress-{os.urandom(8).hex()}"
    events = K.table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    source = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")

    def append(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    progress = ingest.running_progress(source, "user_id", "event_id", "value")
    progress.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{folder}/out")
    return found.groupBy("user_id").agg(F.max("seen").alias("seen"), F.max("repeated").alias("repeated"), F.max("highest").alias("highest"), F.max("top").alias("top"))


@query(f"WITH {K.TRIALS_SQL} SELECT epoch, sample_id, 1::BIGINT AS n FROM trials, (SELECT unnest(range(0, 2)) AS epoch)")
def stream_epochs_by_rank(spark, sf_dir):
    """Two epochs of the trials as two ranks read them: every trial once in each."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{shared.rstrip('/')}/epochs-{os.urandom(8).hex()}"
    K.windows(spark, sf_dir).repartition("subject_id").write.parquet(f"{folder}/windows")
    rows = epochs.prepare(spark, f"{folder}/windows", f"{folder}/plan")
    for rank in range(2):

        def append(batch, number, rank=rank):
            batch.write.mode("overwrite").parquet(f"{folder}/out/rank={rank}/batch={number}")

        stream = epochs.epochs(spark, f"{folder}/plan", count=2, seed=11, rank=rank, world=2, batch_rows=max(1, rows // 2), columns=["sample_id"])
        epochs.consume(stream, append, f"{folder}/checkpoint-{rank}")
    return spark.read.parquet(f"{folder}/out").groupBy("epoch", "sample_id").agg(F.count("*").alias("n"))


@query(
    """WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 6 HOUR, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
r AS (SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS "end", count(*) AS n FROM s GROUP BY user_id, k)
SELECT * FROM r WHERE "end" + 21600000000 <= (SELECT (max(epoch_ms(ts)) - 86400000) * 1000 FROM events)"""
)
def stream_closed_sessions(spark, sf_dir):
    """A stream of the users' events: sessions of 6 hours that timers close, a day behind the newest event."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{shared.rstrip('/')}/sessions-{os.urandom(8).hex()}"
    events = K.table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    own = arrivals.session_for_state(spark, most=events.count())
    source = own.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    found = arrivals.closed_sessions(source, ["user_id"], ["event_id"], "ts", 21_600.0, "1 day")
    found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(found.schema).parquet(f"{folder}/out")
    return rows.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")
