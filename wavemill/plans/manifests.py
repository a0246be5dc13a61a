"""Queries on ids, manifests, layout, planning, order and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wavemill.functions import names, signals
from wavemill.operators import audit, experiments, layout

from . import carriers as K
from .registry import query

_MANIFEST_SQL = (
    K.TRIALS_SQL
    + """, manifest AS (
  SELECT vec_id, sample_id, 'emb' AS dataset_id, printf('sub-%02d', subject) AS subject_id, subject, split, label,
    printf('shards/shard-%06d.arrow', vec_id // 256) AS shard_path, (vec_id // 64 % 4)::INT AS record_batch, (vec_id % 64)::INT AS row_in_batch,
    (SELECT CASE WHEN bool_or(s < 1e-6) THEN 1 ELSE 0 END FROM (SELECT stddev_pop(embedding[k]::DOUBLE) AS s FROM range(1, 65) t(k) GROUP BY (k - 1) // 16)) AS flat
  FROM trials
)"""
)
#: Trials as a manifest without the flags, which only some queries need.
_PLAIN_SQL = (
    K.TRIALS_SQL
    + """, manifest AS (
  SELECT vec_id, sample_id, 'emb' AS dataset_id, printf('sub-%02d', subject) AS subject_id, subject, split, label,
    printf('shards/shard-%06d.arrow', vec_id // 256) AS shard_path, (vec_id // 64 % 4)::INT AS record_batch, (vec_id % 64)::INT AS row_in_batch
  FROM trials
)"""
)


@query(f"WITH {K.TRIALS_SQL} SELECT sample_id, subject, session, split, label, 4 AS num_channels, 16 AS num_samples FROM trials")
def window_canonicalize(spark, sf_dir):
    rows = K.trials(spark, sf_dir)
    return rows.select("sample_id", "subject", "session", "split", "label", F.size("signal").alias("num_channels"), F.size(F.col("signal")[0]).alias("num_samples"))


@query("SELECT event_id, printf('events:%s:sample-%09d', CASE WHEN event_id % 2 = 0 THEN printf('rec-%d', user_id) ELSE printf('%d:none:rest', user_id) END, event_id) AS sample_id FROM events")
def sample_id_format(spark, sf_dir):
    recording = F.when(F.col("event_id") % 2 == 0, F.format_string("rec-%d", "user_id"))
    rows = K.table(spark, sf_dir, "events")
    return rows.select("event_id", names.window_sample_id(F.lit("events"), recording, F.col("user_id").cast("string"), F.lit(None).cast("string"), F.lit("rest"), F.col("event_id")).alias("sample_id"))


@query("SELECT subject, CASE WHEN subject <= 15 THEN 'train' WHEN subject <= 20 THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM (SELECT (user_id % 25 + 1)::INT AS subject FROM events) GROUP BY ALL")
def subject_split_assign(spark, sf_dir):
    rows = K.table(spark, sf_dir, "events").select((F.col("user_id") % 25 + 1).cast("int").alias("subject"))
    return rows.groupBy("subject").agg(F.count("*").alias("n")).select("subject", names.subject_split(F.col("subject")).alias("split"), "n")


_PATHS = "concat('/data/sub-', lpad(cast(user_id % 40 as {text}), 3, '0'), '/eeg/sub-', lpad(cast(user_id % 40 as {text}), 3, '0'), '_ses-', lpad(cast(event_id % 7 as {text}), 2, '0'), '_task-', event_type, '_run-', cast(event_id % 3 as {text}), '_eeg.set')"


def _paths(spark, sf_dir):
    return K.table(spark, sf_dir, "events").select("event_id", F.expr(_PATHS.format(text="string")).alias("path"))


_PATHS_SQL = f"paths AS (SELECT event_id, {_PATHS.format(text='varchar')} AS path FROM events)"


@query(
    rf"""WITH {_PATHS_SQL}, f AS (SELECT event_id, regexp_extract(path, '[^/]*$') AS name FROM paths)
SELECT event_id, regexp_extract(name, '(?:^|_)sub[-_]([^_]+)', 1) AS sub, regexp_extract(name, '(?:^|_)ses[-_]([^_]+)', 1) AS ses,
  regexp_extract(name, '(?:^|_)task[-_]([^_]+)', 1) AS task, regexp_extract(name, '(?:^|_)run[-_]([^_]+)', 1) AS run, NULL::VARCHAR AS acq FROM f"""
)
def parse_bids_entities(spark, sf_dir):
    return _paths(spark, sf_dir).select("event_id", *[names.entity(F.col("path"), k).alias(k) for k in ("sub", "ses", "task", "run", "acq")])


@query(
    rf"""WITH {_PATHS_SQL}, f AS (SELECT event_id, regexp_extract(path, '[^/]*$') AS name FROM paths)
SELECT event_id, nullif(regexp_extract(name, 'sub-0*(25|2[0-4]|1[0-9]|[1-9])(?:[^0-9]|$)', 1), '')::INT AS subject,
  regexp_extract(name, 'ses-0*([0-9]+)', 1)::INT AS session FROM f"""
)
def parse_subject_session(spark, sf_dir):
    name = names.file_name(F.col("path"))
    return _paths(spark, sf_dir).select("event_id", names.subject_number(name).alias("subject"), names.session_number(name).alias("session"))


@query(rf"WITH {_PATHS_SQL} SELECT event_id, regexp_replace(regexp_extract(path, '[^/]*$'), '_eeg\.set$', '') AS recording_id, '.set' AS suffix FROM paths")
def recording_identity(spark, sf_dir):
    return _paths(spark, sf_dir).select("event_id", names.recording_id(F.col("path")).alias("recording_id"), names.suffix(F.col("path")).alias("suffix"))


@query(
    f"""WITH {_MANIFEST_SQL}
SELECT split, count(*) AS examples, 'emb' AS datasets, count(DISTINCT subject_id) AS subjects, count(label) AS labeled, sum(flat)::BIGINT AS flagged,
  count(DISTINCT shard_path) AS shards, (count(*) * 256)::BIGINT AS signal_bytes FROM manifest GROUP BY split"""
)
def manifest_summary(spark, sf_dir):
    """The split-level summary of all windows (the flagship query)."""
    return audit.manifest_summary(K.windows(spark, sf_dir), ["split"])


@query("SELECT coalesce(nullif(split, ''), 'unspecified') AS split, count(*) AS examples FROM (SELECT CASE l_linestatus WHEN 'O' THEN 'train' WHEN 'F' THEN CASE WHEN l_returnflag = 'A' THEN '' ELSE NULL END END AS split FROM lineitem) GROUP BY 1")
def split_counts(spark, sf_dir):
    split = F.when(F.col("l_linestatus") == "O", "train").when((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A"), "")
    return audit.split_counts(K.table(spark, sf_dir, "lineitem").select(split.alias("split")))


@query("SELECT concat(l_linenumber, 'x', l_quantity::INT) AS shape, count(*) AS examples FROM lineitem GROUP BY 1")
def shape_counts(spark, sf_dir):
    return audit.shape_counts(K.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("num_channels"), F.col("l_quantity").cast("int").alias("num_samples")))


_PROTOCOL_SQL = f"""WITH {_PLAIN_SQL}, want AS (SELECT * FROM (VALUES ('train', 1, 15), ('val', 16, 20), ('test', 21, 25)) t(split, low, high)),
have AS (SELECT split, count(*) AS examples, count(*) FILTER (label = 0) AS negatives, count(*) FILTER (label = 1) AS positives, list(DISTINCT subject) AS s
  FROM manifest GROUP BY split)
SELECT split, examples, negatives, positives, 0::BIGINT AS not_binary, len(s)::INT AS subjects,
  array_to_string(list_filter(range(low, high + 1), lambda k: NOT list_contains(s, k::INT)), ',') AS missing, '' AS "foreign",
  len(list_filter(range(low, high + 1), lambda k: NOT list_contains(s, k::INT))) = 0 AND negatives > 0 AND positives > 0 AS ok
FROM want JOIN have USING (split)"""


@query(_PROTOCOL_SQL)
def protocol_audit(spark, sf_dir):
    return audit.protocol_audit(K.windows(spark, sf_dir))


@query("SELECT user_id AS subject FROM (SELECT unnest(range(0, 2000)) AS user_id) WHERE user_id NOT IN (SELECT user_id FROM events)")
def missing_subjects(spark, sf_dir):
    expected = spark.range(2000).select(F.col("id").alias("subject"))
    found = K.table(spark, sf_dir, "events").select(F.col("user_id").alias("subject")).distinct()
    return expected.join(found, "subject", "left_anti")


@query("SELECT l_suppkey, count(DISTINCT l_returnflag) AS splits, count(*) AS examples FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def split_leakage(spark, sf_dir):
    return audit.leakage(K.table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag")


@query(
    """WITH c AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT count(*) FILTER (k BETWEEN 0 AND 9999) AS covered, 10000 - count(*) FILTER (k BETWEEN 0 AND 9999) AS uncovered,
  count(*) FILTER (n > 1) AS repeated, count(*) FILTER (NOT k BETWEEN 0 AND 9999) AS outside FROM c"""
)
def split_coverage(spark, sf_dir):
    return audit.coverage(K.table(spark, sf_dir, "lineitem"), "l_partkey", 10000)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber IN (1, 2) AND l_quantity = 10")
def manifest_view_filtered(spark, sf_dir):
    rows = K.table(spark, sf_dir, "lineitem")
    return rows.filter((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F") & F.col("l_linenumber").isin(1, 2) & (F.col("l_quantity") == 10)).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT source AS split, count(*) AS examples, count(*) FILTER (quality IS NULL) AS unlabeled, count(*) FILTER (quality IS NULL) = 0 AS usable FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def view_label_check(spark, sf_dir):
    rows = K.table(spark, sf_dir, "documents").select("doc_id", "source").join(K.table(spark, sf_dir, "labels"), "doc_id", "left")
    missing = F.count_if(F.col("quality").isNull())
    return rows.groupBy(F.col("source").alias("split")).agg(F.count("*").alias("examples"), missing.alias("unlabeled"), (missing == 0).alias("usable"))


@query(f"WITH {K.SAMPLES_SQL} SELECT vec_id, channel::INT AS channel, sample::INT AS sample, round((value::FLOAT / 100::FLOAT)::DOUBLE, 7) + 0.0 AS value FROM samples")
def read_scaled_signal(spark, sf_dir):
    rows = K.trials(spark, sf_dir).select("vec_id", F.posexplode(signals.scale(F.col("signal"), F.lit(100.0).cast("float"))).alias("channel", "_v"))
    return rows.select("vec_id", "channel", F.posexplode("_v").alias("sample", "_x")).select("vec_id", "channel", "sample", (F.round(F.col("_x").cast("double"), 7) + 0.0).alias("value"))


@query(
    """SELECT user_id, event_id, (k // 16)::INT AS shard, (k // 4 % 4)::INT AS record_batch, (k % 4)::INT AS row_in_batch
FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)"""
)
def shard_layout(spark, sf_dir):
    rows = layout.shard_layout(K.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 4, 4)
    return rows.select("user_id", "event_id", "shard", "record_batch", "row_in_batch")


@query(
    """WITH l AS (SELECT user_id, ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 16)::INT AS shard FROM events)
SELECT user_id, shard, printf('shards/shard-%06d.arrow', dense_rank() OVER (ORDER BY user_id, shard) - 1) AS shard_path, count(*) AS examples FROM l GROUP BY user_id, shard"""
)
def merge_renumber_shards(spark, sf_dir):
    rows = layout.shard_layout(K.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 4, 4)
    counts = rows.groupBy("user_id", "shard").agg(F.count("*").alias("examples"))
    return layout.renumber_shards(counts, "user_id").select("user_id", "shard", "shard_path", "examples")


@query("SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_sample_ids(spark, sf_dir):
    return layout.duplicates(K.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


_MARKS_SQL = "marks AS (SELECT o_orderkey AS job, sha256(concat_ws(chr(10), o_custkey::VARCHAR, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END)) AS fingerprint FROM orders WHERE o_orderkey % 3 <> 0)"
_PLAN_SQL = "jobs AS (SELECT o_orderkey AS job, sha256(concat_ws(chr(10), o_custkey::VARCHAR, o_orderstatus)) AS fingerprint FROM orders)"


def _jobs(spark, sf_dir):
    orders = K.table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))
    job = F.col("o_orderkey").alias("job")
    planned = orders.select(job, layout.fingerprint(F.col("o_custkey").cast("string"), F.col("o_orderstatus")).alias("fingerprint"))
    marks = orders.filter("o_orderkey % 3 <> 0").select(job, layout.fingerprint(F.col("o_custkey").cast("string"), status).alias("fingerprint"))
    return planned, marks


@query(f"WITH {_PLAN_SQL}, {_MARKS_SQL} SELECT job, fingerprint FROM jobs SEMI JOIN marks USING (job, fingerprint)")
def resume_reuse_jobs(spark, sf_dir):
    return layout.reusable(*_jobs(spark, sf_dir), ["job", "fingerprint"])


@query(f"WITH {_PLAN_SQL}, {_MARKS_SQL} SELECT job, fingerprint FROM jobs ANTI JOIN marks USING (job, fingerprint)")
def resume_pending_jobs(spark, sf_dir):
    return layout.pending(*_jobs(spark, sf_dir), ["job", "fingerprint"])


@query(
    """WITH f AS (SELECT doc_id, concat('r', doc_id // 2, CASE WHEN doc_id % 2 = 0 THEN '.set' ELSE '.fdt' END) AS path, n_chars AS length FROM documents)
SELECT a.path, greatest(1, a.length + coalesce(b.length, 0))::BIGINT AS bytes FROM f a LEFT JOIN f b ON b.path = replace(a.path, '.set', '.fdt') WHERE a.path LIKE '%.set'"""
)
def size_estimates(spark, sf_dir):
    path = F.concat(F.lit("r"), F.expr("doc_id div 2"), F.when(F.col("doc_id") % 2 == 0, ".set").otherwise(".fdt"))
    return layout.size_estimates(K.table(spark, sf_dir, "documents").select(path.alias("path"), F.col("n_chars").alias("length")))


@query()
def bundle_plan_ffd(spark, sf_dir):
    """First-fit-decreasing is a loop over bundles: not for SQL."""
    files = K.table(spark, sf_dir, "documents").select("source", F.format_string("doc-%08d", "doc_id").alias("path"), "n_chars")
    return layout.bundle_plan(files, "source", "path", "n_chars", 20_000, 8).select("source", F.array_join("paths", ",").alias("paths"), "bytes")


_SHARDS_SQL = "s AS (SELECT l_orderkey % 97 AS shard, count(*) AS examples, sum(l_quantity)::BIGINT AS bytes FROM lineitem GROUP BY 1)"


def _shards(spark, sf_dir):
    rows = K.table(spark, sf_dir, "lineitem")
    return rows.groupBy((F.col("l_orderkey") % 97).alias("shard")).agg(F.count("*").alias("examples"), F.sum("l_quantity").cast("long").alias("bytes"))


@query(f"WITH {_SHARDS_SQL} SELECT shard, examples, bytes, row_number() OVER (ORDER BY md5(concat_ws(':', '17', '3', shard::VARCHAR)), shard) - 1 AS position FROM s")
def epoch_shard_order(spark, sf_dir):
    return layout.epoch_order(_shards(spark, sf_dir), 17, 3, "shard").withColumn("position", F.col("position").cast("long"))


@query(f"WITH {_SHARDS_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', '17', '3', shard::VARCHAR)), shard) - 1 AS position FROM s) SELECT (position % 8)::INT AS worker, count(*) AS shards, sum(examples)::BIGINT AS examples FROM o GROUP BY 1")
def worker_assignment(spark, sf_dir):
    rows = layout.assign_workers(_shards(spark, sf_dir), 17, 3, 8, "shard")
    return rows.groupBy("worker").agg(F.count("*").alias("shards"), F.sum("examples").alias("examples"))


@query(
    f"""WITH {_SHARDS_SQL}, o AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', '17', '3', shard::VARCHAR)), shard) - 1 AS position FROM s),
w AS (SELECT position % 8 AS worker, sum(bytes) AS b, sum(examples) AS e FROM o GROUP BY 1)
SELECT count(*) AS workers, max(b)::BIGINT AS most, min(b)::BIGINT AS least, round(max(b)::DOUBLE / greatest(1, min(b)), 9) AS imbalance, sum(e)::BIGINT AS examples FROM w"""
)
def worker_imbalance(spark, sf_dir):
    rows = layout.imbalance(layout.assign_workers(_shards(spark, sf_dir), 17, 3, 8, "shard"))
    return rows.withColumn("imbalance", F.round("imbalance", 9))


@query(f"WITH {_PLAIN_SQL} SELECT sample_id, md5(concat_ws(':', '5', '1', shard_path, record_batch::VARCHAR)) AS block_key, md5(concat_ws(':', '5', '1', sample_id)) AS row_key FROM manifest WHERE split = 'train'")
def block_shuffle(spark, sf_dir):
    rows = K.windows(spark, sf_dir).filter("split = 'train'")
    return layout.block_shuffle(rows, 5, 1, ["shard_path", "record_batch"], "sample_id").select("sample_id", "block_key", "row_key")


@query(f"WITH {_PLAIN_SQL} SELECT shard_path, sample_id, row_number() OVER (PARTITION BY shard_path ORDER BY md5(concat_ws(':', '9', '0', sample_id)), sample_id) - 1 AS position FROM manifest")
def keyed_shuffle(spark, sf_dir):
    rows = K.windows(spark, sf_dir)
    order = Window.partitionBy("shard_path").orderBy(layout.shuffle_key(9, 0, "sample_id"), "sample_id")
    return rows.select("shard_path", "sample_id", (F.row_number().over(order) - 1).cast("long").alias("position"))


@query("SELECT user_id, batch, count(*) AS examples, min(event_id) AS first_event FROM (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 16 AS batch FROM events) GROUP BY ALL")
def batch_ids(spark, sf_dir):
    rows = layout.batch_ids(K.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 16)
    return rows.groupBy("user_id", "batch").agg(F.count("*").alias("examples"), F.min("event_id").alias("first_event"))


@query(
    """SELECT 8 AS world, (SELECT count(*) FROM lineitem) AS expected, (SELECT count(DISTINCT (l_orderkey, l_linenumber, l_partkey, l_extendedprice)) FROM lineitem) AS "distinct", (SELECT count(*) FROM lineitem) AS observed,
  ceil((SELECT count(*) FROM lineitem) / 8)::BIGINT AS per_rank, true AS complete"""
)
def epoch_accounting(spark, sf_dir):
    """What eight workers yield of an epoch, row by row: each example once."""
    rows = K.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", (F.col("l_orderkey") % 97).alias("shard"))
    workers = layout.assign_workers(_shards(spark, sf_dir), 17, 3, 8, "shard").select("shard", "worker")
    yielded = layout.bounded_shuffle(rows.join(F.broadcast(workers), "shard").repartition(8, "worker"), 17, 3, 1024)  # 97 shards
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    times = yielded.groupBy(*key).agg(F.count("*").alias("times"))
    wanted = rows.groupBy(*key).agg(F.count("*").alias("want"))
    both = wanted.join(times, key, "full_outer")
    return both.agg(
        F.lit(8).alias("world"),
        F.sum("want").alias("expected"),
        F.count("times").alias("distinct"),
        F.sum("times").alias("observed"),
        F.ceil(F.sum("want") / 8).alias("per_rank"),
        F.bool_and(F.col("want").eqNullSafe(F.col("times"))).alias("complete"),
    )


@query(
    """WITH a AS (SELECT o_orderstatus AS g, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k, [o_totalprice, o_totalprice * 2] AS v, o_custkey % 2 AS l FROM orders),
b AS (SELECT o_orderstatus AS g, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k, [o_totalprice + CASE WHEN o_orderkey % 11 = 0 THEN 0.5 ELSE 0 END, o_totalprice * 2] AS v, o_custkey % 2 AS l FROM orders WHERE o_orderkey % 1000 <> 999),
j AS (SELECT coalesce(a.g, b.g) AS o_orderstatus, a.v AS av, b.v AS bv, a.l AS al, b.l AS bl FROM a FULL JOIN b ON a.g = b.g AND a.k = b.k)
SELECT o_orderstatus, count(*) FILTER (av IS NOT NULL AND bv IS NOT NULL) AS compared, count(*) FILTER (av IS NULL OR bv IS NULL) AS unpaired,
  round(max(CASE WHEN av IS NOT NULL AND bv IS NOT NULL THEN greatest(abs(av[1] - bv[1]), abs(av[2] - bv[2])) END), 4) AS max_abs_diff,
  count(*) FILTER (av IS NOT NULL AND bv IS NOT NULL AND (abs(av[1] - bv[1]) > 1e-6 + 1e-6 * abs(bv[1]) OR abs(av[2] - bv[2]) > 1e-6 + 1e-6 * abs(bv[2]))) AS different,
  count(*) FILTER (av IS NOT NULL AND bv IS NOT NULL AND al <> bl) AS labels_different
FROM j GROUP BY 1"""
)
def backend_parity(spark, sf_dir):
    orders = K.table(spark, sf_dir, "orders")
    price, label = F.col("o_totalprice"), (F.col("o_custkey") % 2).alias("label")
    a = orders.select("o_orderstatus", "o_orderkey", F.array(price, price * 2).alias("value"), label)
    shifted = price + F.when(F.col("o_orderkey") % 11 == 0, 0.5).otherwise(0.0)
    b = orders.filter("o_orderkey % 1000 <> 999").select("o_orderstatus", "o_orderkey", F.array(shifted, price * 2).alias("value"), label)
    return audit.parity(a, b, "o_orderstatus", ["o_orderkey"]).withColumn("max_abs_diff", F.round("max_abs_diff", 4))


@query(
    """SELECT o_orderpriority, count(*) AS samples, round(corr(a, b), 6) AS correlation, round(avg(abs(a - b)), 4) AS mae, round(sqrt(avg((a - b) * (a - b))), 4) AS rmse,
  round(sqrt(avg((a - b) * (a - b))) / stddev_pop(a), 6) AS nrmse, round(max(abs(a - b)), 4) AS max_abs_error
FROM (SELECT o_orderpriority, o_totalprice AS a, c_acctbal AS b FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1"""
)
def aligned_error_stats(spark, sf_dir):
    rows = K.table(spark, sf_dir, "orders").join(K.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderpriority", F.col("o_totalprice").alias("a"), F.col("c_acctbal").alias("b"))
    out = audit.error_stats(rows, "a", "b", ["o_orderpriority"])
    digits = {"correlation": 6, "mae": 4, "rmse": 4, "nrmse": 6, "max_abs_error": 4}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    """SELECT source, lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars, grouping(source)::INT AS all_sources, grouping(lang)::INT AS all_langs
FROM documents GROUP BY ROLLUP (source, lang)"""
)
def coverage_rollup(spark, sf_dir):
    rows = K.table(spark, sf_dir, "documents").rollup("source", "lang")
    return rows.agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.grouping("source").cast("int").alias("all_sources"), F.grouping("lang").cast("int").alias("all_langs"))


@query(f"WITH {_PLAIN_SQL}, w AS (SELECT * FROM (VALUES ('train'), ('val'), ('test'), ('extra')) t(split)) SELECT w.split, count(DISTINCT subject) AS subjects, count(sample_id) AS examples, coalesce(sum(label), 0)::BIGINT AS positives FROM w LEFT JOIN manifest m ON m.split = w.split GROUP BY 1")
def inventory_by_split(spark, sf_dir):
    wanted = spark.createDataFrame([(s,) for s in ("train", "val", "test", "extra")], "split string")
    found = K.trials(spark, sf_dir).groupBy("split").agg(F.countDistinct("subject").alias("subjects"), F.count("sample_id").alias("examples"), F.sum("label").alias("positives"))
    return F.broadcast(wanted).join(found, "split", "left").fillna(0)


@query("SELECT shard, n, n AS places, 0::BIGINT AS first, (n - 1)::BIGINT AS last, true AS moved FROM (SELECT (l_orderkey % 16)::INT AS shard, count(*) AS n FROM lineitem GROUP BY 1)")
def bounded_shuffle_permutation(spark, sf_dir):
    """A bounded buffer over each shard: every row once, in another order."""
    rows = K.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 16).cast("int").alias("shard"), "l_orderkey", "l_linenumber")
    rows = rows.repartition(64, "shard").sortWithinPartitions("shard", "l_orderkey", "l_linenumber")
    out = layout.bounded_shuffle(rows, 9, 0, 256)
    # the shards of a partition follow each other; places count within a shard
    order = Window.partitionBy("shard").orderBy("position")
    placed = out.withColumn("place", F.row_number().over(order) - 1).withColumn("before", F.lag("l_orderkey").over(order))
    return placed.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("place").alias("places"), F.min("place").cast("long").alias("first"), F.max("place").cast("long").alias("last"), F.bool_or(F.col("before") > F.col("l_orderkey")).alias("moved"))


@query(
    """WITH m AS (SELECT l_orderkey % 97 AS shard_path, l_linenumber AS record_batch, l_orderkey AS row_in_batch, l_partkey AS id, l_quantity::INT AS n FROM lineitem WHERE l_orderkey % 101 <> 0),
s AS (SELECT l_orderkey % 97 AS shard_path, l_linenumber AS record_batch, l_orderkey AS row_in_batch, l_partkey + CASE WHEN l_orderkey % 103 = 0 THEN 1 ELSE 0 END AS id, l_quantity::INT * 4 + CASE WHEN l_orderkey % 107 = 0 THEN 1 ELSE 0 END AS n FROM lineitem WHERE l_orderkey % 109 <> 0),
e AS (SELECT CASE WHEN s.id IS NULL THEN 'no window is stored here' WHEN m.id IS NULL THEN 'no manifest row is for this window' WHEN m.id <> s.id THEN 'another window is stored here' WHEN m.n * 4 <> s.n THEN 'the payload has another size' END AS error
  FROM m FULL JOIN s USING (shard_path, record_batch, row_in_batch))
SELECT error, count(*) AS n FROM e WHERE error IS NOT NULL GROUP BY 1"""
)
def manifest_integrity(spark, sf_dir):
    k = F.col("l_orderkey")
    place = [(k % 97).alias("shard_path"), F.col("l_linenumber").alias("record_batch"), k.alias("row_in_batch")]
    rows = K.table(spark, sf_dir, "lineitem")
    size = F.col("l_quantity").cast("int")
    manifest = rows.filter(k % 101 != 0).select(*place, F.col("l_partkey").alias("sample_id"), F.lit(4).alias("num_channels"), size.alias("num_samples"))
    stored = rows.filter(k % 109 != 0).select(*place, (F.col("l_partkey") + F.when(k % 103 == 0, 1).otherwise(0)).alias("sample_id"), (size * 4 + F.when(k % 107 == 0, 1).otherwise(0)).alias("num_values"))
    return audit.integrity(manifest, stored).groupBy("error").agg(F.count("*").alias("n"))


@query("SELECT max(n) AS most_sources FROM (SELECT l_orderkey % 97 AS shard, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)")
def sources_per_shard(spark, sf_dir):
    rows = K.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 97).alias("shard"), "l_suppkey")
    return layout.sources_per_shard(rows, "shard", "l_suppkey")


_KEYS = "concat(CASE event_id % 3 WHEN 0 THEN 'patch_embedding.proj_in.' WHEN 1 THEN 'encoder.layers.' ELSE 'proj_out.0.' END, event_id % 12, CASE event_id % 2 WHEN 0 THEN '.self_attn_s.' ELSE '.self_attn_t.' END, 'weight')"


@query(
    f"""SELECT event_id, replace(replace(replace(replace(replace({_KEYS}, 'patch_embedding.proj_in.', 'patch_embedding.time_projection.'), 'encoder.layers.', 'encoder.'),
  '.self_attn_s.', '.spatial_attention.'), '.self_attn_t.', '.temporal_attention.'), 'proj_out.0.', 'proj_out.') AS key FROM events"""
)
def checkpoint_key_remap(spark, sf_dir):
    rows = K.table(spark, sf_dir, "events").select("event_id", F.expr(_KEYS).alias("key"))
    return rows.select("event_id", names.checkpoint_key(F.col("key")).alias("key"))


@query(
    """SELECT o_orderpriority AS model, sum(o_custkey)::BIGINT AS parameters, coalesce(sum(o_custkey) FILTER (o_orderstatus = 'O'), 0)::BIGINT AS trainable_parameters, sum(o_custkey * (CASE WHEN o_orderkey % 2 = 0 THEN 4 ELSE 2 END))::BIGINT AS state_bytes
FROM orders GROUP BY 1"""
)
def parameter_counts(spark, sf_dir):
    rows = K.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_custkey").alias("size"), F.when(F.col("o_orderkey") % 2 == 0, 4).otherwise(2).alias("item_bytes"), (F.col("o_orderstatus") == "O").alias("trainable"))
    return experiments.parameter_counts(rows, ["model"])


@query("SELECT o_orderpriority AS model, round(avg(e), 6) AS mean, median(e) AS median, round(stddev_samp(e), 6) AS std FROM (SELECT o_orderpriority, (o_orderkey % 50)::INT AS e FROM orders) GROUP BY 1")
def best_epoch_stats(spark, sf_dir):
    rows = K.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model"), (F.col("o_orderkey") % 50).cast("int").alias("best_epoch"))
    return experiments.best_epoch_summary(rows, ["model"]).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(
    """WITH g AS (SELECT o_orderpriority AS metric, avg(v) FILTER (s = 'val') AS val_mean, avg(v) FILTER (s = 'test') AS test_mean, stddev_pop(v) AS std_pop
  FROM (SELECT o_orderpriority, o_totalprice / 1000000 AS v, CASE WHEN o_orderkey % 2 = 0 THEN 'val' ELSE 'test' END AS s FROM orders) GROUP BY 1)
SELECT metric, round(val_mean, 9) AS val_mean, round(test_mean, 9) AS test_mean, round(std_pop, 9) AS std_pop, round(val_mean - test_mean, 9) AS gap, round(100 * (val_mean - test_mean) / val_mean, 6) AS deficit_pct FROM g"""
)
def generalisation_gap(spark, sf_dir):
    rows = K.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("metric"), (F.col("o_totalprice") / 1000000).alias("value"), F.when(F.col("o_orderkey") % 2 == 0, "val").otherwise("test").alias("split"))
    out = experiments.generalisation_gap(rows, "value", ["metric"])
    return out.withColumns({c: F.round(c, 6 if c == "deficit_pct" else 9) for c in ("val_mean", "test_mean", "std_pop", "gap", "deficit_pct")})


@query(
    """SELECT 'train' AS split, coalesce((SELECT string_agg(DISTINCT s::VARCHAR, ',') FROM (SELECT unnest(range(1, 16)) AS s) WHERE s NOT IN (SELECT user_id % 30 FROM events)), '') AS missing,
  coalesce((SELECT string_agg(s::VARCHAR, ',' ORDER BY s) FROM (SELECT DISTINCT user_id % 30 AS s FROM events) WHERE s NOT BETWEEN 1 AND 15), '') AS "foreign" """
)
def protocol_foreign_subjects(spark, sf_dir):
    """Subjects that belong to another split, as the audit lists them."""
    rows = K.table(spark, sf_dir, "events").select((F.col("user_id") % 30).cast("string").alias("subject_id"), F.lit("train").alias("split"), F.lit(1).alias("label"))
    return audit.protocol_audit(rows).filter("split = 'train'").select("split", "missing", "foreign")
