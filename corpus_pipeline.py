"""A training-data pipeline over ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage
before it kept, and returns documents; its result is written as Parquet in the
cluster's shared folder and read again as the next one's input.  All stages but
the last return the columns of ``documents``; the last adds what mixing takes.

Null texts and ids are handled as each operator says: a document without a
text is judged by its metadata, is nobody's copy, leaks and hides nothing, and
has size 0.  Rows are dropped by a hash of all their columns, not by their id,
which may be null or that of several texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import common as C
from wavemill.llm import decontaminate, mixing, near_duplicates, quality_classifier, secrets

#: Id lists up to this many rows are broadcast, others joined by shuffle.
BROADCAST_ROWS = 1_000_000

#: Random draws, fitted models and approximate search: not for SQL.
ORACLE_SQL = None


def _fresh(name: str, docs: DataFrame) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a hash of all columns, and its name: rows share it only if they are equal."""
    key = _fresh("_key", docs)
    return docs.withColumn(key, F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])), key


def _few(rows: DataFrame) -> DataFrame:
    """The rows, kept, and broadcast up to BROADCAST_ROWS."""
    rows = C.durable(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _without(keyed: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The keyed documents whose key is not in ``keys`` (one column, the key)."""
    return keyed.join(_few(keys.distinct()), key, "left_anti")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects."""
    model = quality_classifier.train(docs, C.table(spark, sf_dir, "labels"))
    prefix = _fresh("_qc_kept", docs).removesuffix("kept")
    return quality_classifier.score(docs, model, carry=True, prefix=prefix).filter(F.col(f"{prefix}kept")).select(docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least id, of each near-duplicate class.

    Rows of one id and text are one document, and so are equal rows with words
    but no id.  A document without an id goes before none that has one.
    """
    keyed, key = _keyed(docs)
    found = C.durable(near_duplicates.near_duplicates(keyed, key).filter("n_links > 0").select(key, "class_id").distinct())
    # columns are hashed once more here, but no text is moved
    members = C.durable(keyed.select(key, "doc_id").join(_few(found), key).distinct())
    least = members.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(key).alias("key"))).alias("least"))
    kept = _without(keyed, members.join(_few(least), "class_id").filter(F.col(key) != F.col("least.key")).select(key), key)
    one = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")).when(F.col("text").rlike(r"\S"), F.col(key))
    if not keyed.groupBy(one.alias("one")).count().filter("count > 1 and one is not null").isEmpty():
        named, words = F.col("doc_id").isNotNull(), F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
        kept = kept.filter(~named & ~words).unionByName(kept.filter(~named & words).dropDuplicates([key])).unionByName(kept.filter(named).dropDuplicates(["doc_id", "text"]))
    return kept.select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    keyed, key = _keyed(docs)
    leaks = decontaminate.find_leaks(keyed, C.table(spark, sf_dir, "benchmark"), key, item_id="item_id")
    return _without(keyed, leaks.select(key), key).select(docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; every document stays."""
    return secrets.redact(docs, secrets.thresholds(docs)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``copies`` (how often), ``size``,
    ``taken``, ``source_size`` and ``target`` (in words); columns of these
    names in the input are replaced."""
    decided = mixing.mix(docs).filter("copies > 0")
    size = _fresh("_size", docs)
    named = decided.select(*[F.col(c).alias(_fresh(f"_mix_{c}", docs)) for c in decided.columns])
    by = dict(zip(decided.columns, named.columns, strict=True))
    rows = mixing.with_sizes(docs, name=size)
    on = F.col("doc_id").eqNullSafe(F.col(by["id"])) & F.col("source").eqNullSafe(F.col(by["source"])) & (F.col(size) == F.col(by["size"]))
    new = {"size": F.col(size), "source_size": F.col(by["source_size"]), "target": F.col(by["target"]), "copies": F.col(by["copies"]), "taken": F.col(by["copies"]) * F.col(size)}
    return rows.join(named, on).select(*[c for c in docs.columns if c.lower() not in new], *[v.alias(k) for k, v in new.items()])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminated),
    ("secret_scan", redacted),
    ("mixing", mixed),
]


def _delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.  A stage's table is deleted
    once the next one's is there; the last one's stays for the result."""
    folder = f"{C.shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs, before = C.table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _delete(spark, before)
        before = path
    return docs
