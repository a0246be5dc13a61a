"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target number of words, so each of its documents a fractional
number of copies, target / size of the source (at most ``MOST``).  The whole
part is taken; what is left, p in [0, 1), is the same for all documents of the
source, and rounding each alone would miss the target by a random amount.
Pivotal rounding pairs two fractional documents and moves mass between them,
in words, until one of them is 0 or 1: the words taken in all stay equal, every
document's expectation stays p, and one fractional document goes on to the
next pair.  Documents are paired by falling size, so a long one is settled
against others as long, and the one left over at the end is short.

It runs as a reduction tree.  A source's documents are dealt by hash over
leaves of about ``LEAF`` documents (so a hot source has many leaves); each leaf
keeps at most one fractional document.  Those meet in groups of ``FAN_IN``
leaves, level after level, until each source has one, which is drawn with its
probability; documents settled in that last group make good what the draw is
off by, as far as they fit.  A source's words are thus off its target by less
than one document, and mostly by far less.  All random draws are hashes of the document and a seed, and leaves
depend on counts only, so reruns and other partitionings agree.

Equal rows (id, source and size) are one unit with a multiplicity and get the
same copies.  Documents of size 0 get the whole part of their copies and take
no words.  (So a source that is mostly one row, repeated, can be off by that
row's words.)  A null source is a source of its own, last in order.  A null text
has size 0.  No documents give no rows.  A very long text is one document, and
settled first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

MOST, LEAF, FAN_IN, SEED = 3, 4096, 16, 20240229
WEIGHTS = (1.0, 2.0, 3.0)
#: Source tables up to this many rows are broadcast, others joined by shuffle.
BROADCAST_ROWS = 50_000


def sizes(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``id``, ``source`` and ``size``, the number of words, of every row."""
    rows = docs.select(F.col(id), F.col(source), C.text_of(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.chunks(batches, 2):
            yield C.record({"id": part.column(0), "source": part.column(1), "size": C.Words(*C.text_bytes(part.column(2))).counts.astype(np.int64)})

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {kinds[id]}, source {kinds[source]}, size long")


def with_sizes(docs: DataFrame, text: str = "text", name: str = "_size") -> DataFrame:
    """The documents and, as ``name``, the number of words of each."""
    at, kinds = docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.chunks(batches, at):
            size = C.Words(*C.text_bytes(part.column(at))).counts.astype(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(size)], names=[*part.schema.names, name])

    return docs.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kinds] + [f"`{name}` long"]))


def targets(units: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Per source: ``source_size``, ``n_units``, ``rank`` and ``target``.

    Targets share the total in proportion to the weights; where one exceeds
    ``most`` times its source's size it stops there, and the excess goes to the
    others by weight, until none is above.  That is filling vessels to one
    level: in order of ``most * size / weight``, a source is full while what is
    left, divided by the weights left, reaches its ratio.
    """
    found = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).cast("long").alias("source_size"), F.count("*").alias("n_units"))
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "rank")
    everything = Window.partitionBy()
    found = found.withColumn("rank", F.row_number().over(by_name) - 1)
    found = found.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    found = found.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    found = found.withColumn("full", F.col("ratio") <= left / F.sum("weight").over(after)).withColumn("total", total)
    free = F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    share = F.col("weight") / F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    return found.select("source", "source_size", "n_units", "rank", F.when(F.col("full"), F.col("cap")).otherwise(free * share).alias("target"))


def _draws(uid: np.ndarray, level: int) -> np.ndarray:
    salt = C.mix64(np.array([SEED + level], np.uint64))
    return (C.mix64(uid.view(np.uint64) ^ salt) >> np.uint64(11)).astype(float) / (1 << 53)


def _pivot(x: np.ndarray, mass: np.ndarray, draw: np.ndarray, last: bool) -> np.ndarray:
    """x with all but at most one entry rounded to 0 or 1; ``last``: all.

    The last draw adds or drops up to a document.  What it is off by is made
    good by the largest settled documents that fit into it, one after another.
    """
    free = [k for k, p in enumerate(x.tolist()) if 0 < p < 1]
    x, held = x.tolist(), -1
    mass, draw = mass.tolist(), draw.tolist()
    for j in range(len(x)):
        if not 0 < x[j] < 1:
            continue
        if held < 0:
            held = j
            continue
        i, a = held, mass[j] / mass[held]
        up, down = min(1 - x[i], a * x[j]), min(x[i], a * (1 - x[j]))
        move = up if draw[j] * (up + down) < down else -down
        x[i], x[j] = x[i] + move, x[j] - move / a
        for k in (i, j):
            x[k] = 0.0 if x[k] < 1e-9 else 1.0 if x[k] > 1 - 1e-9 else x[k]
        held = next((k for k in (j, i) if 0 < x[k] < 1), -1)
    if last and held >= 0:
        before, x[held] = x[held], float(draw[held] < x[held])
        off = mass[held] * (x[held] - before)
        for k in sorted(free, key=lambda k: -mass[k]):
            if k != held and x[k] == (off > 0) and mass[k] <= abs(off):
                x[k] = 1 - x[k]
                off += mass[k] if x[k] else -mass[k]
    return np.array(x)


def _round(rows: DataFrame, level: int, last: bool) -> DataFrame:
    """One level of the tree: pivots within each (rank, leaf)."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        uid, x = group["uid"].to_numpy(), group["frac"].to_numpy()
        mass = (group["size"].to_numpy() * group["n_rows"].to_numpy()).astype(float)
        order = np.lexsort((C.mix64(uid.view(np.uint64)), -mass))
        out = np.empty(len(x))
        out[order] = _pivot(x[order], mass[order], _draws(uid, level)[order], last)
        up = out >= 1
        copies = group["copies"].to_numpy() + up
        at = group.schema.get_field_index
        return group.set_column(at("copies"), "copies", pa.array(copies, pa.int64())).set_column(at("frac"), "frac", pa.array(np.where(up, 0.0, out)))

    return rows.groupBy("rank", "leaf").applyInArrow(run, rows.schema)


def mix(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row per unit: ``id``, ``source``, ``size``, ``n_rows`` (how many rows
    it stands for), ``source_size``, ``target`` and ``copies`` of each row."""
    units = C.durable(sizes(docs, id, source, text).groupBy("id", "source", "size").agg(F.count("*").alias("n_rows")))
    goals = C.durable(targets(units, weights, most))
    shape = goals.agg(F.count("*").alias("sources"), F.max("n_units").alias("most")).first()
    small = shape.sources <= BROADCAST_ROWS
    joined = units.alias("u").join(F.broadcast(goals) if small else goals, F.col("u.source").eqNullSafe(goals["source"]))
    each = F.when((F.col("source_size") > 0), F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(each + F.lit(1e-9))
    frac = F.when((F.col("size") == 0) | (each - whole < 1e-9), 0.0).otherwise(each - whole)
    leaves = F.ceil(F.col("n_units") / LEAF)
    rows = joined.select("id", "u.source", "size", "n_rows", "source_size", "target", "rank", F.xxhash64("id", "u.source", "size").alias("uid"), whole.cast("long").alias("copies"), frac.cast("double").alias("frac"))
    uid = F.col("uid")
    rows = rows.join(F.broadcast(goals.select("rank", leaves.alias("leaves"))) if small else goals.select("rank", leaves.alias("leaves")), "rank")
    rows = rows.withColumn("leaf", F.pmod(F.xxhash64(uid, F.lit(SEED)), F.col("leaves"))).drop("leaves")
    n, level, decided = -(-int(shape.most or 0) // LEAF), 0, []
    while True:
        done = C.durable(_round(rows, level, last=n <= 1))
        decided.append(done.filter("frac = 0"))
        if n <= 1:
            break
        rows = done.filter("frac > 0").withColumn("leaf", F.floor(F.col("leaf") / FAN_IN))
        n, level = -(-n // FAN_IN), level + 1
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out.select("id", "source", "size", "n_rows", "source_size", "target", "copies")


def op2_pivotal_mixing(spark, sf_dir: str) -> DataFrame:
    rows = mix(C.table(spark, sf_dir, "documents"))
    rows = rows.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
