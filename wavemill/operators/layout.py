"""Physical layout, work planning and epoch orders.

Orders that must be random and the same everywhere are by md5 of seed, epoch
and key: a seeded permutation that needs no state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavemill.operators import ordered

#: Runs of bundles in a block, and places of items in a cell.
BLOCK, CELL = 128, 16


def shard_layout(windows: DataFrame, bundle: str, order: Sequence[str], rows_per_batch: int, batches_per_shard: int) -> DataFrame:
    """``shard``, ``record_batch`` and ``row_in_batch`` within each bundle."""
    if rows_per_batch <= 0 or batches_per_shard <= 0:
        raise ValueError("batch and shard sizes must be positive")
    rows = ordered.ordinals(windows, [bundle], order, "_k").withColumn("_k", F.col("_k") - 1)
    return (
        rows.withColumn("shard", F.floor(F.col("_k") / (rows_per_batch * batches_per_shard)).cast("int"))
        .withColumn("record_batch", (F.floor(F.col("_k") / rows_per_batch) % batches_per_shard).cast("int"))
        .withColumn("row_in_batch", (F.col("_k") % rows_per_batch).cast("int"))
        .drop("_k")
    )


def renumber_shards(rows: DataFrame, job: str, shard: str = "shard") -> DataFrame:
    """Adds ``shard_path``, numbered over all jobs in order of job and shard.

    Only the distinct shards are ranked; the numbers are joined back.
    """
    shards = rows.select(job, shard).distinct()
    ranked = shards.withColumn("_number", F.row_number().over(Window.orderBy(job, shard)) - 1)
    return rows.join(ranked, [job, shard]).withColumn("shard_path", F.format_string("shards/shard-%06d.arrow", "_number")).drop("_number")


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return rows.groupBy(*key).agg(F.count("*").alias("occurrences")).filter("occurrences > 1")


def size_estimates(files: DataFrame, path: str = "path", length: str = "length") -> DataFrame:
    """Bytes of each recording: its file, and the ``.fdt`` beside a ``.set``."""
    data = files.filter(F.lower(path).endswith(".fdt")).select(F.regexp_replace(path, r"(?i)\.fdt$", "").alias("_stem"), F.col(length).alias("_extra"))
    main = files.filter(~F.lower(path).endswith(".fdt"))
    named = main.withColumn("_stem", F.when(F.lower(path).endswith(".set"), F.regexp_replace(path, r"(?i)\.set$", "")))
    return named.join(data, "_stem", "left").select(path, F.greatest(F.lit(1).cast("long"), F.col(length) + F.coalesce("_extra", F.lit(0))).alias("bytes"))


def plan_bundles(sizes: list[tuple[str, int]], target: int, most: int) -> list[list[str]]:
    """First-fit-decreasing bundles of recordings, on the driver.

    Inherently sequential, and over recordings, of which there are few.
    """
    if most <= 0:
        raise ValueError("bundles must hold at least one recording")
    if target <= 0:
        return [[path] for path, _ in sizes]
    bundles: list[list] = []
    for path, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        fit = next((b for b in bundles if len(b[1]) < most and b[0] + size <= target), None)
        if fit is None:
            bundles.append([size, [path]])
        else:
            fit[0] += size
            fit[1].append(path)
    return sorted(sorted(paths) for _, paths in bundles)


def first_fit(sizes: Iterable[tuple[int | None, int]], target: int, most: int) -> Iterator[tuple[int, int, int, int]]:
    """First-fit bundles of items, given as falling sizes and how often each comes.

    Yields the place of a first item, a number of items, the first of their
    bundles and how many of them each bundle gets, in the order of the items.
    Items of one size fill the first bundle they fit, then the next one.  So
    neighbouring bundles with as much room and as many free slots are one run,
    and time and memory go with the sizes that differ, not with the items.
    Runs stand in blocks, of which only those with room enough are looked at.
    An item of unknown size is alone.
    """
    none = np.iinfo(np.int64).min
    slots_each = 1 if target <= 0 else most
    blocks: list[list[tuple[int, int, int, int]]] = [[]]  # of runs: room, free slots, first bundle, bundles
    tops = np.array([none])  # the most room in each block
    place = number = 0

    def more(room: int, slots: int, size: int) -> int:
        if room < size:
            return 0
        return slots if size <= 0 else min(slots, room // size)

    def top(runs: list[tuple[int, int, int, int]]) -> int:
        return max((room for room, *_ in runs), default=none)

    for size, items in sizes:
        if size is None:
            yield place, items, number, 1
            place, number = place + items, number + items
            continue
        at = 0
        while items and at < len(blocks):
            fits = tops[at:] >= size
            at += int(fits.argmax())
            if tops[at] < size:
                break
            after = []
            for k, run in enumerate(blocks[at]):
                if not items:
                    after += blocks[at][k:]
                    break
                room, slots, first, count = run
                each = more(room, slots, size)
                if not each:
                    after.append(run)
                    continue
                for bundles, put in ((min(count, items // each), each), (1, items % each)):
                    if items and count and bundles and put:
                        yield place, bundles * put, first, put
                        if slots > put:
                            after.append((room - put * size, slots - put, first, bundles))
                        place, items = place + bundles * put, items - bundles * put
                        first, count = first + bundles, count - bundles
                if count:
                    after.append((room, slots, first, count))
            blocks[at], tops[at] = after, top(after)
            if len(after) > 2 * BLOCK:
                blocks[at : at + 1] = after[:BLOCK], after[BLOCK:]
                tops = np.insert(tops, at, top(after[:BLOCK]))
                at += 1
                tops[at] = top(after[BLOCK:])
            at += 1
        if not items:
            continue
        each = 1 + more(target - size, slots_each - 1, size)
        for bundles, put in ((items // each, each), (1, items % each)):
            if bundles and put:
                yield place, bundles * put, number, put
                if slots_each > put:
                    if len(blocks[-1]) >= BLOCK:
                        blocks.append([])
                        tops = np.append(tops, none)
                    blocks[-1].append((target - put * size, slots_each - put, number, bundles))
                    tops[-1] = max(tops[-1], target - put * size)
                place, number = place + bundles * put, number + bundles


def bundle_plan(sizes: DataFrame, by: str, path: str, size: str, target: int, most: int) -> DataFrame:
    """The same plan for each group (a dataset, say), of any number of recordings.

    Only a group's distinct sizes and their counts meet in a task, which plans
    for runs of recordings; recordings find their run by their place in the
    group, and meet by bundle.
    """
    if most <= 0:
        raise ValueError("bundles must hold at least one recording")
    rows = sizes.select(F.col(by).alias("_by"), F.col(path).alias("_path"), F.col(size).cast("long").alias("_size"))
    placed = ordered.ordinals(rows, ["_by"], [F.col("_size").desc_nulls_last(), "_path"], "_k").withColumn("_k", F.col("_k") - 1).withColumn("_cell", F.expr(f"_k div {CELL}"))

    def plan(counts: pa.Table) -> pa.Table:
        counts = counts.sort_by([("_size", "descending")])  # nulls are at the end
        fitted = first_fit(zip(counts["_size"].to_pylist(), counts["_n"].to_pylist(), strict=True), target, most)
        found = np.fromiter(chain.from_iterable(fitted), np.int64).reshape(-1, 4)
        return pa.table([counts["_by"].take(pa.array(np.zeros(len(found), np.int64))), *map(pa.array, found.T)], ["_of", *numbers])

    numbers = ["_first", "_items", "_bundle", "_each"]
    schema = T.StructType([T.StructField("_of", rows.schema["_by"].dataType), *[T.StructField(c, T.LongType()) for c in numbers]])
    counts = placed.groupBy("_by", "_size").agg(F.count("*").alias("_n"))
    # few bytes, but work: not to be joined into few tasks
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = counts.repartition(parts, "_by").groupBy("_by").applyInArrow(plan, schema)
    cells = runs.withColumn("_in", F.explode(F.expr(f"sequence(_first div {CELL}, (_first + _items - 1) div {CELL})")))
    own = F.col("_by").eqNullSafe(F.col("_of")) & (F.col("_cell") == F.col("_in")) & (F.col("_k") >= F.col("_first")) & (F.col("_k") < F.col("_first") + F.col("_items"))
    put = placed.join(cells, own).withColumn("_bundle", F.expr("_bundle + (_k - _first) div _each"))
    paths = F.array_sort(F.transform(F.collect_list(F.struct("_path")), lambda x: x["_path"]))
    return put.groupBy("_by", "_bundle").agg(paths.alias("paths"), F.sum("_size").alias("bytes")).select(F.col("_by").alias(by), "paths", "bytes")


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def reusable(planned: DataFrame, markers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned jobs with a marker that agrees in all ``keys``."""
    return planned.join(markers.select(*keys).distinct(), list(keys), "left_semi")


def pending(planned: DataFrame, markers: DataFrame, keys: Sequence[str]) -> DataFrame:
    return planned.join(markers.select(*keys).distinct(), list(keys), "left_anti")


def shuffle_key(seed: int, epoch: int, *key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), *[F.col(k).cast("string") for k in key]))


def epoch_order(shards: DataFrame, seed: int, epoch: int, *key: str) -> DataFrame:
    """Shards with ``position``, their place in an epoch."""
    return shards.withColumn("position", F.row_number().over(Window.orderBy(shuffle_key(seed, epoch, *key), *key)) - 1)


def assign_workers(shards: DataFrame, seed: int, epoch: int, workers: int, *key: str) -> DataFrame:
    """Shards dealt to workers in turn, in the order of the epoch."""
    if workers <= 0:
        raise ValueError("there must be a worker")
    return epoch_order(shards, seed, epoch, *key).withColumn("worker", (F.col("position") % workers).cast("int"))


def block_shuffle(rows: DataFrame, seed: int, epoch: int, block: Sequence[str], key: str) -> DataFrame:
    """``block_key`` and ``row_key``: blocks shuffled, then rows within each."""
    return rows.withColumn("block_key", shuffle_key(seed, epoch, *block)).withColumn("row_key", shuffle_key(seed, epoch, key))


def batch_ids(rows: DataFrame, by: Sequence[str], order: Sequence, size: int) -> DataFrame:
    """Batches of ``size`` in order within each group; the last may be short."""
    return ordered.ordinals(rows, by, order, "batch").withColumn("batch", F.floor((F.col("batch") - 1) / size))


def imbalance(loads: DataFrame, worker: str = "worker", load: str = "bytes") -> DataFrame:
    """Largest worker load over the smallest (at least 1)."""
    per = loads.groupBy(worker).agg(F.sum(load).alias("_load"), F.sum("examples").alias("_examples"))
    return per.agg(F.count("*").alias("workers"), F.max("_load").alias("most"), F.min("_load").alias("least"), (F.max("_load") / F.greatest(F.lit(1), F.min("_load"))).alias("imbalance"), F.sum("_examples").alias("examples"))


def sources_per_shard(windows: DataFrame, shard: str = "shard_path", source: str = "source_uri") -> DataFrame:
    """The most sources that meet in one shard."""
    return windows.groupBy(shard).agg(F.countDistinct(source).alias("_n")).agg(F.max("_n").alias("most_sources"))


def bounded_shuffle(rows: DataFrame, seed: int, epoch: int, size: int) -> DataFrame:
    """Each partition's rows through a buffer of ``size``, with ``position``.

    A row of the stream takes the place of one in the buffer, which goes out;
    at the end the buffer goes out in a random order.  Every row goes out once,
    and a buffer of one changes nothing.  Draws are by seed, epoch and partition.
    """
    if size < 1:
        raise ValueError("the buffer must hold at least one row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, epoch, part])
        held, at = None, 0

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal at
            place = pa.array(np.arange(at, at + table.num_rows, dtype=np.int64))
            at += table.num_rows
            yield from table.append_column("position", place).combine_chunks().to_batches()

        for batch in batches:
            for low in range(0, batch.num_rows, size):
                block = pa.Table.from_batches([batch.slice(low, size)])
                both = block if held is None else pa.concat_tables([held, block])
                goes = max(0, both.num_rows - size)
                order = rng.permutation(both.num_rows) if size > 1 else np.arange(both.num_rows)
                yield from out(both.take(order[:goes]))
                held = both.take(order[goes:])
        if held is not None:
            yield from out(held.take(rng.permutation(held.num_rows)))

    schema = T.StructType([*rows.schema.fields, T.StructField("position", T.LongType())])
    return rows.mapInArrow(run, schema)
