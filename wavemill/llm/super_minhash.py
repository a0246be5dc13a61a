"""Near-duplicate groups by SuperMinHash signatures, banding, exact
verification and union-find.

A document is the set of its 3-word shingles, A-Z lowered (its whole sequence
of words, if it has fewer); two are linked when the Jaccard similarity of their
sets is at least 0.85.  Documents with equal sets are one class.

1. SuperMinHash: each element draws a random permutation of the ``SIZE``
   registers, step by step; step j offers j plus a random fraction to the
   register that is j-th in it, and each register keeps the least offer.  So
   the registers of one element rank its offers apart, which lowers the
   variance of the share of equal registers.  A set is done once no register
   is above the next step: after few steps, unless it is small.
2. ``BANDS`` bands of ``ROWS`` registers; classes that share a band are a run.
   Of pairs at the threshold all bands miss one in a hundred million.
3. Star: each class is compared with the least class of every run it is in
   (few different ones), which alone joins most of a group, in linear time.
4. Rest: only runs that still hold several components are compared pair by
   pair, and in them only pairs of different components.  Classes outside the
   largest component of their run are dealt over blocks, all classes of the run
   over others, and each pair of blocks is a unit: what is sent grows with the
   classes times those outside the largest component.
5. Pairs whose registers agree in fewer than ``ALIKE``, or whose sizes rule the
   threshold out, are no candidates; candidates are verified on full sets.  A
   unit unites what it links and skips pairs that are united already.  No pair
   is ever a row: a unit returns at most a tie for each class.  The ties of all
   units are united by ``connected``.

Nothing is capped.  Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .near_duplicates import _name, _units, connected, _similar

SHINGLE, THRESHOLD = 3, (85, 100)
BANDS, ROWS, ALIKE = 32, 5, 0.68
SIZE = BANDS * ROWS
#: Classes and shingles to a block of a unit.
BLOCK, BLOCK_GRAMS = 512, 1 << 20
#: Pairs of classes looked at together.
PAIRS = 1 << 15
#: Elements that hold their permutation at once.
ELEMENTS = 1 << 16
BROADCAST_ROWS = 500_000


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, by text, and where each text's
    begin (and the end)."""
    words = C.Words(*C.text_bytes(texts))
    hashes, first, counts = words.hashes(lower=True), words.first, words.counts
    at = C.gram_starts(first, SHINGLE)
    found, doc = (C.grams(hashes, SHINGLE)[at], words.doc()[at]) if len(at) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for n in range(1, SHINGLE):
        few = np.flatnonzero(counts == n)
        if len(few):
            found, doc = np.append(found, C.mix64(C.grams(hashes, n)[first[:-1][few]] + np.uint64(n))), np.append(doc, few)
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    found, doc = found[new], doc[new]
    return found, np.searchsorted(doc, np.arange(len(counts) + 1))


def signatures(found: np.ndarray, cuts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The registers of each set: the step in the high 8 bits, a fraction of 24
    bits below; all ones where a set is empty."""
    out = np.full((len(cuts) - 1, size), 0xFFFFFFFF, np.uint32)
    low = 0
    while low < len(cuts) - 1:
        high = max(low + 1, int(np.searchsorted(cuts, cuts[low] + ELEMENTS, "right")) - 1)
        if high == low + 1:  # a large set alone: its parts offer one after the other
            for at in range(int(cuts[low]), int(cuts[high]), ELEMENTS):
                part = found[at : min(at + ELEMENTS, int(cuts[high]))]
                _offer(out[low:high], part, np.zeros(len(part), np.int64))
        else:
            _offer(out[low:high], found[cuts[low] : cuts[high]], np.repeat(np.arange(high - low), np.diff(cuts[low : high + 1])))
        low = high
    return out


def _offer(registers: np.ndarray, elements: np.ndarray, owner: np.ndarray) -> None:
    """Lowers the registers of each owner by the offers of its elements."""
    size = registers.shape[1]
    flat = registers.reshape(-1)
    places = np.tile(np.arange(size, dtype=np.uint8), (len(elements), 1))
    for j in range(size):
        busy = (registers.max(1) >> 24 >= j)[owner]
        if not busy.all():
            elements, owner, places = elements[busy], owner[busy], places[busy]
        if not len(elements):
            return
        draw = C.mix64(elements + np.uint64(((j + 1) * 0x9E3779B97F4A7C15) & (1 << 64) - 1))
        k = j + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(size - j) >> np.uint64(32)).astype(np.int64)
        each = np.arange(len(elements))
        place = places[each, k]
        places[each, k] = places[:, j]
        np.minimum.at(flat, owner * size + place, np.uint32(j << 24) | (draw >> np.uint64(40)).astype(np.uint32))


def sketch(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``id``, ``node``, ``check`` (128 bits of the set), ``n`` and ``signature``
    (a byte of each register)."""
    rows = docs.select(F.col(id), C.text_of(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.chunks(batches):
            found, cuts = shingle_sets(part.column(1))
            node, check = _name(found, cuts)
            bytes_ = (C.mix64(signatures(found, cuts)) & np.uint64(255)).astype(np.uint8)
            packed = pa.array([x.tobytes() for x in bytes_], pa.binary())
            yield C.record({"id": part.column(0), "node": node, "check": check, "n": np.diff(cuts).astype(np.int64), "signature": packed})

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)[id]}, node long, check long, n long, signature binary")


_UNIT = ["key", "i", "j"]


class _Groups:
    """Union-find over positions."""

    def __init__(self, kinds: np.ndarray) -> None:
        """Positions of one kind are united from the start."""
        _, self.root = np.unique(kinds, return_inverse=True)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.root[a] != self.root[b]

    def unite(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """The pairs that united something, in order."""
        new = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.root[x], self.root[y]
            if p != q:
                self.root[self.root == max(p, q)] = min(p, q)
                new.append((x, y))
        return new


def _pairs(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of a unit (positions), a side against the other."""
    side, node, own, n = (rows[x].to_numpy() for x in ("side", "node", "own", "n"))
    flat = rows["signature"].combine_chunks()
    marks = C.text_bytes(flat)[0].reshape(len(flat), SIZE)
    ones, others = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    step = max(1, PAIRS // max(len(others), 1))
    for low in range(0, len(ones), step):
        a = np.repeat(ones[low : low + step], len(others))
        b = np.tile(others, len(ones[low : low + step]))
        fit = (own[a] != own[b]) & (THRESHOLD[1] * np.minimum(n[a], n[b]) >= THRESHOLD[0] * np.maximum(n[a], n[b]))
        a, b = a[fit], b[fit]
        for at in range(0, len(a), PAIRS):
            x, y = a[at : at + PAIRS], b[at : at + PAIRS]
            alike = (marks[x] == marks[y]).mean(1) >= ALIKE
            yield x[alike], y[alike]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for rows, cuts in _units(batches):
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield rows.slice(low, high - low)


def _dealt(units: DataFrame) -> DataFrame:
    return units.repartition(*_UNIT).sortWithinPartitions(*_UNIT, "side", "node")


def _candidates(units: DataFrame) -> DataFrame:
    """The rows of units that have a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each(batches):
            some = np.zeros(rows.num_rows, bool)
            for a, b in _pairs(rows):
                some[a] = some[b] = True
            if some.any():
                yield from rows.filter(pa.array(some)).combine_chunks().to_batches()

    return _dealt(units).mapInArrow(run, units.schema)


def _ties(units: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that verified links unite, a forest of each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each(batches):
            node, sets = rows["node"].to_numpy(), [np.frombuffer(x, np.uint64) for x in rows["grams"].to_pylist()]
            groups, out = _Groups(rows["own"].to_numpy()), []
            for a, b in _pairs(rows):
                for low in range(0, len(a), 1024):
                    x, y = a[low : low + 1024], b[low : low + 1024]
                    apart = groups.apart(x, y)
                    x, y = x[apart], y[apart]
                    if len(x):
                        both, either = _similar(x, y, sets)
                        linked = THRESHOLD[1] * both >= THRESHOLD[0] * either
                        out += groups.unite(x[linked], y[linked])
            if out:
                a, b = np.array(out).T
                yield C.record({"a": node[a], "b": node[b]})

    return _dealt(units).mapInArrow(run, "a long, b long")


def _sets_of(docs: DataFrame, id: str, text: str, wanted: DataFrame) -> DataFrame:
    """``node`` and ``grams``, its packed set, of every wanted (node, copy_id):
    only the documents that stand for a wanted class are read into sets."""
    hint = F.broadcast if wanted.count() <= BROADCAST_ROWS else lambda x: x
    rows = docs.select(F.col(id).alias("_id"), C.text_of(text).alias("_text"))
    some = rows.join(hint(wanted.select(F.col("copy_id").alias("_id")).distinct()), "_id", "left_semi")
    if not wanted.filter("copy_id is null").isEmpty():
        some = some.unionByName(rows.filter("_id is null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.chunks(batches, 0):
            found, cuts = shingle_sets(part.column(0))
            node, _ = _name(found, cuts)
            seen, at = np.unique(node, return_index=True)
            yield C.record({"node": seen, "grams": pa.array([found[cuts[k] : cuts[k + 1]].tobytes() for k in at.tolist()], pa.binary())})

    found = some.select("_text").mapInArrow(run, "node long, grams binary").join(hint(wanted.select("node")), "node", "left_semi")
    return found.groupBy("node").agg(F.first("grams").alias("grams"))


def _linked(docs: DataFrame, id: str, text: str, units: DataFrame) -> DataFrame:
    """The ties of units of (key, i, j, side, node, own)."""
    some = C.durable(_candidates(units))
    grams = _sets_of(docs, id, text, C.durable(some.select("node", "copy_id").distinct(), some.count()))
    return C.durable(_ties(some.drop("copy_id").join(grams, "node")))


def _blocks(rows: str = "1", size: str = "n") -> F.Column:
    return F.greatest(F.lit(1), F.ceil(F.greatest(F.sum(F.expr(rows)) / BLOCK, F.sum(F.expr(size)) / BLOCK_GRAMS))).cast("int")


def _dealt_to(blocks: str) -> F.Column:
    return F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")


def _all(blocks: str) -> F.Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


_ROW = ["key", "i", "j", "side", "node", "own", "copy_id", "n", "signature"]


def star_units(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Each class with the least class of each of its runs."""
    stars = C.durable(members.filter("node <> least").select(F.col("least").alias("key"), "node").distinct(), members.count())
    stars = stars.join(classes, "node")
    sizes = stars.groupBy("key").agg(_blocks().alias("blocks"))
    rows = stars.join(sizes, "key").withColumn("j", _dealt_to("blocks")).withColumn("side", F.lit(1))
    heads = sizes.withColumn("node", F.col("key")).join(classes, "node").withColumn("j", _all("blocks")).withColumn("side", F.lit(0))
    both = rows.drop("blocks").unionByName(heads.drop("blocks"))
    return both.withColumn("i", F.lit(0)).withColumn("own", F.col("node")).select(_ROW)


def rest_units(members: DataFrame, classes: DataFrame, parts: DataFrame) -> DataFrame:
    """Of runs with several components: what is outside the largest, against all."""
    owned = members.select("key", "node").join(classes.select("node", "n"), "node").join(parts, "node", "left")
    owned = owned.select("key", "node", "n", F.coalesce("label", "node").alias("own"))
    by_part = owned.groupBy("key", "own").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    most = by_part.groupBy("key").agg(F.max(F.struct("rows", "own")).alias("most"), F.count("*").alias("parts"), F.sum("rows").alias("rows"), F.sum("n").alias("n"))
    mixed = most.filter("parts > 1").select("key", F.col("most.own").alias("largest"))
    rows = owned.join(mixed, "key").withColumn("outside", F.col("own") != F.col("largest"))
    sizes = rows.groupBy("key").agg(_blocks("cast(outside as int)", "if(outside, n, 0)").alias("few"), _blocks().alias("many"))
    rows = rows.join(sizes, "key").join(classes.drop("n"), "node")
    ones = rows.filter("outside").withColumn("side", F.lit(0)).withColumn("i", _dealt_to("few")).withColumn("j", _all("many"))
    others = rows.withColumn("side", F.lit(1)).withColumn("j", _dealt_to("many")).withColumn("i", _all("few"))
    return ones.unionByName(others).select(_ROW)


def near_duplicate_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id``, ``n_shingles``, ``component_id`` (the least
    id that links reach, its own included) and ``kept`` (it has that id).

    Null and empty texts, and texts of blanks, have no shingles, are linked with
    nothing and are kept.  A row without an id takes the least id of its
    component and is not kept; if no row of the component has an id,
    component_id is null and all are kept.  Rows that repeat an id are one
    document as far as ``kept`` goes.  Other columns are not read; an empty
    table gives an empty one.
    """
    rows = C.durable(sketch(docs, id, text))
    count = rows.count()
    classes = rows.filter("n > 0").groupBy("node", "check", "n").agg(F.min("id").alias("copy_id"), F.first("signature").alias("signature"))
    classes = C.durable(classes, count).drop("check")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("signature", b * ROWS + 1, F.lit(ROWS))))
    keyed = classes.select("node", F.explode(bands).alias("key"))
    runs = C.durable(keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("least")).filter("size > 1").select("key", "least"), BANDS * count)
    members = C.durable(keyed.join(F.broadcast(runs) if runs.count() <= BROADCAST_ROWS else runs, "key"))
    ties = _linked(docs, id, text, star_units(members, classes))
    parts = connected(ties)
    more = _linked(docs, id, text, rest_units(members, classes, parts))
    if not more.isEmpty():
        parts = connected(parts.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
    named = classes.select("node", "n", "copy_id").join(parts, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = named.groupBy("label").agg(F.min("copy_id").alias("component_id"))
    named = named.join(heads, "label").select("node", "n", "component_id")
    out = rows.select("id", "node", "n").join(named, ["node", "n"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op13_superminhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(C.table(spark, sf_dir, "documents"))
