"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A document is the set of its word 5-grams (of all its words, if it has fewer);
two are linked when the Jaccard similarity of their sets is at least 0.8.

1. Documents with equal sets are one class, and only classes go on.
2. A class has a label in each of ``TREES`` trees: ``DEEPEST`` min-hash values
   of a byte each, most significant first, in one word.  In order, the labels
   of a tree are its prefix trie, and classes that share d values are a run.
3. The forest is worked from the longest prefix up.  At depth d, classes in one
   run of some tree are compared, each pair in the first tree it shares, and
   pairs that shared a longer prefix anywhere are done already.  Pairs whose
   signatures agree in fewer than ``ALIKE`` of all values are no candidates (at
   similarity 0.8 that has a chance of 1e-6).  Candidates are verified exactly,
   by intersecting sets.
4. A link of similarity s is found at depth d with probability
   P = 1 - (1 - s**d)**TREES, so what was found stands for the sum of 1 / P
   links.  That is the measured recall.  The prefix is shortened by one value
   until it reaches ``RECALL``, or until P at the threshold itself does.
5. Connected components of the links are the near-duplicate classes.

So the only chance is in steps 3 and 4.  Nothing is capped.  A run with more
than ``BLOCK`` classes or ``BLOCK_GRAMS`` grams is dealt over blocks; each pair
of blocks is a unit of its own.  No pair is ever a row: a unit returns each
class's number of links and a tie to the least class it is linked with.  Units
are first filtered by labels alone, so only the sets of classes with a
candidate are read (from one document of each) and sent.

Sets are compared by 64-bit hashes of their 5-grams, and a class is known by
128 bits of its set.  Texts without words (null, empty, blank) are linked with
nothing, and each is its own class.  Repeated rows are copies of each other; a
null id is a copy like others, and names a class only if no other id does.  No
documents give no rows.  A very long text is one set like others and may be a
block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

GRAM, THRESHOLD, TREES, DEEPEST, RECALL, ALIKE = 5, (4, 5), 32, 8, 0.9999, 0.68
#: Classes and grams to a block; two blocks and their sets are in memory at once.
BLOCK, BLOCK_GRAMS = 512, 1 << 20
#: Pairs of classes looked at together.
PAIRS = 1 << 15
BROADCAST_ROWS, SALTS = 500_000, 8


def reach(similarity: np.ndarray | float, depth: int, trees: int = TREES) -> np.ndarray | float:
    """The chance that two sets share a prefix of ``depth`` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct gram hashes of each document, in order of document, and where
    each document's begin (and the end)."""
    words = C.Words(*C.text_bytes(texts))
    hashes, first, counts = words.hashes(), words.first, words.counts
    at = C.gram_starts(first, GRAM)
    found, doc = C.grams(hashes, GRAM)[at] if len(at) else np.zeros(0, np.uint64), words.doc()[at]
    for n in range(1, GRAM):
        few = np.flatnonzero(counts == n)
        if len(few):
            found, doc = np.append(found, C.grams(hashes, n)[first[:-1][few]]), np.append(doc, few)
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    found, doc = found[new], doc[new]
    return found, np.searchsorted(doc, np.arange(len(counts) + 1))


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums mod 2**64 of values between cuts."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[cuts[1:]] - total[cuts[:-1]]


def _name(found: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set."""
    return C.mix64(_sums(C.mix64(found), cuts)).view(np.int64), C.mix64(_sums(C.mix64(found ^ np.uint64(0x5851F42D4C957F2D)), cuts)).view(np.int64)


def _labels(found: np.ndarray, cuts: np.ndarray, trees: int) -> np.ndarray:
    """Each document's label in each tree."""
    rng = np.random.default_rng(5)
    factors = (rng.integers(0, 1 << 32, trees * DEEPEST, np.uint64) | np.uint64(1)).astype(np.uint32)
    shifts = rng.integers(0, 1 << 32, trees * DEEPEST, np.uint64).astype(np.uint32)
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(cuts) - 1, trees), np.uint64)
    full = np.flatnonzero(np.diff(cuts))
    if not len(full):
        return out
    starts = cuts[:-1][full]
    for k in range(trees * DEEPEST):
        least = np.minimum.reduceat(x * factors[k] + shifts[k], starts)
        out[full, k // DEEPEST] = out[full, k // DEEPEST] << np.uint64(8) | C.mix64(least) & np.uint64(255)
    return out


def sketch(docs: DataFrame, id: str = "doc_id", text: str = "text", trees: int = TREES) -> DataFrame:
    """``id``, ``node``, ``check`` (128 bits of the set), ``n`` and ``labels``."""
    rows = docs.select(F.col(id), C.text_of(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.chunks(batches):
            found, cuts = _sets(part.column(1))
            node, check = _name(found, cuts)
            labels = _labels(found, cuts, trees).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, labels.size + 1, trees, np.int32)), pa.array(labels.ravel()))
            yield C.record({"id": part.column(0), "node": node, "check": check, "n": np.diff(cuts).astype(np.int64), "labels": lists})

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)[id]}, node long, check long, n long, labels array<long>")


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node of its component, for every node
    of ``edges`` (a, b), by alternating large-star and small-star steps.

    Each step ties the neighbours of a node to the least of them, by a partial
    aggregation and a join, until a round changes nothing.  The joined side has
    a row for each node: it is broadcast while edges are few (counted); beyond
    that a node's neighbours are dealt over ``SALTS`` parts.
    """
    edges = C.durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before, count = None, edges.count()

    def met(rows: DataFrame, least: DataFrame) -> DataFrame:
        if 2 * count <= BROADCAST_ROWS:
            return rows.join(F.broadcast(least), "a")
        salted = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(salted, ["a", "_salt"]).drop("_salt")

    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = met(both, least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = met(large, down).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(down.select("a", F.col("m").alias("b")))
        edges = C.durable(small.distinct(), 2 * count)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, count = now, now[0]
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


_UNIT = ["key", "i", "j"]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole units of rows in order of unit, and where each begins (and the end)."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        cuts = _cuts(rows)
        if len(cuts) > 1:
            yield rows.slice(0, cuts[-1]).combine_chunks(), cuts
        held = rows.slice(cuts[-1])
    if held is not None:
        yield held.combine_chunks(), np.array([0, held.num_rows])


def _cuts(rows: pa.Table) -> np.ndarray:
    """Where units begin."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for name in _UNIT:
        x = rows[name].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as the rows of a matrix."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().view(np.uint64).reshape(len(flat), -1)


def _pairs(rows: pa.Table, cuts: np.ndarray, depth: int, deepest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates (positions of both) that units compare at this depth, by row."""
    labels, tree, block = _matrix(rows["labels"]), rows["tree"].to_numpy(), rows["block"].to_numpy()
    by_tree = np.ascontiguousarray(labels.T)
    across = rows["i"].to_numpy() != rows["j"].to_numpy()
    counts = np.repeat(cuts[1:], np.diff(cuts)) - np.arange(rows.num_rows) - 1
    total = np.cumsum(counts)

    def apart(a: np.ndarray, b: np.ndarray, d: int, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that share no d values in any tree (below their own, if given).

        Alike classes part ways with the first trees, so few are left for the others."""
        for t in range(len(by_tree)):
            shared = (by_tree[t][a] ^ by_tree[t][b]) >> np.uint64(64 - 8 * d) == 0
            if below is not None:
                shared &= below[a] > t
            if shared.any():
                a, b = a[~shared], b[~shared]
            if not len(a):
                break
        return a, b

    low = 0
    while low < len(counts):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + PAIRS, "right")))
        a = np.repeat(np.arange(low, high), counts[low:high])
        b = a + 1 + C.runs(counts[low:high])
        low = high
        meet = ~across[a] | (block[a] != block[b])
        a, b = apart(a[meet], b[meet], depth, tree)
        if not deepest:
            a, b = apart(a, b, depth + 1, None)
        alike = ((labels[a] ^ labels[b]).view(np.uint8).reshape(-1, 8 * labels.shape[1]) == 0).mean(1) >= ALIKE
        yield a[alike], b[alike]


def _candidates(units: DataFrame, depth: int, deepest: bool) -> DataFrame:
    """The rows of units that have a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _units(batches):
            some = np.zeros(rows.num_rows, bool)
            for a, b in _pairs(rows, cuts, depth, deepest):
                some[a] = some[b] = True
            yield from rows.filter(pa.array(some)).combine_chunks().to_batches()

    ordered = units.repartition(C.partitions(units.sparkSession), *_UNIT).sortWithinPartitions(*_UNIT, "node")
    return ordered.mapInArrow(run, units.schema)


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many grams each two sets share."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    columns, owner = (np.cumsum(counts > 1) - 1)[inverse[shared]], owner[shared]
    order = np.argsort(columns, kind="stable")
    columns, owner = columns[order], owner[order]
    common, width = np.zeros((m, m), np.float32), max(256, (1 << 22) // m)
    total = int(columns[-1]) + 1 if len(columns) else 0
    for low in range(0, total, width):
        i, j = np.searchsorted(columns, (low, low + width))
        dense = np.zeros((m, min(width, total - low)), np.float32)
        dense[owner[i:j], columns[i:j] - low] = 1
        common += dense @ dense.T
    return common.astype(np.int64)


def _similar(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Intersections and unions of candidate pairs."""
    if len(a) > 2 * len(sets):
        both = _common(sets)[a, b]
    else:
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    sizes = np.array([len(s) for s in sets])
    return both, sizes[a] + sizes[b] - both


def _tied(a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    """The least position that each of m is linked with, also through others."""
    tied = np.arange(m)
    while True:
        new = tied.copy()
        np.minimum.at(new, a, tied[b])
        np.minimum.at(new, b, tied[a])
        new = np.minimum(new, new[new])
        if (new == tied).all():
            return tied
        tied = new


_LINKS = pa.schema([("node", pa.int64()), ("tied", pa.int64()), ("links", pa.int64()), ("pairs", pa.int64()), ("stands_for", pa.list_(pa.float64()))])


def _verified(units: DataFrame, depth: int, deepest: bool, trees: int) -> DataFrame:
    """``node``, ``tied`` and ``links`` of each linked class of each unit; on one
    row of a unit its linked ``pairs`` and what they stand for by depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _units(batches):
            found = list(_pairs(rows, cuts, depth, deepest))
            a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
            at = np.searchsorted(a, cuts)
            node, weight, grams = rows["node"].to_numpy(), rows["weight"].to_numpy(), rows["grams"]
            out = []
            for u, low, p, q in zip(cuts[1:].tolist(), cuts[:-1].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                if p == q:
                    continue
                own, i, j = slice(low, u), a[p:q] - low, b[p:q] - low
                both, either = _similar(i, j, [np.frombuffer(x, np.uint64) for x in grams[own].to_pylist()])
                linked = THRESHOLD[1] * both >= THRESHOLD[0] * either
                i, j, alike = i[linked], j[linked], (both / either)[linked]
                if not len(i):
                    continue
                w = weight[own]
                links = np.bincount(i, w[j], u - low) + np.bincount(j, w[i], u - low)
                tied, some = node[own][_tied(i, j, u - low)], np.flatnonzero(links)
                for k in some.tolist():
                    out.append((int(node[low + k]), int(tied[k]), int(links[k]), 0, None))
                out[-1] = (*out[-1][:3], len(i), [float((1 / reach(alike, d, trees)).sum()) for d in range(1, DEEPEST + 1)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _LINKS, strict=True)], schema=_LINKS)

    ordered = units.repartition(C.partitions(units.sparkSession), *_UNIT).sortWithinPartitions(*_UNIT, "node")
    return ordered.mapInArrow(run, "node long, tied long, links long, pairs long, stands_for array<double>")


def _grams_of(docs: DataFrame, id: str, text: str, wanted: DataFrame) -> DataFrame:
    """``node`` and ``grams``, its packed set, of every wanted (node, copy_id)."""
    few = wanted.count() <= BROADCAST_ROWS
    hint = F.broadcast if few else lambda x: x
    rows = docs.select(F.col(id).alias("_id"), C.text_of(text).alias("_text"))
    some = rows.join(hint(wanted.select(F.col("copy_id").alias("_id")).distinct()), "_id", "left_semi")
    if not wanted.filter("copy_id is null").isEmpty():
        some = some.unionByName(rows.filter("_id is null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.chunks(batches, 0):
            found, cuts = _sets(part.column(0))
            node, _ = _name(found, cuts)
            full = np.flatnonzero(np.diff(cuts))
            seen, at = np.unique(node[full], return_index=True)
            yield C.record({"node": seen, "grams": pa.array([found[cuts[k] : cuts[k + 1]].tobytes() for k in full[at].tolist()], pa.binary())})

    found = some.select("_text").mapInArrow(run, "node long, grams binary").join(hint(wanted.select("node")), "node", "left_semi")
    return found.groupBy("node").agg(F.first("grams").alias("grams"))


def _level(docs: DataFrame, id: str, text: str, classes: DataFrame, depth: int, deepest: bool, trees: int) -> DataFrame:
    """Links of the pairs that first share a prefix at this depth."""
    keyed = classes.select("node", "n", F.posexplode("labels").alias("tree", "label"))
    keyed = keyed.withColumn("key", F.xxhash64("tree", F.shiftrightunsigned("label", 64 - 8 * depth)))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_GRAMS)).cast("int")
    runs = C.durable(keyed.groupBy("key").agg(F.count("*").alias("size"), blocks.alias("blocks")).filter("size > 1").select("key", "blocks"))
    members = keyed.select("node", "tree", "key").join(F.broadcast(runs) if runs.count() <= BROADCAST_ROWS else runs, "key")
    units = members.join(classes.select("node", "copy_id", "weight", "labels"), "node")
    units = units.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("key", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "tree", "block", "node", "copy_id", "weight", "labels")
    some = C.durable(_candidates(units, depth, deepest))
    grams = _grams_of(docs, id, text, C.durable(some.select("node", "copy_id").distinct()))
    return C.durable(_verified(some.drop("copy_id").join(grams, "node"), depth, deepest, trees))


def links(docs: DataFrame, classes: DataFrame, id: str = "doc_id", text: str = "text", trees: int = TREES, recall: float = RECALL) -> tuple[DataFrame, int, float]:
    """Links of the classes, the depth they were followed to, and the recall."""
    depth, found, measured = DEEPEST, None, 0.0
    while True:
        level = _level(docs, id, text, classes, depth, depth == DEEPEST, trees)
        found = level if found is None else found.unionByName(level)
        seen = found.agg(F.sum("pairs").alias("pairs"), F.sum(F.get("stands_for", depth - 1)).alias("all")).first()
        measured = seen.pairs / seen["all"] if seen.pairs else 0.0
        if measured >= recall or reach(THRESHOLD[0] / THRESHOLD[1], depth, trees) >= recall or depth == 1:
            return found, depth, measured
        depth -= 1


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """One row per document: ``id``; ``class_id``, the least id among those it
    is linked with directly or through others; ``copy_id``, the least id with
    the same set; ``n_links``, the other documents at the threshold or above.
    A document without words has its own id in both and no links."""
    rows = C.durable(sketch(docs, id, text, trees))
    classes = rows.filter("n > 0").groupBy("node", "check", "n").agg(F.min("id").alias("copy_id"), F.count("*").alias("weight"), F.first("labels").alias("labels"))
    classes = C.durable(classes)
    verified, _, _ = links(docs, classes, id, text, trees, recall)
    each = verified.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected(verified.select(F.col("node").alias("a"), F.col("tied").alias("b")))
    named = classes.drop("labels").join(parts, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = named.groupBy("label").agg(F.min("copy_id").alias("class_id"))
    named = named.join(heads, "label").join(each, "node", "left")
    named = named.select("node", "check", "n", "class_id", "copy_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.select("id", "node", "check", "n").join(named, ["node", "check", "n"], "left")
    own = F.col("n") == 0
    return out.select(F.col("id").alias(id), F.when(own, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(own, F.col("id")).otherwise(F.col("copy_id")).alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"))
