"""Benchmark decontamination by SimHash windows and multi-index Hamming search.

Words are runs of ASCII letters and digits and of other characters but general
punctuation, lower-cased, so that case, punctuation and line breaks do not hide
a passage.  A benchmark item of n words is compared with windows of n words of
a document (the whole document, if it is shorter).  Items and windows are bags
of word 5-grams (of all their words, if they have fewer), each weighted by the
inverse of how many items of the benchmark hold it, and have a 64-bit SimHash
over them.

The fingerprints of the items are indexed by ``BLOCKS`` blocks of 16 bits with
radii that add up to RADIUS + 1 - BLOCKS.  If two fingerprints differ in at
most ``RADIUS`` bits, some block of theirs differs in at most its radius, so
probing every block with all values within its radius finds every item within
RADIUS (multi-index hashing, general pigeonhole).  Where a block has fewer
values than a probe would try, the values are compared instead.  What is found
and has the window's size is verified by the exact weighted Jaccard similarity
of the two bags; ``SIMILARITY`` or more is a leak.  At a similarity of just 0.8
two sets have a cosine of 0.89, and fingerprints differ in 9.7 bits give or
take 2.9, so RADIUS misses 1 in 500 there and next to nothing above.

Every item-sized window counts, at whatever offset.  Windows that can reach
SIMILARITY with no item at all are not fingerprinted, by an exact bound that
knows of no item: the weight of a window's 5-grams that the benchmark holds is
at least what it shares with any item, and must be SIMILARITY of the least item
of that size.  Of all others the fingerprint is taken, and only the blocks name
the items that it is compared with.  So a row depends on its document and its
item alone.

The benchmark is a stated query set: its rows and bytes are counted, and up to
``ITEM_ROWS`` items of ``ITEM_BYTES`` are indexed once and broadcast; a larger
one is worked off in slices, each against all documents.  Weights are those of
the whole benchmark: for slices, the 5-grams of several items are counted first
and sent with each (all others weigh 1).

Null or wordless texts and items match nothing, and an empty table on either
side gives no rows.  Ids may be of any type; a null id, of a document or an
item, comes out as null.  Repeated documents are judged one by one; repeated
items each give a row.  Very long texts are handled one window after another.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

GRAM, SIMILARITY, RADIUS, BLOCKS, ITEM_ROWS, ITEM_BYTES = 5, 0.8, 18, 4, 20_000, 32 << 20
#: Windows that are fingerprinted together.
WINDOWS = 2048

_KEEP = np.zeros(256, bool)
_KEEP[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_KEEP[128:] = True


def words_in(column: pa.Array) -> C.Words:
    """The words of a text column."""
    buf, offs = C.text_bytes(pc.utf8_lower(column))
    body = _KEEP[buf]
    # general punctuation (U+2000-206F) and the no-break space part words too
    for lead, more, length in ((0xE2, (0x80, 0x81), 3), (0xC2, (0xA0,), 2)):
        at = np.flatnonzero(buf[: 1 - length] == lead) if len(buf) >= length else np.zeros(0, np.int64)
        at = at[np.isin(buf[at + 1], more)]
        for k in range(length):
            body[at + k] = False
    return C.Words(np.where(body, buf, np.uint8(32)), offs)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each hash."""
    bytes_ = C.mix64(hashes + np.uint64(1)).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(bytes_, axis=1).astype(float) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    """The fingerprints of rows of 64 sums."""
    return np.packbits(sums > 0, axis=-1).view(np.uint64).ravel()


#: The radius of each block; with one more each they add up to RADIUS + 1.
RADII = [(RADIUS + 1 + k) // BLOCKS - 1 for k in range(BLOCKS)]


def _flips(radius: int) -> np.ndarray:
    """All 16-bit values with at most ``radius`` bits set."""
    every = np.arange(1 << 16, dtype=np.uint16)
    return every[np.bitwise_count(every) <= radius]


class Index:
    """The items of a benchmark whose grams have ``gram`` words, to be probed."""

    def __init__(self, gram: int, kept: Sequence[tuple[Any, np.ndarray]], counts: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.gram, self.ids = gram, [i for i, _ in kept]
        self.sizes = np.array([len(g) for _, g in kept], np.int64)
        every, owner = np.concatenate([g for _, g in kept]), np.repeat(np.arange(len(kept)), self.sizes)
        order = np.lexsort((owner, every))
        every, owner = every[order], owner[order]
        new = np.ones(len(every), bool)
        new[1:] = (every[1:] != every[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        # each gram of each item once, by gram: which item, how often
        holder, times = owner[at], np.diff(np.append(at, len(every)))
        self.keys, first = np.unique(every[at], return_index=True)
        n = np.diff(np.append(first, len(at)))
        self.weighed, held = counts or (self.keys, n)
        self.weights = 1 / held
        self.key_weights = self.weight(self.keys)
        key = np.repeat(np.arange(len(self.keys)), n)
        self.total = np.bincount(holder, self.key_weights[key] * times, len(kept))
        order = np.argsort(holder, kind="stable")
        cuts = np.searchsorted(holder[order], np.arange(len(kept) + 1))
        #: The keys of each item, in order, and how often it has them.
        self.bags = [(key[order[i:j]], times[order[i:j]]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        #: Sizes of items; the least weight that one of a size needs, and that one of it or more does.
        enough = SIMILARITY * self.total - 1e-9
        self.lengths, of = np.unique(self.sizes, return_inverse=True)
        needs = np.full(len(self.lengths), np.inf)
        np.minimum.at(needs, of, enough)
        self.by_length = dict(zip(self.lengths.tolist(), needs.tolist(), strict=True))
        self.least = np.minimum.accumulate(needs[::-1])[::-1]
        self.prints = np.concatenate([_pack((_bits(g) * self.weight(g)[:, None]).sum(0)[None]) for _, g in kept])
        self.blocks = [self._block(b) for b in range(BLOCKS)]

    def _block(self, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The values of a block in order, where each begins, and the items."""
        values = self.prints.view(np.uint16).reshape(-1, 4)[:, b]
        order = np.argsort(values, kind="stable")
        found, first = np.unique(values[order], return_index=True)
        return found, np.append(first, len(order)), order

    def weight(self, grams: np.ndarray) -> np.ndarray:
        """The benchmark weight of each gram; 1 for those it doesn't hold."""
        if not len(self.weighed):
            return np.ones(len(grams))
        at = np.minimum(np.searchsorted(self.weighed, grams), len(self.weighed) - 1)
        return np.where(self.weighed[at] == grams, self.weights[at], 1.0)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, item) of all that differ in at most RADIUS bits."""
        pairs = []
        for b, (values, first, items) in enumerate(self.blocks):
            asked, of = np.unique(prints.view(np.uint16).reshape(-1, 4)[:, b], return_inverse=True)
            flips = _FLIPS[RADII[b]]
            if len(values) <= len(flips):
                q, v = np.nonzero(np.bitwise_count(asked[:, None] ^ values[None, :]) <= RADII[b])
            else:
                probes = asked[:, None] ^ flips[None, :]
                at = np.minimum(np.searchsorted(values, probes), len(values) - 1)
                q, k = np.nonzero(values[at] == probes)
                v = at[q, k]
            n = first[v + 1] - first[v]
            held = np.repeat(q, n) * len(self.ids) + items[np.repeat(first[v], n) + C.runs(n)]
            # from distinct block values back to the fingerprints that have them
            order = np.argsort(of, kind="stable")
            begin = np.searchsorted(of[order], np.arange(len(asked) + 1))
            q, item = held // len(self.ids), held % len(self.ids)
            n = begin[q + 1] - begin[q]
            pairs.append(order[np.repeat(begin[q], n) + C.runs(n)] * len(self.ids) + np.repeat(item, n))
        found = np.unique(np.concatenate(pairs))
        at, item = found // len(self.ids), found % len(self.ids)
        close = np.bitwise_count(prints[at] ^ self.prints[item]) <= RADIUS
        return at[close], item[close]

    def leaks(self, grams: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """item -> (similarity, first word, words) of its best window; of equal
        ones the first."""
        best: dict[int, tuple[float, int, int]] = {}
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        known = self.keys[at] == grams
        own = np.concatenate([[0.0], np.cumsum(np.where(known, self.key_weights[at], 0.0))])
        if own[-1] < self.least[0]:
            return best
        weights = np.concatenate([[0.0], np.cumsum(self.weight(grams))])
        fits = np.minimum(self.sizes, len(grams))
        for size in np.unique(np.minimum(self.lengths, len(grams))).tolist():
            # of this many grams, some must be the benchmark's for any item to be reached
            held = own[size:] - own[:-size]
            starts = np.flatnonzero(held >= self.needed(size, len(grams)))
            if not len(starts):
                continue
            found = []
            for start, k in self._close(grams, starts, size):
                if fits[k] == size:
                    both = min(held[start], self.total[k])
                    found.append((-both / (weights[start + size] - weights[start] + self.total[k] - both), start, k))
            for bound, start, k in sorted(found):
                score = best.get(k, (0.0, 0, 0))
                if -bound < max(SIMILARITY, score[0]) - 1e-9:
                    continue
                exact = self._similarity(at[start : start + size][known[start : start + size]], k, weights[start + size] - weights[start])
                if exact >= SIMILARITY - 1e-12 and (exact > score[0] + 1e-12 or exact > score[0] - 1e-12 and start < score[1]):
                    best[k] = (exact, start, size)
        return best

    def needed(self, size: int, most: int) -> float:
        """The least weight that an item compared with windows of ``size`` grams
        needs of one, in a document of ``most`` grams."""
        if size < most:
            return self.by_length[size]
        return self.least[np.searchsorted(self.lengths, size)]

    def _close(self, grams: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
        """(start, item) of windows whose fingerprint is near an item's: only
        the blocks name items."""
        i = 0
        while i < len(starts):
            j = int(np.searchsorted(starts, starts[i] + WINDOWS))
            low, part = int(starts[i]), starts[i:j]
            span = grams[low : int(part[-1]) + size]
            sums = np.zeros((len(span) + 1, 64))
            np.cumsum(_bits(span) * self.weight(span)[:, None], axis=0, out=sums[1:])
            at, item = self.near(_pack(sums[part - low + size] - sums[part - low]))
            yield from zip(part[at].tolist(), item.tolist(), strict=True)
            i = j

    def _similarity(self, window: np.ndarray, item: int, weight: float) -> float:
        """Exact weighted Jaccard of a window's bag, given the keys of it that
        the benchmark holds and its weight, and an item's."""
        keys, times = np.unique(window, return_counts=True)
        own, most = self.bags[item]
        i = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        shared = own[i] == keys
        common = float((np.minimum(times[shared], most[i[shared]]) * self.key_weights[keys[shared]]).sum())
        return common / (weight + self.total[item] - common)


_FLIPS = {r: _flips(r) for r in set(RADII)}

#: Counts of grams that several items hold, by words to a gram: sorted grams, counts.
Counts = dict[int, tuple[np.ndarray, np.ndarray]]


def _grams_by_size(items: Sequence[tuple[Any, str]]) -> dict[int, list[tuple[Any, np.ndarray]]]:
    """Items with their grams, by words to a gram (GRAM, unless items are shorter)."""
    words = words_in(pa.array([t for _, t in items], pa.string()))
    hashes, kept = words.hashes(), defaultdict(list)
    for k, (i, _) in enumerate(items):
        own = hashes[words.first[k] : words.first[k + 1]]
        if len(own):
            kept[min(GRAM, len(own))].append((i, C.grams(own, min(GRAM, len(own)))))
    return kept


def indexes(items: Sequence[tuple[Any, str]], counts: Counts | None = None) -> list[Index]:
    """One index for each number of words to a gram."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return [Index(n, x, None if counts is None else counts.get(n, none)) for n, x in sorted(_grams_by_size(items).items())]


def _counts(items: DataFrame) -> Counts:
    """How many items of the whole benchmark hold each gram that several hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.chunks(batches, 0):
            for n, kept in _grams_by_size([(None, t) for t in part.column(0).to_pylist()]).items():
                found = np.concatenate([np.unique(g) for _, g in kept]).view(np.int64)
                yield C.record({"n": pa.array(np.full(len(found), n, np.int32)), "h": pa.array(found)})

    several = items.select("t").mapInArrow(run, "n int, h long").groupBy("n", "h").count().filter("count > 1").toArrow()
    n, h, times = (several.column(k).to_numpy() for k in range(3))
    h = np.ascontiguousarray(h, np.int64).view(np.uint64)
    order = np.argsort(h)
    n, h, times = n[order], h[order], times[order]
    return {int(k): (h[n == k], times[n == k]) for k in np.unique(n)}


def find_leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item it leaks: ``id``, ``item_id``, similarity
    (of the best window), first_word and n_words of that window."""
    items = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).cast("string").alias("t")).filter("t is not null")
    size = items.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("bytes")).first()
    n = max(-(-size.rows // ITEM_ROWS), -(-size.bytes // ITEM_BYTES), 1)
    counts = _counts(items) if n > 1 else None
    out = None
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        chosen = sorted(((r.i, r.t) for r in part.collect()), key=lambda x: (x[0] is None, str(x[0]), x[1]))  # a slice
        found = _probe(docs, docs.sparkSession.sparkContext.broadcast(indexes(chosen, counts)), id, text, dict(items.dtypes)["i"])
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("i", item_id)


def _probe(docs: DataFrame, shared: Broadcast, id: str, text: str, item_kind: str) -> DataFrame:
    rows = docs.select(F.col(id).alias("id"), C.text_of(text).alias("_text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.chunks(batches):
            words = words_in(part.column(1))
            hashes, doc, found = words.hashes(), words.doc(), []
            for index in shared.value:
                grams, at = C.grams(hashes, index.gram), C.gram_starts(words.first, index.gram)
                for i in np.unique(doc[at[np.isin(grams[at], index.keys)]]).tolist():
                    own = grams[words.first[i] : words.first[i + 1] - index.gram + 1]
                    found += [(i, index.ids[k], score, start, size + index.gram - 1) for k, (score, start, size) in sorted(index.leaks(own).items())]
            if found:
                rows_, items_, score, start, size = zip(*found, strict=True)
                yield C.record({"id": part.column(0).take(pa.array(rows_)), "i": _column(items_, item_kind), "similarity": pa.array(score, pa.float64()), "first_word": pa.array(start, pa.int64()), "n_words": pa.array(size, pa.int64())})

    return rows.mapInArrow(run, f"id {kind}, i {item_kind}, similarity double, first_word long, n_words long").withColumnRenamed("id", id)


def _column(values: Sequence[Any], kind: str) -> pa.Array:
    """Item ids as Spark hands over their type."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string(), "double": pa.float64(), "float": pa.float32(), "date": pa.date32()}
    return pa.array(values, kinds.get(kind))


def op10_benchmark_leaks(spark, sf_dir: str) -> DataFrame:
    leaks = find_leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return leaks.withColumn("similarity", F.round("similarity", 6))
