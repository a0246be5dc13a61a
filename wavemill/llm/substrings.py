"""Substring dedup by fixed-block anchors.

A window is ``WINDOW`` words in a row.  A word goes when a window over it also
starts in a document with a smaller id.

1. Each document is cut into non-overlapping blocks of ``BLOCK`` words.  Any
   window holds a whole block of the document it is in, as 2 * BLOCK - 1 words
   always do.  So if two documents share a window, a block of each is found by
   a rolling probe of BLOCK words in the other.  Blocks and probes meet under
   their hash; a hash that is a block somewhere and is in two documents or more
   is a hit in all of them.
2. Hits are extended: every window over a hit is hashed whole (96 bits) and
   meets its equals, of which all but those of the least document go.  Windows
   that overlap or touch make up the maximal repeats, so what they cover is
   exactly what the repeats cover.
3. Covered words are cut from the texts.

What is shuffled is packed: a batch of documents sends each bucket one row of
byte arrays (document ids, entries of each, 48-bit hashes), about 6 bytes for
each word in step 1, and about 12 for each window over a hit in step 2.  Within
a document equal hashes are sent once, so a hot line or passage sends one entry
a document; buckets are by hash, and a bucket's work is sorting.  No pairs are
formed.  Only documents with a hit are read again with their texts: where their
ids are at most ``BROADCAST_ROWS`` (counted) by a broadcast semi-join, beyond
that all documents are.

Null texts are empty.  A null id is not smaller than any other, nor any other
smaller than it: nothing of such a row goes.  Rows of equal id do not remove
each other's words; rows of equal id and text come out alike.  Ids are whole
numbers, as the least keeps a passage; a column of another type is an error.
No documents give no rows.  A very long text is handled whole, by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW, BLOCK = 13, 7
BROADCAST_ROWS = 1_000_000

#: One row of packed entries: those of document ids[k] are the next counts[k].
#: Ids are ascending; their steps and the counts are compressed.
_PACKED = "bucket int, ids binary, counts binary, high binary, low binary"
_FIELDS = pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("high", pa.binary()), ("low", pa.binary())])


def _place(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document; as ``_place_column``."""
    return np.mod(ids ^ (ids >> 17), buckets)


def _place_column(id: str, buckets: int) -> Column:
    return F.expr(f"cast(pmod(`{id}` ^ shiftright(`{id}`, 17), {buckets}L) as int)")


def _pack(bucket: np.ndarray, ids: np.ndarray, high: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    """Rows of packed entries, one for each bucket."""
    order = np.lexsort((ids, bucket))
    bucket, ids, high, low = bucket[order], ids[order], high[order], low[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-2))
    rows = []
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        new = np.flatnonzero(np.diff(ids[i:j], prepend=ids[i] - 1))
        rows.append({"bucket": int(bucket[i]), "ids": C.squeeze(np.diff(ids[i:j][new], prepend=0)), "counts": C.squeeze(np.diff(np.append(new, j - i)).astype(np.uint32)), "high": high[i:j].tobytes(), "low": low[i:j].tobytes()})
    return pa.RecordBatch.from_pylist(rows, _FIELDS)


def _unpack(packed: pa.Table | pa.RecordBatch, high: type, low: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, high and low part of every entry."""

    def joined(name: str, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(x, kind) for x in packed.column(name).to_pylist()] or [np.zeros(0, kind)])

    counts = np.concatenate([C.unsqueeze(x, np.uint32) for x in packed.column("counts").to_pylist()] or [np.zeros(0, np.uint32)])
    return np.repeat(_ids(packed.column("ids")), counts), joined("high", high), joined("low", low)


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The documents of packed rows, one row after the other."""
    return np.concatenate([np.cumsum(C.unsqueeze(x, np.int64)) for x in column.to_pylist()] or [np.zeros(0, np.int64)])


def _once(ids: np.ndarray, keys: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """One index for each distinct (document, key); where ``first``, if any."""
    both = _names(ids, keys)
    order = np.argsort(both, kind="stable") if first is None else np.lexsort((~first, both))
    return order[np.flatnonzero(np.diff(both[order], prepend=both[order[:1]] + np.uint64(1)))] if len(order) else order


class _Texts:
    """Words, hashes and ids of a batch of documents long enough for a window."""

    def __init__(self, ids: pa.Array, texts: pa.Array) -> None:
        self.words = C.Words(*C.text_bytes(texts))
        self.hashes, self.first = self.words.hashes(), self.words.first
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of n words, and their documents, where windows fit."""
        usable = self.known & (self.words.counts >= WINDOW)
        counts = np.where(usable, self.words.counts - n + 1, 0)
        return np.repeat(self.first[:-1], counts) + C.runs(counts), np.repeat(np.arange(len(counts)), counts)

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, documents and 47-bit keys of all rolling BLOCK-word probes."""
        at, doc = self.grams(BLOCK)
        return at, doc, C.grams(self.hashes, BLOCK)[at] >> np.uint64(17) if len(at) else np.zeros(0, np.uint64)


def _anchors(docs: DataFrame, id: str, text: str, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.chunks(batches):
            texts = _Texts(part.column(0), part.column(1))
            at, doc, keys = texts.probes()
            if len(at):
                block = (at - texts.first[doc]) % BLOCK == 0
                ids = texts.ids[doc]
                one = _once(ids, keys, block)
                sent = keys[one] << np.uint64(1) | block[one]
                yield _pack((keys[one] % np.uint64(buckets)).astype(np.int32), ids[one], (sent >> np.uint64(16)).astype(np.uint32), (sent & np.uint64(0xFFFF)).astype(np.uint16))

    return docs.select(F.col(id).cast("long"), C.text_of(text).alias("_text")).mapInArrow(run, _PACKED)


def _hits(buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(packed: pa.Table) -> pa.Table:
        ids, high, low = _unpack(packed, np.uint32, np.uint16)
        sent = high.astype(np.uint64) << np.uint64(16) | low
        keys, block = sent >> np.uint64(1), (sent & np.uint64(1)).astype(bool)
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
        sizes = np.diff(np.append(cuts, len(order)))
        good = (np.minimum.reduceat(ids[order], cuts) < np.maximum.reduceat(ids[order], cuts)) & np.logical_or.reduceat(block[order], cuts)
        hit = order[np.repeat(good, sizes)]
        return pa.Table.from_batches([_pack(_place(ids[hit], buckets).astype(np.int32), ids[hit], high[hit], low[hit])], _FIELDS)

    return run


def _names(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """One number for each (document, key)."""
    return C.mix64(keys ^ C.mix64(ids.view(np.uint64)))


def _among(names: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which names are in an ordered array."""
    if not len(ordered):
        return np.zeros(len(names), bool)
    return ordered[np.minimum(np.searchsorted(ordered, names), len(ordered) - 1)] == names


def _windows(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, packed: pa.Table) -> pa.Table:
        ids, high, low = _unpack(packed, np.uint32, np.uint16)
        there = np.sort(_names(ids, (high.astype(np.uint64) << np.uint64(16) | low) >> np.uint64(1)))
        del ids, high, low
        out = []
        for part in C.chunks(docs.select(["id", "text"]).combine_chunks().to_batches()):
            texts = _Texts(part.column(0), part.column(1))
            at, doc, keys = texts.probes()
            hit = at[_among(_names(texts.ids[doc], keys), there)]
            over = np.zeros(len(texts.hashes) + BLOCK, np.int64)
            np.add.at(over, np.maximum(hit - (WINDOW - BLOCK), 0), 1)
            np.add.at(over, hit + 1, -1)
            starts, doc = texts.grams(WINDOW)
            chosen = np.cumsum(over)[starts] > 0
            starts, doc = starts[chosen], doc[chosen]
            if len(starts):
                one, two = C.grams(texts.hashes, WINDOW)[starts], C.grams(texts.hashes, WINDOW, second=True)[starts]
                keep = _once(texts.ids[doc], one)
                out.append(_pack((one[keep] % np.uint64(buckets)).astype(np.int32), texts.ids[doc][keep], one[keep], (two[keep] >> np.uint64(32)).astype(np.uint32)))
        return pa.Table.from_batches(out, _FIELDS)

    return run


def _repeats(buckets: int) -> Callable[[pa.Table], pa.Table]:
    def run(packed: pa.Table) -> pa.Table:
        ids, one, two = _unpack(packed, np.uint64, np.uint32)
        order = np.lexsort((ids, two, one))
        ids, one, two = ids[order], one[order], two[order]
        new = np.ones(len(ids), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        cuts = np.flatnonzero(new)
        goes = ids > np.repeat(ids[cuts], np.diff(np.append(cuts, len(ids))))
        return pa.Table.from_batches([_pack(_place(ids[goes], buckets).astype(np.int32), ids[goes], one[goes], two[goes])], _FIELDS)

    return run


_RESULT = "id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _result(ids: pa.Array, words: C.Words, gone: np.ndarray | None, with_text: bool) -> pa.RecordBatch:
    raw, first = words.buf.tobytes(), words.first.tolist()
    digests, kept, removed = [], [], np.zeros(len(first) - 1, np.int64)
    start, end = words.start.tolist(), words.end.tolist()
    offs = words.offsets.tolist()
    total = None if gone is None else np.concatenate([[0], np.cumsum(gone)])
    for k in range(len(first) - 1):
        i, j = first[k], first[k + 1]
        removed[k] = 0 if total is None else total[j] - total[i]
        pieces = raw[offs[k] : offs[k + 1]].split() if not removed[k] else [raw[start[w] : end[w]] for w in range(i, j) if not gone[w]]
        text = b" ".join(pieces)
        digests.append(hashlib.sha256(text).hexdigest())
        kept.append(text.decode() if with_text else None)
    return C.record({"id": ids, "n_words": words.counts.astype(np.int64), "n_removed": removed, "kept_sha256": pa.array(digests, pa.string()), "kept_text": pa.array(kept, pa.string())})


def _cut(with_text: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, packed: pa.Table) -> pa.Table:
        ids, there, _ = _unpack(packed, np.uint64, np.uint32)
        there = np.sort(_names(ids, there))
        out = []
        for part in C.chunks(docs.select(["id", "text"]).combine_chunks().to_batches()):
            texts = _Texts(part.column(0), part.column(1))
            at, doc = texts.grams(WINDOW)
            cover = np.zeros(len(texts.hashes) + WINDOW + 1, np.int64)
            if len(at):
                hit = at[_among(_names(texts.ids[doc], C.grams(texts.hashes, WINDOW)[at]), there)]
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + WINDOW, -1)
            out.append(_result(part.column(0), texts.words, np.cumsum(cover)[: len(texts.hashes)] > 0, with_text))
        return pa.Table.from_batches(out, _RESULT_FIELDS)

    return run


_RESULT_FIELDS = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _whole(with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.chunks(batches):
            yield _result(part.column(0), C.Words(*C.text_bytes(part.column(1))), None, with_text)

    return run


def _holders(packed: pa.Table) -> pa.Table:
    """The documents of one place that have a hit."""
    return pa.table({"id": np.unique(_ids(packed["ids"]))})


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """``id``, ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept_text`` (the
    kept words joined by one space; null unless ``with_text``) of every row."""
    kind = docs.select(id).schema[0].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"ids must be whole numbers, not {kind.simpleString()}")
    buckets = C.partitions(docs.sparkSession)
    rows = docs.select(F.col(id).cast("long").alias("id"), C.text_of(text).alias("text"))
    hits = C.durable(_anchors(docs, id, text, buckets).groupBy("bucket").applyInArrow(_hits(buckets), _PACKED))
    holders = C.durable(hits.select("bucket", "ids").groupBy("bucket").applyInArrow(_holders, "id long"))
    if holders.count() <= BROADCAST_ROWS:
        some = rows.join(F.broadcast(holders), "id", "left_semi")
        rest = rows.join(F.broadcast(holders), "id", "left_anti")
    else:
        some, rest = rows.filter("id is not null"), rows.filter("id is null")
    some = some.withColumn("bucket", _place_column("id", buckets))
    windows = some.groupBy("bucket").cogroup(hits.groupBy("bucket")).applyInArrow(_windows(buckets), _PACKED)
    repeats = C.durable(windows.groupBy("bucket").applyInArrow(_repeats(buckets), _PACKED))
    cut = some.groupBy("bucket").cogroup(repeats.groupBy("bucket")).applyInArrow(_cut(with_text), _RESULT)
    return cut.unionByName(rest.mapInArrow(_whole(with_text), _RESULT)).withColumnRenamed("id", id)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(C.table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")
