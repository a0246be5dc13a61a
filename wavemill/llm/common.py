"""Shared pieces of the corpus operators: vectorised tokens and durable frames.

Word-level operators see hundreds of words per document, so a row per word
would cost far more than the arithmetic on it.  They run over Arrow batches
instead: the text buffer of a batch is one byte array, and words, word hashes
and hashes of word n-grams come from whole-array NumPy operations on it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these (space and 0x09-0x0D).
BLANKS = b" \t\n\x0b\x0c\r"

_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True

#: Odd multipliers of the polynomial hashes (mod 2**64).
_WORD_BASE = 0x9E3779B97F4A7C15
_GRAM_BASE = 0xD1342543DE82EF95
_GRAM_BASE_2 = 0xAF251AF3B0F025B5

#: Text bytes handled at once; a longer document is handled alone, whole.
CHUNK_BYTES = 2 << 20


class _Powers:
    """Powers of a base and of its inverse mod 2**64, extended on demand."""

    def __init__(self, base: int) -> None:
        self.base = np.uint64(base)
        self.inverse = np.uint64(pow(base, -1, 1 << 64))
        self.size = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n + n // 8, 1 << 16)
            up = np.full(self.size, self.base, np.uint64)
            up[0] = 1
            down = np.full(self.size, self.inverse, np.uint64)
            down[0] = 1
            self.up = np.multiply.accumulate(up)
            self.down = np.multiply.accumulate(down)
        return self.up, self.down


_powers = {b: _Powers(b) for b in (_WORD_BASE, _GRAM_BASE, _GRAM_BASE_2)}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit affects every output bit."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a run of documents, in order.

    ``start``/``end`` are byte positions in ``buf``; the words of document i
    are ``first[i]`` to ``first[i + 1]``.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray) -> None:
        self.buf, self.offsets = buf, offsets
        n = len(buf)
        body = ~_BLANK[buf]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = body[:-1]
        self.start = np.flatnonzero(body & (~before | edge[:-1]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = body[1:]
        self.end = np.flatnonzero(body & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The document index of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes; ``lower`` folds A-Z first."""
        n = len(self.buf)
        up, down = _powers[_WORD_BASE].upto(n + 1)
        buf = self.buf
        if lower:
            buf = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        return mix64((total[self.end] - total[self.start]) * down[self.start])


def grams(hashes: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """A hash of every n consecutive word hashes (document bounds ignored)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = _powers[_GRAM_BASE_2 if second else _GRAM_BASE].upto(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum((mix64(hashes) if second else hashes) * up[: len(hashes)], out=total[1:])
    return mix64((total[n:] - total[:-n]) * down[: len(hashes) - n + 1])


def gram_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Positions at which n words of one document start."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(first[:-1], counts) + within


def runs(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, joined."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null as empty) and its offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), o - o[0]
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def chunks(batches: Iterable[pa.RecordBatch], text: int = 1, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose text column holds about ``size`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = text_bytes(batch.column(text))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def record(columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


_ZSTD = pa.Codec("zstd", compression_level=3)


def squeeze(x: np.ndarray, ordered: bool = False) -> bytes:
    """A compressed array; the length of its bytes comes first.

    Bytes of equal weight are put together, as the high ones of counts and
    small steps are mostly zero.  ``ordered``: steps are kept, not values.
    """
    x = np.ascontiguousarray(x).ravel()
    if ordered:
        x = np.diff(x, prepend=x.dtype.type(0))
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() if len(x) else b""
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def unsqueeze(x: bytes, kind: type, ordered: bool = False) -> np.ndarray:
    raw = np.frombuffer(_ZSTD.decompress(x[8:], int.from_bytes(x[:8], "little")), np.uint8)
    size = np.dtype(kind).itemsize
    values = np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(kind).ravel()
    return np.cumsum(values, dtype=values.dtype) if ordered else values


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; where
    that is unset (as in tests), one in the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


#: Drops the shuffle files of a query when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows to a file of a kept frame whose rows are counted.
FILE_ROWS = 1 << 15


def durable(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The frame computed once and kept in the shared folder.

    Cuts the lineage, and survives the loss of executors.  The shuffle files it
    took are dropped as soon as it is kept, as nothing can ask for them again.
    ``rows``: about how many rows its last step reads, where that is known; it is
    then kept in no more files than those rows need, as executors start child
    processes for each file they make (Hadoop's local files without its native
    library), and a partition of a few rows is not worth a task.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        return df.select("*").checkpoint()  # a query is asked how it ends when it is made
    finally:
        spark.conf.set(_CLEAN, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text column for word operators: null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
