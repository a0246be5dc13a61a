"""Periodic runs of words, found by a suffix automaton, and their collapse.

A run is a stretch of consecutive words whose smallest period is q (words q
apart are identical), of at least max(``LEAST``, ``TIMES`` * q) words, that no
neighbouring word extends with that period.

1. Only words that a run could hold are looked at.  Each word of a run of a
   period up to ``NEAR`` has an equal word that near; each ``GRAM`` words of a
   run of a longer period (``GRAM`` <= q + 1) are in the document three times,
   as the run has four periods.  Stretches of such words hold every run whole,
   so runs of a stretch are runs of the document.  This only narrows the text:
   it says nothing about periods.
2. The suffix automaton of a stretch is built over its words.  States are
   taken from the longest down, so a state's end positions are those of the
   states that link to it and its own: the smaller ordered sets are merged
   into the largest.  Neighbours e < f that are new in a state of length m (no
   state that links to it has both) and no more than m apart are the ends of two equal, overlapping or touching
   factors: a square.  As the state is the first that has both, its longest
   word reaches back as far as period f - e does, and as they are neighbours,
   the period is the smallest.  The square is extended to the right, and a
   (start, period) is one run.

Everything is exact: words are compared as bytes.  Rows are independent, so
nothing is shuffled.  A document is handled whole by one task; the automaton
takes about a kilobyte a word of its longest stretch.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Words and periods of a run at least.
LEAST, TIMES = 6, 4
#: See step 1; GRAM is at most NEAR + 2 and grams are in a run TIMES - 1 times.
NEAR, GRAM = 6, 8
#: States this short cannot show the square of a run: a run's longest square leaves out one period.
SHORTEST = min(max(LEAST, TIMES * q) - q for q in range(1, LEAST + 1))
#: End positions to a block of an ordered set.
BLOCK = 512

Run = tuple[int, int, int]
_OUT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Ends:
    """An ordered set of end positions, in blocks."""

    __slots__ = ("blocks", "heads", "size")

    def __init__(self, x: int) -> None:
        self.blocks, self.heads, self.size = [[x]], [x], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> None:
        k = max(bisect_right(self.heads, x) - 1, 0)
        block = self.blocks[k]
        insort(block, x)
        self.heads[k] = block[0]
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks[k : k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.heads.insert(k + 1, block[BLOCK])

    def around(self, x: int) -> tuple[int | None, int | None]:
        """The members just before and after the member x."""
        k = bisect_right(self.heads, x) - 1
        block = self.blocks[k]
        i = bisect_left(block, x)
        before = block[i - 1] if i else self.blocks[k - 1][-1] if k else None
        after = block[i + 1] if i + 1 < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else None
        return before, after


def automaton(words: list) -> tuple[list[int], list[int], list[int]]:
    """Of each state of the suffix automaton: the length of its longest word,
    its suffix link, and the end position that it adds (-1 for a clone)."""
    length, link, end, step = [0], [-1], [-1], [{}]
    last = 0
    for i, word in enumerate(words):
        state, at = len(length), last
        length.append(i + 1)
        link.append(0)
        end.append(i)
        step.append({})
        while at >= 0 and word not in step[at]:
            step[at][word] = state
            at = link[at]
        if at >= 0:
            target = step[at][word]
            if length[target] == length[at] + 1:
                link[state] = target
            else:
                clone = len(length)
                length.append(length[at] + 1)
                link.append(link[target])
                end.append(-1)
                step.append(dict(step[target]))
                link[target] = link[state] = clone
                while at >= 0 and step[at].get(word) == target:
                    step[at][word] = clone
                    at = link[at]
        last = state
    return length, link, end


def runs_of(words: list) -> list[Run]:
    """The runs (start, length, period) of a list of words, in order."""
    length, link, end = automaton(words)
    below: dict[int, list[Ends]] = {}
    found: dict[tuple[int, int], int] = {}
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        size = length[state]
        if size < SHORTEST:
            break
        sets = below.pop(state, [])
        if end[state] >= 0:
            sets.append(Ends(end[state]))
        ends = max(sets, key=lambda s: s.size)
        new = {e: k for k, s in enumerate(sets) if s is not ends for e in s}
        for e in new:
            ends.add(e)
        for e in new:
            before, after = ends.around(e)
            for low, high in ((before, e), (e, after)):
                if low is None or high is None or high - low > size or new.get(low) == new.get(high):
                    continue
                period, start = high - low, low - size + 1
                if size + period < max(LEAST, TIMES * period) or (start, period) in found:
                    continue
                while high + 1 < len(words) and words[high + 1] == words[high + 1 - period]:
                    high += 1
                found[start, period] = high - start + 1
        if length[link[state]] >= SHORTEST:
            below.setdefault(link[state], []).append(ends)
    return sorted((start, n, period) for (start, period), n in found.items())


def stretches(words: C.Words) -> np.ndarray:
    """Starts and ends of the stretches that can hold a run, as two columns."""
    hashes, n = words.hashes(), len(words.start)
    if n < LEAST:
        return np.zeros((0, 2), np.int64)
    own = C.mix64(hashes + words.doc().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # equal within a document only
    some = np.zeros(n + 1, bool)
    for d in range(1, NEAR + 1):
        same = own[d:] == own[:-d]
        some[d:n] |= same
        some[: n - d] |= same
    grams = C.grams(own, GRAM)
    if len(grams):
        _, place, counts = np.unique(grams, return_inverse=True, return_counts=True)
        at = np.flatnonzero(counts[place] >= TIMES - 1)
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + GRAM, -1)
        some |= np.cumsum(cover) > 0
    some[n] = False
    cut = np.zeros(n + 1, bool)
    cut[words.first] = True
    begins = np.flatnonzero(some[:n] & (cut[:n] | ~np.concatenate([[False], some[: n - 1]])))
    ends = np.flatnonzero(some[:n] & (cut[1:] | ~some[1:])) + 1
    long = ends - begins >= LEAST
    return np.stack([begins[long], ends[long]], 1)


def _found(part: pa.Array) -> tuple[np.ndarray, dict[int, list[Run]]]:
    """The number of words of each text, and the runs of those that have any."""
    buf, offsets = C.text_bytes(part)
    words = C.Words(buf, offsets)
    found: dict[int, list[Run]] = {}
    for low, high in stretches(words).tolist():
        begin, at = int(words.start[low]), words.start[low:high]
        raw, ids = buf[begin : int(words.end[high - 1])].tobytes(), {}
        codes = [ids.setdefault(raw[s:e], len(ids)) for s, e in zip((at - begin).tolist(), (words.end[low:high] - begin).tolist(), strict=True)]
        runs = runs_of(codes)
        if runs:
            doc = int(np.searchsorted(words.first, low, "right")) - 1
            shift = low - int(words.first[doc])
            found.setdefault(doc, []).extend((start + shift, n, period) for start, n, period in runs)
    return words.counts, found


def _collapsed(text: bytes, runs: list[Run]) -> str:
    """The words that no run holds after its first period, joined by a space."""
    words = text.split()  # on the same six blanks
    if runs:
        gone = np.zeros(len(words), bool)
        for start, n, period in runs:
            gone[start + period : start + n] = True
        words = [w for w, out in zip(words, gone.tolist(), strict=True) if not out]
    return b" ".join(words).decode()


def periodic_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", change: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Of every row: ``id``, ``n_words``, ``runs`` (start, length and period, by
    start and period) and ``collapsed``, the words that no run holds after its
    first period, joined by one space.

    ``change`` may replace a row's words, given its id, before they are looked
    at.  Null and empty texts have no words, no runs and an empty text; ids may
    be null or repeated, as each row is answered for itself; other columns are
    not read.  An empty table gives an empty table.
    """
    rows = docs.select(F.col(id), C.text_of(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.chunks(batches):
            texts = [x.as_buffer().to_pybytes() for x in part.column(1)]
            column = part.column(1)
            if change:
                for k, key in enumerate(part.column(0).to_pylist()):
                    words = texts[k].split()
                    new = change(key, words)
                    if new is not words:
                        texts[k] = b" ".join(new)
                column = pa.array(texts, pa.large_binary()).cast(pa.large_string())
            counts, found = _found(column)
            listed = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found.get(k, ())] for k in range(len(texts))]
            runs = pa.array(listed, pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])))
            yield C.record({"id": part.column(0), "n_words": counts.astype(np.int64), "runs": runs, "collapsed": pa.array([_collapsed(t, found.get(k, [])) for k, t in enumerate(texts)], pa.string())})

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)[id]}, {_OUT}").withColumnRenamed("id", id)


def looped(id: object, words: list[bytes]) -> list[bytes]:
    """The words with a tail that repeats, for one id in ten (by crc32)."""
    h = zlib.crc32(str(id).encode())
    if id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(C.table(spark, sf_dir, "documents"), change=looped)
    order = F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"]))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    found = found.withColumn("_best", F.array_max(order))
    length, period = F.col("_best.length"), -F.col("_best.col3")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.col2")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
