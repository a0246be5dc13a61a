"""Secret scan: fixed patterns plus a battery of randomness tests.

Three patterns give the base spans.  Beyond them, every run of 16 or more
characters of the base64 alphabets that holds letters and digits, or letters of
both cases, is a candidate.  Its encoding is inferred from its characters (hex,
single-case alphanumeric or base64), and three tests ask whether it could be
uniform over that alphabet: chi-squared, runs above and below the middle of the
alphabet, and lag-1 serial correlation.  Chi-squared is taken twice, over the
characters and over their kinds (digits, symbols, vowels and other letters, of
each case), as the first tells little of short runs.  The
Bonferroni-combined p-value is small for words, names and counters and uniform
for keys.

How small is too small depends on length: short pieces of ordinary text pass
such tests often, and text with numbers passes as single-case more often than as
base64.  So false discoveries are controlled in strata of encoding (single case
or base64) and length against decoys of the candidates' own kind: the words, names, numbers and dates
of a document, but no candidates, run together and cut into pieces of each
length in turn; a piece without a digit has its last one to four characters made
digits, as names with numbers have.  In each stratum, which counts a hundred
decoys of the other encoding among its own, the threshold is the lowest p at
which (share of decoys that pass) x (candidates) / (candidates that pass) is at
most ``FALSE_SHARE``; a stratum without such a threshold adds nothing.  Decoys
never reach over the end of a document, so thresholds do not depend on how rows
are batched.  Counts come from all documents; what reaches the driver is one
row per stratum and grid point, whatever the corpus.

The corpus is read twice, once for the counts and once for the spans.  Nothing
but the counts is shuffled, and no state is kept between tasks.

Null texts count as empty and have no spans.  Spans are code points, end
exclusive.  An added span never overlaps a base span.  Without decoys, as in an
empty table, nothing is added.  A very long text is handled whole, by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_RUN = 8, 16, 32, 16

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
#: Every assignment holds one of these, in lower case.
_STEMS = (b"passw", b"secret", b"token", b"api_key", b"apikey")

#: Lower bounds of the lengths of strata, of which there are as many for either
#: encoding, and the p-values tried as thresholds.
LENGTHS = (16, 20, 24, 32, 40, 64, 128)
STRATA = 2 * len(LENGTHS)
GRID = (0.001, 0.003, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5)
FALSE_SHARE = 0.01
#: Decoys of both encodings that count beside a stratum's own.
POOLED = 100

_INDEX = np.full(256, -1, np.int64)
for _i, _c in enumerate(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
    _INDEX[_c] = _i
_INDEX[ord("-")], _INDEX[ord("_")] = 62, 63
_RUN = _INDEX >= 0
#: The kind of each character: digit, symbol, vowel and other letter, by case.
_KIND = np.zeros(256, np.int64)
_KIND[list(b"-_+/")] = 1
for _base, _letters in ((2, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (4, b"abcdefghijklmnopqrstuvwxyz")):
    for _c in _letters:
        _KIND[_c] = _base + (bytes([_c | 32]) not in b"aeiou")
#: Characters of each kind in hex, single-case alphanumeric and base64; in the
#: first two, letters of either case count alike.
_KINDS_OF = {16: (10, 0, 2, 4, 0, 0), 36: (10, 0, 5, 21, 0, 0), 64: (10, 2, 5, 21, 5, 21)}
_LOWERED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _normal_tail(z: np.ndarray) -> np.ndarray:
    """P(Z >= z) for z >= 0 (Abramowitz-Stegun 26.2.17, error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.exp(-z * z / 2) / np.sqrt(2 * np.pi) * poly


def battery(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run: whether it is a candidate, its p-value and its stratum."""
    n, lengths = len(start), end - start
    owner = np.repeat(np.arange(n), lengths)
    chars = buf[np.repeat(start, lengths) + C.runs(lengths)]

    def has(flags: np.ndarray) -> np.ndarray:
        return np.bincount(owner[flags], minlength=n) > 0

    upper, lower = (chars >= 65) & (chars <= 90), (chars >= 97) & (chars <= 122)
    digit = (chars >= 48) & (chars <= 57)
    u, l, d, other = has(upper), has(lower), has(digit), has(~(upper | lower | digit))
    beyond_hex = has((upper & (chars > 70)) | (lower & (chars > 102)))
    candidate = d & (u | l) | u & l
    single = ~other & ~(u & l)
    hexed = single & d & (u | l) & ~beyond_hex
    size = np.where(hexed, 16, np.where(single, 36, 64))
    index = _INDEX[chars]
    # letters of either case first, digits after them, when the case is single
    folded = np.where(digit, np.where(hexed[owner], index - 52, index - 26), np.where(lower, index - 26, index) + np.where(hexed[owner], 10, 0))
    index = np.where((size == 64)[owner], index, folded)

    counts = np.bincount(owner * 64 + index, minlength=64 * n).reshape(n, 64).astype(float)
    chi = size / lengths * (counts**2).sum(1) - lengths
    spread = np.sqrt(2.0 * (size - 1) * (lengths - 1) / lengths)
    z_chi = (chi - (size - 1)) / spread
    p_chi = np.where(z_chi > 0, _normal_tail(np.abs(z_chi)), 1 - _normal_tail(np.abs(z_chi)))

    kind = _KIND[chars]
    kind = np.where((size == 64)[owner] | (kind < 4), kind, kind - 2)
    seen = np.bincount(owner * 6 + kind, minlength=6 * n).reshape(n, 6)
    share = np.array([_KINDS_OF[k] for k in (16, 36, 64)], float)[np.searchsorted((16, 36, 64), size)] / size[:, None]
    expected = np.maximum(share * lengths[:, None], 1e-9)
    free = (share > 0).sum(1) - 1
    chi = ((seen - expected) ** 2 / expected).sum(1)
    # Wilson and Hilferty's cube root
    z_kind = (np.cbrt(chi / free) - (1 - 2 / (9 * free))) / np.sqrt(2 / (9 * free))
    p_kind = np.where(z_kind > 0, _normal_tail(np.abs(z_kind)), 1 - _normal_tail(np.abs(z_kind)))

    high = index >= (size // 2)[owner]
    n1 = np.bincount(owner, weights=high, minlength=n)
    n0 = lengths - n1
    inner = np.ones(len(owner), bool)
    inner[np.cumsum(lengths) - lengths] = False
    turn = np.zeros(len(owner), bool)
    turn[1:] = high[1:] != high[:-1]
    seen = 1 + np.bincount(owner[turn & inner], minlength=n)
    both = n1 * n0
    mean = 1 + 2 * both / lengths
    var = np.maximum(2 * both * (2 * both - lengths) / (lengths**2 * np.maximum(lengths - 1, 1)), 1e-9)
    p_runs = np.where(both > 0, 2 * _normal_tail(np.abs(seen - mean) / np.sqrt(var)), 2.0 ** (1 - np.minimum(lengths, 60)))

    centred = index - (np.bincount(owner, weights=index, minlength=n) / lengths)[owner]
    power = np.maximum(np.bincount(owner, weights=centred**2, minlength=n), 1e-9)
    lag = np.zeros(len(owner))
    lag[1:] = centred[1:] * centred[:-1] * inner[1:]
    p_serial = 2 * _normal_tail(np.abs(np.bincount(owner, weights=lag, minlength=n) / power) * np.sqrt(lengths))
    stratum = np.where(size == 64, len(LENGTHS), 0) + np.maximum(np.searchsorted(LENGTHS, lengths, "right") - 1, 0)
    return candidate, np.minimum(1.0, 4 * np.minimum(np.minimum(p_chi, p_kind), np.minimum(p_runs, p_serial))), stratum


def _long_runs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every run of MIN_RUN or more characters."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = _RUN[buf]
    step = np.diff(inside)
    cuts = offs[1:-1]
    start = np.union1d(np.flatnonzero(step == 1), cuts[inside[cuts + 1] == 1] if len(cuts) else cuts)
    end = np.union1d(np.flatnonzero(step == -1), cuts[inside[cuts] == 1] if len(cuts) else cuts)
    keep = end - start >= MIN_RUN
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(offs, start, "right") - 1


def _base(raw: bytes, offs: np.ndarray, runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Per document: (start, kind, end) in bytes, sorted."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offs) - 1)]
    low, asked = raw.translate(_LOWERED), set()
    for stem in _STEMS:
        at = low.find(stem)
        while at >= 0:
            doc = int(np.searchsorted(offs, at, "right")) - 1
            asked.add(doc)
            at = low.find(stem, int(offs[doc + 1]))
    for doc in asked:
        for m in _ASSIGN.finditer(raw, offs[doc], offs[doc + 1]):
            if m.end(2) - m.start(2) >= MIN_ASSIGN:
                found[doc].append((m.start(), 0, m.end()))
    # whole runs of both other patterns lie inside one long run
    for s, e, doc in zip(*(x.tolist() for x in runs), strict=True):
        if raw.find(b"AKIA", s, e) >= 0:
            found[doc] += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(raw, s, e) if m.end() - m.start() >= MIN_ACCESS]
        if e - s >= MIN_HEX:
            found[doc] += [(m.start(), 2, m.end()) for m in _HEX.finditer(raw, s, e) if m.end() - m.start() >= MIN_HEX]
    return [sorted(x) for x in found]


def _decoys(buf: np.ndarray, offs: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of words and numbers that are not taken, and where decoys
    begin and end in them; each lies within one document."""
    plain = np.flatnonzero(_RUN[buf] & ~taken)
    first = np.searchsorted(plain, offs)
    starts, ends, turns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for low, size in zip(first[:-1].tolist(), np.diff(first).tolist(), strict=True):
        if size >= LENGTHS[0]:
            cuts = _cut(size % len(LENGTHS), size)
            starts.append(low + cuts[:-1])
            ends.append(low + cuts[1:])
            turns.append(np.arange(len(cuts) - 1) + size)
    chars, start, end, turn = buf[plain], np.concatenate(starts), np.concatenate(ends), np.concatenate(turns)
    digits = np.concatenate([[0], np.cumsum((chars >= 48) & (chars <= 57))])
    bare = digits[end] == digits[start]
    many = (1 + turn % 4)[bare]
    at = np.repeat(end[bare] - many, many) + C.runs(many)
    chars[at] = 48 + C.mix64(chars[at] + np.repeat(turn[bare] * 256, many).astype(np.uint64)) % np.uint64(10)
    return chars, start, end


@lru_cache(maxsize=64)
def _cuts(turn: int, bits: int) -> np.ndarray:
    """Ends of pieces of all strata's lengths in turn, up to 2**bits and more."""
    lengths = np.roll(LENGTHS, -turn)
    return np.concatenate([[0], np.cumsum(np.tile(lengths, (1 << bits) // sum(LENGTHS) + 1))])


def _cut(turn: int, size: int) -> np.ndarray:
    cuts = _cuts(turn, size.bit_length())
    return cuts[: np.searchsorted(cuts, size, "right")]


def survey(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts per stratum and grid point: candidates and decoys with p above it."""

    def add(counts: np.ndarray, counted: np.ndarray, p: np.ndarray, stratum: np.ndarray) -> None:
        np.add.at(counts, (stratum[counted], np.searchsorted(GRID, p[counted], "left")), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, STRATA, len(GRID) + 1), np.int64)
        for part in C.chunks(batches, 0):
            buf, offs = C.text_bytes(part.column(0))
            start, end, _ = _long_runs(buf, offs)
            inside = np.zeros(len(buf) + 1, np.int32)
            if len(start):
                candidate, p, stratum = battery(buf, start, end)
                add(total[0], candidate, p, stratum)
                np.add.at(inside, start[candidate], 1)
                np.add.at(inside, end[candidate], -1)
            chars, start, end = _decoys(buf, offs, np.cumsum(inside[:-1]) > 0)
            if len(start):
                add(total[1], *battery(chars, start, end))
        s, g = np.indices(total.shape[1:])
        yield C.record({"stratum": s.ravel().astype(np.int32), "above": g.ravel().astype(np.int32), "candidates": total[0].ravel(), "decoys": total[1].ravel()})

    rows = docs.select(C.text_of(text).alias("_text")).mapInArrow(run, "stratum int, above int, candidates long, decoys long")
    return rows.groupBy("stratum", "above").agg(F.sum("candidates").alias("candidates"), F.sum("decoys").alias("decoys"))


def thresholds(docs: DataFrame, text: str = "text", false_share: float = FALSE_SHARE) -> list[float]:
    """The p-value from which a candidate counts, per stratum (2: none does)."""
    counts = np.zeros((2, STRATA, len(GRID) + 1))
    for r in survey(docs, text).collect():  # at most STRATA * (len(GRID) + 1) rows
        counts[:, r.stratum, r.above] = r.candidates, r.decoys
    passing = counts[:, :, ::-1].cumsum(2)[:, :, ::-1][:, :, 1:]
    of = counts.sum(2)
    # the share of decoys that pass, drawn to that of both encodings
    both = lambda x: np.tile(x.reshape(2, len(LENGTHS), -1).sum(0), (2, 1))
    pooled = (both(passing[1]) + 1) / (both(of[1]) + 1)
    share = (passing[1] + POOLED * pooled) / (of[1][:, None] + POOLED)
    good = (passing[0] > 0) & (share * of[0][:, None] <= false_share * passing[0])
    out = [GRID[int(np.argmax(x))] if x.any() else 2.0 for x in good]
    return out


def _spans(part: pa.Array, levels: Sequence[float]) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int, int]]], np.ndarray]:
    buf, offs = C.text_bytes(part)
    found = _base(buf.tobytes(), offs, runs := _long_runs(buf, offs))
    start, end, doc = runs
    if len(start):
        candidate, p, stratum = battery(buf, start, end)
        hit = candidate & (p > np.asarray(levels)[stratum])
        for s, e, i in zip(start[hit].tolist(), end[hit].tolist(), doc[hit].tolist(), strict=True):
            if not any(s < y and x < e for x, _, y in found[i]):
                found[i].append((s, 3, e))
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
    return buf, offs, [sorted(x) for x in found], points


def scan(docs: DataFrame, levels: Sequence[float], text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``spans``, an array of (start, kind, end)."""
    levels = list(levels)
    kept = docs.select(*[F.col(k) for k in keep])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.chunks(batches, len(keep)):
            _, offs, found, points = _spans(part.column(len(keep)), levels)
            rows = [[{"start": int(points[s] - points[o]), "kind": k, "end": int(points[e] - points[o])} for s, k, e in x] for x, o in zip(found, offs.tolist(), strict=False)]
            yield C.record({k: part.column(i) for i, k in enumerate(keep)} | {"spans": pa.array(rows, kind)})

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["spans array<struct<start: long, kind: int, end: long>>"])
    return docs.select(*[F.col(k) for k in keep], C.text_of(text).alias("_text")).mapInArrow(run, schema)


def redact(docs: DataFrame, levels: Sequence[float], text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mark``; null stays null."""
    levels, at = list(levels), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.chunks(batches, at):
            buf, offs, found, _ = _spans(part.column(at), levels)
            texts = part.column(at).to_pylist()
            for i, spans in enumerate(found):
                if spans:
                    raw, out, last = buf[offs[i] : offs[i + 1]].tobytes(), [], 0
                    for s, _, e in spans:
                        s, e = s - int(offs[i]), e - int(offs[i])
                        if s >= last:
                            out += [raw[last:s], mark.encode()]
                        last = max(last, e)
                    texts[i] = b"".join([*out, raw[last:]]).decode()
            columns = {f.name: part.column(k) for k, f in enumerate(part.schema)}
            yield C.record(columns | {text: pa.array(texts, part.schema.field(at).type)})

    return docs.mapInArrow(run, docs.schema)


def spans_string(kinds: Sequence[int], spans: str = "spans"):
    """kind:start:end of the spans of these kinds, by start then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    chosen = F.filter(F.col(spans), lambda x: x["kind"].isin(list(kinds)))
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    rows = scan(docs, thresholds(docs))
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts[:3], F.sha2(spans_string((0, 1, 2)).cast("binary"), 256).alias("base_sha256"), spans_string((0, 1, 2, 3)).alias("spans"), counts[3])
