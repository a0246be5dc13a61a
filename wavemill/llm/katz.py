"""LM scoring by Katz backoff.

A model of ``order`` words (three in the query) over lower-cased words, with an
end token after each text and a start history for each order before it.  With
h = u g a history of k - 1 words, g without its first, r = c(h, w) in training,

    p(w | h) = d(r) r / c(h)         for r > 0
             = alpha(h) p(w | g)     else (alpha is 1 for an unseen h)
    p(w)     = d1(c) c / N           for c = c(w) > 0
             = what the others leave for all unseen words together

d is the Good-Turing discount of each order in Katz's form for counts up to
``SMALL``, from the order's counts of counts.  Larger counts are discounted by
``LARGE`` only, so that every history leaves some mass; where the counts of
counts are too few for a discount between 0 and 1, half a count is taken off.
alpha(h) is exact: what h leaves, divided by the mass that the shorter history
gives to the words not seen after h.

All texts are tokenised whole, once, over NumPy arrays; what moves is packed.

1. Documents are dealt over groups of about ``GROUP_BYTES`` of text, whatever
   the cluster.  Each group becomes codes of its own words, by falling
   frequency, and is kept so; its words and their training counts go to buckets
   by word, which sum them: the unigram table, a row for each bucket and group.
2. For each order from two on, each group sends its distinct n-grams and their
   training counts, with the count and history's count of each one's shorter
   n-gram, to a bucket by history.  There r, c(h) and the sums for alpha(h) are
   known, as all n-grams of a history are together, and go back to the group.
   A seen n-gram's shorter one is seen too, so its probability needs no backoff.
3. Counts of counts are summed between orders; at the end each group scores its
   documents from the answers of all orders.

A history with at least 1/``SHARE`` of all tokens (so at most ``SHARE`` of
them) and ``LEAST`` occurrences is dealt by n-gram instead, so that no bucket
has to take all of "the"; the few sums for its alpha are added over buckets.
A history is 56 bits, and an n-gram 40 bits more within its history.  The
n-grams of an order move in ``ROUNDS`` turns, each with a part of the buckets.

All tables grow with the corpus and are kept as partitioned, checkpointed
frames; only counts of counts and the frequent histories reach the driver.

A null text is empty: one token, the end.  A row with a null id is scored, and
trains; ids may be of any type.  Repeated rows each train and are each scored,
and neither they nor rows without an id meet in one group.  No documents give
no rows.  A very long text is one of its group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .common import squeeze as _pack
from .common import unsqueeze as _unpack

SMALL, LARGE, SHARE, LEAST = 5, 1 - 1e-5, 2048, 10_000
#: Words of an n-gram in the query; bytes of text to a group.
ORDER, GROUP_BYTES = 3, 20 << 20
#: Turns in which n-grams move, so that not all are on the way at once.
ROUNDS = 2
#: Tokens of a group that are scored together.
PART = 1 << 17
END, START = np.uint64(0xE0D0E0D0E0D0E0D1), np.uint64(0x5747A127B0B5EED3)

#: The bits of a history's key.
_HISTORY = ~np.uint64(255)

_DOC_FIELDS = ["ids", "held", "sizes", "codes", "ranks"]
#: A row of a bucket's words (bucket >= 0), or of a group's documents.
_FIRST = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), *[(f, pa.binary()) for f in _DOC_FIELDS]])
_WORDS = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])
_GRAM_FIELDS = ["h", "h_grams", "w", "counts", "lower", "above", "full"]
_GRAMS = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), *[(f, pa.binary()) for f in _GRAM_FIELDS]])
#: Answers of order k, for each bucket and group (g = -1: statistics).
_ANSWER_FIELDS = ["words", "counts", "above", "open_h", "stats", "heavy_h", "heavy_stats", "nr", "often"]
_ANSWERS = pa.schema([("k", pa.int32()), ("bucket", pa.int32()), ("g", pa.int32()), *[(f, pa.binary()) for f in _ANSWER_FIELDS]])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in schema)


def discounts(nr: np.ndarray) -> np.ndarray:
    """d(0..SMALL), d(0) being that of larger counts; nr[r] has counts of counts."""
    out = np.full(SMALL + 1, LARGE)
    last = (SMALL + 1) * nr[SMALL + 1] / nr[1] if nr[1] else 1.0
    for r in range(1, SMALL + 1):
        d = ((r + 1) * nr[r + 1] / (r * nr[r]) - last) / (1 - last) if nr[r] and last < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Unigrams:
    """Discounted unigram probabilities from the training counts of counts."""

    def __init__(self, tokens: int, types: int, nr: np.ndarray) -> None:
        self.tokens, self.types, self.d = tokens, types, discounts(nr)
        small = sum(r * nr[r] * (1 - self.d[r]) for r in range(1, SMALL + 1))
        large = tokens - sum(r * nr[r] for r in range(1, SMALL + 1))
        self.unseen = (small + large * (1 - LARGE)) / tokens if tokens else 1.0

    def p(self, counts: np.ndarray) -> np.ndarray:
        counts = counts.astype(float)
        d = self.d[np.where(counts > SMALL, 0, counts).astype(int)]
        return np.where(counts > 0, d * counts / max(self.tokens, 1), self.unseen)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1.0) / (self.tokens + self.types + 1.0))


def _order(keys: np.ndarray) -> np.ndarray:
    """A stable ascending order of 64-bit keys.

    Keys are sorted with their places in the low bits, which is several times
    as fast as an indirect sort; the few that differ in those bits alone are
    put right afterwards.
    """
    n = len(keys)
    bits = np.uint64(max(1, n.bit_length()))
    packed = keys >> bits
    packed <<= bits
    packed |= np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).view(np.int64)
    found = keys[order]
    wrong = np.flatnonzero(found[1:] < found[:-1])
    if len(wrong):
        high = packed >> bits
        for i in np.unique(np.searchsorted(high, high[wrong])).tolist():
            j = int(np.searchsorted(high, high[i], "right"))
            order[i:j] = order[i:j][np.argsort(keys[order[i:j]], kind="stable")]
    return order


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, keys ascending, and which each key is."""
    order = _order(keys)
    found = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = found[1:] != found[:-1]
    of = np.empty(len(keys), np.int32)
    of[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[new], of


def _to_bytes(column: pa.Array) -> bytes:
    """A column as an Arrow stream."""
    sink = pa.BufferOutputStream()
    batch = pa.record_batch({"id": column})
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _count_words(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Words of a group to the buckets, and its documents as codes."""

    def run(docs: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        words_of, sizes = [], []
        for part in C.chunks(docs.to_batches()):
            found = C.Words(*C.text_bytes(part.column(1)))
            counts = found.counts
            w = np.full(len(found.start) + len(counts), END, np.uint64)
            w[np.arange(len(found.start)) + found.doc()] = found.hashes(lower=True)
            words_of.append(w)
            sizes.append((counts + 1).astype(np.uint32))
        w, sizes, held, g = np.concatenate(words_of), np.concatenate(sizes), docs["held_out"].to_numpy(), docs["g"][0].as_py()
        del words_of
        w = C.mix64(w)  # so that words in order are in order of bucket
        at, of = _distinct(w)
        words, times = w[at], np.bincount(of)
        counts = np.bincount(of, weights=np.repeat(~held, sizes), minlength=len(at)).astype(np.int64)
        ranked = np.argsort(-times, kind="stable")
        rank = np.empty(len(at), np.uint32)
        rank[ranked] = np.arange(len(at), dtype=np.uint32)
        cuts = np.searchsorted(_bucket(words, buckets), np.arange(buckets + 1))
        rows = [{"bucket": b, "g": g, "words": _pack(words[i:j], True), "counts": _pack(counts[i:j])} for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
        ids = docs["id"]
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        rows.append({"bucket": -1, "g": g, "ids": _to_bytes(ids), "held": held.tobytes(), "sizes": _pack(sizes), "codes": _pack(rank[of]), "ranks": _pack(ranked.astype(np.uint32))})
        return pa.Table.from_pylist(rows, _FIRST)

    return run


def _sum_words(least: int) -> Callable[[pa.Table], pa.Table]:
    """Each row with its words' totals, and one row (g = -1) of statistics:
    tokens, types and counts of counts; and frequent words with counts."""

    def run(packed: pa.Table) -> pa.Table:
        words = [_unpack(x, np.uint64, True) for x in packed["words"].to_pylist()]
        counts = np.concatenate([_unpack(x, np.int64) for x in packed["counts"].to_pylist()])
        every = np.concatenate(words)
        at, of = _distinct(every)
        each, total = every[at], np.zeros(len(at), np.int64)
        np.add.at(total, of, counts)
        cuts, bucket = np.cumsum([0, *map(len, words)]), packed["bucket"][0].as_py()
        rows = [{"bucket": bucket, "g": g, "words": _pack(w, True), "counts": _pack(total[of[i:j]])} for g, w, i, j in zip(packed["g"].to_pylist(), words, cuts, cuts[1:], strict=False)]
        often = (total >= least) & (total * SHARE >= total.sum())
        rows.append({"bucket": bucket, "g": -1, "words": _pack(each[often], True), "counts": _pack(np.concatenate([[total.sum(), (total > 0).sum()], np.bincount(np.minimum(total, SMALL + 2), minlength=SMALL + 3)[: SMALL + 2], total[often]]).astype(np.int64))})
        return pa.Table.from_pylist(rows, _WORDS)

    return run


def _start(k: int) -> np.uint64:
    """The history of a text's first word in order k."""
    return C.mix64(np.array([START + np.uint64(k)]))[0]


def _next(w: np.ndarray, gram: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """History and n-gram of every token in order k, from the n-gram in order k - 1."""
    h = np.empty_like(gram)
    h[1:] = gram[:-1]
    h[first] = _start(k)
    return h, C.mix64(C.mix64(h) + w)


def _keys(h: np.ndarray, gram: np.ndarray, heavy: np.ndarray, buckets: int) -> np.ndarray:
    """Where n-grams go: the key of their history, whose high bits say the
    bucket.  A frequent history has a key in each bucket, chosen by n-gram."""
    keys = C.mix64(h) & _HISTORY
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
        often = np.flatnonzero(heavy[at] == h)
        keys[often] = _heavy_key(h[often], _bucket(gram[often], buckets), buckets)
    return keys


def _heavy_key(h: np.ndarray, bucket: np.ndarray | int, buckets: int) -> np.ndarray:
    """The key of a frequent history in a bucket."""
    low = (np.asarray(bucket).astype(np.uint64) << np.uint64(32)) + np.uint64(buckets - 1)
    return (low // np.uint64(buckets) << np.uint64(32)) + C.mix64(h) // np.uint64(4 * buckets) & _HISTORY


class _Level:
    """The distinct n-grams of one order in a group, in the order they are sent:
    by history's key and n-gram."""

    def __init__(self, h: np.ndarray, gram: np.ndarray, heavy: np.ndarray, buckets: int) -> None:
        at, of = _distinct(gram)
        keys = _keys(h[at], gram[at], heavy, buckets)
        order = _order(keys)
        self.keys = keys[order]
        del keys
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.of = place[of]  # of each token
        del of, place
        self.first = at[order]  # a token of each
        del at, order
        new = np.ones(len(self.keys), bool)
        new[1:] = self.keys[1:] != self.keys[:-1]
        self.hs, self.history = np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - 1
        bounds = np.arange(buckets + 1)
        self.bounds = np.searchsorted(_bucket(self.keys, buckets), bounds)
        self.h_bounds = np.searchsorted(self.hs, self.bounds)


class _Group:
    """Tokens of a group with what is known of each in every order so far:
    count and history's count or, if it is to be scored, log10 of its
    probability, by token; known words and base scores by document."""

    def __init__(self, docs: pa.Table, answers: pa.Table, scored: bool, buckets: int, uni: Unigrams, heavies: list[np.ndarray], ds: list[np.ndarray], alphas: list[np.ndarray]) -> None:
        row = docs.to_pylist()[0]
        self.ids, self.held, self.sizes = row["ids"], np.frombuffer(row["held"], bool), _unpack(row["sizes"], np.uint32)
        code = _unpack(row["ranks"], np.uint32)[_unpack(row["codes"], np.uint32)]
        ks = answers["k"].to_numpy()
        counted = sorted((x["bucket"], x["words"], x["counts"]) for x in answers.filter(pa.array(ks == 1)).select(["bucket", "words", "counts"]).to_pylist())
        words = np.concatenate([_unpack(x[1], np.uint64, True) for x in counted])
        counts = np.concatenate([_unpack(x[2], np.int64) for x in counted])
        self.w = words[code]
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.begins = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.gram = self.w
        if scored:
            self.known, self.base, self.log = self.per_doc((counts > 0)[code]), self.per_doc(uni.base(counts)[code]), np.log10(uni.p(counts))[code]
        else:
            self.count, self.above = counts[code], np.full(len(self.w), uni.tokens, np.int64)
        del row, code, words, counts, counted
        for k, heavy, d, heavy_alpha in zip(range(2, len(ds) + 2), heavies, ds, alphas, strict=False):
            h, self.gram = _next(self.w, self.gram, self.begins, k)
            level = _Level(h, self.gram, heavy, buckets)
            r, ch, la = np.zeros(len(level.keys), np.int64), np.zeros(len(level.hs), np.int64), np.zeros(len(level.hs))
            for x in answers.filter(pa.array(ks == k)).to_pylist():
                b = x["bucket"]
                low = level.h_bounds[b]
                r[level.bounds[b] : level.bounds[b + 1]] = _unpack(x["counts"], np.int64)
                ch[low : level.h_bounds[b + 1]] = _unpack(x["above"], np.int64)
                if not scored:
                    continue
                la[low + _unpack(x["open_h"], np.int32, True)] = np.log10(alpha(_unpack(x["stats"], np.float64).reshape(-1, SMALL + 3), d))
            if len(heavy):
                hs = h[level.first[level.hs]]
                at = np.minimum(np.searchsorted(heavy, hs), len(heavy) - 1)
                often = heavy[at] == hs
                la[often] = heavy_alpha[at[often]]
            del h
            if not scored:
                self.count, self.above = r[level.of], ch[level.history][level.of]
                continue
            la[ch == 0] = 0
            for low in range(0, len(level.of), PART):  # so that no array of all tokens is made on the way
                part = slice(low, low + PART)
                of, log = level.of[part], self.log[part]
                count, history = r[of], level.history[of]
                own = np.log10(d[np.where(count > SMALL, 0, count)] * np.maximum(count, 1) / np.maximum(ch[history], 1))
                log[:] = np.where(count > 0, own, la[history] + log)
            del level, r, ch, la

    def per_doc(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=x, minlength=len(self.held))


def _send(k: int, turn: int, buckets: int, uni: Unigrams, heavies: list[np.ndarray], ds: list[np.ndarray], alphas: list[np.ndarray]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The n-grams of order k of a group, to the buckets whose turn it is."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _GRAMS.empty_table()
        g = docs["g"][0].as_py()
        group = _Group(docs, answers, False, buckets, uni, heavies, ds, alphas)
        h, gram = _next(group.w, group.gram, group.begins, k)
        del group.w, group.gram
        level = _Level(h, gram, heavies[k - 2], buckets)
        del h
        counts = np.bincount(level.of, weights=~group.held[group.doc], minlength=len(level.keys)).astype(np.uint32)
        lower, above = group.count[level.first], group.above[level.first[level.hs]]
        h_grams, keys = np.diff(np.append(level.hs, len(level.keys))).astype(np.uint32), level.keys[level.hs]
        # what is frequent in all is so in some group, which sends it whole
        often = (counts > 0) & (counts.astype(np.int64) * SHARE >= counts.sum())
        # the high five bytes of each n-gram
        w = np.ascontiguousarray(gram[level.first].view(np.uint8).reshape(-1, 8)[:, 3:])
        rows = []
        for b, (i, j, p, q) in enumerate(zip(level.bounds, level.bounds[1:], level.h_bounds, level.h_bounds[1:], strict=False)):
            if j > i and b % ROUNDS == turn:
                rows.append({"bucket": b, "g": g, "h": _pack(keys[p:q], True), "h_grams": _pack(h_grams[p:q]), "w": w[i:j].tobytes(), "counts": _pack(counts[i:j]), "lower": _pack(lower[i:j]), "above": _pack(above[p:q]), "full": _pack(gram[level.first[i:j][often[i:j]]])})
        return pa.Table.from_pylist(rows, _GRAMS)

    return run


def _sum_grams(k: int, buckets: int, uni: Unigrams, d: np.ndarray | None, heavy: np.ndarray, heavy_counts: np.ndarray, least: int) -> Callable[[pa.Table], pa.Table]:
    """The answers to each group, and one row (g = -1) of statistics.

    An answer has r of each n-gram sent, c(h) of each history, and what alpha
    needs for each history with an unseen n-gram of that group.
    """

    def run(packed: pa.Table) -> pa.Table:
        each = lambda name, kind, ordered=False: [_unpack(x, kind, ordered) for x in packed[name].to_pylist()]
        bucket, h_grams = packed["bucket"][0].as_py(), each("h_grams", np.uint32)
        hs = np.concatenate(each("h", np.uint64, True))
        h_at, h_of = _distinct(hs)  # of each history sent
        keys, runs = hs[h_at], np.concatenate(h_grams)
        history = np.repeat(h_of, runs)  # of each n-gram sent
        wide = np.zeros((len(history), 8), np.uint8)
        wide[:, 3:] = np.frombuffer(b"".join(packed["w"].to_pylist()), np.uint8).reshape(-1, 5)
        w = wide.view(np.uint64).ravel()
        at, name = _distinct(C.mix64(w ^ C.mix64(keys)[history]))
        history = history[at]
        r = np.bincount(name, weights=np.concatenate(each("counts", np.uint32)), minlength=len(at)).astype(np.int64)
        lower = np.concatenate(each("lower", np.int64))[at]
        above = np.repeat(np.concatenate(each("above", np.int64)), runs)[at]
        p = uni.p(lower) if d is None else d[np.where(lower > SMALL, 0, lower)] * lower / np.maximum(above, 1)
        del lower, above, hs
        ch = np.bincount(history, weights=r, minlength=len(keys)).astype(np.int64)
        heavy_keys = _heavy_key(heavy, bucket, buckets) if len(heavy) else heavy
        of_heavy = np.argsort(heavy_keys)
        which = np.searchsorted(heavy_keys, keys, sorter=of_heavy) if len(heavy) else np.zeros(len(keys), np.int64)
        which = of_heavy[np.minimum(which, len(heavy) - 1)] if len(heavy) else which
        is_heavy = heavy_keys[which] == keys if len(heavy) else np.zeros(len(keys), bool)
        if len(heavy):
            ch[is_heavy] = heavy_counts[which[is_heavy]]

        stats = np.zeros((len(keys), SMALL + 3))  # c(h), p of seen words, larger counts, types with r = 1..SMALL
        stats[:, 0] = ch
        stats[:, 1] = np.bincount(history, weights=p * (r > 0), minlength=len(keys))
        stats[:, 2] = np.bincount(history, weights=r * (r > SMALL), minlength=len(keys))
        for i in range(1, SMALL + 1):
            stats[:, 2 + i] = np.bincount(history, weights=r == i, minlength=len(keys))

        rows, at_gram, at_h = [], 0, 0
        for g, n in zip(packed["g"].to_pylist(), h_grams, strict=True):
            mine, found = name[at_gram : at_gram + int(n.sum())], h_of[at_h : at_h + len(n)]
            at_gram, at_h = at_gram + len(mine), at_h + len(n)
            open_ = np.zeros(len(n), bool)
            open_[np.repeat(np.arange(len(n)), n)[r[mine] == 0]] = True
            open_ = np.flatnonzero(open_ & (ch[found] > 0) & ~is_heavy[found]).astype(np.int32)
            rows.append({"k": k, "bucket": bucket, "g": g, "counts": _pack(r[mine]), "above": _pack(ch[found]), "open_h": _pack(open_, True), "stats": _pack(stats[found[open_]])})
        own = _pack(heavy[which[is_heavy]]) if len(heavy) else _pack(heavy)
        rows.append({"k": k, "bucket": bucket, "g": -1, "heavy_h": own, "heavy_stats": _pack(stats[is_heavy]), "nr": _pack(np.bincount(np.minimum(r, SMALL + 2), minlength=SMALL + 3)[: SMALL + 2].astype(np.int64))})
        often = np.flatnonzero((r >= least) & (r * SHARE >= uni.tokens))
        full = np.unique(np.concatenate(each("full", np.uint64)))
        known = np.searchsorted(full, w[at[often]])  # the least with these high bytes
        rows[-1]["often"] = _pack(np.stack([full[known], r[often].astype(np.uint64)]))
        return pa.Table.from_pylist(rows, _ANSWERS)

    return run


def alpha(stats: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Backoff weights of histories from their sums."""
    kept = stats[:, 2] * LARGE + (stats[:, 3:] * d[1:] * np.arange(1, SMALL + 1)).sum(1)
    return (1 - kept / stats[:, 0]) / (1 - stats[:, 1])


def _finish(buckets: int, uni: Unigrams, heavies: list[np.ndarray], ds: list[np.ndarray], alphas: list[np.ndarray], id_type: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The scores of a group's documents."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("id", id_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})
        group = _Group(docs, answers, True, buckets, uni, heavies, ds, alphas)
        ids = pa.ipc.open_stream(group.ids).read_all()["id"]
        return pa.table({"id": ids, "held_out": pa.array(group.held), "n_tokens": group.sizes.astype(np.int64), "n_known": group.known.astype(np.int64), "base_score": group.base, "score": group.per_doc(group.log)})

    return run


def score(docs: DataFrame, held_out, id: str = "doc_id", text: str = "text", least: int = LEAST, order: int = 2) -> DataFrame:
    """``id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score`` (log10 of the text's probability) of every row.

    ``held_out`` is a boolean column; rows where it is true do not train.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("id"), C.text_of(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = buckets = max(C.partitions(spark), -(-size // GROUP_BYTES))
    rows = rows.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    first = C.durable(rows.groupBy("g").applyInArrow(_count_words(buckets), _ddl(_FIRST)))
    coded = first.filter("bucket < 0").select("g", *_DOC_FIELDS)
    counted = first.filter("bucket >= 0").select(*_WORDS.names)
    words = C.durable(counted.groupBy("bucket").applyInArrow(_sum_words(least), _ddl(_WORDS)))
    found = [(_unpack(r.words, np.uint64, True), _unpack(r.counts, np.int64)) for r in words.filter("g < 0").select("words", "counts").collect()]
    total = np.sum([c[: SMALL + 4] for _, c in found], 0) if found else np.zeros(SMALL + 4, np.int64)
    uni = Unigrams(int(total[0]), int(total[1]), total[2:])
    end = C.mix64(np.array([END]))[0]
    texts = sum(int(c[SMALL + 4 :][ws == end].sum()) for ws, c in found)  # that train, if they are many
    often = {int(w): int(n) for ws, c in found for w, n in zip(ws, c[SMALL + 4 :], strict=True) if n * SHARE >= total[0]}
    answers = words.filter("g >= 0").select(F.lit(1).alias("k"), "bucket", "g", "words", "counts", *[F.lit(None).cast("binary").alias(f) for f in _ANSWER_FIELDS[2:]])
    heavies, ds, alphas = [], [], []
    for k in range(2, order + 1):
        if texts >= least and texts * SHARE >= uni.tokens:
            often[int(_start(k))] = texts  # as many starts as ends
        heavies.append(np.array(sorted(often), np.uint64))
        heavy, heavy_counts = heavies[-1], np.array([often[x] for x in sorted(often)], np.int64)
        parts = None
        for turn in range(ROUNDS):
            sent = coded.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_send(k, turn, buckets, uni, heavies, ds, alphas), _ddl(_GRAMS))
            part = C.durable(sent.groupBy("bucket").applyInArrow(_sum_grams(k, buckets, uni, ds[-1] if ds else None, heavy, heavy_counts, least), _ddl(_ANSWERS)))
            parts = part if parts is None else parts.unionByName(part)
        nr, stats, often = np.zeros(SMALL + 2, np.int64), np.zeros((len(heavy), SMALL + 3)), {}
        for r in parts.filter("g < 0").select("nr", "heavy_h", "heavy_stats", "often").toLocalIterator():
            nr = nr + _unpack(r.nr, np.int64)
            np.add.at(stats, np.searchsorted(heavy, _unpack(r.heavy_h, np.uint64)), _unpack(r.heavy_stats, np.float64).reshape(-1, SMALL + 3))
            grams, counts = _unpack(r.often, np.uint64).reshape(2, -1)
            often |= dict(zip(grams.tolist(), counts.tolist(), strict=True))
        stats[:, 0] = heavy_counts
        ds.append(discounts(nr))
        with np.errstate(invalid="ignore", divide="ignore"):
            alphas.append(np.log10(alpha(stats, ds[-1])) if len(heavy) else np.zeros(0))
        answers = answers.unionByName(parts.filter("g >= 0"))
    id_type = rows.select("id").limit(0).toArrow().schema.field("id").type
    scored = coded.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_finish(buckets, uni, heavies, ds, alphas, id_type), f"id {dict(rows.dtypes)['id']}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias(id), "held_out", "n_tokens", "n_known", F.lit(uni.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op9_katz_scoring(spark, sf_dir: str) -> DataFrame:
    return score(C.table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, order=ORDER)
