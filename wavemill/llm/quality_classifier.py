"""Quality classifier by co-training of two views.

A document is good when its label says quality 1 and toxic 0 (the worst label
counts, if it has several).  One view sees the words of the text, the other the
metadata of the page: source, language and layout counts.  Each is a logistic
regression, first fitted on labelled documents alone.

In each round both views label every unlabelled document of the corpus, in one
distributed pass.  What a view is sure of, and the other is not against, counts
for the other view: how many such documents of each class there are, and how
many of them hold each feature, are summed over the corpus.  How sure a view
must be is chosen for each class by itself: labelled documents of a fold of
their own that the other view is not against are ranked by the view, and the
bound is the last at which ``PRECISION`` of those beyond it are of the class.  These counts, with
those of the labelled documents, give each feature a log ratio, and the view is
fitted again with its weights drawn towards the ratios (the naive-Bayes prior
of co-training, with a discriminative fit on top).  Together pseudo-labels weigh
at most as much as labels, and a view takes a new fit only if with it both views
together explain the labelled documents of another fold better; a round in which
no view does is the last, as the next would be the same.  (The metadata cannot
see a toxic word, and is sure of many documents that have one; so what the
other view is against is not passed on.  ``against=0`` is co-training without
that.)  ``Model.rounds`` tells of each round and view what was passed on and
whether the fit was taken.

At the end each view is calibrated (Platt scaling) on a third fold, and a
logistic regression stacked on a fourth gives the score from the two calibrated
log-odds.  No fold serves twice.

Only the labelled sample is bounded: ``labelled`` documents, those of the least
hashed ids, of up to ``LABELLED_BYTES`` of packed features, which go to the
driver; beyond it, only tables of fixed size do (two counts a feature).  Every
unlabelled document takes part in every round, and every document is scored
over its whole text, however long, with two weight vectors of fixed size.

Null or empty texts have no words and are scored by their metadata.  Labels
whose quality and toxic are both null, or of no document, are not used; a null
in one counts as unknown there and the other decides.  Documents with a null id
are unlabelled.  With fewer than ten good or ten bad labelled documents nothing
can be learnt: the score is 0.5 and all are kept.  Repeated rows are scored
alike.  No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .decontaminate import words_in

WORD_BITS, META_BITS = 18, 10
SEED = 7
LABELLED, LABELLED_BYTES = 6000, 48 << 20
#: PRECISION, of at least LEAST_SURE documents, that makes a view sure of a
#: class; AGAINST: p of a class below which a view is against it.
ROUNDS, PRECISION, LEAST_SURE, AGAINST = 4, 0.98, 8, 0.4
#: Of FOLDS parts of the labelled documents, those that bounds are chosen on,
#: fits are accepted on, views are calibrated on and the score is stacked on;
#: the others are fitted.
FOLDS, CHOOSE, ACCEPT, CALIBRATE, STACK = 16, 12, 13, 14, 15
#: Labels up to this many rows are broadcast, others joined by shuffle.
BROADCAST_ROWS = 2_000_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>~^=+{}[]\\@_")] = True


@dataclass
class Model:
    """Weights of both views, their calibrations and the stacked weights."""

    word: np.ndarray
    meta: np.ndarray
    calibration: np.ndarray  # a, b of each view, then intercept and two weights
    rounds: tuple[dict, ...] = ()

    def log_odds(self, word: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, c, d, e, f, g = self.calibration
        word, meta = a + b * word, c + d * meta
        return word, meta, e + f * np.clip(word, -12, 12) + g * np.clip(meta, -12, 12)


def _word_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, feature and value of each distinct word of each document."""
    words = words_in(column)
    doc, feature = words.doc(), (words.hashes() >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    keys = np.unique(doc << WORD_BITS | feature)
    doc, feature = keys >> WORD_BITS, keys & ((1 << WORD_BITS) - 1)
    return doc, feature, np.ones(len(doc), np.float32)


def _levels(x: np.ndarray) -> np.ndarray:
    return np.clip(np.round(x).astype(np.int64), 0, 40)


def _meta_view(texts: pa.Array, source: pa.Array, lang: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf, offs = C.text_bytes(texts)
    words, docs = C.Words(buf, offs), len(offs) - 1

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[offs[1:]] - total[offs[:-1]]

    size, n = np.diff(offs), words.counts
    upper, lower = (buf >= 65) & (buf <= 90), (buf >= 97) & (buf <= 122)
    doc = words.doc()
    _, at = np.unique(C.mix64(doc.astype(np.uint64)) ^ words.hashes(), return_index=True)
    distinct = np.bincount(doc[at], minlength=docs)
    shares = [
        _levels(3 * np.log2(1 + size)),
        _levels(3 * np.log2(1 + n)),
        _levels(20 * per_doc(upper) / np.maximum(1, per_doc(upper | lower))),
        _levels(4 * np.log2(1 + 100 * per_doc(_SYMBOL[buf]) / np.maximum(1, size))),
        _levels(4 * np.log2(1 + 100 * per_doc(buf == 33) / np.maximum(1, size))),
        _levels(4 * np.log2(1 + 100 * per_doc((buf >= 48) & (buf <= 57)) / np.maximum(1, size))),
        _levels(2 * np.log2(1 + per_doc(buf == 10))),
        _levels(20 * distinct / np.maximum(1, n)),
        _levels(2 * size / np.maximum(1, n)),
    ]
    named = [[hash_name(f"{k}:{v}") for v in column.to_pylist()] for k, column in enumerate((source, lang))]
    columns = [64 + 41 * k + x for k, x in enumerate(shares)] + [np.array(x, np.int64) for x in named]
    feature = np.stack([np.zeros(docs, np.int64), *columns], 1) if docs else np.zeros((0, 1), np.int64)
    return np.repeat(np.arange(docs), feature.shape[1]), feature.ravel(), np.ones(feature.size, np.float32)


def hash_name(name: str) -> int:
    """A metadata feature past those of the layout counts."""
    low = 64 + 41 * 9
    data = np.frombuffer(name.encode(), np.uint8)
    return low + int(C.Words(np.where(C._BLANK[data], np.uint8(95), data), np.array([0, len(data)])).hashes()[0] % np.uint64((1 << META_BITS) - low))


def features(docs: DataFrame, id: str, text: str, source: str, lang: str) -> DataFrame:
    """The id and both views of each document, as packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.chunks(batches, 1):
            columns = []
            for view in (_word_view(part.column(1)), _meta_view(part.column(1), part.column(2), part.column(3))):
                cuts = np.searchsorted(view[0], np.arange(part.num_rows + 1))
                columns.append(pa.array([view[1][i:j].astype(np.int32).tobytes() for i, j in zip(cuts, cuts[1:], strict=False)], pa.binary()))
            yield C.record({"id": part.column(0), "word": columns[0], "meta": columns[1]})

    rows = docs.select(F.col(id), C.text_of(text).alias("_text"), F.col(source).cast("string"), F.col(lang).cast("string"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)[id]}, word binary, meta binary")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Counts:
    """Documents of each class, and those that hold each feature."""

    good: np.ndarray
    bad: np.ndarray
    n_good: float
    n_bad: float


class _View:
    """Rows of one view; fits by batch gradient steps (Adam)."""

    def __init__(self, packed: Sequence[bytes], bits: int, least: int, z: float, decay: float) -> None:
        self.least, self.z, self.decay = least, z, decay
        arrays = [np.frombuffer(x, np.int32) for x in packed]
        self.row = np.repeat(np.arange(len(arrays)), [len(x) for x in arrays])
        self.col = np.concatenate([*arrays, np.zeros(0, np.int32)]).astype(np.int64)
        self.n, self.size = len(arrays), 1 << bits

    def _tells(self, x: Counts) -> np.ndarray:
        """Features whose share of good and of bad documents differs by ``z``
        standard errors."""
        share = (x.good + x.bad) / (x.n_good + x.n_bad)
        gap = np.abs(x.good / x.n_good - x.bad / x.n_bad) / np.sqrt(np.maximum(share * (1 - share) * (1 / x.n_good + 1 / x.n_bad), 1e-12))
        return (gap >= self.z) & (x.good + x.bad >= self.least)

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n) + w[-1]

    def fit(self, target: np.ndarray, weight: np.ndarray, pseudo: Counts | None, steps: int) -> np.ndarray:
        """Weights (the last is the intercept) for rows of positive weight.

        Only features that tell take part: rare words would otherwise fit each
        row.  ``pseudo``: counts of pseudo-labels; with them more features may
        tell, and weights start from the log ratios and are drawn to them.
        """
        good, bad = weight * target, weight * (1 - target)
        g, b = (np.bincount(self.col, weights=x[self.row], minlength=self.size) for x in (good, bad))
        own = Counts(g, b, good.sum(), bad.sum())
        tells, w = self._tells(own), np.zeros(self.size + 1)
        if pseudo and min(pseudo.n_good, pseudo.n_bad) > 0:
            # together pseudo-labels weigh as much as labels do
            part = min(1.0, (own.n_good + own.n_bad) / (pseudo.n_good + pseudo.n_bad))
            both = Counts(g + part * pseudo.good, b + part * pseudo.bad, own.n_good + part * pseudo.n_good, own.n_bad + part * pseudo.n_bad)
            told = self._tells(both)
            ratio = np.where(told, np.log((both.good + 0.5) / (both.n_good + 1)) - np.log((both.bad + 0.5) / (both.n_bad + 1)), 0)
            rows = weight > 0
            a, slope = _platt(self.scores(np.append(ratio, 0.0))[rows, None], target[rows], np.array([0.0, 0.1]))
            w, tells = np.append(slope * ratio, a), tells | told
        prior = w.copy()
        prior[-1] = 0
        used = (weight[self.row] > 0) & tells[self.col]
        row, col = self.row[used], self.col[used]
        m, v, total = np.zeros_like(w), np.zeros_like(w), weight.sum()
        for step in range(1, steps + 1):
            error = weight * (_sigmoid(np.bincount(row, weights=w[col], minlength=self.n) + w[-1]) - target) / total
            pull = self.decay * (w - prior)
            pull[-1] = 0
            grad = np.append(np.bincount(col, weights=error[row], minlength=self.size), error.sum()) + pull
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            w -= 0.1 / (1 + step / 150) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return w


def _platt(x: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Intercept and weights of a logistic regression, by Newton steps of
    bounded size with a unit Gaussian prior about the start."""
    x = np.column_stack([np.ones(len(y)), x])
    w = start.astype(float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1])
        w = w - np.clip(np.linalg.solve(hess, x.T @ (p - y) + (w - start)), -0.5, 0.5)
    return w


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every entry of a column of packed features."""
    buf, offs = C.text_bytes(column)
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs) // 4), np.frombuffer(buf.tobytes(), np.int32)


def _loss(x: np.ndarray, y: np.ndarray) -> float:
    """Log loss of scores (a column a view) after their calibration."""
    w = _platt(x, y, np.append(0.0, np.full(x.shape[1], 0.7)))
    p = _sigmoid(w[0] + x @ w[1:])
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def bounds(scores: np.ndarray, label: np.ndarray, other: np.ndarray, against: float = AGAINST, precision: float = PRECISION, least: int = LEAST_SURE) -> tuple[float, float]:
    """The scores up to which a view is sure of class 0, and from which of
    class 1 (infinite where it never is), by rank in those documents of known
    class that the other view, by its scores, is not against."""
    out = []
    for value in (0, 1):
        p = _sigmoid(other)
        some = (p if value else 1 - p) > against
        x, known = (scores if value else -scores)[some], label[some]
        order = np.argsort(-x, kind="stable")
        right = np.cumsum(known[order] == value) / np.arange(1, len(x) + 1)
        # the last of equal scores stands for all of them
        last = np.append(x[order][1:] != x[order][:-1], True) if len(x) else np.zeros(0, bool)
        good = np.flatnonzero(last & (right >= precision) & (np.arange(1, len(x) + 1) >= least))
        at = x[order][good[-1]] if len(good) else np.inf
        out.append(float(at if value else -at))
    return out[0], out[1]


def exchange(rows: DataFrame, fits: Sequence[np.ndarray], sure: Sequence[tuple[float, float]], against: float = AGAINST) -> list[Counts]:
    """For each view, the counts of what the other view is ``sure`` of.

    ``rows`` are packed features of unlabelled documents.
    """
    shared = rows.sparkSession.sparkContext.broadcast([f.astype(np.float32) for f in fits])  # vectors of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        # by view and class (bad, good); the last entry counts documents
        counts = [np.zeros((2, len(w)), np.int64) for w in weights]
        for part in batches:
            views = [_unpacked(part.column(k)) for k in (0, 1)]
            scores = [np.bincount(row, weights=w[col], minlength=part.num_rows) + w[-1] for (row, col), w in zip(views, weights, strict=True)]
            for k, (row, col) in enumerate(views):
                low, high = sure[1 - k]
                p = _sigmoid(scores[k])
                for value in (0, 1):
                    passed = scores[1 - k] >= high if value else scores[1 - k] <= low
                    passed &= (p if value else 1 - p) > against
                    counts[k][value, -1] += passed.sum()
                    counts[k][value, :-1] += np.bincount(col[passed[row]], minlength=counts[k].shape[1] - 1)
        for k, both in enumerate(counts):
            some = np.flatnonzero(both.any(0))
            yield C.record({"view": np.full(len(some), k, np.int32), "feature": some, "bad": both[0, some], "good": both[1, some]})

    summed = rows.select("word", "meta").mapInArrow(run, "view int, feature long, bad long, good long").groupBy("view", "feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()
    view, feature, bad, good = (summed.column(k).to_numpy() for k in range(4))
    out = []
    for k, w in enumerate(fits):
        both = np.zeros((2, len(w)))
        both[0, feature[view == k]], both[1, feature[view == k]] = bad[view == k], good[view == k]
        out.append(Counts(both[1, :-1], both[0, :-1], float(both[1, -1]), float(both[0, -1])))
    return out


def co_train(word: Sequence[bytes], meta: Sequence[bytes], label: np.ndarray, unlabelled: DataFrame | None, rounds: int = ROUNDS, against: float = AGAINST) -> Model | None:
    """A model from packed features of labelled rows (label 1 or 0) and a frame
    of those of unlabelled ones."""
    fold = np.arange(len(label)) % FOLDS
    fitted = fold < min(CHOOSE, ACCEPT, CALIBRATE, STACK)
    if min((label == 1).sum(), (label == 0).sum()) < 10 or min((label[fitted] == 1).sum(), (label[fitted] == 0).sum()) < 2:
        return None
    views = (_View(word, WORD_BITS, 3, 5.0, 2e-5), _View(meta, META_BITS, 1, 2.0, 1e-4))
    target, weight = label.astype(float), fitted.astype(float)
    fits = [view.fit(target, weight, None, 400) for view in views]
    chosen, gate = fold == CHOOSE, fold == ACCEPT

    def together(fits: Sequence[np.ndarray]) -> float:
        """What both views leave unexplained of the labels that accept fits."""
        return _loss(np.column_stack([view.scores(f)[gate] for view, f in zip(views, fits, strict=True)]), target[gate])

    best = together(fits)
    told: list[dict] = []
    for k in range(rounds if unlabelled is not None else 0):
        seen = [view.scores(f)[chosen] for view, f in zip(views, fits, strict=True)]
        sure = [bounds(seen[v], label[chosen], seen[1 - v], against) for v in (0, 1)]
        before = list(fits)
        for v, counts in enumerate(exchange(unlabelled, before, sure, against)):
            new = views[v].fit(target, weight, counts, 300) if min(counts.n_good, counts.n_bad) > 0 else fits[v]
            loss = together([new, fits[1]] if v == 0 else [fits[0], new])
            taken = bool(loss < best)
            told.append({"round": k + 1, "view": ("text", "metadata")[v], "good": int(counts.n_good), "bad": int(counts.n_bad), "loss_before": best, "loss": loss, "taken": taken})
            if taken:
                fits[v], best = new, loss
        if not any(t["taken"] for t in told[-2:]):
            break
    raw = [view.scores(f) for view, f in zip(views, fits, strict=True)]
    use, last = fold == CALIBRATE, fold == STACK
    each = [_platt(r[use, None], target[use], np.array([0.0, 1.0])) for r in raw]
    odds = np.column_stack([np.clip(c[0] + c[1] * r[last], -12, 12) for c, r in zip(each, raw, strict=True)])
    stacked = _platt(odds, target[last], np.array([0.0, 0.7, 0.7]))
    return Model(fits[0].astype(np.float32), fits[1].astype(np.float32), np.array([*each[0], *each[1], *stacked]), tuple(told))


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", labelled: int = LABELLED, rounds: int = ROUNDS, against: float = AGAINST) -> Model | None:
    """A model from a bounded labelled sample and all unlabelled documents;
    None where labels are too few."""
    good = F.when((F.col("quality") == 0) | (F.col("toxic") > 0), 0).when((F.col("quality") == 1) | (F.col("toxic") == 0), 1)
    known = labels.select(F.col(id).alias("id"), good.alias("good")).filter("good is not null and id is not null").groupBy("id").agg(F.min("good").alias("good"))
    known = C.durable(known)
    joined = features(docs, id, text, source, lang).join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, "id", "left")
    rows = C.durable(joined.withColumn("place", F.xxhash64("id", F.lit(SEED))))
    # one row of an id, ids in hashed order, up to both bounds
    order = rows.filter("good is not null").groupBy("place").agg(F.max(F.octet_length("word") + F.octet_length("meta")).alias("bytes")).orderBy("place").limit(labelled).collect()
    total, last = 0, None
    for r in order:
        total += r.bytes
        if total > LABELLED_BYTES:
            break
        last = r.place
    if last is None:
        return None
    sample = rows.filter((F.col("good").isNotNull()) & (F.col("place") <= last)).dropDuplicates(["place"]).collect()
    sample.sort(key=lambda r: r.place)
    return co_train([r.word for r in sample], [r.meta for r in sample], np.array([r.good for r in sample]), rows.filter("good is null"), rounds, against)


def score(docs: DataFrame, model: Model | None, id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", threshold: float = 0.5, carry: bool = False, prefix: str = "") -> DataFrame:
    """``id``, ``p_text``, ``p_meta``, ``score`` and ``kept`` of every row; with
    ``carry``, after all columns of ``docs`` instead of the id.  ``prefix`` comes
    before the new names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two vectors of fixed size
    kept = docs.schema if carry else docs.select(id).schema
    n, names = len(kept), [*kept.names, *(prefix + x for x in ("p_text", "p_meta", "score", "kept"))]
    rows = docs.select(*[F.col(k) for k in kept.names], C.text_of(text).alias("_text"), F.col(source).cast("string").alias("_s"), F.col(lang).cast("string").alias("_l"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in C.chunks(batches, n):
            if model is None:
                p = [np.full(part.num_rows, 0.5)] * 3
            else:
                sums = []
                for weights, view in ((model.word, _word_view(part.column(n))), (model.meta, _meta_view(*(part.column(n + k) for k in range(3))))):
                    sums.append(np.bincount(view[0], weights=weights[view[1]], minlength=part.num_rows) + weights[-1])
                p = [1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in model.log_odds(*sums)]
            columns = [part.column(k) for k in range(n)] + [pa.array(x, pa.float64()) for x in p] + [pa.array(p[2] >= threshold)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{prefix}p_text double, {prefix}p_meta double, {prefix}score double, {prefix}kept boolean"])
    return rows.mapInArrow(run, schema)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return score(docs, train(docs, C.table(spark, sf_dir, "labels")))
