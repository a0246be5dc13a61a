"""Training by epochs: mini-batches as distributed gradient sums, AdamW at the
driver, the best state of a validation metric, and runs that can be resumed.

A batch is the rows of a seeded hash order that share a batch number, so it is
the same rows wherever and however often it is computed.  Tasks add up the
gradients of their rows of a batch; what comes to the driver is one vector of
the model's size for each batch.  After each epoch the state (weights, moments,
step, best so far) replaces the one before in one step, and a run that is
started again goes on after the last epoch that is there.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.operators import ranking
from wavemill.session import kept
from wavemill.sinks.publish import Store


@dataclass(frozen=True)
class Plan:
    """How a model is trained; see ``config.SETTINGS``."""

    epochs: int = 30
    batch_size: int = 4096
    lr: float = 0.05
    weight_decay: float = 0.01
    label_smoothing: float = 0.0
    patience: int = 10
    seed: int = 0
    warm_up: float = 0.1

    def rate(self, step: int, steps: int) -> float:
        """The rate of a step: linear warm-up, then a half cosine to nothing."""
        rise = max(1, int(self.warm_up * steps))
        if step < rise:
            return self.lr * (step + 1) / rise
        return self.lr * 0.5 * (1 + math.cos(math.pi * (step - rise) / max(1, steps - rise)))


@dataclass
class State:
    """All that the next epoch needs; ``weights`` has the intercept last."""

    weights: list[float]
    first: list[float]
    second: list[float]
    step: int = 0
    epoch: int = 0
    best: list[float] = field(default_factory=list)
    best_metric: float = -math.inf
    best_epoch: int = 0
    history: list[dict[str, Any]] = field(default_factory=list)


def gradients(rows: DataFrame, weights: np.ndarray, smoothing: float) -> DataFrame:
    """``n``, ``loss`` and ``gradient``: sums over rows of (x, y), a row a task."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)  # a vector of the model's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total, n, loss = shared.value, np.zeros(len(shared.value)), 0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.column_stack([batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1), np.ones(batch.num_rows)])
            y = batch.column(1).to_numpy() * (1 - smoothing) + 0.5 * smoothing
            z = x @ w
            total += x.T @ (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
            n, loss = n + batch.num_rows, loss + float((np.logaddexp(0, z) - y * z).sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "loss": [loss], "gradient": pa.array([total], pa.list_(pa.float64()))})

    return rows.select("x", "y").mapInArrow(run, "n long, loss double, gradient array<double>")


def _step(state: State, gradient: np.ndarray, plan: Plan, steps: int) -> None:
    """AdamW: decay apart from the moments, and not of the intercept."""
    w, m, v = (np.array(a) for a in (state.weights, state.first, state.second))
    rate = plan.rate(state.step, steps)
    state.step += 1
    m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
    decayed = w * np.append(np.full(len(w) - 1, 1 - rate * plan.weight_decay), 1.0)
    w = decayed - rate * (m / (1 - 0.9**state.step)) / (np.sqrt(v / (1 - 0.999**state.step)) + 1e-8)
    state.weights, state.first, state.second = w.tolist(), m.tolist(), v.tolist()


def scored(rows: DataFrame, weights: list[float]) -> DataFrame:
    """Rows of (x, y) with their score."""
    w = F.array(*[F.lit(float(x)) for x in weights[:-1]])
    logit = F.aggregate(F.zip_with("x", w, lambda a, b: a * b), F.lit(float(weights[-1])), lambda a, b: a + b)
    return rows.withColumn("score", ranking.sigmoid(logit))


def fit(rows: DataFrame, plan: Plan, folder: str, stop_after: int | None = None) -> State:
    """Trains on split train of rows (sample_id, split, x, y), with the AUROC of
    split val after each epoch; ends after ``patience`` epochs without a better
    one, and keeps the best weights.

    ``folder`` holds the state after each epoch; a run with another plan does
    not go on from it.  ``stop_after`` ends this call after so many epochs.
    """
    spark = rows.sparkSession
    train = rows.filter("split = 'train' and y is not null")
    count = train.count()
    if not count or rows.filter("split = 'val' and y is not null").isEmpty():
        raise ValueError("splits train and val must have labelled rows")
    batches = -(-count // plan.batch_size)
    size = len(train.select("x").first().x) + 1
    store, name = Store(spark, folder), "state.json"
    state, done = State([0.0] * size, [0.0] * size, [0.0] * size), 0
    if store.exists(name):
        saved = store.read_json(name)
        if saved["plan"] != asdict(plan) or saved["rows"] != count:
            raise ValueError("the folder holds a run of another plan or other rows")
        state = State(**saved["state"])
        if state.best_metric is None:
            state.best_metric = -math.inf
    # what is summed is read from a table of vectors, dealt once by the seeded order of each epoch
    vectors = kept(train.select("sample_id", "x", F.col("y").cast("double").alias("y")))
    val = kept(rows.filter("split = 'val' and y is not null").select("x", "y"))
    while state.epoch < plan.epochs and state.epoch - state.best_epoch < plan.patience:
        if stop_after is not None and done >= stop_after:
            return state
        number = F.pmod(F.xxhash64(F.lit(plan.seed), F.lit(state.epoch), "sample_id"), F.lit(batches))
        dealt = vectors.withColumn("batch", number)
        total, n = 0.0, 0
        for b in range(batches):  # steps follow each other: each needs the weights of the one before
            sums = gradients(dealt.filter(F.col("batch") == b), np.array(state.weights), plan.label_smoothing)
            found = sums.select("n", "loss", F.posexplode("gradient").alias("k", "g")).groupBy("k").agg(F.sum("g").alias("g"), F.sum("n").alias("n"), F.sum("loss").alias("loss")).orderBy("k").collect()
            if found and found[0].n:
                _step(state, np.array([r.g for r in found]) / found[0].n, plan, plan.epochs * batches)
                total, n = total + found[0].loss, n + found[0].n
        metric = ranking.ranking_metrics(scored(val, state.weights), "score", "y").first().auroc
        state.epoch, done = state.epoch + 1, done + 1
        state.history.append({"epoch": state.epoch, "loss": total / max(n, 1), "auroc": metric})
        if metric is not None and metric > state.best_metric:
            state.best, state.best_metric, state.best_epoch = list(state.weights), metric, state.epoch
        store.write_json(name, {"plan": asdict(plan), "rows": count, "state": asdict(replace(state, best_metric=None if state.best_metric == -math.inf else state.best_metric))})
    return state


def load(spark: SparkSession, folder: str) -> State:
    """The state of a run."""
    return State(**json.loads(json.dumps(Store(spark, folder).read_json("state.json")["state"])))
