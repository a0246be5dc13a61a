"""Epochs, early stopping, and a run that is stopped and goes on."""

import numpy as np
import pytest

from wavemill import training


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = (x @ [2.0, -1.0, 0.5, 0.0] + rng.normal(size=600) > 0.3).astype(int)
    data = [(f"s{k}", "train" if k < 400 else "val" if k < 500 else "test", x[k].tolist(), int(y[k])) for k in range(600)]
    return spark.createDataFrame(data, "sample_id string, split string, x array<double>, y int").repartition(3)


def test_gradients_are_those_of_numpy(rows):
    w, part = np.array([0.1, -0.2, 0.3, 0.4, 0.5]), rows.filter("split = 'val'")
    found = training.gradients(part, w, 0.1).collect()
    data = part.collect()
    x, y = np.array([[*r.x, 1] for r in data]), np.array([r.y * 0.9 + 0.05 for r in data])
    p = 1 / (1 + np.exp(-x @ w))
    assert sum(r.n for r in found) == 100
    np.testing.assert_allclose(np.sum([r.gradient for r in found], 0), x.T @ (p - y), atol=1e-9)
    assert sum(r.loss for r in found) == pytest.approx(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def test_a_stopped_run_goes_on_to_the_same_weights(spark, rows, tmp_path):
    plan = training.Plan(epochs=3, batch_size=150, lr=0.2)
    whole = training.fit(rows, plan, str(tmp_path / "a"))
    part = training.fit(rows, plan, str(tmp_path / "b"), stop_after=1)
    assert part.epoch == 1 and part.step == 3
    rest = training.fit(rows, plan, str(tmp_path / "b"))
    np.testing.assert_allclose(rest.weights, whole.weights, rtol=1e-9)
    assert rest.best_metric == pytest.approx(whole.best_metric) and [h["epoch"] for h in rest.history] == [1, 2, 3] and whole.best_metric > 0.9
    assert training.load(spark, str(tmp_path / "b")).best == rest.best
    assert whole.history[-1]["loss"] < whole.history[0]["loss"]
    with pytest.raises(ValueError, match="another plan"):
        training.fit(rows, training.Plan(epochs=4), str(tmp_path / "b"))


def test_patience_ends_a_run(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(training, "_step", lambda state, *_: setattr(state, "step", state.step + 1))  # learns nothing
    found = training.fit(rows, training.Plan(epochs=9, batch_size=1000, patience=2), str(tmp_path / "c"))
    assert found.epoch == 3 and found.best_epoch == 1 and found.best_metric == 0.5
    with pytest.raises(ValueError, match="labelled"):
        training.fit(rows.filter("split = 'test'"), training.Plan(), str(tmp_path / "d"))


def test_rates_rise_and_fall():
    plan = training.Plan(lr=1.0)
    rates = [plan.rate(k, 100) for k in range(100)]
    assert rates[9] == 1.0 and rates[0] == 0.1 and all(a >= b for a, b in zip(rates[10:], rates[11:])) and rates[-1] < 0.01
