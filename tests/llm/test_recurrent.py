"""The recurrent model: a proper distribution, right gradients, state carried over windows."""

import numpy as np
import pytest

from statloom.llm import recurrent
from statloom.llm.recurrent import GatedModel


@pytest.fixture
def model():
    m = GatedModel(np.array([5, 3, 2, 9, 1, 4, 2, 30]), hidden=5)
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    return m


def test_outputs_sum_to_one(model):
    h = np.random.default_rng(0).normal(size=(6, 5))
    total = sum(np.exp(model._log_p(h, np.full(6, s))) for s in range(8))
    assert total == pytest.approx(np.ones(6), abs=1e-6)


def test_gradients_match_differences(model):
    docs = [np.array([1, 2, 3, 0]), np.array([4, 5, 6, 1, 0]), np.array([3, 0]), np.array([7, 7, 0])]
    target, before, _, fresh = next(model._windows(docs))
    real, h0 = target >= 0, np.zeros((target.shape[1], 5))

    def loss():
        states, _, _ = model._states(before, fresh, h0, keep=False)
        return -model._log_p(states.astype(float)[real], target[real]).sum()

    states, saved, _ = model._states(before, fresh, h0, keep=True)
    g, d = model._gradients(states[real].astype(float), target[real])
    ds = np.zeros(states.shape)
    ds[real] = d
    g |= model._backward(before, fresh, saved, ds)
    random = np.random.default_rng(1)
    for k, v in model.p.items():
        for _ in range(4):
            i = tuple(random.integers(0, n) for n in v.shape)
            old, e = v[i], 1e-3
            v[i] = old + e
            up = loss()
            v[i] = old - e
            down = loss()
            v[i] = old
            assert (up - down) / 2 / e == pytest.approx(g[k][i], rel=2e-2, abs=2e-3)


def test_windows_and_lanes_do_not_change_scores(model, monkeypatch):
    random = np.random.default_rng(2)
    docs = [np.append(random.integers(1, 8, n), 0) for n in (70, 3, 0, 25, 24, 23, 1)]
    whole = model.log_likelihood(docs)
    alone = [model.log_likelihood([d])[0] for d in docs]
    assert whole == pytest.approx(alone, rel=1e-4)
    monkeypatch.setattr(recurrent, "WINDOW", 5)
    assert model.log_likelihood(docs, 2) == pytest.approx(alone, rel=1e-4)


def test_training_learns_an_order(model):
    model = GatedModel(np.array([10, 100, 100, 100]), hidden=8)
    docs = [np.array([1, 2, 3] * 20 + [0])] * 40
    before, memory = model.log_likelihood(docs).mean(), None
    for _ in range(60):
        memory = model.train(docs, memory)
    assert model.log_likelihood(docs).mean() > before / 3
