"""The label model over all vote patterns: its posterior against the sum over voters, and against Bayes' rule for voters that are known."""

import itertools
import math

import numpy as np

from planweave.llm.toxicity import LabelModel, fit_linear


def world(rates, prior):
    """Expected shares of all patterns for independent voters, by class."""
    m = len(rates[0])
    out = np.zeros((2, 1 << m))
    for p in range(1 << m):
        for y in (0, 1):
            share = prior if y else 1 - prior
            for j in range(m):
                share *= rates[y][j] if p >> j & 1 else 1 - rates[y][j]
            out[y, p] = share
    return out


def test_posterior_of_all_patterns():
    rates = [[0.02, 0.05, 0.10, 0.30, 0.01, 0.2], [0.55, 0.40, 0.60, 0.35, 0.30, 0.05]]
    joint = world(rates, 0.15)
    model = LabelModel(6).fit(joint.sum(axis=0) * 200_000, joint * 4000)
    base = model.logit[0]
    for p in range(64):  # correlations are the same for both classes, so each voter adds its accuracy
        assert abs(model.logit[p] - base - sum(model.accuracy[j] for j in range(6) if p >> j & 1)) < 1e-9
    bayes = joint[1] / joint.sum(axis=0)
    mine = 1 / (1 + np.exp(-model.logit))
    assert (np.abs(mine - bayes) * joint.sum(axis=0)).sum() < 0.01
    for j, (a, b) in enumerate(zip(*rates, strict=True)):
        truth = math.log(b / (1 - b)) - math.log(a / (1 - a))
        assert abs(model.accuracy[j] - truth) < 0.5, j


def test_linear_fit_is_a_minimum():
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(8) < 0.3) for _ in range(400)]
    target = np.array([0.9 if 0 in r or 3 in r else 0.1 for r in rows])
    w, b = fit_linear(rows, target, 8, steps=4000)

    def loss(v):
        z = np.array([v[r].sum() for r in rows]) + v[8]
        return (np.logaddexp(0, z) - target * z).sum() + 0.15 * (v[:8] ** 2).sum()

    at = np.append(w, b)
    best = loss(at)
    for i, step in itertools.product(range(9), (-0.05, 0.05)):
        moved = at.copy()
        moved[i] += step
        assert loss(moved) > best - 1e-6, (i, step)
