"""Ordinal heads of all cells, against plain gradient descent on one cell."""

import numpy as np
import pytest

from fleetlife.models import ordinal
from fleetlife.operators import sampling

CAP, BINS, L2 = 20.0, 4, 1e-2


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(9)
    out = []
    for u in range(1, 9):
        for c in range(1, 30 + u):
            x = rng.normal(size=2) * [3, 0.2] + [10, 1]
            out.append(("A", u, c, [float(v) for v in x], float(np.clip(8 + 2 * (x[0] - 10) - 10 * (x[1] - 1) + rng.normal() * 2, 0, 30))))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "dataset string, unit_number long, end_cycle long, x array<double>, label double").repartition(3)


def _plain(train):
    """Weights on standardized inputs by many small steps."""
    x, y = np.array([r[3] for r in train]), np.array([min(BINS - 1, max(0, int(r[4] // (CAP / BINS)))) for r in train])
    z = np.concatenate([np.ones((len(x), 1)), (x - x.mean(0)) / x.std(0)], axis=1)
    out = []
    for k in range(BINS - 1):
        at, w = y >= k, np.zeros(3)
        t = (y[at] > k).astype(float)
        if t.min() == t.max():
            out.append(np.array([ordinal.SURE if t.max() else -ordinal.SURE, 0, 0]))
            continue
        for _ in range(40_000):
            w -= 0.5 * (z[at].T @ (1 / (1 + np.exp(-z[at] @ w)) - t) / at.sum() + L2 * w * [0, 1, 1])
        out.append(w)
    return np.array(out), x.mean(0), x.std(0)


def _rank(weights, mean, sd, x):
    p, total = 1.0, 0.0
    for w in weights:
        p /= 1 + np.exp(-(w[0] + w[1:] @ ((np.array(x) - mean) / sd)))
        total += p
    return total


def test_every_cell_as_fitted_alone(spark, frame, rows):
    units = frame.select("dataset", "unit_number").distinct()
    plan = sampling.sampling_plan(units, (2,), (0, 1), 0.2)
    members = {}
    for r in sampling.membership(units, plan).collect():
        members.setdefault(("A", r.n_units, r.seed), {})[r.unit_number] = r.role
    head = ordinal.fit(frame, plan, "x", CAP, bins=BINS, l2=L2)
    assert set(head.cells) == set(members) and head.steps < ordinal.STEPS
    assert (head.loss <= head.base + 1e-9).all() and head.loss.max() > 0
    got = {}
    for r in ordinal.predict(head, frame, "x", CAP, ["unit_number", "end_cycle"]).collect():
        got[("A", r.n_units, r.seed), r.unit_number, r.end_cycle] = r.pred
    for cell, role in members.items():
        model = _plain([r for r in rows if role.get(r[1]) == "train"])
        want = [np.clip((_rank(*model, r[3]) + 0.5) * CAP / BINS, 0, CAP) for r in rows]
        assert [got[cell, r[1], r[2]] for r in rows] == pytest.approx(want, abs=1e-4)


def test_one_class(spark):
    frame = spark.createDataFrame([("A", 1, c, [float(c)], 50.0) for c in range(5)], "dataset string, unit_number long, end_cycle long, x array<double>, label double")
    plan = sampling.sampling_plan(frame.select("dataset", "unit_number").distinct(), (), (0,), 0.2)
    head = ordinal.fit(frame, plan, "x", CAP, bins=BINS)
    got = [r.pred for r in ordinal.predict(head, frame, "x", CAP, []).collect()]
    assert got == pytest.approx([17.5] * 5, abs=1e-5)
