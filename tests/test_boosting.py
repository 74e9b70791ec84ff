"""Boosted trees of all cells, against one plain fit per cell."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlife.models import boosting
from fleetlife.operators import sampling

NAMES = ["a", "b"]
ROUNDS, DEPTH, RATE, PATIENCE = 8, 2, 0.9, 2


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = []
    for u in range(1, 13):
        for c in range(1, 25 + u):
            a, b = float(rng.normal()), float(rng.integers(0, 6))
            out.append(("A", u, c, a, b, float(10 + 8 * (a > 0.2) - 5 * (b > 3) + rng.normal())))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "dataset string, unit_number long, end_cycle long, a double, b double, label double").repartition(3)


class Plain:
    """Boosting of one cell, row sets in lists."""

    def __init__(self, train, val, edges):
        self.edges = edges
        code = self.code(train)
        y = np.array([r[5] for r in train])
        self.start, self.trees = y.mean(), []
        f = np.full(len(y), self.start)
        v, vc = np.array([r[5] for r in val]), self.code(val)
        errors = [((v - self.start) ** 2).sum()]
        for _ in range(ROUNDS):
            tree = self.grow(code, y - f, DEPTH)
            self.trees.append(tree)
            f = f + np.array([self.walk(tree, c) for c in code])
            errors.append(((v - self.of(vc, len(self.trees))) ** 2).sum())
            if len(val) and len(errors) - 1 - int(np.argmin(errors)) >= PATIENCE:
                break
        self.used = int(np.argmin(errors)) if len(val) else ROUNDS

    def code(self, rows):
        return np.array([[np.searchsorted(e, r[3 + i], side="left") for i, e in enumerate(self.edges)] for r in rows]).reshape(-1, 2)

    def grow(self, code, rest, depth):
        best = None
        for i in range(2):
            for cut in range(boosting.BINS - 1):
                left = code[:, i] <= cut
                if min(left.sum(), (~left).sum()) < boosting.MIN_LEAF:
                    continue
                gain = rest[left].sum() ** 2 / left.sum() + rest[~left].sum() ** 2 / (~left).sum() - rest.sum() ** 2 / len(rest)
                if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-9) + 1e-9):
                    best = gain, i, cut, left
        if best is None or depth == 0:
            return RATE * rest.mean()
        _, i, cut, left = best
        return i, cut, self.grow(code[left], rest[left], depth - 1), self.grow(code[~left], rest[~left], depth - 1)

    def walk(self, tree, c):
        while isinstance(tree, tuple):
            tree = tree[2] if c[tree[0]] <= tree[1] else tree[3]
        return tree

    def of(self, code, used):
        return np.array([self.start + sum(self.walk(t, c) for t in self.trees[:used]) for c in code])


def test_every_cell_as_grown_alone(spark, frame, rows):
    units = frame.select("dataset", "unit_number").distinct()
    plan = sampling.sampling_plan(units, (1, 4), (0, 1), 0.25)
    members = {}
    for r in sampling.membership(units, plan).collect():
        members.setdefault(("A", r.n_units, r.seed), {})[r.unit_number] = r.role
    model = boosting.fit(frame, plan, NAMES, rounds=ROUNDS, depth=DEPTH, rate=RATE, patience=PATIENCE)
    assert set(model.cells) == set(members)
    got = {}
    for r in boosting.predict(model, frame, NAMES, 100.0, ["dataset", "unit_number", "end_cycle"]).collect():
        got[(r.dataset, r.n_units, r.seed), r.unit_number, r.end_cycle] = r.pred
    assert len(got) == len(members) * len(rows)
    stopped = 0
    for i, cell in enumerate(model.cells):
        role = members[cell]
        plain = Plain([r for r in rows if role.get(r[1]) == "train"], [r for r in rows if role.get(r[1]) == "val"], model.edges["A"])
        assert model.used[i] == plain.used
        stopped += plain.used < ROUNDS
        want = np.clip(plain.of(plain.code(rows), plain.used), 0, 100)
        assert [got[cell, r[1], r[2]] for r in rows] == pytest.approx(list(want))
    assert 0 < stopped
    assert (model.error <= model.floor + 1e-9).all() and (model.error < 0.5 * model.floor).any()


def test_no_signal_and_nulls(spark):
    frame = spark.createDataFrame([("A", u, c, None if c % 2 else float("nan"), 1.0, 5.0) for u in (1, 2) for c in range(9)],
                                  "dataset string, unit_number long, end_cycle long, a double, b double, label double")
    plan = sampling.sampling_plan(frame.select("dataset", "unit_number").distinct(), (), (0,), 0.5)
    model = boosting.fit(frame, plan, NAMES, rounds=2)
    got = boosting.predict(model, frame, NAMES, 4.0, ["unit_number"]).collect()
    assert len(got) == 18 and {r.pred for r in got} == {4.0}


def test_inputs_are_made_once(spark, frame, rows):
    made = spark.sparkContext.accumulator(0)

    def counted(x):
        made.add(1)
        return x

    plan = sampling.sampling_plan(frame.select("dataset", "unit_number").distinct(), (4,), (0,), 0.25)
    boosting.fit(frame.withColumn("a", F.udf(counted, "double")("a")), plan, NAMES, rounds=1, depth=1)
    assert made.value == len(rows)
