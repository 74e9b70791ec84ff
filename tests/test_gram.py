"""Linear models of all cells from Gram matrices, against one fit per cell."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlife.models import gram
from fleetlife.operators import sampling
from fleetlife.plans import sweep

D = 3


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    out = []
    for u in range(1, 13):
        for c in range(1, 20 + u):
            x = rng.normal(size=D) * [1, 5, 0.1] + [0, 40, 3]
            out.append(("A", u, c, [float(v) for v in x], float(x @ [2, -1, 30] + rng.normal())))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "dataset string, unit_number long, end_cycle long, x array<double>, label double")


def _fit(train, check, alphas, scaled):
    x, y = np.array([r[3] for r in train]), np.array([r[4] for r in train])
    unit = np.array([x[:, i].std(ddof=1) if i in scaled else 1.0 for i in range(D)])
    best = None
    for a in alphas:
        xc = (x - x.mean(0)) / unit
        w = np.linalg.solve(xc.T @ xc + a * np.eye(D), xc.T @ (y - y.mean())) / unit
        ic = y.mean() - w @ x.mean(0)
        cx, cy = np.array([r[3] for r in check]), np.array([r[4] for r in check])
        err = ((cx @ w + ic - cy) ** 2).sum()
        if best is None or err < best[0]:
            best = err, a, ic, w
    return best[1:]


@pytest.mark.parametrize("scaled", [(), (0, 1, 2)])
def test_every_cell_as_fitted_alone(spark, frame, rows, scaled):
    units = frame.select("dataset", "unit_number").distinct()
    plan = sampling.sampling_plan(units, (1, 2, 5), (0, 1), 0.2)
    members = {}
    for r in sampling.membership(units, plan).collect():
        members.setdefault((r.n_units, r.seed), {})[r.unit_number] = r.role
    got = gram.fit_ridge(gram.cell_grams(gram.unit_grams(frame.repartition(5), "x"), plan), scaled=scaled).collect()
    assert {(r.n_units, r.seed) for r in got} == set(members)
    for r in got:
        role = members[r.n_units, r.seed]
        train = [x for x in rows if role.get(x[1]) == "train"]
        check = [x for x in rows if role.get(x[1]) == "val"] or train
        alpha, intercept, weights = _fit(train, check, gram.ALPHAS, scaled)
        assert r.alpha == pytest.approx(alpha) and r.intercept == pytest.approx(intercept, rel=1e-6) and r.weights == pytest.approx(weights, rel=1e-6)


def test_predictions_are_clipped_and_named(spark, frame):
    units = frame.select("dataset", "unit_number").distinct()
    plan = sampling.sampling_plan(units, (5,), (0,), 0.2)
    test = frame.withColumnRenamed("label", "true_rul")
    got = sweep.ridge_predictions(frame, test, plan, "x", "ridge", "native", 60.0)
    assert got.columns == ["model", "dataset", "max_rul", "n_units", "seed", "loss", "unit_number", "end_cycle", "true_rul", "pred"]
    assert got.count() == 2 * frame.count() and got.where("pred < 0 OR pred > 60").count() == 0
    near = got.where("true_rul > 5 AND true_rul < 55").select(F.avg(F.abs(F.col("pred") - F.col("true_rul")))).first()[0]
    assert near < 2


def test_constant_and_dependent_inputs(spark):
    rows = [("A", 1, [float(c), 2.0 * c, 7.0], 3.0 * c + 1) for c in range(9)]
    frame = spark.createDataFrame(rows, "dataset string, unit_number long, x array<double>, label double")
    sums = gram.add_up(gram.unit_grams(frame, "x").withColumn("role", F.lit("train")), ["dataset", "role"])
    r = gram.fit_ridge(sums, ["dataset"], alphas=(0.0,), scaled=(2,)).first()
    assert r.intercept + np.dot(r.weights, [4.0, 8.0, 7.0]) == pytest.approx(13.0)


def test_rows_with_nulls_are_left_out(spark):
    frame = spark.createDataFrame([("A", 1, [1.0, None], 2.0), ("A", 1, [1.0, 2.0], None), ("A", 1, [3.0, 4.0], 5.0)],
                                  "dataset string, unit_number long, x array<double>, label double")
    got = gram.unit_grams(frame, "x").collect()
    assert len(got) == 1 and got[0].g == [1, 3, 4, 5, 9, 12, 15, 16, 20, 25] and len(got[0].g) == gram.gram_size(2)
    assert gram.unit_grams(frame.limit(0), "x").count() == 0
