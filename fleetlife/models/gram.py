"""Least squares of all cells from Gram matrices of units.

A row's vector is z = (1, x_1 .. x_d, y). The sums of all products z_i z_j add up: over the rows of a unit, over the units
of a cell, over shots and arms of a transfer. They hold all that a linear fit needs: counts, means, deviations,
normal equations, and the squared error of any linear model on the rows they were summed over. So the rows are
read once, whatever the number of cells, seeds and penalties, a cell's standardizer is that of its own train
units, and its penalty is chosen by the sums of its validation units.

The products of a batch are made in numpy; only one array per unit and batch leaves the task. Everything else is sums
per (cell, position), and one small solve per cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import KEYS
from ..functions.errors import clip
from ..operators.sampling import CELL, cell_rows

STD_GUARD = 1e-8
ALPHAS = tuple(10.0 ** (-3 + 6 * i / 9) for i in range(10))


def gram_size(width: int) -> int:
    """Number of sums for ``width`` inputs: the upper triangle of a matrix of width + 2."""
    return (width + 2) * (width + 3) // 2


def unit_grams(rows: DataFrame, column: str, label: str = "label", keys: list[str] = KEYS) -> DataFrame:
    """(keys, g): sums of products over the rows of a unit, as upper triangle row by row; a unit has one array for each
    batch that holds some of its rows. ``column`` is an array of numbers, all of one length. Rows with a null in it, or a
    null label, are left out."""
    flat = rows.select(*keys, F.transform(column, lambda v: v.cast("double")).alias("_x"), F.col(label).cast("double").alias("_y"))
    flat = flat.where(F.col("_y").isNotNull() & F.forall("_x", lambda v: v.isNotNull()))
    schema = flat.select(*keys, F.array().cast("array<double>").alias("g")).schema

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            z = np.stack(batch["_x"].to_numpy())
            z = np.concatenate([np.ones((len(z), 1)), z, batch["_y"].to_numpy()[:, None]], axis=1)
            upper = np.triu_indices(z.shape[1])
            unit = batch.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(unit, kind="stable")
            first = np.searchsorted(unit[order], np.arange(unit.max() + 1))
            out = batch[keys].iloc[order[first]].reset_index(drop=True)
            yield out.assign(g=[(z[at].T @ z[at])[upper] for at in np.split(order, first[1:])])

    return flat.mapInPandas(run, schema)


def cell_grams(grams: DataFrame, plan: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """(cell, role, at, s): the sums of each cell's train and validation units, one row per position."""
    return add_up(cell_rows(grams, plan), [*cell, "role"])


def add_up(grams: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """(by, at, s): arrays added up position by position; ``weight`` repeats a unit."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    each = grams.select(*by, w.alias("_w"), F.posexplode("g").alias("at", "_v"))
    return each.groupBy(*by, "at").agg(F.sum(F.col("_w") * F.col("_v")).alias("s"))


def full(triangle: np.ndarray) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    m = int((2 * len(triangle)) ** 0.5)
    g = np.zeros((m, m))
    g[np.triu_indices(m)] = triangle
    return g + np.triu(g, 1).T


def solve(train: np.ndarray, check: np.ndarray | None, alphas, scaled) -> tuple[float, np.ndarray, float, float]:
    """(intercept, weights, alpha, squared error on ``check``) of the ridge fit with the best penalty; of equal ones the
    smallest. The penalty is on the weights of centred inputs; inputs at the positions of ``scaled`` are divided by their
    sample deviation first, which the weights returned take in. Without ``check`` the train rows decide."""
    n, mean = train[0, 0], train[0, 1:] / train[0, 0]
    spread = train[1:, 1:] - n * np.outer(mean, mean)
    d = len(mean) - 1
    unit = np.ones(d)
    for i in scaled:
        sd = (max(spread[i, i], 0.0) / (n - 1)) ** 0.5 if n > 1 else 0.0
        unit[i] = sd if sd > STD_GUARD else 1.0
    a, b = spread[:d, :d] / np.outer(unit, unit), spread[:d, d] / unit
    best = None
    for alpha in alphas:
        left = a + alpha * np.eye(d)
        try:
            w = np.linalg.solve(left, b)
        except np.linalg.LinAlgError:  # no penalty, and inputs that depend on each other
            w = np.linalg.lstsq(left, b, rcond=None)[0]
        w = w / unit
        intercept = mean[d] - w @ mean[:d]
        v = np.concatenate([[-intercept], -w, [1.0]])
        error = float(v @ (train if check is None else check) @ v)
        if best is None or error < best[3]:
            best = (float(intercept), w, float(alpha), error)
    return best


def fit_ridge(sums: DataFrame, cell: list[str] = CELL, alphas=ALPHAS, scaled=()) -> DataFrame:
    """(cell, intercept, weights, alpha) of every cell of ``sums`` (cell, role, at, s). The sums of a cell are a matrix of the
    inputs' number squared; cells are solved apart from one another."""
    schema = sums.select(*cell).schema.simpleString()[len("struct<"):-1].replace(":", " ")
    alphas, scaled = tuple(map(float, alphas)), tuple(scaled)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = {role: full(part.sort_values("at")["s"].to_numpy()) for role, part in group.groupby("role")}
        out = group[cell].iloc[:1].reset_index(drop=True)
        if "train" not in found:
            return out.iloc[:0].assign(intercept=0.0, weights=None, alpha=0.0)
        intercept, weights, alpha, _ = solve(found["train"], found.get("val"), alphas, scaled)
        return out.assign(intercept=intercept, weights=[weights], alpha=alpha)

    return sums.groupBy(*cell).applyInPandas(run, f"{schema}, intercept double, weights array<double>, alpha double")


def predict(params: DataFrame, rows: DataFrame, column: str, max_rul: float, keep: list[str], on: tuple = ("dataset",)) -> DataFrame:
    """Clipped predictions of every row by every fitted cell of its dataset. ``params`` has one row per cell, all chosen
    by the caller, so it is broadcast."""
    products = F.zip_with(F.col("weights"), F.col(column), lambda w, x: w * x.cast("double"))
    value = F.aggregate(products, F.lit(0.0), lambda s, x: s + x) + F.col("intercept")
    out = rows.join(F.broadcast(params), list(on))
    cells = [c for c in params.columns if c not in ("intercept", "weights", "alpha")]
    return out.select(*cells, *[k for k in keep if k not in cells], clip(value, max_rul).alias("pred"))
