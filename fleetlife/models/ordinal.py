"""Ordinal heads of all cells: conditional tasks fitted together by Newton steps.

Task k asks whether a row's bin is above k, among the rows that reached bin k. All tasks of all cells share each pass over the
rows: tasks of the job add up the loss, the gradient and the Hessian per (cell, k), and the driver solves one small
system for each. A step that raises a task's loss is halved until it doesn't. Inputs are standardized with the cell's own
train units, whose moments come from their Gram sums. Tasks with one class only have a fixed logit.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import KEYS
from ..functions.errors import clip
from ..functions.ordinal import argmax_rank, bin_to_rul, expected_rank, rul_to_bin
from ..operators.sampling import CELL, cell_codes
from ..session import work_dir
from ..sources.store import materialize, remove
from . import gram

BINS, L2, STEPS, SURE, TOLERANCE = 25, 1e-3, 25, 20.0, 1e-8


@dataclass
class Head:
    cells: list[tuple]
    weights: np.ndarray  # (cell, task, 1 + inputs), on the inputs as they are
    loss: np.ndarray  # mean loss of each (cell, task), without the penalty
    base: np.ndarray  # that of the classes' shares alone
    steps: int


def _moments(rows: DataFrame, plan: DataFrame, column: str, cells: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation (1 where nothing varies) of each cell's train rows: one row per cell."""
    sums = gram.cell_grams(gram.unit_grams(rows, column), plan).where("role = 'train'")
    found = {}
    for r in sums.groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("at", "s"))).alias("g")).collect():
        found[tuple(r[c] for c in CELL)] = gram.full(np.array([p["s"] for p in r["g"]]))
    width = len(next(iter(found.values()))) - 2 if found else 0
    mean, sd = np.zeros((len(cells), width)), np.ones((len(cells), width))
    for i, c in enumerate(cells):
        if c in found:
            g = found[c]
            mean[i] = g[0, 1:-1] / g[0, 0]
            spread = np.sqrt(np.maximum(np.diag(g)[1:-1] / g[0, 0] - mean[i] ** 2, 0))
            sd[i] = np.where(spread > gram.STD_GUARD, spread, 1.0)
    return mean, sd


def _pass(state: DataFrame, w: np.ndarray, mean: np.ndarray, sd: np.ndarray, going: np.ndarray) -> dict[int, tuple]:
    """cell -> (rows, ones, loss, gradient, Hessian) per task, summed over all train rows, for the cells still ``going``."""
    tasks, width = w.shape[1:]
    size = 3 * tasks + tasks * width + tasks * width * width

    def run(batches):
        total = {}
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(len(batch), -1) if len(batch) else np.empty((0, width - 1))
            reached = batch.column(1).to_numpy()
            codes = batch.column(2)
            row = np.repeat(np.arange(len(batch)), np.diff(codes.offsets.to_numpy()))
            code = codes.flatten().to_numpy()
            row, cell = row[code & 1 == 0], code[code & 1 == 0] >> 1
            order = np.argsort(cell, kind="stable")
            row, cell = row[order], cell[order]
            for c in np.unique(cell):
                if not going[c]:
                    continue
                at = row[np.searchsorted(cell, c):np.searchsorted(cell, c, side="right")]
                z = np.concatenate([np.ones((len(at), 1)), (x[at] - mean[c]) / sd[c]], axis=1)
                asked = reached[at, None] >= np.arange(tasks)
                above = (reached[at, None] > np.arange(tasks)).astype(float)
                logit = z @ w[c].T
                p = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
                loss = (np.logaddexp(0, logit) - above * logit) * asked
                rest, curve = (p - above) * asked, p * (1 - p) * asked
                made = np.concatenate([asked.sum(0), (above * asked).sum(0), loss.sum(0), (rest.T @ z).ravel(),
                                       np.stack([z.T @ (curve[:, k:k + 1] * z) for k in range(tasks)]).ravel()])
                total[c] = total.get(c, 0) + made
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(map(int, total)), pa.int32()), pa.array(list(total.values()), pa.list_(pa.float64()))], ["cell", "sums"])

    parts = state.mapInArrow(run, "cell int, sums array<double>")
    added = parts.select("cell", F.posexplode("sums").alias("at", "v")).groupBy("cell", "at").agg(F.sum("v").alias("v"))
    out = {}
    for r in added.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("s")).collect():
        s = np.array([p["v"] for p in r["s"]])
        assert len(s) == size
        out[r["cell"]] = (s[:tasks], s[tasks:2 * tasks], s[2 * tasks:3 * tasks], s[3 * tasks:3 * tasks + tasks * width].reshape(tasks, width),
                          s[3 * tasks + tasks * width:].reshape(tasks, width, width))
    return out


def fit(rows: DataFrame, plan: DataFrame, column: str, max_rul: float, label: str = "label", bins: int = BINS, l2: float = L2,
        steps: int = STEPS) -> Head:
    """Heads of every cell of ``plan``: the mean loss plus l2 / 2 times the squared weights, per task. The driver holds the
    sums of one pass: (1 + inputs) squared numbers per cell and task."""
    spark = rows.sparkSession
    cells, drawn = cell_codes(rows.select(*KEYS).distinct(), plan)
    mean, sd = _moments(rows.withColumn("label", F.col(label)), plan, column, cells)
    base = f"{work_dir(spark)}/ordinal_{uuid.uuid4().hex}"
    clean = rows.where(F.col(label).isNotNull() & F.forall(column, lambda v: v.isNotNull()))
    state = clean.select(*KEYS, F.transform(column, lambda v: v.cast("double")).alias("x"), rul_to_bin(F.col(label), max_rul, bins).alias("bin"))
    state = materialize(state.join(drawn, KEYS).select("x", "bin", "codes"), base, "rows")
    tasks, width = bins - 1, mean.shape[1] + 1
    w = np.zeros((len(cells), tasks, width))
    last, low = w.copy(), np.full((len(cells), tasks), np.inf)
    loss, shares = np.zeros((len(cells), tasks)), np.zeros((len(cells), tasks))
    going, free = np.ones(len(cells), bool), np.zeros((len(cells), tasks), bool)
    ridge = l2 * np.diag([0.0] + [1.0] * (width - 1))
    for step in range(steps + 1):
        found = _pass(state, w, mean, sd, going)
        for c, (n, ones, total, gradient, hessian) in found.items():
            if step == 0:
                free[c] = (ones > 0) & (ones < n)
                w[c, ~free[c], 0] = np.where(ones > 0, SURE, -SURE)[~free[c]]
                share = np.clip(np.where(n > 0, ones / np.maximum(n, 1), 0.5), 1e-12, 1 - 1e-12)
                shares[c] = np.where(free[c], -(share * np.log(share) + (1 - share) * np.log(1 - share)), 0.0)
            moved = 0.0
            for k in np.flatnonzero(free[c]):
                whole = total[k] / n[k] + 0.5 * l2 * (w[c, k, 1:] ** 2).sum()
                if whole > low[c, k] + 1e-12:  # the step was too long
                    w[c, k] = (w[c, k] + last[c, k]) / 2
                    moved = np.inf
                    continue
                low[c, k], loss[c, k], last[c, k] = whole, total[k] / n[k], w[c, k]
                slope = gradient[k] / n[k] + np.concatenate([[0.0], l2 * w[c, k, 1:]])
                change = np.linalg.solve(hessian[k] / n[k] + ridge + 1e-12 * np.eye(width), slope)
                w[c, k] = w[c, k] - change
                moved = max(moved, np.abs(slope).max())
            going[c] = moved > TOLERANCE
        going &= np.isin(np.arange(len(cells)), list(found))
        if not going.any():
            break
    w = np.where(free[:, :, None], last, w)
    remove(spark, base)
    raw = w.copy()
    raw[:, :, 1:] = w[:, :, 1:] / sd[:, None, :]
    raw[:, :, 0] = w[:, :, 0] - (raw[:, :, 1:] * mean[:, None, :]).sum(axis=2)
    return Head(cells, raw, loss, shares, step)


def predict(head: Head, rows: DataFrame, column: str, max_rul: float, keep: list[str], corn: str = "expected_value") -> DataFrame:
    """(cell, keep, pred) of every row by every cell of its dataset."""
    table = rows.sparkSession.createDataFrame([(*c, w.tolist()) for c, w in zip(head.cells, head.weights)],
                                              "dataset string, n_units long, seed int, _tasks array<array<double>>")
    dot = lambda w: F.aggregate(F.zip_with(F.slice(w, 2, F.size(w) - 1), F.col(column), lambda a, x: a * x.cast("double")),
                                F.get(w, F.lit(0)), lambda s, v: s + v)
    rank = {"expected_value": expected_rank, "argmax": argmax_rank}[corn]
    pred = clip(bin_to_rul(rank(F.transform("_tasks", dot)), max_rul, head.weights.shape[1] + 1), max_rul)
    return rows.join(F.broadcast(table), "dataset").select(*CELL, *[k for k in keep if k not in CELL], pred.alias("pred"))
