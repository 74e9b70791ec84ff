"""Gradient-boosted trees of all cells at once, on shared bins, with a stopping rule.

Inputs are cut into bins once per fleet (quantiles of the train rows). A row carries the bins, the label, and one entry for each
cell that drew its unit: the cell, whether the unit validates there, and the cell's prediction so far. A tree
grows by levels: tasks add up, per cell, node, input and bin, the residuals and the counts of their rows; the
histograms of a cell meet, and the best split of each of its nodes comes back, a row per node. All cells share each
pass over the rows. After a tree the entries' predictions are written, so that no pass repeats earlier trees.

A cell stops when ``patience`` trees in a row did not lower the squared error of its validation units, and keeps the
trees up to the lowest; its entries then leave the passes. Cells without validation units take all rounds. Squared
loss; a leaf adds ``rate`` times the mean residual of its rows. Ties go to the smaller input, then bin, so results do
not depend on how rows are dealt but for the order of floating sums.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import KEYS
from ..operators.sampling import CELL, cell_codes
from ..session import work_dir
from ..sources.store import materialize, remove

BINS, MIN_LEAF, PATIENCE = 32, 5, 3


@dataclass
class Tree:
    """One tree per cell as arrays over (cell, node): the input (-1: a leaf), the last bin that goes left, and the value."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def nodes(self, bins: np.ndarray, row: np.ndarray, cell: np.ndarray, depth: int) -> np.ndarray:
        """The node that each (row, cell) reaches in ``depth`` steps."""
        at = np.zeros(len(row), "int64")
        for _ in range(depth):
            f = self.feature[cell, at]
            inner = f >= 0
            right = bins[row, np.maximum(f, 0)] > self.cut[cell, at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at


@dataclass
class Model:
    cells: list[tuple]  # (cell columns) by number
    edges: dict  # dataset -> list of bin edges per input
    start: np.ndarray
    trees: list[Tree] = field(default_factory=list)
    used: np.ndarray | None = None  # trees of each cell
    floor: np.ndarray | None = None  # squared error of the train rows without a tree
    error: np.ndarray | None = None  # and with the trees used
    depth: int = 3


def bin_edges(rows: DataFrame, inputs: list[str], bins: int = BINS) -> dict:
    """Inner edges of each input per dataset, from quantiles of the rows: a number per bin, input and dataset."""
    at = [i / bins for i in range(1, bins)]
    found = rows.groupBy("dataset").agg(*[F.percentile_approx(F.col(c).cast("double"), at, 10_000).alias(c) for c in inputs]).collect()
    return {r["dataset"]: [sorted(set(r[c] or [])) for c in inputs] for r in found}


def binned(rows: DataFrame, inputs: list[str], edges: dict, keep: list[str]) -> DataFrame:
    """``keep`` (with the dataset) and ``bins``: one byte per input, the number of edges below its value (null and NaN: 0)."""
    names = [f"_{i}" for i in range(len(inputs))]
    schema = rows.select(*keep, F.lit(b"").alias("bins")).schema
    flat = rows.select(*keep, *[F.col(c).cast("double").alias(n) for c, n in zip(inputs, names)])

    def run(batches):
        for batch in batches:
            code = np.zeros((len(batch), len(inputs)), "u1")
            for dataset, part in batch.groupby("dataset").indices.items():
                for i, n in enumerate(names):
                    x = batch[n].to_numpy("float64")[part]
                    code[part, i] = np.where(np.isnan(x), 0, np.searchsorted(edges.get(dataset, [[]] * len(inputs))[i], x, side="left"))
            yield batch[keep].assign(bins=[c.tobytes() for c in code])

    return flat.mapInPandas(run, schema)


def _entries(batch: pa.RecordBatch, width: int):
    """(bins, labels, row, cell, validates, prediction) of a batch's entries, one per row and cell."""
    bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), "u1").reshape(-1, width)
    label = batch.column(1).to_numpy(zero_copy_only=False)
    lists = batch.column(2)
    count = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, "int64")
    code = lists.flatten().to_numpy(zero_copy_only=False)
    pred = batch.column(3).flatten().to_numpy(zero_copy_only=False)
    return bins, label, np.repeat(np.arange(len(label)), count), code >> 1, (code & 1).astype(bool), pred


def _histograms(state: DataFrame, tree: Tree, level: int, width: int, bins: int, active: np.ndarray) -> DataFrame:
    """(cell, node, sums, counts) of each task; at level 0 also the squared errors per cell, of validation rows as node
    -1 and of train rows as node -2."""
    cells = len(active)
    first, nodes = 2 ** level - 1, 2 ** level

    def run(batches):
        total = np.zeros((2, width, cells * nodes * bins))  # an input at a time: a count is as long as one input's histogram
        check = np.zeros((2, 2, cells))
        seen = False
        for batch in batches:
            code, label, row, cell, val, pred = _entries(batch, width)
            on = active[cell]
            row, cell, val, rest = row[on], cell[on], val[on], (label[row] - pred)[on]
            if level == 0:
                for k, part in enumerate((val, ~val)):
                    check[k] += [np.bincount(cell[part], rest[part] ** 2, cells), np.bincount(cell[part], minlength=cells)]
            row, cell, rest = row[~val], cell[~val], rest[~val]
            at = tree.nodes(code, row, cell, level)
            inside = at >= first  # others rest in leaves above
            row, cell, rest, at = row[inside], cell[inside], rest[inside], at[inside] - first
            base = (cell * nodes + at) * bins
            for i, column in enumerate(np.ascontiguousarray(code.T)):
                place = base + column[row]
                total[0, i] += np.bincount(place, rest, total.shape[2])
                total[1, i] += np.bincount(place, minlength=total.shape[2])
            seen = True
        if seen:
            sums, counts = np.moveaxis(total.reshape(2, width, cells, nodes, bins), 1, 3)
            for c in np.flatnonzero(active):
                out = [(n, sums[c, n], counts[c, n]) for n in range(nodes) if counts[c, n].any()]
                out += [(-1 - k, check[k, 0, c:c + 1], check[k, 1, c:c + 1]) for k in (0, 1) if check[k, 1, c]]
                if out:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([c] * len(out), pa.int32()), pa.array([o[0] for o in out], pa.int32()),
                        pa.array([o[1].tobytes() for o in out], pa.binary()), pa.array([o[2].tobytes() for o in out], pa.binary())],
                        ["cell", "node", "sums", "counts"])

    return state.mapInArrow(run, "cell int, node int, sums binary, counts binary")


def _splits(histograms: DataFrame, width: int, bins: int, min_leaf: int) -> DataFrame:
    """(cell, node, feature, cut, total, count, left, some): the best split of each node (-1: none gains), sum of residuals and
    count of the node and of what goes left; for nodes below 0 the error and count."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        s = np.sum([np.frombuffer(x) for x in rows["sums"]], axis=0)
        n = np.sum([np.frombuffer(x) for x in rows["counts"]], axis=0)
        out = rows[["cell", "node"]].iloc[:1].reset_index(drop=True)
        if out["node"][0] < 0:
            return out.assign(feature=-1, cut=-1, total=float(s[0]), count=float(n[0]), left=0.0, some=0.0)
        s, n = s.reshape(width, bins), n.reshape(width, bins)
        total, count = float(s[0].sum()), float(n[0].sum())
        left, some = s.cumsum(axis=1)[:, :-1], n.cumsum(axis=1)[:, :-1]
        gain = left ** 2 / np.maximum(some, 1) + (total - left) ** 2 / np.maximum(count - some, 1) - total ** 2 / count
        gain[(some < min_leaf) | (count - some < min_leaf)] = -1
        # Gains that differ by rounding alone are ties.
        best = int(np.flatnonzero(gain.ravel() >= gain.max() - 1e-9 * max(1.0, abs(gain.max())))[0])
        feature, cut = divmod(best, bins - 1)
        half = float(left[feature, cut]), float(some[feature, cut])
        if gain.max() <= 1e-12:
            feature, cut = -1, -1
        return out.assign(feature=feature, cut=cut, total=total, count=count, left=half[0], some=half[1])

    return histograms.groupBy("cell", "node").applyInPandas(
        run, "cell int, node int, feature int, cut int, total double, count double, left double, some double")


def _advanced(state: DataFrame, tree: Tree, depth: int, width: int) -> DataFrame:
    """The state with the tree's values added to the predictions."""
    def run(batches):
        for batch in batches:
            code, label, row, cell, _, pred = _entries(batch, width)
            new = pred + tree.value[cell, tree.nodes(code, row, cell, depth)]
            made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(label)))]), pa.int32()), pa.array(new))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], made], ["bins", "label", "codes", "preds"])

    return state.mapInArrow(run, state.schema)


def fit(rows: DataFrame, plan: DataFrame, inputs: list[str], label: str = "label", rounds: int = 20, depth: int = 3, rate: float = 0.1,
        bins: int = BINS, min_leaf: int = MIN_LEAF, patience: int = PATIENCE) -> Model:
    """Trees of every cell of ``plan`` on ``rows`` (the train units' rows with ``inputs`` and ``label``). The driver holds the
    trees: 2 ** depth nodes per cell and round."""
    if not 2 <= bins <= 256:
        raise ValueError(f"bins fit in a byte: 2 to 256, got {bins}")
    base = f"{work_dir(rows.sparkSession)}/boosting_{uuid.uuid4().hex}"
    # Written once: the edges, the units and the bins are read from it, not made from the windows each time.
    rows = materialize(rows.select(*KEYS, F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in inputs]), base, "inputs")
    edges, width = bin_edges(rows, inputs, bins), len(inputs)
    cells, drawn = cell_codes(rows.select(*KEYS).distinct(), plan)
    state = binned(rows.where("_y IS NOT NULL"), inputs, edges, [*KEYS, "_y"])
    state = materialize(state.join(drawn, KEYS).select("bins", F.col("_y").alias("label"), "codes"), base, "rows")
    means = state.select("label", F.explode("codes").alias("k")).where("k % 2 = 0").groupBy("k").agg(F.avg("label").alias("m")).collect()
    start = np.zeros(len(cells))
    for r in means:
        start[r["k"] // 2] = r["m"]
    first = F.transform("codes", lambda k: F.get(F.array(*map(F.lit, start.tolist())), F.floor(k / 2).cast("int")))
    state = state.withColumn("preds", first)
    model = Model(cells, edges, start, depth=depth, used=np.zeros(len(cells), "int64"), error=np.zeros(len(cells)))
    size = 2 ** (depth + 1) - 1
    active = np.zeros(len(cells), bool)
    active[[r["k"] // 2 for r in means]] = True
    best = np.full(len(cells), np.inf)
    for t in range(rounds + 1):
        tree = Tree(np.full((len(cells), size), -1), np.full((len(cells), size), -1), np.zeros((len(cells), size)))
        for level in range(depth if t < rounds else 1):
            found = _splits(_histograms(state, tree, level, width, bins, active), width, bins, min_leaf).collect()
            if level == 0:
                for r in found:
                    if r["node"] == -1 and r["total"] < best[r["cell"]]:
                        best[r["cell"]], model.used[r["cell"]] = r["total"], t
                checked = np.isfinite(best)
                model.used[~checked] = t
                for r in found:
                    if r["node"] == -2 and model.used[r["cell"]] == t:
                        model.error[r["cell"]] = r["total"]
                model.floor = model.error.copy() if t == 0 else model.floor
                active &= ~checked | (t - model.used < patience)
            for r in found:
                c, n = r["cell"], r["node"] + 2 ** level - 1
                if r["node"] < 0 or not active[c]:
                    continue
                tree.feature[c, n], tree.cut[c, n] = r["feature"], r["cut"]
                if r["feature"] < 0:
                    tree.value[c, n] = rate * r["total"] / r["count"]
                elif level == depth - 1:
                    tree.value[c, 2 * n + 1] = rate * r["left"] / r["some"]
                    tree.value[c, 2 * n + 2] = rate * (r["total"] - r["left"]) / (r["count"] - r["some"])
            if not active.any():
                break
        if t == rounds or not active.any():
            break
        state = materialize(_advanced(state, tree, depth, width), base, f"state_{t + 1}")
        model.trees.append(tree)
    remove(rows.sparkSession, base)
    return model


def predict(model: Model, rows: DataFrame, inputs: list[str], max_rul: float, keep: list[str]) -> DataFrame:
    """(cell, keep, pred) of every row by every cell of its dataset, in [0, max_rul]."""
    table = binned(rows, inputs, model.edges, list(dict.fromkeys(["dataset", *keep])))
    of = {}
    for i, c in enumerate(model.cells):
        of.setdefault(c[0], []).append(i)
    columns = [k for k in keep if k not in CELL]
    kinds = {f.name: f for f in rows.schema}
    schema = "dataset string, n_units long, seed int, " + "".join(f"{k} {kinds[k].dataType.simpleString()}, " for k in columns) + "pred double"
    width = len(inputs)
    units, seeds = np.array([c[1] for c in model.cells], "int64"), np.array([c[2] for c in model.cells], "int32")

    def run(batches):
        for batch in batches:
            code = np.frombuffer(b"".join(batch["bins"]), "u1").reshape(-1, width)
            for dataset, part in batch.groupby("dataset").indices.items():
                cells = np.array(of.get(dataset, []), "int64")
                row, cell = np.repeat(part, len(cells)), np.tile(cells, len(part))
                value = model.start[cell] + 0.0
                for t, tree in enumerate(model.trees):
                    on = t < model.used[cell]
                    value[on] += tree.value[cell[on], tree.nodes(code, row[on], cell[on], model.depth)]
                out = batch[columns].iloc[row].reset_index(drop=True)
                out.insert(0, "dataset", dataset)
                out.insert(1, "n_units", units[cell])
                out.insert(2, "seed", seeds[cell])
                yield out.assign(pred=np.clip(value, 0.0, max_rul))

    return table.mapInPandas(run, schema)
