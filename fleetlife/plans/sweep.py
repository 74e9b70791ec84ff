"""Sweeps over data-volume cells, ablations, probes and window comparisons.

Closed-form models handle every cell in one plan; Spark ML models are fitted per cell from a small
pool. Both end in prediction rows that ``metrics.evaluate`` turns into result rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CYCLE, KEYS
from ..models import closed, gram
from ..models.learned import Model, fit_cells
from ..operators.metrics import PRED_CELL, evaluate
from ..operators.sampling import CELL, cell_rows, pending_cells

ROWS_PER_TASK = 1_000_000


def dealt(rows: DataFrame, copies: int, keys: tuple = (KEYS[1], CYCLE), per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows dealt by ``keys`` to so many tasks that each has about ``per_task`` rows once every row has become ``copies``. Rows
    that are sorted by cell after that need no other shuffle, and their tasks grow in number, not in size."""
    return rows.repartition(max(1, -(-rows.count() * copies // per_task)), *keys)


def line_predictions(train: DataFrame, test: DataFrame, plan: DataFrame, lines, max_rul: float,
                     keep: tuple = (CYCLE,)) -> DataFrame:
    """Predictions of every test row by every (model, loss, input) line of every cell. ``train``
    carries ``label`` and the inputs; ``test`` carries ``true_rul`` and the inputs."""
    inputs = [x for _, _, x in lines if x]
    params = closed.fit_lines(closed.cell_sums(closed.unit_sums(train, inputs), plan), lines)
    rows = test.withColumn("max_rul", F.lit(float(max_rul)))
    return closed.predict_lines(params, rows, lines, max_rul, ["max_rul", *KEYS, *keep, "true_rul"])


def line_sweep(train: DataFrame, test: DataFrame, plan: DataFrame, lines, max_rul: float,
               done: DataFrame | None = None) -> DataFrame:
    """Result rows of the cells that are not finished yet."""
    cells = plan if done is None else pending_cells(plan, done, CELL)
    return evaluate(line_predictions(train, test, cells, lines, max_rul), PRED_CELL, max_rul)


def learned_predictions(train: DataFrame, test: DataFrame, plan: DataFrame, make: Callable[[int], Model],
                        model: str, loss: str, max_rul: float, keep: tuple = ("end_cycle",)) -> DataFrame:
    """Predictions of a fitted model for each cell of ``plan`` (one fit per row). ``make(seed)``
    builds the unfitted model."""
    cells = plan.select(*CELL, "available", "sub_cut", "val_cut").collect()
    schema = plan.select(*CELL, "available", "sub_cut", "val_cut").schema

    def job(cell):
        one = plan.sparkSession.createDataFrame([cell], schema)
        rows = cell_rows(train, one)
        fitted = make(cell["seed"]).fit(rows.where("role = 'train'"), rows.where("role = 'val'"))
        mine = fitted.predict(test.where(F.col("dataset") == cell["dataset"]))
        facts = {"model": model, "loss": loss, "max_rul": float(max_rul), "n_units": cell["n_units"], "seed": cell["seed"]}
        return mine.withColumns({k: F.lit(v) for k, v in facts.items()}).select(
            *PRED_CELL, KEYS[1], *keep, "true_rul", "pred")

    return fit_cells([lambda c=c: job(c) for c in cells])


def whole_fleet(plan: DataFrame) -> DataFrame:
    """The full-data cells of a plan."""
    return plan.where(F.col("n_units") == F.col("available"))


def over_levels(levels: dict, run: Callable[[object], DataFrame], name: str = "level") -> DataFrame:
    """Result rows of ``run(value)`` for each named level, with the level as a column. Used for
    probes (one factor at a time), ablations and window sizes."""
    parts = [run(value).withColumn(name, F.lit(level)) for level, value in levels.items()]
    return reduce(DataFrame.unionByName, parts)


def ridge_predictions(train: DataFrame, test: DataFrame, plan: DataFrame, column: str, model: str, loss: str, max_rul: float,
                      alphas=gram.ALPHAS, scaled=(), keep: tuple = ("end_cycle",)) -> DataFrame:
    """Predictions of a linear model on the inputs in the array ``column`` for all cells of ``plan`` in one plan: one pass over
    the train rows, whatever the number of cells and penalties."""
    sums = gram.cell_grams(gram.unit_grams(train, column), plan)
    facts = {"model": F.lit(model), "loss": F.lit(loss), "max_rul": F.lit(float(max_rul))}
    params = gram.fit_ridge(sums, CELL, alphas, scaled).withColumns(facts)
    names = [*PRED_CELL, KEYS[1], *keep, "true_rul"]
    return gram.predict(params, test, column, max_rul, names).select(*names, "pred")
