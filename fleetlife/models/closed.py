"""Closed-form models of all cells in one job.

Rows are reduced to sums per unit; a cell's fit is the sum over its units. The number of cells
does not multiply the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import KEYS
from ..functions.errors import clip
from ..operators.sampling import CELL, cell_rows


def unit_sums(rows: DataFrame, inputs: list[str], label: str = "label") -> DataFrame:
    """Per unit: count, and the sums a mean or a line on any of ``inputs`` needs."""
    y = F.col(label)
    out = [F.count("*").cast("double").alias("sum_n"), F.sum(y).alias("sum_y")]
    for x in inputs:
        v = F.col(x).cast("double")
        out += [F.sum(v).alias(f"sum_{x}"), F.sum(v * v).alias(f"sum_{x}_sq"),
                F.sum(v * y).alias(f"sum_{x}_y")]
    return rows.groupBy(*KEYS).agg(*out)


def cell_sums(sums: DataFrame, plan: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """Sums of each cell over its train units."""
    return add_up(cell_rows(sums, plan).where("role = 'train'"), cell)


def add_up(sums: DataFrame, cell: list[str], weight: str | None = None) -> DataFrame:
    """Unit sums added up per cell; ``weight`` repeats a unit (bootstrap counts)."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    names = [c for c in sums.columns if c.startswith("sum_")]
    return sums.groupBy(*cell).agg(*[F.sum(w * F.col(c)).alias(c) for c in names])


def fit_lines(cells: DataFrame, lines: list[tuple], cell: list[str] = CELL) -> DataFrame:
    """Every (model, loss, input) line of every cell from one table of cell sums; an input of None
    is the mean. Adds model, loss, slope, intercept."""
    fits = []
    n, sy = F.col("sum_n"), F.col("sum_y")
    for model, loss, x in lines:
        slope = F.lit(0.0)
        shift = sy
        if x is not None:
            sx = F.col(f"sum_{x}")
            spread = n * F.col(f"sum_{x}_sq") - sx * sx
            slope = F.when(spread > 0, (n * F.col(f"sum_{x}_y") - sx * sy) / spread).otherwise(0.0)
            shift = sy - slope * sx
        fits.append(F.struct(F.lit(model).alias("model"), F.lit(loss).alias("loss"),
                             slope.alias("slope"), (shift / n).alias("intercept")))
    return cells.select(*cell, F.inline(F.array(*fits)))


def fit_mean(cells: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """Mean label per cell, as a line of slope 0."""
    return fit_lines(cells, [("predict_mean", "native", None)], cell)


def fit_line(cells: DataFrame, x: str, cell: list[str] = CELL) -> DataFrame:
    """Least-squares line label ~ x per cell (slope 0 when x does not vary)."""
    return fit_lines(cells, [("cycle_reg", "native", x)], cell)


def predict_lines(params: DataFrame, rows: DataFrame, lines: list[tuple], max_rul: float,
                  keep: list[str], on: tuple = ("dataset",)) -> DataFrame:
    """Clipped predictions of every fitted line for every row. ``params`` has one row per cell and
    line (datasets x counts x seeds x lines, all chosen by the caller), so it is broadcast."""
    value = F.lit(0.0)
    for model, loss, x in lines:
        if x is not None:
            hit = (F.col("model") == model) & (F.col("loss") == loss)
            value = F.when(hit, F.col(x).cast("double")).otherwise(value)
    out = rows.join(F.broadcast(params), list(on))
    cells = [c for c in params.columns if c not in ("slope", "intercept")]
    return out.select(*cells, *[k for k in keep if k not in cells],
                      clip(F.col("intercept") + F.col("slope") * value, max_rul).alias("pred"))
