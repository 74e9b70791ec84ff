"""From predictions and result rows to the tables of a study."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import compare, metrics
from ..operators.sampling import finished_cells, pending_cells
from ..operators.metrics import PRED_CELL
from ..session import cut_lineage
from ..sources.store import commit_cells, committed


def horizon_rows(preds: DataFrame, max_rul: float, edges: list[float] | None = None) -> DataFrame:
    """Error by distance to failure of every cell."""
    return metrics.horizon_bins(preds, PRED_CELL, max_rul, edges or metrics.bin_edges(max_rul))


def pending_horizon(grid: DataFrame, bins: DataFrame, preds: DataFrame, keys: list[str] = PRED_CELL) -> DataFrame:
    """Cells still to run. A cell is finished when both its bins and its predictions are stored;
    bins without predictions raise."""
    return pending_cells(grid, finished_cells(bins, preds, keys), keys)


def earliness_and_cost(preds: DataFrame, edges, ratios, done_hist: DataFrame | None = None,
                       done_cost: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Histogram and cost rows of the cells each table does not hold yet."""
    def todo(done):
        return preds if done is None else pending_cells(preds, done, PRED_CELL)

    return (metrics.earliness(todo(done_hist), PRED_CELL, edges),
            metrics.cost_curve(todo(done_cost), PRED_CELL, ratios))


def study_tables(results: DataFrame, preds: DataFrame, edges, ratios) -> dict[str, DataFrame]:
    """All cross-model tables from concatenated runs: repeated rows are dropped once, on keys that
    include the cycle."""
    rows = compare.dedupe(results, PRED_CELL, ["rmse_clipped"], same=["rmse_clipped"])
    once = compare.dedupe(preds, [*PRED_CELL, "unit_number", "time_cycles"], ["pred"], same=["pred"])
    hist, costs = earliness_and_cost(once, edges, ratios)
    return {
        "data_scaling": compare.data_scaling(rows), "success_map": compare.success_map(rows),
        "earliness": hist, "cost": costs, "roster": compare.roster(rows),
    }


def restart(preds: DataFrame, base: str, edges, ratios) -> tuple[DataFrame, DataFrame]:
    """Histogram and cost tables under ``base``, brought up to the cells of ``preds``: cells that a table holds are not run again,
    each table by itself, and what an earlier run left undone is. The predictions of cells that a table lacks are read once,
    for the sums of both tables, which are a row per cell. Returns both tables as stored."""
    spark = preds.sparkSession
    makers = {"earliness": lambda s: metrics.earliness_of(s, PRED_CELL, edges), "cost": lambda s: metrics.cost_of(s, PRED_CELL, ratios)}

    def sums(rows):
        return rows.groupBy(*PRED_CELL).agg(*metrics.earliness_sums(edges), *metrics.cost_sums())

    schemas = {name: make(sums(preds)).schema for name, make in makers.items()}
    done = {name: committed(spark, f"{base}/{name}", schema).select(*PRED_CELL).distinct() for name, schema in schemas.items()}
    found = cut_lineage(sums(pending_cells(preds, done["earliness"].intersect(done["cost"]), PRED_CELL)))
    for name, make in makers.items():
        commit_cells(make(pending_cells(found, done[name], PRED_CELL)), f"{base}/{name}", PRED_CELL)
    return tuple(committed(spark, f"{base}/{name}", schema) for name, schema in schemas.items())
