"""Boosted trees of all cells. Their numbers follow no SQL; what must hold for every cell does."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlife.config import CYCLE
from fleetlife.models import boosting, indicators
from fleetlife.operators import windows
from fleetlife.operators.sampling import CELL

from .base import CAP, FLEET_SQL, MEMBERS_SQL, WINDOW, cells, fleet, query

CHANNELS = ["s_1", "s_2", "s_3"]
ROUNDS = 8


def _stats(spark, path, channels):
    """Window statistics of train units, and of the last window of test units."""
    train, test = (fleet(spark, path, s).withColumn("age", F.col(CYCLE)) for s in ("train", "test"))
    return (windows.window_stats(train, channels, WINDOW), windows.last_window_stats(test, channels, WINDOW),
            [f"{c}_{s}" for s in windows.STATS for c in channels])


def _facts(spark, path, train, test, inputs, model):
    """Per cell: test units predicted, all predictions in range, and the train rows' squared error not above the mean's."""
    made = boosting.fit(train, cells(spark, path), inputs, rounds=ROUNDS)
    preds = boosting.predict(made, test, inputs, CAP, ["unit_number"])
    fits = spark.createDataFrame([(*c, bool(e <= f)) for c, e, f in zip(made.cells, made.error, made.floor)],
                                 "dataset string, n_units long, seed int, fits boolean")
    found = preds.groupBy(*CELL).agg(F.count("*").alias("n"), F.expr(f"min(pred) >= 0 AND max(pred) <= {CAP}").alias("in_range"))
    return found.join(fits, CELL).select(F.lit(model).alias("model"), *CELL, "n", "in_range", "fits")


def _facts_sql(model: str) -> str:
    return f"""WITH {FLEET_SQL}, {MEMBERS_SQL}, t AS (SELECT dataset, count(DISTINCT unit_number) AS n FROM fleet WHERE split = 'test' GROUP BY dataset)
SELECT '{model}' AS model, c.dataset, c.n_units, c.seed, t.n, true AS in_range, true AS fits FROM cells c JOIN t ON t.dataset = c.dataset"""


@query("boosted_trees_cells", "M4 M11", _facts_sql("gbm"))
def boosted_trees_cells(spark, path):
    return _facts(spark, path, *_stats(spark, path, CHANNELS), "gbm")


@query("boosted_trees_with_age_cells", "M5 X4 M11", _facts_sql("gbm_age"))
def boosted_trees_with_age_cells(spark, path):
    return _facts(spark, path, *_stats(spark, path, ["age", *CHANNELS]), "gbm_age")


@query("indicator_trees_cells", "M7 M11", _facts_sql("indicator_gbm"))
def indicator_trees_cells(spark, path):
    train = windows.sliding_windows(fleet(spark, path, "train"), CHANNELS, WINDOW)
    test = windows.last_windows(fleet(spark, path, "test"), CHANNELS, WINDOW)
    names = [f"{c}_{n}" for c in CHANNELS for n in indicators.INDICATORS]
    return _facts(spark, path, *(indicators.window_indicators(w, CHANNELS, WINDOW) for w in (train, test)), names, "indicator_gbm")
