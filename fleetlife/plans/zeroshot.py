"""Remaining life without training: health index, failure threshold, forecast, crossing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CYCLE, KEYS, UNIT
from ..functions.errors import clip
from ..models import closed
from ..operators import health
from ..operators.metrics import PRED_CELL, evaluate
from ..operators.sampling import bootstrap_units
from ..session import small_side

FLOORS = (("predict_mean", "native", None), ("cycle_reg", "native", CYCLE))


def crossings(train: DataFrame, test: DataFrame, channels: list[str], draws: DataFrame, horizon: int,
              last_k: int, q: float = 0.5) -> DataFrame:
    """Per test unit and seed: the step at which the forecast index reaches the threshold
    (``crossing``), with ``true_rul``."""
    transform = small_side(health.fit_health_index(train, channels, draws))
    threshold = small_side(health.failure_threshold(train, transform, draws, channels, q))
    ahead = health.trend_forecast(test, transform, channels, last_k, horizon, ("actual_rul",))
    step = health.crossing_rul(F.col("last_hi"), F.col("forecast"), F.col("threshold"), horizon)
    return ahead.join(threshold, ["dataset", "seed"]).select(
        *KEYS, "seed", "end_cycle", F.col("actual_rul").alias("true_rul"), step.alias("crossing"))


def zero_shot(train: DataFrame, test: DataFrame, units: DataFrame, channels: list[str], seeds, max_rul: float,
              last_k: int, horizon: int | None = None, q: float = 0.5, name: str = "trend_zeroshot") -> DataFrame:
    """Result rows of the zero-shot arm and the two floors. Each seed redraws the train units with
    replacement; the index, the threshold and the floors all use that draw."""
    draws = bootstrap_units(units, seeds)
    found = crossings(train, test, channels, draws, int(horizon or max_rul), last_k, q)
    arm = found.select(
        F.lit(name).alias("model"), F.lit("zeroshot").alias("loss"), "dataset", "seed", UNIT, "true_rul",
        clip(F.col("crossing"), max_rul).alias("pred"))
    sums = closed.unit_sums(train, [CYCLE], "clipped_rul").join(draws, KEYS)
    params = closed.fit_lines(closed.add_up(sums, ["dataset", "seed"], "freq"), FLOORS, ["dataset", "seed"])
    last = test.where(F.col(CYCLE) == F.col("n_obs")).withColumn("true_rul", F.col("actual_rul"))
    floors = closed.predict_lines(params, last, FLOORS, max_rul, [UNIT, "true_rul"])
    preds = arm.unionByName(floors).withColumns({"max_rul": F.lit(float(max_rul)), "n_units": F.lit(0).cast("bigint")})
    return evaluate(preds, PRED_CELL, max_rul)
