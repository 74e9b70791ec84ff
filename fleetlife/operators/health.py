"""Health index, failure threshold, forecasts and threshold crossing (no life labels used)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CYCLE, KEYS, UNIT
from ..session import cut_lineage
from .labels import with_length
from .quantiles import weighted_quantile


def fit_health_index(frame: DataFrame, channels: list[str], draws: DataFrame) -> DataFrame:
    """Per (dataset, seed): channel means and deviations, and the first principal direction of
    the z-scores, turned so that the index grows with the cycle. ``draws`` are bootstrap counts
    (dataset, seed, unit_number, freq); a unit's rows count ``freq`` times.

    Rows are reduced to sums per unit once, whatever the number of seeds; each seed then weights
    the unit sums. Only C x C sums per seed reach the eigen-solve.
    """
    shift = F.broadcast(frame.groupBy("dataset").agg(
        *[F.avg(c).alias(f"_o_{c}") for c in channels]))  # one row per dataset
    x = {c: F.col(c) - F.col(f"_o_{c}") for c in channels}
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[i:]]
    t = F.col(CYCLE).cast("double")
    sums = (frame.join(shift, "dataset").groupBy(*KEYS).agg(
        F.count("*").alias("_n"), F.sum(t).alias("_t"),
        *[F.sum(x[c]).alias(f"_s_{c}") for c in channels],
        *[F.sum(x[c] * t).alias(f"_t_{c}") for c in channels],
        *[F.sum(x[a] * x[b]).alias(f"_p_{a}_{b}") for a, b in pairs]))
    weighted = draws.join(sums, KEYS).groupBy("dataset", "seed").agg(*[
        F.sum(F.col("freq") * F.col(c)).alias(c) for c in sums.columns if c not in KEYS])
    n = F.col("_n")
    mean = {c: F.col(f"_s_{c}") / n for c in channels}

    def cov(a, b):
        first, second = (a, b) if (a, b) in pairs else (b, a)
        return F.col(f"_p_{first}_{second}") / n - mean[a] * mean[b]

    std = {c: F.when(cov(c, c) >= 1e-16, F.sqrt(cov(c, c))).otherwise(1.0) for c in channels}
    matrix = F.array(*[cov(a, b) / (std[a] * std[b]) for a in channels for b in channels])
    with_time = F.array(*[(F.col(f"_t_{c}") / n - mean[c] * F.col("_t") / n) / std[c] for c in channels])

    @F.pandas_udf("array<double>")
    def first_direction(corr: pd.Series, slope: pd.Series) -> pd.Series:
        out = []
        for m, s in zip(corr, slope):
            side = int(round(len(m) ** 0.5))
            _, vectors = np.linalg.eigh(np.asarray(m, float).reshape(side, side))
            v = vectors[:, -1]
            lean = float(v @ np.asarray(s, float))
            out.append(list(-v if lean < 0 else v))
        return pd.Series(out)

    return (weighted.join(shift, "dataset").select(
        "dataset", "seed", F.array(*[mean[c] + F.col(f"_o_{c}") for c in channels]).alias("hi_mean"),
        F.array(*[std[c] for c in channels]).alias("hi_std"),
        first_direction(matrix, with_time).alias("hi_dir")))


def index_value(channels: list[str]) -> Column:
    """Health index of a row that carries ``hi_mean, hi_std, hi_dir``."""
    terms = [(F.col(c) - F.col("hi_mean")[i]) / F.col("hi_std")[i] * F.col("hi_dir")[i]
             for i, c in enumerate(channels)]
    out = terms[0]
    for term in terms[1:]:
        out = out + term
    return out


def health_index(frame: DataFrame, transform: DataFrame, channels: list[str]) -> DataFrame:
    """Add ``seed`` and ``hi``: one row per row and seed. ``transform`` has a row per
    (dataset, seed)."""
    return (frame.join(F.broadcast(transform), "dataset").withColumn("hi", index_value(channels))
            .drop("hi_mean", "hi_std", "hi_dir"))


def failure_threshold(train: DataFrame, transform: DataFrame, draws: DataFrame,
                      channels: list[str], q: float = 0.5) -> DataFrame:
    """q-quantile over drawn units of the index at the unit's last cycle, per (dataset, seed)."""
    last = with_length(train).where(F.col(CYCLE) == F.col("n_obs"))
    at_end = health_index(last, transform, channels).join(draws, ["dataset", "seed", UNIT])
    # the quantile reads its input three times: one row per unit and seed, written out once
    at_end = cut_lineage(at_end.select("dataset", "seed", "hi", "freq"))
    return weighted_quantile(at_end, ["dataset", "seed"], "hi", "freq", q, "threshold")


def trend_forecast(frame: DataFrame, transform: DataFrame, channels: list[str], last_k: int,
                   horizon: int, keep: tuple = ()) -> DataFrame:
    """Straight-line forecast of each unit's index from its last ``last_k`` rows: columns
    ``last_hi`` and ``forecast`` (array of ``horizon`` steps), per (unit, seed)."""
    tail = with_length(frame).where(F.col(CYCLE) > F.col("n_obs") - last_k)
    rows = health_index(tail, transform, channels)
    fit = rows.groupBy(*KEYS, "seed").agg(
        F.max(CYCLE).alias("end_cycle"), F.max_by("hi", CYCLE).alias("last_hi"),
        F.coalesce(F.regr_slope("hi", CYCLE), F.lit(0.0)).alias("_b"),
        F.avg("hi").alias("_y"), F.avg(CYCLE).alias("_x"),
        *[F.max_by(c, CYCLE).alias(c) for c in keep])
    steps = F.sequence(F.lit(1), F.lit(horizon))
    line = F.transform(steps, lambda h: F.col("_y") + F.col("_b") * (F.col("end_cycle") + h - F.col("_x")))
    return fit.withColumn("forecast", line).drop("_b", "_y", "_x")


def plugged_forecast(series: DataFrame, make: Callable[[], object], horizon: int,
                     column: str = "series") -> DataFrame:
    """Forecast with a user's model: ``make()`` is called once per task and must return an object
    with ``forecast(values, horizon)``. Each row carries its history array; rows stay where they
    are, so no group is gathered. Adds ``forecast``."""
    names = series.columns
    schema = series.select("*").withColumn("forecast", F.array().cast("array<double>")).schema

    def run(batches):
        model = make()
        for batch in batches:
            batch["forecast"] = [
                [float(v) for v in model.forecast(np.asarray(s, float), horizon)[:horizon]]
                for s in batch[column]
            ]
            yield batch[[*names, "forecast"]]

    return series.mapInPandas(run, schema)


def crossing_rul(last: Column, forecast: Column, threshold: Column, horizon: int) -> Column:
    """0 when the last value is at the threshold already; else the first forecast step at or above
    it (from 1), or ``horizon`` when it is never reached."""
    step = F.array_position(F.transform(forecast, lambda x: x >= threshold), True)
    return (F.when(last >= threshold, 0.0).when(step > 0, step.cast("double"))
            .otherwise(F.lit(float(horizon))))
