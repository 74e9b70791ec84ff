"""Time-series indicators of a window, as array expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import KEYS

INDICATORS = ("acf1", "acf2", "acf_drop", "longest_above", "crossings", "max_diff", "mode_bin", "low_share")
MODE_BINS = 5
LOW_LAGS = 3
UNROLLED = 40


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _field(name):
    return lambda row: row[name].cast("double")


def _with_shape(df: DataFrame, x: str, size: int) -> DataFrame:
    """Steps the indicators share, as columns of their own so that each is computed once: the
    centred values, the autocorrelations, the range, the bin counts."""
    z, acf, low, high, bins = (f"{x}_{n}" for n in ("z", "acf", "low", "high", "bins"))
    df = df.withColumns({f"{x}_mean": _total(F.col(x)) / size, low: F.array_min(x), high: F.array_max(x)})
    mean, lo, hi = F.col(f"{x}_mean"), F.col(low), F.col(high)
    df = df.withColumn(z, F.transform(x, lambda v: v - mean))
    energy = F.aggregate(z, F.lit(0.0), lambda a, v: a + v * v)
    df = df.withColumn(f"{x}_energy", energy)
    at = [F.get(z, F.lit(i)) for i in range(size)]

    def lag(k):
        if size > UNROLLED:
            return _total(F.zip_with(F.slice(z, 1, size - k), F.slice(z, k + 1, size - k), lambda a, b: a * b))
        # a short window: a plain sum of products, compiled with the rest of the stage
        total = at[0] * at[k]
        for i in range(1, size - k):
            total = total + at[i] * at[i + k]
        return total

    scale = F.when(F.col(f"{x}_energy") > 0, 1.0 / F.col(f"{x}_energy")).otherwise(0.0)
    df = df.withColumn(acf, F.array(*[lag(k) * scale for k in range(1, size)]))
    place = F.transform(x, lambda v: F.when(hi > lo, F.least(
        F.lit(MODE_BINS - 1), F.floor((v - lo) / (hi - lo) * MODE_BINS))).otherwise(0))
    df = df.withColumn(f"{x}_place", place)
    spots = [F.get(f"{x}_place", F.lit(i)) for i in range(size)]
    counts = [sum(((p == b).cast("int") for p in spots[1:]), (spots[0] == b).cast("int")) for b in range(MODE_BINS)]
    return df.withColumn(bins, F.array(*counts))


def _indicators(x: str, size: int) -> dict[str, Column]:
    z, acf, bins = F.col(f"{x}_z"), F.col(f"{x}_acf"), F.col(f"{x}_bins")
    drop = F.array_position(F.transform(acf, lambda r: r < 1 / math.e), True)
    run = F.aggregate(
        z, F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda a, v: F.struct(F.when(v > 0, a["now"] + 1).otherwise(0).alias("now"),
                              F.greatest(a["best"], F.when(v > 0, a["now"] + 1).otherwise(0)).alias("best")),
        lambda a: a["best"])
    value = [F.get(x, F.lit(i)) for i in range(size)]
    above = [F.get(z, F.lit(i)) > 0 for i in range(size)]
    crossed = sum(((a != b).cast("int") for a, b in zip(above[1:-1], above[2:])), (above[0] != above[1]).cast("int"))
    squares = F.transform(acf, lambda r: r * r)
    whole, near = _total(squares), _total(F.slice(squares, 1, LOW_LAGS))
    return {
        "acf1": acf[0], "acf2": acf[1], "acf_drop": F.when(drop > 0, drop).otherwise(size).cast("double"),
        "longest_above": run.cast("double"), "crossings": crossed / (size - 1),
        "max_diff": F.greatest(*[F.abs(b - a) for a, b in zip(value, value[1:])]),
        "mode_bin": (F.array_position(bins, F.array_max(bins)) - 1).cast("double"),
        "low_share": F.when(whole > 0, near / whole).otherwise(F.lit(0.0)),
    }


def window_indicators(windows: DataFrame, channels: list[str], size: int) -> DataFrame:
    """Indicators of every channel of every window of ``size`` rows: columns
    ``<channel>_<indicator>``.

    ``acf1/acf2``: autocorrelation; ``acf_drop``: first lag with autocorrelation below 1/e (the
    window size if none); ``longest_above``: longest run above the mean; ``crossings``: share of
    steps that cross the mean; ``max_diff``: largest step; ``mode_bin``: fullest of five equal bins
    (the lowest on ties); ``low_share``: share of the squared autocorrelation in the first lags.
    A flat window has autocorrelation 0."""
    base = windows.withColumns({f"_{c}": F.transform("win", _field(c)) for c in channels}).drop("win")
    for c in channels:
        base = _with_shape(base, f"_{c}", size)
    return base.select(*KEYS, "end_cycle", "label", *[
        v.alias(f"{c}_{n}") for c in channels for n, v in _indicators(f"_{c}", size).items()])
