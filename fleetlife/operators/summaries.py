"""Reduction of high-rate rows to one row per cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BEARING_INDICATORS, CYCLE, KEYS


def to_long(frame: DataFrame, channels: list[str], ids: list[str]) -> DataFrame:
    """Channels as rows (channel, x)."""
    return frame.unpivot(ids, channels, "channel", "x")


def to_wide(long: DataFrame, channels: list[str], ids: list[str]) -> DataFrame:
    """Back to one column per channel."""
    return long.groupBy(*ids).pivot("channel", channels).agg(F.first("x"))


def aggregate_cycles(rows: DataFrame, channels: list[str], flight_class: str, order: list[str],
                     by: tuple = (*KEYS, CYCLE)) -> DataFrame:
    """Mean and sample deviation of each channel per cycle (0 for a one-row cycle), the row count
    as ``cycle_len_s``, and the class value of the cycle's first row as ``setting_1``."""
    # a single order column keeps the aggregation hash-based
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    stats = []
    for c in channels:
        stats += [F.avg(c).alias(f"{c}_mean"),
                  F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std")]
    return rows.groupBy(*by).agg(
        F.min_by(flight_class, place).cast("double").alias("setting_1"),
        *stats, F.count("*").cast("double").alias("cycle_len_s"),
    ).withColumns({"setting_2": F.lit(0.0), "setting_3": F.lit(0.0)})


def snapshot_indicators(samples: DataFrame, axes: dict[str, str], by: tuple) -> DataFrame:
    """Time-domain indicators of each axis of a snapshot: rms, excess kurtosis, skewness, peak,
    peak to peak, crest, impulse and shape factor. ``axes``: output prefix -> sample column.
    A flat snapshot has kurtosis -3 and skewness 0, which its range tells: merged moments of equal
    values are not always zero. Zero denominators become 1e-12."""
    tiny = F.lit(1e-12)
    base, cols = [], []
    for p, c in axes.items():
        x = F.col(c).cast("double")
        base += [F.sqrt(F.avg(x * x)).alias(f"{p}_rms"), F.kurtosis(x).alias(f"{p}_k"),
                 F.skewness(x).alias(f"{p}_s"), F.max(F.abs(x)).alias(f"{p}_peak"),
                 F.avg(F.abs(x)).alias(f"{p}_abs"), (F.max(x) - F.min(x)).alias(f"{p}_p2p"),
                 (F.max(x) == F.min(x)).alias(f"{p}_flat")]
        rms, peak, flat = (F.col(f"{p}_{n}") for n in ("rms", "peak", "flat"))
        safe_rms = F.when(rms > 0, rms).otherwise(tiny)
        safe_abs = F.when(F.col(f"{p}_abs") > 0, F.col(f"{p}_abs")).otherwise(tiny)
        values = {
            "rms": rms, "kurtosis": F.coalesce(F.when(~flat, F.nanvl(F.col(f"{p}_k"), F.lit(None))), F.lit(-3.0)),
            "skewness": F.coalesce(F.when(~flat, F.nanvl(F.col(f"{p}_s"), F.lit(None))), F.lit(0.0)),
            "peak": peak, "p2p": F.col(f"{p}_p2p"), "crest": peak / safe_rms,
            "impulse": peak / safe_abs, "shape": safe_rms / safe_abs,
        }
        cols += [values[n].alias(f"{p}_{n}") for n in BEARING_INDICATORS]
    return samples.groupBy(*by).agg(*base).select(*by, *cols)
