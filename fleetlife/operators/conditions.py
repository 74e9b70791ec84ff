"""Operating conditions: keys, per-condition scaling, and condition counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTING_DECIMALS, SETTINGS
from ..functions.errors import guarded_std
from ..session import small_side
from .numbering import number_rows


def snap(value: Column, decimals: int) -> Column:
    """Round half to even at ``decimals`` places, with -0.0 turned into 0.0."""
    factor = float(10 ** decimals)
    return F.rint(value * factor) / factor + 0.0


def condition_keys(frame: DataFrame, settings=SETTINGS, decimals=SETTING_DECIMALS) -> DataFrame:
    """Add ``key_1..`` : the settings snapped to their grid. Keys are values, not ranks, so train
    and test rows at one operating point always agree."""
    return frame.withColumns({
        f"key_{i}": snap(F.col(c), d) for i, (c, d) in enumerate(zip(settings, decimals), 1)
    })


def _keys(frame: DataFrame) -> list[str]:
    return sorted((c for c in frame.columns if c.startswith("key_")), key=lambda c: int(c[4:]))


def fit_condition_scaler(train: DataFrame, channels: list[str]) -> DataFrame:
    """Mean and population deviation of each channel, per dataset and condition, plus one global
    row per dataset (``is_global``), in one pass over the keyed train rows."""
    keys = _keys(train)
    aggs = [F.count("*").alias("n_rows"), F.max(F.grouping(keys[0])).cast("boolean").alias("is_global")]
    for c in channels:
        aggs += [F.avg(c).alias(f"{c}_mean"), guarded_std(F.stddev_pop(c)).alias(f"{c}_std")]
    sets = [[F.col("dataset"), *map(F.col, keys)], [F.col("dataset")]]
    return train.groupingSets(sets, "dataset", *keys).agg(*aggs)


def apply_condition_scaler(frame: DataFrame, scaler: DataFrame, channels: list[str]) -> DataFrame:
    """Z-score each channel with its condition's statistics; conditions not seen in training use
    the dataset's global row."""
    keys = _keys(frame)
    stats = [f"{c}_{s}" for c in channels for s in ("mean", "std")]
    scaler = small_side(scaler)
    own = scaler.where(~F.col("is_global")).select("dataset", *keys, *stats)
    overall = scaler.where("is_global").select(
        "dataset", *[F.col(s).alias(f"_all_{s}") for s in stats])
    joined = frame.join(own, ["dataset", *keys], "left").join(F.broadcast(overall), "dataset", "left")

    def stat(name):
        return F.coalesce(F.col(name), F.col(f"_all_{name}"))

    scaled = {c: (F.col(c) - stat(f"{c}_mean")) / stat(f"{c}_std") for c in channels}
    return joined.withColumns(scaled).drop(*stats, *[f"_all_{s}" for s in stats])


def normalize_conditions(train: DataFrame, test: DataFrame, channels: list[str]):
    """Fit on all train rows, apply to both frames. Returns (train, test)."""
    train, test = condition_keys(train), condition_keys(test)
    scaler = small_side(fit_condition_scaler(train, channels))
    drop = _keys(train)
    return (apply_condition_scaler(train, scaler, channels).drop(*drop),
            apply_condition_scaler(test, scaler, channels).drop(*drop))


def condition_ids(frame: DataFrame) -> DataFrame:
    """Add ``condition_id``: the rank (from 0) of the row's key among the dataset's own keys.
    Diagnostic only; the ranks of two frames are not comparable."""
    keys = _keys(frame)
    ranked = number_rows(frame.select("dataset", *keys).distinct(), ["dataset"], keys, "condition_id")
    ranked = ranked.withColumn("condition_id", (F.col("condition_id") - 1).cast("int"))
    return frame.join(small_side(ranked), ["dataset", *keys])
