"""The one loading path: label, normalise by condition, perturb, in that order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MULTI_CONDITION
from ..functions.errors import cap
from ..operators.conditions import normalize_conditions
from ..operators.labels import label_test, label_train
from ..operators.perturb import inject_split
from ..session import small_side


def prepare(train: DataFrame, test: DataFrame, truth: DataFrame | None, channels: list[str], max_rul: float,
            by_condition: bool = False, noise: dict | None = None, seed: int = 42,
            family: str = "turbofan") -> tuple[DataFrame, DataFrame]:
    """Labelled train and test frames of one fleet; ``truth`` is None when the test frame carries its own (see
    ``truncate_units``). ``by_condition`` normalises the channels with the statistics of all train rows of a
    condition. ``noise`` (kind, magnitude, seed) comes last, and only in families that are simulated."""
    frames = label_train(train, max_rul), label_test(test, truth, max_rul)
    if by_condition:
        frames = normalize_conditions(*frames, channels)
    return inject_split(*frames, channels, noise, seed, family) if noise else frames


def several_conditions(dataset: str) -> bool:
    """Whether a fleet runs at more than one operating condition."""
    return dataset in MULTI_CONDITION


def with_settings(frame: DataFrame, settings: DataFrame, defaults: dict) -> DataFrame:
    """Per-dataset protocol settings as columns: a dataset's own value, else the default.
    ``settings``: dataset plus any of the default names."""
    named = settings.select("dataset", *[F.col(c).alias(f"_{c}") for c in settings.columns if c != "dataset"])
    out = frame.join(small_side(named), "dataset", "left")
    values = {
        k: F.coalesce(F.col(f"_{k}"), F.lit(v)) if k in settings.columns else F.lit(v) for k, v in defaults.items()}
    return out.withColumns(values).drop(*[c for c in named.columns if c != "dataset"])


def label_fleets(frame: DataFrame, settings: DataFrame, defaults: dict) -> DataFrame:
    """Labels of all fleets in one frame (with ``n_obs``), each capped at its own ``max_rul``."""
    out = with_settings(frame, settings, defaults)
    return out.withColumn("clipped_rul", cap(F.col("actual_rul"), F.col("max_rul").cast("double")))
