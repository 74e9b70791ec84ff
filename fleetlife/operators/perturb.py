"""Seeded perturbation of simulated readings: gaussian noise, drift and dropout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CYCLE, KEYS, SIMULATED_KINDS, UNIT
from ..functions.errors import guarded_std
from ..functions.hashing import normal, uniform
from ..session import small_side
from .labels import with_length


def _with_std(frame: DataFrame, channels: list[str]) -> DataFrame:
    """Add ``_sd_<channel>``: population deviation over the dataset's rows, guarded."""
    std = frame.groupBy("dataset").agg(
        *[guarded_std(F.stddev_pop(c)).alias(f"_sd_{c}") for c in channels])
    return frame.join(small_side(std), "dataset")


def _row_key(channel: str, seed: int):
    return F.col("dataset"), F.col(UNIT), F.col(CYCLE), channel, seed


def add_gaussian(frame: DataFrame, channels: list[str], seed: int, snr_db: float = 20.0) -> DataFrame:
    """White noise with deviation std / sqrt(10^(snr/10)) per channel."""
    scale = (10.0 ** (snr_db / 10.0)) ** 0.5
    out = _with_std(frame, channels)
    noisy = {c: F.col(c) + normal(*_row_key(c, seed)) * F.col(f"_sd_{c}") / scale for c in channels}
    return out.withColumns(noisy).select(*frame.columns)


def add_drift(frame: DataFrame, channels: list[str], magnitude: float = 1.0) -> DataFrame:
    """Ramp from 0 at a unit's first cycle to ``magnitude`` deviations at its last."""
    out = _with_std(with_length(frame), channels)
    ramp = F.when(F.col("n_obs") > 1,
                  (F.col(CYCLE) - 1) / F.greatest(F.col("n_obs") - 1, F.lit(1))).otherwise(F.lit(0.0))
    drifted = {c: F.col(c) + ramp * (F.lit(float(magnitude)) * F.col(f"_sd_{c}")) for c in channels}
    return out.withColumns(drifted).select(*frame.columns)


def add_dropout(frame: DataFrame, channels: list[str], seed: int, rate: float = 0.1) -> DataFrame:
    """Each (row, channel) set to 0 with probability ``rate``."""
    return frame.withColumns({
        c: F.when(uniform(*_row_key(c, seed)) < rate, F.lit(0.0)).otherwise(F.col(c)) for c in channels
    })


def inject(frame: DataFrame, channels: list[str], spec: dict, seed: int) -> DataFrame:
    """Apply the perturbation named by ``spec['kind']``."""
    kind = spec["kind"]
    if kind == "gaussian":
        return add_gaussian(frame, channels, seed, float(spec.get("snr_db", 20.0)))
    if kind == "drift":
        return add_drift(frame, channels, float(spec.get("magnitude", 1.0)))
    if kind == "dropout":
        return add_dropout(frame, channels, seed, float(spec.get("rate", 0.1)))
    raise ValueError(f"unknown noise kind {kind!r}")


def inject_split(train: DataFrame, test: DataFrame, channels: list[str], spec: dict, seed: int,
                 kind: str) -> tuple[DataFrame, DataFrame]:
    """Perturb both frames with different, fixed seeds. Real measurements are refused."""
    if kind not in SIMULATED_KINDS:
        raise ValueError(f"only simulated fleets {SIMULATED_KINDS} may be perturbed, not {kind!r}")
    base = int(spec.get("seed", seed))
    return inject(train, channels, spec, base), inject(test, channels, spec, base + 1)
