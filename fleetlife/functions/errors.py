"""Error expressions. ``d`` is always prediction minus truth: d >= 0 is a late (dangerous) call."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(value: float | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def cap(value: Column, max_rul: float | Column) -> Column:
    """Label cap: min(value, max_rul). The cap may be a column (one per dataset)."""
    return F.least(value, _number(max_rul))


def clip(value: Column, max_rul: float | Column) -> Column:
    """Prediction clipped to [0, max_rul]."""
    return F.greatest(F.lit(0.0), F.least(value, _number(max_rul)))


def nasa(d: Column) -> Column:
    """Asymmetric penalty of one error: e^(d/10)-1 when late, e^(-d/13)-1 when early."""
    return F.when(d >= 0, F.exp(d / 10.0) - 1.0).otherwise(F.exp(-d / 13.0) - 1.0)


def pinball(err: Column, level: Column) -> Column:
    """Quantile loss of truth minus prediction at ``level``."""
    return F.greatest(level * err, (level - 1.0) * err)


def rmse(d: Column) -> Column:
    return F.sqrt(F.avg(d * d))


def mae(d: Column) -> Column:
    return F.avg(F.abs(d))


def guarded_std(std: Column) -> Column:
    """Deviation with flat channels (below 1e-8, or undefined) set to 1."""
    return F.when(std >= 1e-8, std).otherwise(F.lit(1.0))


def r(value: Column, digits: int = 6) -> Column:
    """Rounded, with negative zero turned into zero."""
    return F.round(value, digits) + F.lit(0.0)
