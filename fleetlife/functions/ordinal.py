"""Ordinal bins of remaining life and decoding of model outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import clip


def rul_to_bin(rul: Column, max_rul: float, bins: int) -> Column:
    """floor(rul / width) kept inside 0..bins-1, width = max_rul / bins."""
    raw = F.floor(rul / F.lit(max_rul / bins))
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), raw)).cast("bigint")


def bin_to_rul(rank: Column, max_rul: float, bins: int) -> Column:
    """Centre of a (possibly fractional) bin."""
    return (rank + 0.5) * F.lit(max_rul / bins)


def _fold(logits: Column, gain) -> Column:
    """Walk the running product of sigmoids, adding ``gain(product)`` at each step."""
    start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("s"))

    def step(acc, logit):
        p = acc["p"] / (1.0 + F.exp(-logit))
        return F.struct(p.alias("p"), (acc["s"] + gain(p)).alias("s"))

    return F.aggregate(logits, start, step, lambda acc: acc["s"])


def expected_rank(logits: Column) -> Column:
    """Sum over k of P(y > k), with P(y > k) the product of the first k+1 sigmoids."""
    return _fold(logits, lambda p: p)


def argmax_rank(logits: Column) -> Column:
    """Number of thresholds whose P(y > k) is above one half."""
    return _fold(logits, lambda p: F.when(p > 0.5, 1.0).otherwise(0.0))


def scale_target(rul: Column, max_rul: float) -> Column:
    return rul / F.lit(float(max_rul))


def decode(outputs: Column, loss: str, max_rul: float, *, scaled: bool = True, bins: int = 25,
           corn: str = "expected_value", levels=(0.1, 0.5, 0.9)) -> Column:
    """Output array of a head -> remaining life in [0, max_rul]."""
    if loss == "corn":
        if corn not in ("expected_value", "argmax"):
            raise ValueError(f"unknown corn decoding {corn!r}")
        rank = expected_rank(outputs) if corn == "expected_value" else argmax_rank(outputs)
        return clip(bin_to_rul(rank, max_rul, bins), max_rul)
    if loss == "mse":
        point = outputs[0]
    elif loss == "quantile":
        levels = list(levels)
        point = outputs[levels.index(0.5) if 0.5 in levels else len(levels) // 2]
    else:
        raise ValueError(f"unknown loss {loss!r}")
    return clip(point * float(max_rul) if scaled else point, max_rul)
