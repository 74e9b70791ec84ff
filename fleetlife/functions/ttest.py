"""Two-sided p-value of Student's t for whole degrees of freedom, as a column expression."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _series(count: Column, factor) -> Column:
    """1 + sum of `count` further terms, term k being the previous one times factor(k)."""
    steps = F.when(count >= 1, F.sequence(F.lit(1), count.cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc, k):
        term = acc["term"] * factor(k)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    return F.aggregate(steps, start, step, lambda acc: acc["total"])


def t_pvalue(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) by the closed trigonometric form for integer ``df`` (NULL below 1)."""
    theta = F.atan(F.abs(t) / F.sqrt(df))
    sin, cos = F.sin(theta), F.cos(theta)
    c2 = cos * cos
    even = sin * _series(df / 2 - 1, lambda k: c2 * (2 * k - 1) / (2 * k))
    odd = (2 / math.pi) * (
        theta + F.when(df > 1, sin * cos * _series((df - 3) / 2, lambda k: c2 * (2 * k) / (2 * k + 1)))
        .otherwise(F.lit(0.0))
    )
    inside = F.when(df % 2 == 0, even).otherwise(odd)
    return F.when(df >= 1, F.greatest(F.lit(0.0), 1.0 - inside))
