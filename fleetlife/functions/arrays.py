"""Pooling of patch embeddings and assembly of head features, as array expressions.

A patch embedding is ``array<array<array<double>>>``: variates, patches, model width.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _mean_rows(rows: Column) -> Column:
    """Elementwise mean of an array of equally long arrays."""
    zeros = F.transform(F.element_at(rows, 1), lambda x: F.lit(0.0))
    total = F.aggregate(rows, zeros, lambda acc, row: F.zip_with(acc, row, lambda a, b: a + b))
    return F.transform(total, lambda x: x / F.size(rows))


def pool_patches(emb: Column, strategy: str, special: int = 2) -> Column:
    """Pool the patch axis: one vector per variate. The last ``special`` positions are not
    content; a window without content raises."""

    def content(patches):
        count = F.size(patches) - special
        checked = F.when(count >= 1, count).otherwise(
            F.raise_error(F.concat(F.lit("no content patch in "), F.size(patches))).cast("int")
        )
        return F.slice(patches, 1, checked)

    if strategy == "forecast_token":
        return F.transform(emb, lambda p: F.when(F.size(content(p)) > 0, F.element_at(p, -1)))
    if strategy == "last_content":
        return F.transform(emb, lambda p: F.element_at(content(p), -1))
    if strategy == "mean":
        return F.transform(emb, lambda p: _mean_rows(content(p)))
    if strategy == "flatten":
        return F.transform(emb, lambda p: F.flatten(content(p)))
    raise ValueError(f"unknown pooling {strategy!r}")


def aggregate_variates(per_variate: Column, how: str) -> Column:
    """Collapse the variate axis: ``concat`` keeps every channel, ``mean`` averages them."""
    if how == "concat":
        return F.flatten(per_variate)
    if how == "mean":
        return _mean_rows(per_variate)
    raise ValueError(f"unknown channel aggregation {how!r}")


def pool_window(emb: Column, strategy: str, how: str = "concat", special: int = 2) -> Column:
    return aggregate_variates(pool_patches(emb, strategy, special), how)


def flatten_locscale(locscale: Column) -> Column:
    """array<struct<loc,scale>> -> [loc, scale, loc, scale, ...]."""
    return F.flatten(F.transform(locscale, lambda s: F.array(s["loc"], s["scale"])))


def standardize(values: Column, mean: Column, std: Column) -> Column:
    """(values - mean) / std for three parallel arrays."""
    centred = F.zip_with(values, mean, lambda x, m: x - m)
    return F.zip_with(centred, std, lambda x, s: x / s)


def head_width(mode: str, emb_dim: int, variates: int, channels: int) -> int:
    """Length of the head features for a feature mode."""
    return (emb_dim + (2 * variates if "locscale" in mode else 0)
            + (channels if mode.endswith("raw") else 0))
