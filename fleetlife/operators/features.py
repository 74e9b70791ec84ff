"""Head features: pooled embedding, optionally with standardized loc/scale and raw last values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import flatten_locscale, standardize
from ..functions.errors import guarded_std


def fit_standardizer(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Mean and sample deviation (flat columns 1) of scalar columns per cell, from train rows."""
    return rows.groupBy(*by).agg(*[a for c in columns for a in (
        F.avg(c).alias(f"{c}_mean"), guarded_std(F.stddev_samp(c)).alias(f"{c}_std"))])


def fit_array_standardizer(rows: DataFrame, column: str, size: int, by: list[str]) -> DataFrame:
    """The same for the positions of an array column: ``<column>_mean`` and ``<column>_std``."""
    at = [F.get(column, F.lit(i)) for i in range(size)]
    return rows.groupBy(*by).agg(
        F.array(*[F.avg(x) for x in at]).alias(f"{column}_mean"),
        F.array(*[guarded_std(F.stddev_samp(x)) for x in at]).alias(f"{column}_std"))


def head_features(train: DataFrame, rows: DataFrame, mode: str, variates: int, channels: list[str],
                  by: list[str]) -> DataFrame:
    """Add array ``head`` to ``rows`` (columns ``emb``, ``locscale`` and the channels). The
    appended blocks are standardized with statistics of the cell's train rows; the embedding
    passes through. ``by`` names the cell columns present in both tables."""
    blocks, out = [F.col("emb")], rows
    parts = []
    if "locscale" in mode:
        parts.append(("_ls", flatten_locscale(F.col("locscale")), 2 * variates))
    if mode.endswith("raw"):
        parts.append(("_raw", F.array(*[F.col(c).cast("double") for c in channels]), len(channels)))
    for name, value, size in parts:
        fitted = fit_array_standardizer(train.withColumn(name, value), name, size, by)
        # one row per cell
        out = out.withColumn(name, value).join(F.broadcast(fitted), by)
        blocks.append(standardize(F.col(name), F.col(f"{name}_mean"), F.col(f"{name}_std")))
    return out.withColumn("head", F.concat(*blocks)).select(*rows.columns, "head")
