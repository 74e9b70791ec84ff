"""Ablation in two phases, in one plan: contexts x feature sets, then raw values and poolings at the winner.

The second phase depends on the results of the first: the winner is a table of one row, from which the arms of the second
phase are made and joined to the rows by context length. The results of the first phase are written; nothing is collected.

All arms have inputs of one width: blocks that an arm lacks are zeros, which the penalty gives no weight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CYCLE, KEYS
from ..functions.arrays import flatten_locscale, pool_window
from ..models import gram
from ..operators.compare import best_cell
from ..operators.metrics import evaluate
from ..operators.numbering import BLOCK_ROWS, block_window, blocked, unblocked
from ..operators.sampling import CELL
from ..session import cut_lineage

ARM = ["context_length", "head_features", "pooling"]
SPECIAL = 2
FEATURE_SETS, POOLINGS = ("emb", "emb+locscale"), ("forecast_token", "last_content")


def patch_rows(frame: DataFrame, channels: list[str], lengths: list[int], patch: int, scale: float, min_cycle: int = 1,
               keep: tuple = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row per cycle and context length: (keys, end_cycle, keep, context_length, emb, locscale, raw). ``emb`` holds, per
    channel, a vector for each patch of ``patch`` cycles of the context, oldest first, and two special ones at its end: of
    the whole context, and of its last value (the forecast token). All lengths come from one sort; patches before
    the unit's first cycle are left out."""
    if any(n % patch for n in lengths):
        raise ValueError(f"context lengths {lengths} are not multiples of {patch}")
    cols = {}
    for i, c in enumerate(channels):
        for j in range(max(lengths) // patch):
            cols[f"_p{i}_{j}"] = F.avg(c).over(block_window().rowsBetween(-(patch * (j + 1) - 1), -patch * j))
        for n in lengths:
            over = block_window().rowsBetween(-(n - 1), 0)
            cols |= {f"_m{i}_{n}": F.avg(c).over(over), f"_d{i}_{n}": F.stddev_pop(c).over(over)}
    rows = blocked(frame.select(*KEYS, CYCLE, *keep, *channels), max(lengths), block_rows).withColumns(cols)
    rows = unblocked(rows).where(F.col(CYCLE) >= min_cycle)
    vector = lambda v: F.array(F.tanh(v / scale))

    def context(n):
        emb = F.array(*[F.concat(
            F.transform(F.filter(F.array(*[F.col(f"_p{i}_{j}") for j in reversed(range(n // patch))]), lambda p: p.isNotNull()), vector),
            F.array(vector(F.col(f"_m{i}_{n}")), vector(F.col(c).cast("double")))) for i, c in enumerate(channels)])
        pairs = F.array(*[F.struct(F.col(f"_m{i}_{n}").alias("loc"), F.col(f"_d{i}_{n}").alias("scale")) for i in range(len(channels))])
        return F.struct(F.lit(n).alias("context_length"), emb.alias("emb"), pairs.alias("locscale"))

    raw = F.array(*[F.col(c).cast("double") for c in channels])
    return rows.select(*KEYS, F.col(CYCLE).alias("end_cycle"), *keep, raw.alias("raw"), F.inline(F.array(*map(context, lengths))))


def arm_inputs(rows: DataFrame, arms: DataFrame, channels: int) -> DataFrame:
    """Rows of ``patch_rows`` joined to arms (context_length, head_features, pooling) by their context, with inputs ``x``."""
    out = rows.join(F.broadcast(arms), "context_length")
    pooled = F.coalesce(*[F.when(F.col("pooling") == p, pool_window(F.col("emb"), p, special=SPECIAL)) for p in ("mean", *POOLINGS)])
    features = F.col("head_features")
    zeros = lambda n: F.array(*[F.lit(0.0)] * n)
    ls = F.when(features.contains("locscale"), flatten_locscale(F.col("locscale"))).otherwise(zeros(2 * channels))
    raw = F.when(features.endswith("raw"), F.col("raw")).otherwise(zeros(channels))
    return out.withColumn("x", F.concat(pooled, ls, raw)).drop("emb", "locscale", "raw")


def run(train: DataFrame, test: DataFrame, plan: DataFrame, arms: DataFrame, channels: int, max_rul: float, alpha: float) -> DataFrame:
    """Result rows of every arm for the cells of ``plan``, fitted together. ``train`` and ``test``: rows of ``patch_rows``
    with ``label`` and ``true_rul``."""
    grams = gram.unit_grams(arm_inputs(train, arms, channels), "x", keys=[*KEYS, *ARM])
    cell = [*CELL, *ARM]
    scaled = range(channels, 4 * channels)
    params = gram.fit_ridge(gram.cell_grams(grams, plan, cell), cell, (alpha,), scaled)
    preds = gram.predict(params, arm_inputs(test, arms, channels), "x", max_rul, ["true_rul"], ("dataset", *ARM))
    return evaluate(preds.withColumn("max_rul", F.lit(float(max_rul))), cell, max_rul)


def two_phases(train: DataFrame, test: DataFrame, plan: DataFrame, lengths: list[int], channels: int, max_rul: float,
               alpha: float = 1e-3) -> DataFrame:
    """Result rows of both phases, with ``phase``. Phase 1: every context length and feature set, mean pooling. Phase 2, at the
    context of the cell with the lowest mean error: raw values added, and the winner's features in other poolings."""
    spark = train.sparkSession
    first = spark.createDataFrame([(n, f, "mean") for n in lengths for f in FEATURE_SETS], "context_length int, head_features string, pooling string")
    one = cut_lineage(run(train, test, plan, first, channels, max_rul, alpha))  # a row per cell and arm; the winner reads it too
    name = lambda f, p: F.struct("context_length", f.alias("head_features"), F.lit(p).alias("pooling"))
    second = best_cell(one).select(F.inline(F.array(
        name(F.lit("emb+locscale+raw"), "mean"), *[name(F.col("head_features"), p) for p in POOLINGS])))
    two = run(train, test, plan, second, channels, max_rul, alpha)
    return one.withColumn("phase", F.lit(1)).unionByName(two.withColumn("phase", F.lit(2)))
