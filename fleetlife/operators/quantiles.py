"""Exact quantiles of a group that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BUCKETS = 256


def weighted_quantile(df: DataFrame, by: list[str], value: str, freq: str, q: float,
                      name: str) -> DataFrame:
    """Quantile with linear interpolation of ``value`` repeated ``freq`` times, per group.

    Equal values are merged first. Approximate quantiles of the merged values cut them into 256 buckets of
    about the same number of values, however long their tail; only the one or two buckets that hold the wanted
    ranks are sorted. ``by`` must have few distinct values (cells).
    """
    vals = df.groupBy(*by, F.col(value).alias("_v")).agg(F.sum(freq).alias("_f"))
    ends = vals.groupBy(*by).agg(
        F.percentile_approx("_v", [i / BUCKETS for i in range(1, BUCKETS)], 10 * BUCKETS).alias("_cuts"),
        (q * (F.sum("_f") - 1)).alias("_pos"))
    placed = (vals.join(F.broadcast(cut_lineage(ends)), by)  # the same cuts in both passes below
              .withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts"))
    upto = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    sizes = (placed.groupBy(*by, "_b").agg(F.sum("_f").alias("_c"), F.first("_pos").alias("_p"))
             .withColumn("_end", F.sum("_c").over(upto)).withColumn("_start", F.col("_end") - F.col("_c"))
             .where((F.col("_end") > F.floor("_p")) & (F.col("_start") <= F.floor("_p") + 1))
             .select(*by, "_b", "_start"))
    inside = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    # at most two buckets per group are left
    ranked = placed.join(F.broadcast(sizes), [*by, "_b"]).withColumn(
        "_cum", F.col("_start") + F.sum("_f").over(inside))
    low = F.floor("_pos")
    return (ranked.groupBy(*by).agg(
        F.min(F.when(F.col("_cum") > low, F.col("_v"))).alias("_a"),
        F.min(F.when(F.col("_cum") > low + 1, F.col("_v"))).alias("_z"),
        F.first(F.col("_pos") - low).alias("_w"))
        .select(*by, (F.col("_a") + F.coalesce(F.col("_z") - F.col("_a"), F.lit(0.0)) * F.col("_w")).alias(name)))
