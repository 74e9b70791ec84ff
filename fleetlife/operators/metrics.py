"""Metrics of predictions. A prediction row has the cell columns, ``true_rul`` (uncapped) and
``pred``; every function reduces rows by partial aggregation before it shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.errors import cap, mae, nasa, pinball, rmse

PRED_CELL = ["model", "dataset", "max_rul", "n_units", "seed", "loss"]
METRICS = ["rmse_clipped", "mae_clipped", "nasa_clipped",
           "rmse_unclipped", "mae_unclipped", "nasa_unclipped"]


def evaluate(preds: DataFrame, cell: list[str], max_rul: float) -> DataFrame:
    """RMSE, MAE and summed penalty per cell, against the capped and the uncapped truth."""
    out = []
    for protocol, truth in (("clipped", cap(F.col("true_rul"), max_rul)), ("unclipped", F.col("true_rul"))):
        d = F.col("pred") - truth
        out += [rmse(d).alias(f"rmse_{protocol}"), mae(d).alias(f"mae_{protocol}"),
                F.sum(nasa(d)).alias(f"nasa_{protocol}")]
    return preds.groupBy(*cell).agg(*out, F.count("*").alias("n"))


def bin_edges(max_rul: float, width: float = 25.0) -> list[float]:
    """0, width, 2*width .. max_rul, then infinity; max_rul is always an edge."""
    edges, e = [], 0.0
    while e <= max_rul + 1e-9:
        edges.append(e)
        e += width
    if edges[-1] < max_rul:
        edges.append(float(max_rul))
    return [*edges, float("inf")]


def bin_edges_of(max_rul: Column, width: float = 25.0) -> Column:
    """The same edges as an array column, for caps that differ by row."""
    steps = F.transform(F.sequence(F.lit(0), F.floor(max_rul / width).cast("int")),
                        lambda i: i * F.lit(float(width)))
    return F.array_append(F.array_union(steps, F.array(max_rul.cast("double"))), F.lit(float("inf")))


def bin_index(value: Column, edges: list[float]) -> Column:
    """0-based bin of a value in [edges[i], edges[i+1]); NULL outside the edges."""
    out = F.when(value < edges[0], F.lit(None).cast("int"))
    for i, hi in enumerate(edges[1:]):
        out = out.when(value < F.lit(hi), F.lit(i))
    return out


def _edge(edges: list[float], index: Column, shift: int) -> Column:
    return F.get(F.array(*[F.lit(float(e)) for e in edges]), index + shift)


def horizon_bins(preds: DataFrame, cell: list[str], max_rul: float, edges: list[float]) -> DataFrame:
    """Error by distance to failure: one row per non-empty bin of the uncapped truth and one row
    for all predictions (NULL edges, ``is_all``). The total is rolled up from the bins' sums."""
    d = F.col("pred") - cap(F.col("true_rul"), max_rul)
    sums = {"n_bin": F.count("*"), "_sq": F.sum(d * d), "_ab": F.sum(F.abs(d)), "_d": F.sum(d), "_nasa": F.sum(nasa(d))}
    parts = preds.groupBy(*cell, bin_index(F.col("true_rul"), edges).alias("_bin")).agg(
        *[v.alias(n) for n, v in sums.items()])
    # The few bins of a cell meet in one row, with their total appended.
    total = F.struct(F.lit(None).cast("int").alias("_bin"), *[F.sum(c).alias(c) for c in sums], F.lit(True).alias("is_all"))
    one = F.when(F.col("_bin").isNotNull(), F.struct("_bin", *sums, F.lit(False).alias("is_all")))
    rows = parts.groupBy(*cell).agg(F.array_append(F.collect_list(one), total).alias("_rows")).select(*cell, F.inline("_rows"))
    n = F.col("n_bin")
    return rows.select(
        *cell, "is_all", _edge(edges, F.col("_bin"), 0).alias("bin_lo"),
        _edge(edges, F.col("_bin"), 1).alias("bin_hi"), "n_bin",
        F.sqrt(F.col("_sq") / n).alias("rmse_clipped"), (F.col("_ab") / n).alias("mae_clipped"),
        (F.col("_d") / n).alias("bias"), (F.col("_nasa") / n).alias("nasa_mean"))


def earliness(preds: DataFrame, cell: list[str], edges) -> DataFrame:
    """Histogram of the signed error per cell, empty bins included, with the late and early
    shares. One aggregation; the bins are exploded from the aggregated row."""
    return earliness_of(preds.groupBy(*cell).agg(*earliness_sums(edges)), cell, edges)


def earliness_sums(edges) -> list[Column]:
    """What a cell's histogram is made from."""
    inner = sorted(float(e) for e in edges)
    d = F.col("pred") - F.col("true_rul")
    at = bin_index(d, [*inner, float("inf")])
    below = F.count_if(d < inner[0])
    counts = F.array(below, *[F.count_if(at == i) for i in range(len(inner))])
    return [F.count("*").alias("n"), F.avg(d).alias("mean_signed_error"), F.count_if(d >= 0).alias("_late"),
            F.count_if(d < 0).alias("_early"), counts.alias("_counts")]


def earliness_of(rows: DataFrame, cell: list[str], edges) -> DataFrame:
    """Histograms from ``earliness_sums``, a row per cell."""
    all_edges = [float("-inf"), *sorted(float(e) for e in edges), float("inf")]
    lo = _edge(all_edges, F.col("_i"), 0)
    return rows.select("*", F.posexplode("_counts").alias("_i", "n_bin")).select(
        *cell, lo.alias("lo"), _edge(all_edges, F.col("_i"), 1).alias("hi"),
        F.when(lo >= 0, "late").otherwise("early").alias("side"), "n_bin",
        (F.col("n_bin") / F.col("n")).alias("frac"), (F.col("_late") / F.col("n")).alias("frac_late"),
        (F.col("_early") / F.col("n")).alias("frac_early"), "mean_signed_error", "n")


def require_predictions(preds: DataFrame) -> DataFrame:
    """The predictions, or an error when there are none to describe."""
    if preds.isEmpty():
        raise ValueError("need at least one prediction")
    return preds


def cost_curve(preds: DataFrame, cell: list[str], ratios) -> DataFrame:
    """Cost per late:early ratio: early cycles lost plus ratio times late cycles."""
    return cost_of(preds.groupBy(*cell).agg(*cost_sums()), cell, ratios)


def cost_sums() -> list[Column]:
    """What a cell's costs are made from."""
    d = F.col("pred") - F.col("true_rul")
    return [F.sum(F.greatest(d, F.lit(0.0))).alias("_late_sum"), F.sum(F.greatest(-d, F.lit(0.0))).alias("_early_sum")]


def cost_of(sums: DataFrame, cell: list[str], ratios) -> DataFrame:
    """Cost curves from ``cost_sums``, a row per cell."""
    return (sums.withColumn("cost_ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
            .select(*cell, "cost_ratio", (F.col("_early_sum") + F.col("cost_ratio") * F.col("_late_sum")).alias("cost")))


def pinball_loss(preds: DataFrame, cell: list[str], quantiles: str, levels) -> DataFrame:
    """Mean quantile loss over rows and levels. ``quantiles``: array column, one entry per level."""
    terms = F.array(*[
        pinball(F.col("true_rul") - F.col(quantiles)[i], F.lit(float(q))) for i, q in enumerate(levels)])
    row = F.aggregate(terms, F.lit(0.0), lambda a, v: a + v) / len(levels)
    return preds.groupBy(*cell).agg(F.avg(row).alias("pinball"))
