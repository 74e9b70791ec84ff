"""Comparison of result rows: curves, strongest competitor, paired tests, the verdict map.

A result row has ``model, dataset, n_units, seed, loss`` and metric columns; lower is better.
The loss is part of a model's identity throughout, so two loss arms never mix.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FLOOR_MODEL, FOIL_MODELS, NET_MODELS
from ..functions.names import model_class, roster_class, series_label
from ..functions.ttest import t_pvalue

PRIMARY, SECONDARY = "nasa_clipped", "rmse_clipped"
CELL_FIELDS = ["dataset", "n_units"]
ARM = ["model", "loss"]


def valid_rows(results: DataFrame, metric: str, cell: list[str]) -> DataFrame:
    """Rows that have the metric and every cell field."""
    return results.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in (metric, *cell)]))


def _cells_only(results: DataFrame, cell: list[str]) -> DataFrame:
    return results.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in cell]))


def _differs(df: DataFrame, name: str, whole, tolerance: float) -> Column:
    """Whether a column has several values in a window: NULL is one, and so are numbers within the tolerance."""
    low, high, n = F.min(name).over(whole), F.max(name).over(whole), F.count(name).over(whole)
    apart = high != low
    if df.schema[name].dataType.typeName() in ("double", "float"):
        apart &= high - low > tolerance * F.greatest(F.lit(1.0), F.least(F.abs(low), F.abs(high), F.lit(1e300)))
    return F.coalesce(apart, F.lit(False)) | ((n > 0) & (n < F.count("*").over(whole)))


def dedupe(df: DataFrame, keys: list[str], order: list[str], same: list[str] | None = None, tolerance: float = 1e-9) -> DataFrame:
    """First row of each key in ``order``, the order of the runs. Copies that differ in ``same`` are an error:
    which of them is right cannot be told from the rows. Sums of two runs differ in their last digits, so floating columns
    may differ by ``tolerance`` (relative above 1). Rounding first would not do: values next to an edge fall to both sides."""
    first = Window.partitionBy(*keys).orderBy(*order)
    if same:  # the same order, so that one sort serves both
        whole = first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        differ = reduce(Column.__or__, [_differs(df, c, whole, tolerance) for c in same])
        df = df.withColumn("_d", F.when(differ, F.raise_error(F.lit(f"copies of a row differ in {same}")))).where(
            "_d IS NULL").drop("_d")
    return df.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def seed_means(results: DataFrame, metric: str, cell: list[str]) -> DataFrame:
    """Mean of the metric over seeds per (cell, model, loss)."""
    return (valid_rows(results, metric, cell).groupBy(*cell, *ARM)
            .agg(F.avg(metric).alias("mean"), F.count("*").alias("n_seeds")))


def data_scaling(results: DataFrame, metric: str = SECONDARY, dataset: str | None = None) -> DataFrame:
    """Mean and population deviation over seeds per dataset, series label and unit count."""
    rows = results if dataset is None else results.where(F.col("dataset") == dataset)
    return (rows.withColumn("label", series_label(F.col("model"), F.col("loss")))
            .groupBy("dataset", "label", "n_units")
            .agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std")))


def ablation_table(results: DataFrame, metric: str = SECONDARY) -> DataFrame:
    """Mean, population deviation and row count per (context, features, pooling)."""
    return (results.groupBy("context_length", "head_features", "pooling")
            .agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"),
                 F.count("*").alias("n_seeds")))


def best_cell(results: DataFrame, metric: str = SECONDARY) -> DataFrame:
    """The ablation cell with the lowest mean (ties to the smaller key)."""
    return ablation_table(results, metric).orderBy(
        "mean", "context_length", "head_features", "pooling").limit(1)


def strongest(results: DataFrame, metric: str = PRIMARY, cell: list[str] = CELL_FIELDS,
              kind: str = "competitor") -> DataFrame:
    """Best arm of a class per cell (ties to the smaller name); cells without one are left out."""
    means = seed_means(results, metric, cell).where(model_class(F.col("model")) == kind)
    pick = F.struct("mean", *ARM)
    return means.groupBy(*cell).agg(F.min(pick).alias("_b")).select(
        *cell, F.col("_b.model").alias("best_baseline"), F.col("_b.loss").alias("baseline_loss"),
        F.col("_b.mean").alias("baseline_mean"))


def paired_ttest(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b",
                 seed: str = "seed") -> DataFrame:
    """Paired t statistic and two-sided p of a - b. Both are NULL with fewer than two pairs or a
    difference that does not vary."""
    d = F.col(a) - F.col(b)
    agg = pairs.groupBy(*by).agg(
        F.count(d).alias("n_seeds"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
        F.avg(d).alias("mean_delta"), F.stddev_samp(d).alias("_sd"),
        F.min_by(d, seed).alias("_d0"), F.min(d).alias("_lo"), F.max(d).alias("_hi"))
    spread = F.greatest(F.col("_hi") - F.col("_d0"), F.col("_d0") - F.col("_lo"))
    moves = spread > F.lit(1e-8) + F.lit(1e-5) * F.abs("_d0")
    t = F.when((F.col("n_seeds") >= 2) & moves,
               F.col("mean_delta") / (F.col("_sd") / F.sqrt("n_seeds")))
    return (agg.withColumn("t", t).withColumn("p", t_pvalue(F.col("t"), F.col("n_seeds") - 1))
            .withColumn("p", F.when(F.col("t").isNotNull(), F.col("p")))
            .drop("_sd", "_d0", "_lo", "_hi"))


def paired_loss_test(horizon: DataFrame, model: str, loss_a: str = "corn", loss_b: str = "mse",
                     metric: str = "mae_clipped") -> DataFrame:
    """Paired-by-seed test of two losses of one model per (dataset, cap, n_units, bin)."""
    cell = ["dataset", "max_rul", "n_units", "bin_lo", "bin_hi"]
    arm = {n: F.max(F.when(F.col("loss") == loss, F.col(metric))) for n, loss in (("a", loss_a), ("b", loss_b))}
    pairs = (horizon.where((F.col("model") == model) & F.col("loss").isin(loss_a, loss_b))
             .groupBy(*cell, "seed").agg(*[v.alias(n) for n, v in arm.items()])
             .where(F.col("a").isNotNull() & F.col("b").isNotNull()))
    return paired_ttest(pairs, cell)


def verdict(margin: Column, p: Column, candidate: Column, floor: Column, win_margin: float,
            alpha: float, versus_floors: bool = False) -> Column:
    """win / loss when the margin is significant and clears ``win_margin``, else tie; a win that
    is no better than the floor is hollow (unless the floors are the bar)."""
    sure = F.coalesce(p < alpha, F.lit(False))
    hollow = F.lit(False) if versus_floors else F.coalesce(candidate >= floor - win_margin, F.lit(False))
    win = sure & (margin > win_margin)
    return (F.when(win & hollow, "hollow").when(win, "win")
            .when(sure & (margin < -win_margin), "loss").otherwise("tie"))


def success_map(results: DataFrame, metric: str = PRIMARY, cell: list[str] = CELL_FIELDS,
                secondary: str = SECONDARY, win_margin: float = 0.0, alpha: float = 0.05,
                versus_floors: bool = False) -> DataFrame:
    """One row per (cell, candidate arm): verdict, margin, p and means against the strongest
    competitor (or floor), with the secondary metric's mean beside it."""
    kind = model_class(F.col("model"))
    bar_kind = "floor" if versus_floors else "competitor"
    in_cell = Window.partitionBy(*cell)
    # One row per seed first, so that the list of an arm is as long as the number of seeds.
    per_seed = (_cells_only(results, cell).groupBy(*cell, *ARM, "seed")
                .agg(F.avg(metric).alias("_v"), F.avg(secondary).alias("_s")))
    arms = (per_seed.groupBy(*cell, *ARM).agg(
        F.avg("_v").alias("candidate_mean"), F.avg("_s").alias(f"candidate_{secondary}"),
        F.sort_array(F.collect_list(F.when(F.col("_v").isNotNull(), F.struct("seed", "_v")))).alias("_seeds"))
        .where(F.col("candidate_mean").isNotNull())
        .withColumn("_bar", F.min(F.when(kind == bar_kind, F.struct("candidate_mean", *ARM, "_seeds"))).over(in_cell))
        .withColumn("floor", F.avg(F.when(F.col("model") == FLOOR_MODEL, F.col("candidate_mean"))).over(in_cell))
        .where((kind == "candidate") & F.col("_bar").isNotNull()))
    facts = ["candidate_mean", f"candidate_{secondary}", "floor", "best_baseline", "baseline_mean"]
    pairs = (arms.withColumns({"best_baseline": F.col("_bar.model"), "baseline_mean": F.col("_bar.candidate_mean"),
                               "_bar": F.map_from_entries("_bar._seeds")})
             .select(*cell, *ARM, *facts, "_bar", F.inline("_seeds"))
             .withColumn("b", F.try_element_at("_bar", F.col("seed"))))
    tested = paired_ttest(pairs, [*cell, *ARM, *facts], "_v", "b")
    margin = F.col("baseline_mean") - F.col("candidate_mean")
    return tested.select(
        *cell, *ARM,
        verdict(margin, F.col("p"), F.col("candidate_mean"), F.col("floor"), win_margin, alpha,
                versus_floors).alias("verdict"),
        F.lit(metric).alias("metric"), margin.alias("margin"), "p", "n_seeds", *facts)


def in_text_order(table: DataFrame, keys: list[str]) -> DataFrame:
    """Deterministic output order of a small table: its keys compared as text."""
    return table.orderBy(*[F.col(k).cast("string") for k in keys])


def verdict_grid(table: DataFrame, condition: str, size: int) -> DataFrame:
    """Model rows by condition columns ``c1..c<size>`` per dataset. Conditions are placed with
    numbers first (ascending), then text. More conditions than columns are an error."""
    text = F.col(condition).cast("string")
    number = text.try_cast("double")
    order = Window.partitionBy("dataset").orderBy(number.isNull(), number, text)
    rank = F.dense_rank().over(order)
    placed = table.withColumn("_c", F.when(rank <= size, F.concat(F.lit("c"), rank)).otherwise(
        F.raise_error(F.concat(F.lit(f"more than {size} conditions of "), F.col("dataset")))))
    return placed.groupBy("dataset", "model").pivot("_c", [f"c{i}" for i in range(1, size + 1)]).agg(
        F.first("verdict"))


def roster(results: DataFrame, metric: str = PRIMARY, keep: dict | None = None,
           foils=FOIL_MODELS, nets=NET_MODELS) -> DataFrame:
    """Reduced roster: the two best candidates, two best cheap foils and the best net by overall
    mean of the metric."""
    keep = keep or {"candidate": 2, "foil": 2, "net": 1}
    means = (results.where(F.col(metric).isNotNull()).groupBy("model").agg(F.avg(metric).alias("mean"))
             .withColumn("category", roster_class(F.col("model"), foils, nets)).where("category IS NOT NULL"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy("mean", "model"))
    quota = reduce(lambda acc, kv: acc.when(F.col("category") == kv[0], kv[1]), keep.items(),
                   F.when(F.lit(False), 0))
    return means.withColumn("place", rank).where(F.col("place") <= quota)


# ---- tables behind the figures ------------------------------------------------------------------
def earliness_summary(hist: DataFrame, cell: list[str]) -> DataFrame:
    """Mean late and early share per model; each cell counts once."""
    per_cell = hist.groupBy(*cell).agg(F.max("frac_late").alias("l"), F.max("frac_early").alias("e"))
    return per_cell.groupBy("dataset", "max_rul", "model").agg(
        F.avg("l").alias("frac_late"), F.avg("e").alias("frac_early"))


def cost_summary(costs: DataFrame) -> DataFrame:
    """Mean cost per model and ratio."""
    return costs.groupBy("dataset", "max_rul", "model", "cost_ratio").agg(F.avg("cost").alias("cost"))


def mode_summary(results: DataFrame, metric: str = SECONDARY) -> DataFrame:
    """Mean and deviation per model and representation mode."""
    return results.groupBy("model", "mode").agg(
        F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))


def transfer_summary(results: DataFrame, metric: str = SECONDARY) -> DataFrame:
    """Mean and deviation per arm and shot count; the zero-shot arm is one level (NULL shots)."""
    shots = F.when(F.col("mode") != "zero_shot", F.col("n_target_units"))
    return (results.withColumn("label", series_label(F.col("model"), F.col("loss")))
            .groupBy("source_dataset", "target_dataset", "label", "mode", shots.alias("n_target_units"))
            .agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std")))


def horizon_summary(horizon: DataFrame) -> DataFrame:
    """Mean and deviation over seeds of MAE and bias per bin (the total row left out)."""
    return (horizon.where(F.col("bin_lo").isNotNull())
            .withColumn("label", series_label(F.col("model"), F.col("loss")))
            .groupBy("dataset", "max_rul", "n_units", "label", "bin_lo", "bin_hi")
            .agg(F.avg("mae_clipped").alias("mae_mean"), F.stddev_pop("mae_clipped").alias("mae_std"),
                 F.avg("bias").alias("bias_mean"), F.stddev_pop("bias").alias("bias_std")))


def select_arm(preds: DataFrame, dataset: str | None = None, max_rul: float | None = None,
               n_units: int | None = None, seed: int = 0) -> DataFrame:
    """Predictions of one (dataset, cap, n_units, seed). A dataset or cap left open must be
    unique; n_units defaults to the largest; an absent seed falls back to the smallest."""
    arms = [r.asDict() for r in preds.select("dataset", "max_rul", "n_units", "seed").distinct().collect()]
    for name, wanted in (("dataset", dataset), ("max_rul", max_rul)):
        present = sorted({a[name] for a in arms})
        if wanted is None and len(present) > 1:
            raise ValueError(f"predictions mix {name} values {present}; choose one")
        if wanted is not None and wanted not in present:
            raise ValueError(f"no predictions with {name}={wanted}; present: {present}")
        chosen = present[0] if wanted is None else wanted
        arms = [a for a in arms if a[name] == chosen]
    counts = sorted({a["n_units"] for a in arms})
    n = counts[-1] if n_units is None else n_units
    if n not in counts:
        raise ValueError(f"no predictions with n_units={n}; present: {counts}")
    seeds = sorted(a["seed"] for a in arms if a["n_units"] == n)
    pick = arms[0] | {"n_units": n, "seed": seed if seed in seeds else seeds[0]}
    return preds.where(reduce(Column.__and__, [F.col(k) == F.lit(v) for k, v in pick.items()]))
