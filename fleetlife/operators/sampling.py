"""Seeded sampling of whole units: data-volume cells, train/validation splits, bootstrap.

A unit's md5 digest with the seed fixes its place in every draw, so a draw is a cut: the units
whose digest is at or below the digest of the last unit taken. ``sampling_plan`` finds the cuts
(one row per cell, the only thing that reaches the driver); applying a plan to units, windows or
unit sums is then a broadcast join and a comparison, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import KEYS, UNIT
from ..functions.hashing import digest, hash32
from .numbering import number_rows

CELL = ["dataset", "n_units", "seed"]


def units_of(frame: DataFrame) -> DataFrame:
    """Distinct units."""
    return frame.select(*KEYS).distinct()


def rows_of(frame: DataFrame, units: DataFrame) -> DataFrame:
    """Rows whose unit is listed."""
    return frame.join(units.select(*KEYS).distinct(), KEYS, "left_semi")


def digest_ranks(rows: DataFrame, by: list[str], key: str, name: str, total: str | None = None) -> DataFrame:
    """Add ``name``, the place 1..n of a row among its ``by`` group in order of its hex digest ``key``, and the size of the
    group as ``total``. The first three digits cut a group into 4096 even buckets: these are sorted, each by itself, and
    shifted by the sizes of the buckets before (at most 4096 rows per group)."""
    rows = rows.withColumn("_b", F.substring(key, 1, 3))
    group = Window.partitionBy(*by)
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*by, "_b").agg(F.count("*").alias("_c")).select(
        *by, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(group).alias(total or "_total"))
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(key)) + F.col("_before")
    return (rows.join(F.broadcast(starts), [*by, "_b"]).withColumn(name, place)
            .drop("_b", "_before", *([] if total else ["_total"])))


def unit_counts(units: DataFrame, counts) -> DataFrame:
    """Data-volume grid per dataset: the requested counts below the fleet size, plus the size."""
    return (units.groupBy("dataset").agg(F.count_distinct(UNIT).alias("available"))
            .select("dataset", "available", F.explode(_wanted(counts)).alias("n_units")))


def _wanted(counts):
    """The counts below ``available``, and that."""
    available = F.col("available")
    below = F.filter(F.array(*[F.lit(int(c)).cast("bigint") for c in counts]), lambda c: c < available)
    return F.array_distinct(F.array_append(below, available))


def cell_grid(units: DataFrame, counts, seeds) -> DataFrame:
    """(dataset, n_units, seed) cells with the fleet size."""
    seed_list = F.array(*[F.lit(int(s)) for s in seeds])
    return unit_counts(units, counts).withColumn("seed", F.explode(seed_list))


def with_levels(df: DataFrame, name: str, levels) -> DataFrame:
    """One output row per row and literal level."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in levels])))


def validation_size(n, fraction: float):
    """max(1, half-even round of n * fraction); 0 when there are fewer than two units."""
    share = F.greatest(F.lit(1), F.rint(n * F.lit(float(fraction))).cast("bigint"))
    return F.when(n > 1, share).otherwise(F.lit(0).cast("bigint"))


def _draw_key():
    return digest(F.col(UNIT), F.col("seed"), "sub")


def _split_key():
    return digest(F.col(UNIT), F.col("seed"), "val")


def sampling_plan(units: DataFrame, counts, seeds, fraction: float) -> DataFrame:
    """Cells with their cuts: (dataset, n_units, seed, available, sub_cut, val_cut). ``units`` has one row per unit. ``sub_cut``
    is NULL for the whole fleet, ``val_cut`` where no unit validates. It has |datasets| x (|counts| + 1) x |seeds| rows, all
    chosen by the caller. Nothing runs until the plan is used."""
    drawn = with_levels(units.select(*KEYS), "seed", [int(s) for s in seeds]).withColumns({"_s": _draw_key(), "_v": _split_key()})
    ranked = digest_ranks(drawn, ["dataset", "seed"], "_s", "_r", "available")
    inside = F.filter(_wanted(counts), lambda n: F.col("_r") <= n)
    members = digest_ranks(ranked.withColumn("n_units", F.explode(inside)), CELL, "_v", "_q")
    return members.groupBy(*CELL).agg(
        F.max("available").alias("available"), F.max(F.when(F.col("n_units") < F.col("available"), F.col("_s"))).alias("sub_cut"),
        F.max(F.when(F.col("_q") <= validation_size(F.col("n_units"), fraction), F.col("_v"))).alias("val_cut"))


def _drawn(rows: DataFrame, cells: DataFrame) -> DataFrame:
    inside = F.col("sub_cut").isNull() | (_draw_key() <= F.col("sub_cut"))
    return rows.join(F.broadcast(cells), "dataset").where(inside)


def cell_rows(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (of units, windows or unit sums) of every cell that drew their unit, with the unit's
    ``role`` in the cell (train / val). The rows must be of the units the plan was made for. No
    shuffle."""
    role = F.when(_split_key() <= F.col("val_cut"), "val").otherwise("train")
    return _drawn(rows, plan).withColumn("role", role).drop("available", "sub_cut", "val_cut")


def cell_codes(units: DataFrame, plan: DataFrame) -> tuple[list[tuple], DataFrame]:
    """The cells of a plan by number, and (dataset, unit_number, codes): for each unit the cells that drew it, as twice the
    cell's number, plus one where the unit validates. A unit has one entry per cell at most."""
    found = [tuple(r) for r in plan.select(*CELL).orderBy(*CELL).collect()]
    kinds = plan.select(*CELL).schema.simpleString()[len("struct<"):-1].replace(":", " ")
    numbers = plan.sparkSession.createDataFrame([(*c, i) for i, c in enumerate(found)], f"{kinds}, _c int")
    code = F.col("_c") * 2 + F.when(F.col("role") == "val", 1).otherwise(0)
    codes = cell_rows(units.select(*KEYS), plan).join(F.broadcast(numbers), CELL).groupBy(*KEYS).agg(F.sort_array(F.collect_list(code)).alias("codes"))
    return found, codes


def subsample_units(units: DataFrame, plan: DataFrame) -> DataFrame:
    """Units drawn without replacement for every cell: (dataset, n_units, seed, unit_number). The
    draw of a smaller count is part of the draw of a larger one with the same seed."""
    return _drawn(units.select(*KEYS), plan).select(*CELL, UNIT)


def membership(units: DataFrame, plan: DataFrame) -> DataFrame:
    """Which units each cell trains and validates on."""
    return cell_rows(units.select(*KEYS), plan).select(*CELL, UNIT, "role")


def bootstrap_units(units: DataFrame, seeds) -> DataFrame:
    """Units drawn with replacement, N draws per seed: (dataset, seed, unit_number, freq)."""
    numbered = number_rows(units.select(*KEYS), ["dataset"], [UNIT], "_i")
    # number of units per dataset: one row per dataset
    sizes = F.broadcast(units.groupBy("dataset").agg(F.count("*").alias("_n")))
    draws = (with_levels(numbered, "seed", [int(s) for s in seeds]).join(sizes, "dataset")
             .withColumn("_i", hash32("boot", F.col("seed"), F.col("_i")) % F.col("_n") + 1)
             .groupBy("dataset", "seed", "_i").agg(F.count("*").alias("freq")))
    return draws.join(numbered, ["dataset", "_i"]).select("dataset", "seed", UNIT, "freq")


def pending_cells(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the grid that have no finished row yet."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def finished_cells(metrics: DataFrame, preds: DataFrame, keys: list[str]) -> DataFrame:
    """Cells present in both tables. Metrics without predictions are an error: the two tables
    were not kept together."""
    orphan = orphan_cells(metrics, preds, keys).limit(1).collect()
    if orphan:
        raise ValueError(f"metrics without predictions, e.g. {orphan[0]}; regenerate both tables")
    return metrics.select(*keys).intersect(_present(preds, keys))


def orphan_cells(metrics: DataFrame, preds: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.select(*keys).subtract(_present(preds, keys))


def _present(preds: DataFrame, keys: list[str]) -> DataFrame:
    """The cells of a table, a row each, reduced before any shuffle: a cell has many predictions."""
    return preds.select(*keys).distinct()


def longest_units(preds: DataFrame, k: int) -> DataFrame:
    """The k units of each dataset with the most rows (ties to the smaller id)."""
    order = Window.partitionBy("dataset").orderBy(F.desc("n_rows"), UNIT)
    return (preds.groupBy(*KEYS).agg(F.count("*").alias("n_rows"))
            .withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r"))
