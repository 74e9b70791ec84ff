"""Readers: cycle text, truth text, snapshot trees, high-rate tables, learning curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import (
    BEARING_CONDITIONS, CYCLE, FLIGHT_SCENARIO, FLIGHT_SENSORS, KEYS, TURBOFAN_COLUMNS, UNIT,
)
from ..operators.labels import renumber_units
from ..operators.numbering import number_rows
from ..session import cut_lineage
from ..operators.summaries import aggregate_cycles, snapshot_indicators

HIGH_RATE_IDS = [UNIT, CYCLE, "t", "Fc", "hs"]


# ---- cycle text ---------------------------------------------------------------------------------
def parse_cycle_lines(lines: DataFrame, dataset: str | Column) -> DataFrame:
    """26 whitespace-separated numbers per line (column ``value``) -> canonical frame."""
    name = F.lit(dataset) if isinstance(dataset, str) else dataset
    parts = F.split(F.trim("value"), r"\s+")
    kinds = ["bigint", "bigint"] + ["double"] * (len(TURBOFAN_COLUMNS) - 2)
    return (lines.where(F.trim("value") != "").withColumn("_p", parts).select(
        name.alias("dataset"),
        *[F.get("_p", F.lit(i)).cast("double").cast(k).alias(c)
          for i, (c, k) in enumerate(zip(TURBOFAN_COLUMNS, kinds))]))


def read_cycle_text(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    return parse_cycle_lines(spark.read.text(path), dataset)


def parse_truth_lines(lines: DataFrame, dataset: str | Column, order: list[str]) -> DataFrame:
    """One number per line; line i of a dataset (in ``order``, blank lines skipped) is unit i."""
    name = F.lit(dataset) if isinstance(dataset, str) else dataset
    rows = lines.where(F.trim("value") != "").withColumn("dataset", name)
    return number_rows(rows, ["dataset"], order, UNIT).select(
        "dataset", UNIT, F.trim("value").cast("double").cast("bigint").alias("rul_truth"))


def read_truth(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Truth file of a test fleet. Lines are numbered by their split of the file and their place
    in it, so a large file is read in parallel."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"))
    return parse_truth_lines(lines, dataset, ["_block", "_line"])


# Fixed value: how a folder of an operating condition is named.
CONDITION_FOLDER = r"^[\d.]+Hz\d+kN$"


# ---- snapshot trees -----------------------------------------------------------------------------
def unknown_conditions(folders: DataFrame, known=tuple(BEARING_CONDITIONS), pattern: str = CONDITION_FOLDER) -> DataFrame:
    """Distinct folders (column ``condition``) that look like an operating condition but are not a known one."""
    named = folders.select("condition").where(F.col("condition").rlike(pattern))
    return named.where(~F.col("condition").isin(*known)).distinct()


def check_conditions(folders: DataFrame, known=tuple(BEARING_CONDITIONS)) -> None:
    """Error when there are unknown conditions; they would otherwise be skipped in silence."""
    odd = unknown_conditions(folders, known).limit(20).collect()
    if odd:
        raise ValueError(f"unknown condition folders {sorted(r[0] for r in odd)}; known: {sorted(known)}")


def read_snapshot_tree(spark: SparkSession, root: str, dataset: str = "XJTU-SY") -> DataFrame:
    """``<condition>/<unit>/<n>.csv`` with two sample columns -> one canonical row per snapshot.

    Folder names are checked from the listing of files. Samples are read once: reduced to indicators per file,
    which are written before they are numbered. Snapshots are ordered by the number in their file name and
    renumbered 1..n; units by sorted name.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
             .load(root).select(F.url_decode(F.element_at(F.split("path", "/"), -3)).alias("condition")))
    check_conditions(files)
    path = F.col("_metadata.file_path")

    def part(i):
        return F.url_decode(F.element_at(F.split(path, "/"), i))

    samples = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv")
               .option("header", "true").option("mode", "FAILFAST")
               .schema("h double, v double").option("enforceSchema", "true").csv(root)
               .select("h", "v", part(-3).alias("condition"), part(-2).alias("unit_name"),
                       F.regexp_extract(part(-1), r"^(\d+)\.csv$", 1).cast("bigint").alias("_stem")))
    return snapshot_frame(samples, dataset)


def snapshot_frame(samples: DataFrame, dataset: str) -> DataFrame:
    """Samples (condition, unit_name, _stem: number of the snapshot, h, v) -> canonical frame with ``unit_name``. The
    indicators of a snapshot are written before they are numbered; folders of no known condition are left out."""
    rows = cut_lineage(snapshot_indicators(samples, {"h": "h", "v": "v"}, ("condition", "unit_name", "_stem")))
    known = {c: i for i, c in enumerate(BEARING_CONDITIONS)}
    rows = rows.where(F.col("condition").isin(*known))
    at = F.create_map(*[x for c, v in BEARING_CONDITIONS.items()
                        for x in (F.lit(c), F.array(*[F.lit(float(n)) for n in v]))])[F.col("condition")]
    numbered = number_rows(rows.withColumns({f"setting_{i + 1}": at[i] for i in range(3)}),
                           ["unit_name"], ["_stem"], CYCLE)
    return (renumber_units(numbered.withColumn("dataset", F.lit(dataset)), "unit_name", ["dataset"])
            .drop("_stem", "condition"))


# ---- high-rate tables ---------------------------------------------------------------------------
def require_channels(df: DataFrame, names: list[str], ids: list[str]) -> DataFrame:
    """Columns in declared order; the channel set of the file must be exactly the declared one."""
    found = set(df.columns) - set(ids)
    if found != set(names):
        raise ValueError(f"channels {sorted(found)} do not match the declared {sorted(names)}")
    return df.select(*ids, *names)


def read_high_rate(spark: SparkSession, path: str, dataset: str,
                   channels: list[str] | None = None) -> DataFrame:
    """Parquet of one fleet's seconds -> canonical frame of per-cycle statistics. Only the id,
    scenario and sensor columns are read; simulation-only columns never are."""
    names = channels or FLIGHT_SCENARIO + FLIGHT_SENSORS
    return high_rate_cycles(spark.read.parquet(path).withColumn("dataset", F.lit(dataset)), names)


def high_rate_cycles(table: DataFrame, names: list[str], more: tuple = ()) -> DataFrame:
    """Per-cycle statistics of a table of seconds with its dataset (and ``more`` columns that a cycle has one value of);
    other columns are not read."""
    missing = {"dataset", *more, *HIGH_RATE_IDS, *names} - set(table.columns)
    if missing:
        raise ValueError(f"high-rate table lacks {sorted(missing)}")
    return aggregate_cycles(table.select("dataset", *more, *HIGH_RATE_IDS, *names), names, "Fc", ["t"], (*KEYS, CYCLE, *more))


# ---- learning curves ----------------------------------------------------------------------------
def parse_curves(points: DataFrame, name: Column) -> DataFrame:
    """Points (step, epoch, metric, value) of curves called ``name`` -> (n_units, seed, loss,
    metric, x, value). x is the step, or the epoch when the step is empty; the cell comes from the
    end of the name, and points with other names are ignored."""
    pattern = r"n(\d+)_seed(\d+)_([a-z]+)$"
    return points.where(name.rlike(pattern)).select(
        F.regexp_extract(name, pattern, 1).cast("bigint").alias("n_units"),
        F.regexp_extract(name, pattern, 2).cast("int").alias("seed"),
        F.regexp_extract(name, pattern, 3).alias("loss"), "metric",
        F.coalesce("step", "epoch").alias("x"), "value")


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    """Learning curves from CSV files named after their cell."""
    points = spark.read.option("header", "true").schema(
        "step double, epoch double, metric string, value double").csv(path)
    return parse_curves(points, F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", ""))
