"""Remaining-life labels, truncation of test units, and unit ids across fleets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CYCLE, KEYS, UNIT
from ..functions.errors import cap
from .numbering import BLOCK_ROWS, join_units, number_rows


def unit_lengths(frame: DataFrame) -> DataFrame:
    """One row per unit: its last cycle as ``n_obs``."""
    return frame.groupBy(*KEYS).agg(F.max(CYCLE).alias("n_obs"))


def with_length(frame: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``n_obs``, the last cycle of the row's unit."""
    if "n_obs" in frame.columns:
        return frame
    return join_units(frame, unit_lengths(frame), "n_obs", block_rows=block_rows)


def label_train(frame: DataFrame, max_rul: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Run-to-failure label: last cycle of the unit minus the cycle, and its capped copy."""
    rul = (F.col("n_obs") - F.col(CYCLE)).cast("double")
    return (with_length(frame, block_rows)
            .withColumn("actual_rul", rul).withColumn("clipped_rul", cap(rul, max_rul)))


def label_test(frame: DataFrame, truth: DataFrame | None, max_rul: float,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Label of a unit that ends before failure: given remaining cycles at its last row plus the
    cycles still to come. ``truth``: (dataset, unit_number, rul_truth); None when the frame carries
    ``n_obs`` and ``rul_truth`` itself."""
    rows = frame
    if truth is not None:
        facts = unit_lengths(frame).join(truth, KEYS, "left")
        rows = join_units(frame.drop("n_obs", "rul_truth"), facts, "n_obs", block_rows=block_rows)
    rul = (F.col("rul_truth") + F.col("n_obs") - F.col(CYCLE)).cast("double")
    return (rows.withColumn("actual_rul", rul).withColumn("clipped_rul", cap(rul, max_rul))
            .drop("rul_truth"))


def kept_cycles(n, fraction: float, window: int):
    """Cycles kept of a truncated unit: floor(n * fraction), at least ``window``, below n."""
    return F.greatest(F.lit(window), F.least(F.floor(n * F.lit(fraction)), n - 1))


def truncate_units(frame: DataFrame, fraction: float, window: int,
                   block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Cut every unit to the first part of its life. Returns the kept rows (with ``n_obs`` and
    ``rul_truth``, the remaining cycles at the cut) and the truth table. A unit too short to cut
    raises."""
    keep = kept_cycles(F.col("n_obs"), fraction, window)
    checked = F.when((keep >= 1) & (keep < F.col("n_obs")), keep).otherwise(
        F.raise_error(F.concat(F.lit("unit too short to truncate: "), F.col(UNIT))).cast("bigint"))
    facts = unit_lengths(frame).withColumn("_keep", checked)
    rows = (join_units(frame.drop("n_obs"), facts, "n_obs", block_rows=block_rows)
            .where(F.col(CYCLE) <= F.col("_keep"))
            .withColumn("rul_truth", F.col("n_obs") - F.col("_keep"))
            .withColumn("n_obs", F.col("_keep")).drop("_keep"))
    truth = facts.select(*KEYS, (F.col("n_obs") - F.col("_keep")).alias("rul_truth"))
    return rows, truth


def renumber_units(frame: DataFrame, name: str, per: list[str] | None = None) -> DataFrame:
    """Unit numbers 1..N by sorted unit name (inside ``per`` when given). The names are numbered
    as a table of their own and joined back."""
    keys = per or ["_all"]
    names = frame.withColumn("_all", F.lit(0)).select(*keys, name).distinct()
    text = F.encode(name, "UTF-8")
    ends = names.groupBy(*keys).agg(F.min(text).alias("_a"), F.max(text).alias("_b"))
    # All names share the common start of the smallest and the largest; the six bytes after it
    # give a number in name order.
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("_a"), F.length("_b"))))
    shared = F.size(F.filter(places, lambda i: F.substring(F.col("_a"), F.lit(1), i)
                             == F.substring(F.col("_b"), F.lit(1), i)))
    six = F.rpad(F.substring(text, shared + 1, F.lit(6)), 6, F.unhex(F.lit("00")))
    coded = (names.join(ends, keys).withColumn("_code", F.conv(F.hex(six), 16, 10).cast("bigint"))
             .select(*keys, name, "_code"))
    ids = number_rows(coded, keys, ["_code", name], UNIT).drop("_code", "_all")
    return frame.drop(UNIT).join(ids, [*(per or []), name])


def union_stride(members: dict[str, DataFrame], least: int = 1000) -> int:
    """The smallest power of ten from ``least`` on that no unit id of a member reaches."""
    tops = reduce(DataFrame.union, [m.agg(F.max(UNIT), F.min(UNIT)) for m in members.values()]).collect()  # a row each
    if any(low is not None and low < 0 for _, low in tops):
        raise ValueError("unit ids below 0 cannot be told apart in a union")
    stride, top = least, max((t for t, _ in tops if t is not None), default=0)
    while stride <= top:
        stride *= 10
    return stride


def union_fleets(members: dict[str, DataFrame], name: str) -> DataFrame:
    """Union of fleets under one dataset name with ids ``stride * position + unit``, positions in
    sorted member order; ``union_stride`` keeps the ids apart. At least two members are required."""
    if len(members) < 2:
        raise ValueError(f"a union needs at least two members, got {sorted(members)}")
    stride = union_stride(members)
    parts = [
        members[m].withColumn(UNIT, F.col(UNIT) + stride * i).withColumn("member", F.lit(m))
        for i, m in enumerate(sorted(members))
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("dataset", F.lit(name))


def require_members(frame: DataFrame, names: list[str], column: str = "dataset") -> DataFrame:
    """The frame, or an error when a named member has no rows in it."""
    spark = frame.sparkSession
    wanted = spark.createDataFrame([(n,) for n in names], f"{column} string")
    missing = [row[0] for row in wanted.join(frame.select(column).distinct(), column, "left_anti").collect()]
    if missing:
        raise ValueError(f"missing fleet members: {sorted(missing)}")
    return frame
