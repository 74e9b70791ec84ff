"""Row positions and unit blocks: how one very long unit is spread over many tasks.

Two tools keep every per-unit operator exact when a single unit holds a large share of the rows.

* ``number_rows`` gives each row its dense position 1..n inside its group. Groups above a row
  limit are cut into slices at quantiles of their order key, numbered slice by slice, and shifted
  by the sizes of the earlier slices. NULL keys come first and NaN last, cut or not.
* ``blocked`` cuts a numbered unit into blocks of consecutive cycles and copies the few rows a
  sliding frame needs from the previous block. Windows are then partitioned by (unit, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CYCLE, KEYS

SLICE_ROWS = 1_000_000
MAX_SLICED_GROUPS = 100_000
BLOCK_ROWS = 65_536
BLOCK = "_block"
HOME = "_home"


def _as_number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name)
    return F.col(name).cast("double")


def _large_groups(df: DataFrame, keys: list[str], lead: Column, slice_rows: int):
    """Groups to slice, as a local table, or None when there are none. Counted by one aggregation
    of the key and order columns. There are never more than ``MAX_SLICED_GROUPS``: with more
    groups above the limit, the limit becomes that share of the table."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    limit = slice_rows
    found = sizes.where(F.col("_n") > limit).limit(MAX_SLICED_GROUPS + 1).collect()
    if len(found) > MAX_SLICED_GROUPS:
        limit = max(slice_rows, df.count() // MAX_SLICED_GROUPS + 1)
        found = sizes.where(F.col("_n") > limit).collect()
    if not found:
        return None
    local = F.broadcast(df.sparkSession.createDataFrame(found, sizes.schema))
    number = F.when(F.isnan(lead), None).otherwise(lead)
    parts = min(1000, 4 * (max(r["_n"] for r in found) // limit + 1))
    cuts = (df.join(local, keys).groupBy(*keys)
            .agg(F.percentile_approx(number, [i / parts for i in range(1, parts)], 10 * parts).alias("_cuts")))
    made = cuts.select(*keys, F.coalesce(F.array_distinct("_cuts"), F.array().cast("array<double>")).alias("_cuts"))
    return df.sparkSession.createDataFrame(made.collect(), made.schema)  # the same cuts in every use


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str = CYCLE,
                slice_rows: int = SLICE_ROWS, total: str | None = None) -> DataFrame:
    """Add ``name``: the position 1..n of a row inside its ``keys`` group, sorted by ``order``
    (first entry numeric or a timestamp; together the entries must identify a row). ``total``: also add the size n of the
    group, under that name.

    Groups above ``slice_rows`` are cut at approximate quantiles of the first order key, so that an outlier
    does not matter; rows with one and the same first key stay in one slice. The sizes of the slices give each
    its starting position.
    """
    lead = _as_number(df, order[0])
    large = _large_groups(df, keys, lead, slice_rows)
    if large is None:
        group = Window.partitionBy(*keys).orderBy(*order)
        made = {name: F.row_number().over(group).cast("bigint")}
        if total:  # the same order, so that one sort serves both
            made[total] = F.count("*").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return df.withColumns(made)
    above = F.size(F.filter("_cuts", lambda c: c < lead))
    place = F.when(lead.isNull(), -1).when(F.isnan(lead), F.size("_cuts") + 1).otherwise(above)
    sliced = (
        df.join(F.broadcast(large), keys, "left")
        .withColumns({"_k": F.col("_cuts").isNotNull(), "_slice": F.when(F.col("_cuts").isNull(), 0).otherwise(place)})
        .drop("_cuts")
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        sliced.where("_k").groupBy(*keys, "_slice").agg(F.count("*").alias("_c"))
        .select(*keys, "_slice", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_shift"))
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    out = (
        sliced.withColumn(name, F.row_number().over(inside).cast("bigint"))
        .join(F.broadcast(shifts), [*keys, "_slice"], "left")
        .withColumn(name, F.col(name) + F.coalesce("_shift", F.lit(0)))
    )
    if total:  # a sliced group's size is the sum of its slices; other groups are counted where they lie
        whole = sliced.where("_k").groupBy(*keys).agg(F.count("*").alias("_whole"))
        here = F.count("*").over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        out = (out.withColumn("_here", here).join(F.broadcast(whole), keys, "left")
               .withColumn(total, F.coalesce("_whole", "_here")).drop("_whole", "_here"))
    return out.drop("_k", "_slice", "_shift")


def dense_cycles(frame: DataFrame) -> DataFrame:
    """Cycles replaced by row positions 1..n (the old ones kept as ``source_cycle``). Frames with
    gaps need this before any window: windows count rows."""
    old = frame.withColumnRenamed(CYCLE, "source_cycle")
    return number_rows(old, KEYS, ["source_cycle"], CYCLE)


def require_dense(frame: DataFrame) -> DataFrame:
    """The frame, or an error when some unit's cycles are not 1..n."""
    cycles = frame.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.min(CYCLE).alias("lo"), F.max(CYCLE).alias("hi"))
    odd = cycles.where("lo != 1 OR hi != n").limit(1).collect()
    if odd:
        raise ValueError(f"cycles are not 1..n: {odd[0]}; renumber with dense_cycles")
    return frame


def block_of(position: Column, block_rows: int = BLOCK_ROWS) -> Column:
    return F.floor((position - 1) / F.lit(block_rows))


def blocked(frame: DataFrame, width: int, block_rows: int = BLOCK_ROWS,
            position: str = CYCLE) -> DataFrame:
    """Add the block of each row, and copy the last ``width - 1`` rows of a block into the next
    one so that frames of ``width`` rows are complete. Copies carry ``_home = false``."""
    if width > block_rows:
        raise ValueError(f"frame of {width} rows is wider than a block of {block_rows}")
    own = block_of(F.col(position), block_rows)
    if width <= 1:
        return frame.withColumn(BLOCK, own).withColumn(HOME, F.lit(True))
    tail = (F.col(position) - 1) % block_rows >= block_rows - (width - 1)
    places = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    return (frame.withColumn(BLOCK, F.explode(places))
            .withColumn(HOME, F.col(BLOCK) == own))


def unblocked(frame: DataFrame) -> DataFrame:
    """Drop the copies and the block columns."""
    return frame.where(HOME).drop(BLOCK, HOME)


def block_window(keys: list[str] | None = None, position: str = CYCLE):
    """Window over the rows of one unit block, in cycle order."""
    return Window.partitionBy(*(keys or KEYS), BLOCK).orderBy(position)


def join_units(frame: DataFrame, facts: DataFrame, last: str, how: str = "inner",
               block_rows: int = BLOCK_ROWS, keys: list[str] | None = None) -> DataFrame:
    """Join one-row-per-unit ``facts`` to the rows of a frame on (unit, block), so that a unit
    with many rows is spread by block. ``last`` is the facts column with the last position."""
    pieces = F.sequence(F.lit(0).cast("bigint"), block_of(F.col(last), block_rows))
    spread = facts.withColumn(BLOCK, F.explode(pieces))
    had_blocks = BLOCK in frame.columns
    rows = frame if had_blocks else frame.withColumn(BLOCK, block_of(F.col(CYCLE), block_rows))
    out = rows.join(spread, [*(keys or KEYS), BLOCK], how)
    return out if had_blocks else out.drop(BLOCK)
