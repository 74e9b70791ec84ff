"""Sliding windows, history contexts and statistics over them.

All functions take a canonical frame (``dataset, unit_number, time_cycles`` = 1..n per unit) and
use row frames partitioned by (unit, block), see ``numbering``. Where only statistics are needed
they are frame aggregates; arrays are built only where an array is consumed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CYCLE, KEYS, UNIT
from ..functions.errors import guarded_std
from ..session import small_side
from .labels import with_length
from .numbering import BLOCK_ROWS, block_window, blocked, unblocked

STATS = ("mean", "std", "min", "max", "q25", "q50", "q75", "slope", "last")


def _histories(frame, channels, length, min_cycle, name, target, block_rows, also=()):
    over = block_window().rowsBetween(-(length - 1), 0)
    row = F.struct(*[F.col(c) for c in channels])
    rows = blocked(_needed(frame, [*channels, target, *also]), length, block_rows)
    return (
        unblocked(rows.withColumn(name, F.collect_list(row).over(over)))
        .where(F.col(CYCLE) >= min_cycle)
        .select(*KEYS, F.col(CYCLE).alias("end_cycle"), F.col(target).alias("label"), *also, name)
    )


def _needed(frame, columns):
    """Keys, cycle and each named column once."""
    return frame.select(*dict.fromkeys([*KEYS, CYCLE, *columns]))


def sliding_windows(frame: DataFrame, channels: list[str], window: int,
                    target: str = "clipped_rul", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every full window of ``window`` rows inside a unit, stride 1, labelled at its last row."""
    return _histories(frame, channels, window, window, "win", target, block_rows)


def contexts(frame: DataFrame, channels: list[str], window: int, length: int,
             target: str = "clipped_rul", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For the same (unit, end) set as ``sliding_windows``: the last min(c, length) rows, never
    padded."""
    return _histories(frame, channels, length, window, "ctx", target, block_rows)


def _tail(frame, channels, length, name, target):
    """Last ``length`` rows of each unit as an array; at most ``length`` rows per unit travel."""
    rows = with_length(frame).where(F.col(CYCLE) > F.col("n_obs") - length)
    packed = F.struct(CYCLE, F.struct(*[F.col(c) for c in channels]).alias("x"))
    return rows.groupBy(*KEYS).agg(
        F.max(CYCLE).alias("end_cycle"), F.max_by(target, CYCLE).alias("label"),
        F.transform(F.sort_array(F.collect_list(packed)), lambda s: s["x"]).alias(name))


def last_windows(frame: DataFrame, channels: list[str], window: int,
                 target: str = "actual_rul", pad: bool = True) -> DataFrame:
    """One window per unit: its last ``window`` rows. Shorter units repeat their first row in
    front, or are dropped when ``pad`` is false."""
    out = _tail(frame, channels, window, "win", target)
    if not pad:
        return out.where(F.size("win") == window)
    return out.withColumn("win", pad_front(F.col("win"), window))


def pad_front(rows: Column, window: int) -> Column:
    """Repeat the first element in front up to ``window`` elements."""
    return F.concat(F.array_repeat(F.element_at(rows, 1), F.lit(window) - F.size(rows)), rows)


def last_contexts(frame: DataFrame, channels: list[str], length: int,
                  target: str = "actual_rul") -> DataFrame:
    """One context per unit: its last min(n, length) rows, never padded."""
    return _tail(frame, channels, length, "ctx", target)


def last_raw(win: Column) -> Column:
    """Last row of a window."""
    return F.element_at(win, -1)


def window_stats(frame: DataFrame, channels: list[str], window: int,
                 target: str = "clipped_rul", keep: tuple = (),
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Nine statistics of each channel over every full window: mean, population deviation, min,
    max, quartiles, slope per step, last value. Columns ``<channel>_<stat>``. NULL readings are left out of
    the statistics; a window without readings has NULL ones."""
    over = block_window().rowsBetween(-(window - 1), 0)
    step = F.col(CYCLE).cast("double")
    cols = {}
    for c in channels:
        x = F.col(c).cast("double")
        cols |= {
            f"{c}_mean": F.avg(x).over(over), f"{c}_std": F.stddev_pop(x).over(over),
            f"{c}_min": F.min(x).over(over), f"{c}_max": F.max(x).over(over),
            f"_{c}_list": F.collect_list(x).over(over),
            f"{c}_slope": F.regr_slope(x, step).over(over), f"{c}_last": x,
        }
    rows = blocked(_needed(frame, [*channels, target, *keep]), window, block_rows).withColumns(cols)
    full = unblocked(rows).where(F.col(CYCLE) >= window)
    full = full.withColumns({f"_{c}_list": F.array_sort(f"_{c}_list") for c in channels})
    quartiles = {
        f"{c}_q{q}": present_quantile(F.col(f"_{c}_list"), q / 100)
        for c in channels for q in (25, 50, 75)
    }
    return full.withColumns(quartiles).select(
        *KEYS, F.col(CYCLE).alias("end_cycle"), F.col(target).alias("label"), *keep,
        *[f"{c}_{s}" for s in STATS for c in channels])


def present_quantile(values: Column, q: float) -> Column:
    """Quantile by linear interpolation of the values there are, from a sorted array; NULL without any."""
    place = (F.size(values) - 1) * F.lit(q)
    low = F.floor(place).cast("int")
    a = F.get(values, low)
    return a + (F.coalesce(F.get(values, low + 1), a) - a) * (place - low)


def array_stats(win: Column, channel: str, window: int) -> dict[str, Column]:
    """The nine statistics of one channel from a window array (padded windows included). NULL readings are left out, as
    ``window_stats`` does: both halves of the features agree."""
    placed = F.filter(F.transform(win, lambda s, i: F.struct(s[channel].cast("double").alias("v"), i.cast("double").alias("i"))),
                      lambda p: p["v"].isNotNull())
    x = F.transform(placed, lambda p: p["v"])
    ordered = F.array_sort(x)
    n = F.nullif(F.size(x), F.lit(0))

    def over(value):
        return F.aggregate(placed, F.lit(0.0), lambda a, p: a + value(p))

    mean, middle = over(lambda p: p["v"]) / n, over(lambda p: p["i"]) / n
    square = over(lambda p: (p["v"] - mean) * (p["v"] - mean))
    spread = over(lambda p: (p["i"] - middle) * (p["i"] - middle))
    tilt = over(lambda p: (p["v"] - mean) * (p["i"] - middle))
    return {
        "mean": mean, "std": F.sqrt(square / n), "min": F.array_min(x), "max": F.array_max(x),
        **{f"q{q}": present_quantile(ordered, q / 100) for q in (25, 50, 75)},
        "slope": tilt / F.nullif(spread, F.lit(0.0)), "last": F.element_at(win, -1)[channel].cast("double"),
    }


def last_window_stats(frame: DataFrame, channels: list[str], window: int,
                      target: str = "actual_rul") -> DataFrame:
    """``window_stats`` of one padded last window per unit."""
    wins = last_windows(frame, channels, window, target)
    per = {c: array_stats(F.col("win"), c, window) for c in channels}
    return wins.select(*KEYS, "end_cycle", "label",
                       *[per[c][s].alias(f"{c}_{s}") for s in STATS for c in channels])


def loc_scale(frame: DataFrame, channels: list[str], length: int, min_cycle: int = 1,
              keep: tuple = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean and population deviation of each channel over the last ``length`` rows: columns
    ``<channel>_loc`` and ``<channel>_scale``, beside ``keep``."""
    many = loc_scales(frame, channels, [length], min_cycle, keep, block_rows)
    return many.withColumnsRenamed({f"{c}_{s}_{length}": f"{c}_{s}" for c in channels for s in ("loc", "scale")})


def loc_scales(frame: DataFrame, channels: list[str], lengths: list[int], min_cycle: int = 1,
               keep: tuple = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``loc_scale`` at several lengths from one sort: ``<channel>_loc_<length>`` and so on."""
    cols = {}
    for n in lengths:
        over = block_window().rowsBetween(-(n - 1), 0)
        for c in channels:
            cols |= {f"{c}_loc_{n}": F.avg(c).over(over), f"{c}_scale_{n}": F.stddev_pop(c).over(over)}
    rows = blocked(_needed(frame, [*channels, *keep]), max(lengths), block_rows).withColumns(cols)
    return (unblocked(rows).where(F.col(CYCLE) >= min_cycle)
            .select(*KEYS, F.col(CYCLE).alias("end_cycle"), *keep, *cols))


def channel_scaler(frame: DataFrame, channels: list[str], window: int,
                   by: tuple = ("dataset",)) -> DataFrame:
    """Mean and population deviation of each channel over all full windows. A cycle counts once
    per window that holds it, so no window is built."""
    n, c = F.col("n_obs"), F.col(CYCLE)
    weight = F.greatest(F.lit(0), F.least(c, F.lit(window), n - c + 1, n - window + 1)).cast("double")
    rows = with_length(frame).withColumn("_w", weight).where("_w > 0")
    total = F.sum("_w")
    first = rows.groupBy(*by).agg(
        total.alias("weight"), *[(F.sum(F.col("_w") * F.col(x)) / total).alias(f"{x}_mean") for x in channels])
    first = small_side(first)
    centred = rows.join(first, list(by))
    second = centred.groupBy(*by).agg(*[
        guarded_std(F.sqrt(F.sum(F.col("_w") * F.pow(F.col(x) - F.col(f"{x}_mean"), 2)) / total)).alias(f"{x}_std")
        for x in channels])
    return first.join(second, list(by))


def apply_channel_scaler(frame: DataFrame, scaler: DataFrame, channels: list[str],
                         by: tuple = ("dataset",)) -> DataFrame:
    """(x - mean) / std with the statistics of ``channel_scaler``."""
    stats = [f"{x}_{s}" for x in channels for s in ("mean", "std")]
    rows = frame.join(small_side(scaler.select(*by, *stats)), list(by), "left")
    scaled = {x: (F.col(x) - F.col(f"{x}_mean")) / F.col(f"{x}_std") for x in channels}
    return rows.withColumns(scaled).drop(*stats)


def alignment_gaps(windows: DataFrame, ctx: DataFrame) -> DataFrame:
    """Rows of two (unit, end_cycle, label) tables that do not pair one to one."""
    keys = [*KEYS, "end_cycle"]
    a = windows.select(*keys, F.col("label").alias("a_label"))
    b = ctx.select(*keys, F.col("label").alias("b_label"))
    return a.join(b, keys, "full_outer").where(~F.col("a_label").eqNullSafe(F.col("b_label")))


def require_aligned(windows: DataFrame, ctx: DataFrame) -> None:
    gaps = alignment_gaps(windows, ctx).limit(1).collect()
    if gaps:
        raise ValueError(f"windows and contexts do not pair: {gaps[0]}")


def require_disjoint(train: DataFrame, test: DataFrame) -> None:
    """Error when a unit occurs in both frames."""
    both = shared_units(train, test).limit(1).collect()
    if both:
        raise ValueError(f"train and test share unit {both[0][UNIT]}")


def shared_units(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.select(*KEYS).distinct().join(test.select(*KEYS).distinct(), KEYS)
