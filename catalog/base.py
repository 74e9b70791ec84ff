"""Shared inputs of the registered queries: the driver tables seen as fleets, in Spark and in SQL.

``events`` becomes a run-to-failure fleet: a user is a unit, its events in time order are cycles,
and a hash of the user id gives the fleet (dataset) and the train/test split.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlife.config import CYCLE, KEYS, UNIT
from fleetlife.functions.errors import cap, r
from fleetlife.functions.hashing import digest
from fleetlife.operators import labels, metrics, numbering, sampling
from fleetlife.plans import sweep

WINDOW, CONTEXT, CAP = 12, 24, 30
EDGES = [0.0, 10.0, 20.0, 30.0, float("inf")]
COUNTS, SEEDS, VAL = (2, 5, 10, 25), (0, 1, 2, 3, 4), 0.2
CHANNELS = ["s_1", "s_2", "s_3"]
CELL = sampling.CELL
PCELL = metrics.PRED_CELL


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: tuple[str, ...]


CATALOG: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register a Spark query under a name, with the inventory ids it covers and its SQL twin."""

    def add(fn):
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = Query(fn, sql, tuple(ids.split()))
        return fn

    return add


def plan(fn):
    """Marks a shared input. Nothing is kept between queries: each builds its plan from the files as they are."""
    return fn


@plan
def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, so that summation order does not show."""
    names = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({n: r(F.col(n).cast("double"), digits) for n in names})


# ---- Spark side ---------------------------------------------------------------------------------
# Operating point of each event type.
POINTS = {"click": 0, "error": 10, "purchase": 20, "signup": 25, "view": 35}


def _placed(df: DataFrame, unit: str) -> DataFrame:
    fleet = F.when(digest(F.col(unit), "fleet") < "8", "north").otherwise("south")
    split = F.when(digest(F.col(unit), "split") < "9a", "train").otherwise("test")
    return df.withColumns({"dataset": fleet, "split": split})


@plan
def cycles(spark: SparkSession, path: str) -> DataFrame:
    """Canonical frame of whole lives."""
    ev = table(spark, path, "events").select("user_id", "event_id", "ts", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("double")
    point = F.lit(0)
    for name, at in POINTS.items():
        point = F.when(F.col("event_type") == name, at).otherwise(point)
    value = F.col("value")
    rows = numbering.number_rows(ev, ["user_id"], ["ts", "event_id"], CYCLE, total="n_full").withColumnRenamed("user_id", UNIT)
    return _placed(rows, UNIT).select(
        "dataset", "split", UNIT, CYCLE, "n_full", "event_type",
        (point + (value - F.floor(value) - 0.5) * 0.8).alias("setting_1"),
        (point / 100.0 + (k - 50) / 100000.0).alias("setting_2"),
        (100.0 + (k - 50) / 200.0).alias("setting_3"),
        value.alias("s_1"), k.alias("s_2"), (value + 2.0 * k).alias("s_3"))


@plan
def lifetimes(spark: SparkSession, path: str) -> DataFrame:
    """Units with the length of their whole life."""
    users = table(spark, path, "events").groupBy("user_id").agg(F.count("*").alias("n_full"))
    return _placed(users, "user_id").select("dataset", "split", F.col("user_id").alias(UNIT), "n_full")


@plan
def units(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    return lifetimes(spark, path).where(F.col("split") == split).select(*KEYS)


@plan
def fleet(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Labelled frame: whole train lives, test lives cut at 60 percent."""
    kept = labels.kept_cycles(F.col("n_full"), 0.6, WINDOW)
    n_obs = F.when(F.col("split") == "train", F.col("n_full")).otherwise(kept)
    rul = (F.col("n_full") - F.col(CYCLE)).cast("double")
    out = (cycles(spark, path).withColumn("n_obs", n_obs)
           .where(F.col(CYCLE) <= F.col("n_obs"))
           .withColumns({"actual_rul": rul, "clipped_rul": cap(rul, CAP)}))
    return out if split is None else out.where(F.col("split") == split)


@plan
def features(spark: SparkSession, path: str) -> DataFrame:
    """One row per full window of both splits: its end, labels, last values and the mean of s_1."""
    over = numbering.block_window().rowsBetween(-(WINDOW - 1), 0)
    rows = numbering.blocked(
        fleet(spark, path).select(*KEYS, "split", CYCLE, "n_obs", "actual_rul", "clipped_rul", *CHANNELS),
        WINDOW)
    return (numbering.unblocked(rows.withColumn("m_1", F.avg("s_1").over(over)))
            .where(F.col(CYCLE) >= WINDOW).withColumnRenamed("clipped_rul", "label"))


@plan
def cells(spark: SparkSession, path: str) -> DataFrame:
    return sampling.sampling_plan(units(spark, path), COUNTS, SEEDS, VAL)


def members(spark: SparkSession, path: str) -> DataFrame:
    return sampling.membership(units(spark, path), cells(spark, path))


# model, loss, input column of the line (None: the mean)
LINES = (("predict_mean", "native", None), ("cycle_reg", "native", CYCLE),
         ("linear_stats", "native", "m_1"), ("level_mlp", "mse", "s_2"), ("level_mlp", "corn", "s_1"))


@plan
def predictions(spark: SparkSession, path: str, lines=LINES, last_only: bool = False, spread: bool = False) -> DataFrame:
    """Every cell's prediction of every test window (or of each unit's last one). ``spread``: dealt by unit and cycle to
    tasks of a bounded size, for queries that sort all of them."""
    feats = features(spark, path).withColumn("true_rul", F.col("actual_rul"))
    train, test = feats.where("split = 'train'"), feats.where("split = 'test'")
    if last_only:
        test = test.where(F.col(CYCLE) == F.col("n_obs"))
    if spread:
        test = sweep.dealt(test, (len(COUNTS) + 1) * len(SEEDS) * len(lines))
    return sweep.line_predictions(train, test, cells(spark, path), lines, CAP)


def results(spark: SparkSession, path: str, lines=LINES) -> DataFrame:
    """Result rows on each test unit's last window."""
    return metrics.evaluate(predictions(spark, path, lines, last_only=True), PCELL, CAP)


def horizon(spark: SparkSession, path: str) -> DataFrame:
    return metrics.horizon_bins(predictions(spark, path), PCELL, CAP, EDGES)


# ---- SQL side -----------------------------------------------------------------------------------
def s_hash(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::UBIGINT"


def s_uniform(*parts: str) -> str:
    return f"({s_hash(*parts)}::DOUBLE / 4294967296e0)"


def rnd(*names: str, digits: int = 6) -> str:
    """Rounded output columns; a name may be ``expression AS name``."""
    out = []
    for n in names:
        expr, _, alias = n.rpartition(" AS ")
        out.append(f"round(({expr or alias})::DOUBLE, {digits}) + 0e0 AS {alias}")
    return ", ".join(out)


_PLACE = ("CASE WHEN md5(concat_ws('|', user_id, 'fleet')) < '8' THEN 'north' ELSE 'south' END AS dataset, "
          "CASE WHEN md5(concat_ws('|', user_id, 'split')) < '9a' THEN 'train' ELSE 'test' END AS split, "
          "user_id AS unit_number")
_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
_POINT = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 10 WHEN 'purchase' THEN 20 WHEN 'signup' THEN 25 WHEN 'view' THEN 35 ELSE 0 END"

CYCLES_SQL = f"""cycles AS (
  SELECT {_PLACE}, event_type,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS time_cycles,
    count(*) OVER (PARTITION BY user_id) AS n_full,
    {_POINT} + (value - floor(value) - 0.5::DOUBLE) * 0.8::DOUBLE AS setting_1,
    {_POINT} / 100e0 + ({_K} - 50) / 100000e0 AS setting_2,
    100e0 + ({_K} - 50) / 200e0 AS setting_3,
    value AS s_1, {_K} AS s_2, value + 2e0 * {_K} AS s_3
  FROM events)"""

FLEET_SQL = CYCLES_SQL + f""",
cut AS (SELECT *, CASE WHEN split = 'train' THEN n_full
    ELSE greatest({WINDOW}, least(floor(n_full * 0.6::DOUBLE)::BIGINT, n_full - 1)) END AS n_obs FROM cycles),
fleet AS (SELECT *, (n_full - time_cycles)::DOUBLE AS actual_rul,
    least(n_full - time_cycles, {CAP})::DOUBLE AS clipped_rul FROM cut WHERE time_cycles <= n_obs)"""

FEATURES_SQL = FLEET_SQL + f""",
framed AS (SELECT *, avg(s_1) OVER (PARTITION BY unit_number ORDER BY time_cycles
    ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS m_1 FROM fleet),
feats AS (SELECT *, clipped_rul AS label FROM framed WHERE time_cycles >= {WINDOW})"""

_COUNTS = ", ".join(map(str, COUNTS))
_SEEDS = ", ".join(map(str, SEEDS))
UNITS_SQL = f"""lives AS (SELECT DISTINCT {_PLACE} FROM events),
units AS (SELECT dataset, unit_number FROM lives WHERE split = 'train'),
seeds AS (SELECT unnest([{_SEEDS}]) AS seed)"""
MEMBERS_SQL = UNITS_SQL + f""",
avail AS (SELECT dataset, count(*) AS available FROM units GROUP BY dataset),
grid AS (SELECT dataset, available, c::BIGINT AS n_units FROM avail, (SELECT unnest([{_COUNTS}]) AS c) WHERE c < available
    UNION SELECT dataset, available, available FROM avail),
cells AS (SELECT dataset, available, n_units, seed FROM grid, seeds),
ranked AS (SELECT dataset, unit_number, seed, row_number() OVER (PARTITION BY dataset, seed
    ORDER BY md5(concat_ws('|', unit_number, seed, 'sub')), unit_number) AS rk FROM units, seeds),
drawn AS (SELECT c.dataset, c.n_units, c.seed, r.unit_number FROM cells c
    JOIN ranked r ON c.dataset = r.dataset AND c.seed = r.seed AND r.rk <= c.n_units),
members AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY dataset, n_units, seed
      ORDER BY md5(concat_ws('|', unit_number, seed, 'val')), unit_number)
    <= CASE WHEN n_units > 1 THEN greatest(1, round_even(n_units * {VAL}::DOUBLE, 0)::BIGINT) ELSE 0 END
    THEN 'val' ELSE 'train' END AS role FROM drawn)"""


def _params_sql(lines=LINES) -> str:
    """One row per cell and line, from the cell's train rows."""
    parts = []
    for model, loss, x in lines:
        if x is None:
            fit = "0e0 AS slope, avg(label) AS intercept"
        else:
            b = f"coalesce(regr_slope(label, {x}::DOUBLE), 0e0)"
            fit = f"{b} AS slope, avg(label) - {b} * avg({x}::DOUBLE) AS intercept"
        parts.append(f"SELECT dataset, n_units, seed, '{model}' AS model, '{loss}' AS loss, {fit} "
                     "FROM trainrows GROUP BY dataset, n_units, seed")
    return " UNION ALL ".join(parts)


def _value_sql(lines=LINES) -> str:
    whens = " ".join(f"WHEN p.model = '{m}' AND p.loss = '{s}' THEN f.{x}::DOUBLE" for m, s, x in lines if x)
    return f"CASE {whens} ELSE 0e0 END"


PREDS_SQL = FEATURES_SQL + ", " + MEMBERS_SQL + f""",
trainrows AS (SELECT f.*, m.n_units, m.seed FROM feats f JOIN members m
    ON f.dataset = m.dataset AND f.unit_number = m.unit_number AND m.role = 'train' WHERE f.split = 'train'),
params AS ({_params_sql()}),
preds AS (SELECT p.model, p.dataset, {CAP}::DOUBLE AS max_rul, p.n_units, p.seed, p.loss, f.unit_number, f.time_cycles,
    f.n_obs, f.actual_rul AS true_rul, greatest(0e0, least(p.intercept + p.slope * {_value_sql()}, {CAP}::DOUBLE)) AS pred
    FROM feats f JOIN params p ON f.dataset = p.dataset WHERE f.split = 'test')"""


def s_nasa(d: str) -> str:
    return f"CASE WHEN ({d}) >= 0 THEN exp(({d}) / 10e0) - 1 ELSE exp(-({d}) / 13e0) - 1 END"


def s_metrics(cap_sql: str = f"{CAP}::DOUBLE") -> str:
    out = []
    for protocol, truth in (("clipped", f"least(true_rul, {cap_sql})"), ("unclipped", "true_rul")):
        d = f"(pred - {truth})"
        out += [f"sqrt(avg({d} * {d})) AS rmse_{protocol}", f"avg(abs({d})) AS mae_{protocol}",
                f"sum({s_nasa(d)}) AS nasa_{protocol}"]
    return ", ".join(out) + ", count(*) AS n"


PKEYS = ", ".join(PCELL)
RESULTS_SQL = PREDS_SQL + f""",
results AS (SELECT {PKEYS}, {s_metrics()} FROM preds WHERE time_cycles = n_obs GROUP BY {PKEYS})"""

_D = f"(pred - least(true_rul, {CAP}::DOUBLE))"
_BINS = "(VALUES (0e0, 10e0), (10e0, 20e0), (20e0, 30e0), (30e0, 'Infinity'::DOUBLE)) AS b(bin_lo, bin_hi)"
_HAGG = (f"count(*) AS n_bin, sqrt(avg({_D} * {_D})) AS rmse_clipped, avg(abs({_D})) AS mae_clipped, "
         f"avg({_D}) AS bias, avg({s_nasa(_D)}) AS nasa_mean")
HORIZON_SQL = PREDS_SQL + f""",
horizon AS (
  SELECT {PKEYS}, false AS is_all, bin_lo, bin_hi, {_HAGG} FROM preds JOIN {_BINS} ON true_rul >= bin_lo AND true_rul < bin_hi
    GROUP BY {PKEYS}, bin_lo, bin_hi
  UNION ALL
  SELECT {PKEYS}, true, NULL::DOUBLE, NULL::DOUBLE, {_HAGG} FROM preds GROUP BY {PKEYS})"""
METRIC_NAMES = metrics.METRICS
