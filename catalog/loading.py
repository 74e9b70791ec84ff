"""Fleets of each family through the one loading path, from the given tables laid out as the family's files are."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlife.config import BEARING_CHANNELS, BEARING_CONDITIONS, CYCLE, UNIT
from fleetlife.operators import labels, numbering
from fleetlife.plans import families
from fleetlife.sources import files

from .base import CAP, CYCLES_SQL, WINDOW, cycles, lifetimes, query, rnd, rounded, table
from .preparation import _moments, seconds

CUT = 0.6
SETTINGS = families.Settings(max_rul=CAP, window=WINDOW, fraction=CUT)
_KEPT = f"greatest({WINDOW}, least(floor(n_life * {CUT}::DOUBLE)::BIGINT, n_life - 1))"


def _labelled(train, test, columns):
    """Both parts in one table."""
    names = [*columns, "actual_rul", "clipped_rul"]
    return train.select(F.lit("train").alias("split"), *names).unionByName(test.select(F.lit("test").alias("split"), *names))


def _scaled_sql(source: str, channels: list[str], keys: list[str], several: str) -> str:
    """``channels`` scaled by the train rows of their condition where ``several`` holds. Conditions that only test rows
    have are scaled by all train rows."""
    stat = lambda c: (f"avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) >= 1e-8::DOUBLE THEN stddev_pop({c}) ELSE 1 END AS {c}_d")
    stats = ", ".join(stat(c) for c in channels)
    keyed = ", ".join(keys)
    values = ", ".join(f"CASE WHEN {several} THEN (f.{c} - coalesce(o.{c}_m, g.{c}_m)) / coalesce(o.{c}_d, g.{c}_d) ELSE f.{c} END AS {c}"
                       for c in channels)
    on = " AND ".join(f"o.{k} = f.{k}" for k in keys)
    return f"""own AS (SELECT dataset, {keyed}, {stats} FROM {source} WHERE split = 'train' GROUP BY dataset, {keyed}),
whole AS (SELECT dataset, {stats} FROM {source} WHERE split = 'train' GROUP BY dataset),
scaled AS (SELECT f.* EXCLUDE ({', '.join(channels)}), {values} FROM {source} f JOIN whole g ON g.dataset = f.dataset
  LEFT JOIN own o ON o.dataset = f.dataset AND {on})"""


_LABELS = f"(n_life - time_cycles)::DOUBLE AS actual_rul, least(n_life - time_cycles, {CAP})::DOUBLE AS clipped_rul"


# ---- cycle text ---------------------------------------------------------------------------------
def _text(spark, path):
    """Users as two turbofan fleets in cycle text; test units are numbered from 1 on in the order of their truth lines."""
    name = F.when(F.col("dataset") == "north", "FD001").otherwise("FD002")
    lives = lifetimes(spark, path).withColumn("dataset", name)
    kept = labels.kept_cycles(F.col("n_full"), CUT, WINDOW)
    tests = numbering.number_rows(lives.where("split = 'test'"), ["dataset"], [UNIT], "_id")
    rows = cycles(spark, path).withColumn("dataset", name).where((F.col("split") == "train") | (F.col(CYCLE) <= kept))
    rows = rows.join(tests.select("dataset", UNIT, "_id"), ["dataset", UNIT], "left")
    fields = [F.coalesce("_id", UNIT), F.col(CYCLE), F.col("setting_1"), F.lit(0.84), F.lit(100.0), F.col("s_1"), F.col("s_2"), F.col("s_3")]
    text = F.concat_ws(" ", *[f.cast("string") for f in fields], *[F.lit("0.5")] * 18)
    truth = tests.select("dataset", (F.col("n_full") - kept).cast("string").alias("value"), F.col("_id").alias("at"))
    return rows.select("dataset", "split", text.alias("value")), truth


@query("turbofan_family", "X1 S1 S2 J1 P2", f"""WITH {CYCLES_SQL},
lives AS (SELECT *, n_full AS n_life, CASE dataset WHEN 'north' THEN 'FD001' ELSE 'FD002' END AS name,
  round_even(setting_1, 0) + 0e0 AS key_1 FROM cycles),
frame AS (SELECT name AS dataset, split, time_cycles, n_life, key_1, s_1, s_2, s_3,
  CASE WHEN split = 'train' THEN unit_number ELSE dense_rank() OVER (PARTITION BY name, split ORDER BY unit_number) END AS unit_number
  FROM lives WHERE split = 'train' OR time_cycles <= {_KEPT}),
{_scaled_sql('frame', ['s_1', 's_2', 's_3'], ['key_1'], "f.dataset = 'FD002'")}
SELECT split, dataset, unit_number, time_cycles, {rnd('s_1', 's_2', 's_3')}, {_LABELS} FROM scaled""")
def turbofan_family(spark, path):
    fleet = families.turbofan(*_text(spark, path), ["at"])
    both = families.prepared(fleet, SETTINGS, ["s_1", "s_2", "s_3"])
    return rounded(_labelled(*both, ["dataset", UNIT, CYCLE, "s_1", "s_2", "s_3"]))


# ---- snapshots ----------------------------------------------------------------------------------
TESTED = ("Bearing1", "Bearing2", "Bearing4", "Bearing9")
_FOLDERS = list(BEARING_CONDITIONS)


def _samples(spark, path):
    """Line items as samples: a supplier is a bearing, a ship month a snapshot."""
    folder = F.get(F.array(*map(F.lit, _FOLDERS)), (F.col("l_suppkey") % 3).cast("int"))
    return table(spark, path, "lineitem").select(
        folder.alias("condition"), F.concat(F.lit("Bearing"), F.col("l_suppkey")).alias("unit_name"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("bigint").alias("_stem"),
        F.col("l_quantity").cast("double").alias("h"), F.col("l_extendedprice").cast("double").alias("v"))


_BEARING_SQL = f"""WITH snaps AS (SELECT l_suppkey % 3 AS key_1, 'Bearing' || l_suppkey AS unit_name, (year(l_shipdate) * 12 + month(l_shipdate))::BIGINT AS stem,
  {', '.join(_moments('h', 'l_quantity') + _moments('v', 'l_extendedprice'))} FROM lineitem GROUP BY ALL),
lives AS (SELECT *, 'XJTU-SY' AS dataset, row_number() OVER (PARTITION BY unit_name ORDER BY stem) AS time_cycles,
  count(*) OVER (PARTITION BY unit_name) AS n_life, dense_rank() OVER (ORDER BY unit_name) AS unit_number,
  CASE WHEN unit_name IN {TESTED} THEN 'test' ELSE 'train' END AS split FROM snaps),
frame AS (SELECT * FROM lives WHERE split = 'train' OR time_cycles <= {_KEPT}),
{_scaled_sql('frame', BEARING_CHANNELS, ['key_1'], 'true')}
SELECT split, dataset, unit_name, unit_number, time_cycles, {rnd(*BEARING_CHANNELS, digits=3)}, {_LABELS} FROM scaled"""


@query("bearing_family", "X1 S3 A2 W15 W8", _BEARING_SQL)
def bearing_family(spark, path):
    frame = files.snapshot_frame(_samples(spark, path), "XJTU-SY")
    fleet = families.bearing(frame, TESTED, CUT, WINDOW)
    both = families.prepared(fleet, SETTINGS)
    return rounded(_labelled(*both, ["dataset", "unit_name", UNIT, CYCLE, *BEARING_CHANNELS]), 3)


# ---- seconds ------------------------------------------------------------------------------------
RATE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CYCLES = [f"{c}_{s}" for c in RATE for s in ("mean", "std")]


def _dealt(spark, path):
    """High-rate rows of two members, some of whose units are for testing."""
    unit = F.col(UNIT)
    return seconds(spark, path).withColumns({"dataset": F.when(unit % 2 == 0, "DS01").otherwise("DS02"),
                                             "split": F.when(unit % 5 == 3, "test").otherwise("dev")})


def _flight_sql(unit: str, columns: str) -> str:
    moments = ", ".join(f"avg({c}) AS {c}_mean, coalesce(stddev_samp({c}), 0) AS {c}_std" for c in RATE)
    return f"""WITH flights AS (SELECT CASE l_suppkey % 2 WHEN 0 THEN 'DS01' ELSE 'DS02' END AS member,
  CASE l_suppkey % 5 WHEN 3 THEN 'test' ELSE 'train' END AS split, l_suppkey AS unit, (year(l_shipdate) * 12 + month(l_shipdate))::BIGINT AS source_cycle,
  {moments}, count(*)::DOUBLE AS cycle_len_s FROM lineitem GROUP BY ALL),
lives AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY source_cycle) AS time_cycles, count(*) OVER (PARTITION BY unit) AS n_life FROM flights)
SELECT split, {columns}, {unit} AS unit_number, time_cycles, source_cycle, {rnd(*_CYCLES, 'cycle_len_s')}, {_LABELS}
FROM lives WHERE split = 'train' OR time_cycles <= {_KEPT}"""


@query("flight_family", "X1 S5 A1 W8", _flight_sql("unit", "member AS dataset"))
def flight_family(spark, path):
    fleet = families.flight(files.high_rate_cycles(_dealt(spark, path), RATE, ("split",)), CUT, WINDOW)
    both = families.prepared(fleet, SETTINGS, _CYCLES)
    return rounded(_labelled(*both, ["dataset", UNIT, CYCLE, "source_cycle", *_CYCLES, "cycle_len_s"]))


_STRIDE = """(SELECT CASE WHEN max(l_suppkey) < 1000 THEN 1000 WHEN max(l_suppkey) < 10000 THEN 10000
  WHEN max(l_suppkey) < 100000 THEN 100000 ELSE 1000000 END FROM lineitem)"""


@query("flight_union", "X1 U1 W8", _flight_sql(f"unit + CASE member WHEN 'DS02' THEN {_STRIDE} ELSE 0 END", "'DSALL' AS dataset, member"))
def flight_union(spark, path):
    rows = _dealt(spark, path)
    fleet = families.flight(files.high_rate_cycles(rows, RATE, ("split",)), CUT, WINDOW, "DSALL", labels.union_stride({"all": rows}))
    both = families.prepared(fleet, SETTINGS, _CYCLES)
    return rounded(_labelled(*both, ["dataset", "member", UNIT, CYCLE, "source_cycle", *_CYCLES, "cycle_len_s"]))
