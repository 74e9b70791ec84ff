"""Sources, labels, conditions, fleets, per-cycle summaries and perturbations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlife.config import BEARING_INDICATORS, CYCLE, KEYS, SETTINGS, UNIT
from fleetlife.operators import conditions, labels, numbering, perturb, summaries, windows
from fleetlife.sources import files

from .base import (
    CAP, CHANNELS, CYCLES_SQL, FLEET_SQL, UNITS_SQL, WINDOW, cycles, fleet, lifetimes, query, rnd, rounded, s_hash, table,
    units,
)


# ---- sources ------------------------------------------------------------------------------------
def _lines(spark, path):
    """The fleet written as cycle text: 26 fields, trailing blanks."""
    rows = cycles(spark, path)
    sensors = [F.col("s_1"), F.col("s_2"), F.col("s_3")] + [F.lit(0.0)] * 18
    fields = [F.col(UNIT), F.col(CYCLE), F.col("setting_1"), F.lit(0.84), F.lit(100.0), *sensors]
    return rows.select(F.concat(F.concat_ws(" ", *[f.cast("string") for f in fields]), F.lit("  ")).alias("value"))


@query("cycle_text", "S1", f"""WITH {CYCLES_SQL} SELECT 'FD001' AS dataset, unit_number, time_cycles,
  {rnd('setting_1', '0.84e0 AS setting_2', '100e0 AS setting_3', 's_1', 's_2', 's_3')} FROM cycles""")
def cycle_text(spark, path):
    frame = files.parse_cycle_lines(_lines(spark, path), "FD001")
    return rounded(frame.select("dataset", UNIT, CYCLE, *SETTINGS, *CHANNELS))


@query("truth_lines", "S2", """SELECT 'T' AS dataset, row_number() OVER (ORDER BY o_orderkey) AS unit_number,
  o_custkey AS rul_truth FROM orders""")
def truth_lines(spark, path):
    lines = table(spark, path, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("value"))
    return files.parse_truth_lines(lines, "T", ["o_orderkey"])


def seconds(spark, path):
    """Line items as high-rate rows: a supplier is a unit, a ship month is a cycle. Rows of a cycle
    are ordered by ship day and order; the order key stands for the class."""
    day = F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint")
    return table(spark, path, "lineitem").select(
        F.lit("DS01").alias("dataset"), F.col("l_suppkey").alias(UNIT),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("bigint").alias(CYCLE),
        (day * 1000000000000 + F.col("l_orderkey")).alias("t"), F.col("l_orderkey").alias("Fc"), F.lit(1).alias("hs"), *RATE)


RATE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_SECONDS = """sec AS (SELECT 'DS01' AS dataset, l_suppkey AS unit_number, (year(l_shipdate) * 12 + month(l_shipdate))::BIGINT AS time_cycles,
  date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::BIGINT * 1000000000000 + l_orderkey AS t, * FROM lineitem)"""


@query("high_rate_cycles", "A1 S5", f"""WITH {_SECONDS} SELECT dataset, unit_number, time_cycles,
  {rnd('arg_min(l_orderkey, t)::DOUBLE AS setting_1')},
  {', '.join(rnd(f'avg({c}) AS {c}_mean', f'coalesce(stddev_samp({c}), 0) AS {c}_std') for c in RATE)},
  count(*)::DOUBLE AS cycle_len_s FROM sec GROUP BY dataset, unit_number, time_cycles""")
def high_rate_cycles(spark, path):
    out = files.high_rate_cycles(seconds(spark, path), RATE)
    return rounded(out.drop("setting_2", "setting_3"))


@query("required_channels", "S6 P1", f"SELECT l_orderkey, {rnd(*RATE)} FROM lineitem")
def required_channels(spark, path):
    rows = table(spark, path, "lineitem").select("l_orderkey", *reversed(RATE))
    return rounded(files.require_channels(rows, RATE, ["l_orderkey"]))


def _moments(p: str, c: str) -> list[str]:
    return [f"sqrt(avg({c} * {c})) AS {p}_rms",
            f"CASE WHEN max({c}) > min({c}) THEN kurtosis_pop({c}) ELSE -3 END AS {p}_kurtosis",
            f"CASE WHEN max({c}) > min({c}) THEN (avg({c} ** 3) - 3 * avg({c}) * avg({c} ** 2) + 2 * avg({c}) ** 3) / stddev_pop({c}) ** 3 ELSE 0 END AS {p}_skewness",
            f"max(abs({c})) AS {p}_peak", f"max({c}) - min({c}) AS {p}_p2p",
            f"max(abs({c})) / sqrt(avg({c} * {c})) AS {p}_crest", f"max(abs({c})) / avg(abs({c})) AS {p}_impulse",
            f"sqrt(avg({c} * {c})) / avg(abs({c})) AS {p}_shape"]


@query("snapshot_indicators", "A2 S3", f"""SELECT l_partkey, {rnd(*_moments('h', 'l_quantity'), digits=4)},
  {rnd(*_moments('v', 'l_extendedprice'), digits=4)} FROM lineitem GROUP BY l_partkey""")
def snapshot_indicators(spark, path):
    return rounded(summaries.snapshot_indicators(
        table(spark, path, "lineitem"), {"h": "l_quantity", "v": "l_extendedprice"}, ("l_partkey",)), 4)


@query("unknown_conditions", "S4", """SELECT DISTINCT p_brand AS condition FROM part WHERE p_brand LIKE 'Brand%'
  AND p_brand NOT IN ('Brand#11', 'Brand#12')""")
def unknown_conditions(spark, path):
    brands = table(spark, path, "part").select(F.col("p_brand").alias("condition"))
    return files.unknown_conditions(brands, ("Brand#11", "Brand#12"), "^Brand")


@query("long_and_wide", "S14", f"""WITH {FLEET_SQL} SELECT dataset, unit_number, time_cycles, {rnd(*CHANNELS)} FROM fleet""")
def long_and_wide(spark, path):
    ids = [*KEYS, CYCLE]
    long = summaries.to_long(fleet(spark, path).select(*ids, *CHANNELS), CHANNELS, ids)
    return rounded(summaries.to_wide(long, CHANNELS, ids))


@query("channel_means_long", "S14 P1", f"""WITH {FLEET_SQL}, l AS (UNPIVOT (SELECT dataset, s_1, s_2, s_3 FROM fleet) ON s_1, s_2, s_3 INTO NAME channel VALUE x)
SELECT dataset, channel, count(*) AS n, {rnd('avg(x) AS mean')} FROM l GROUP BY dataset, channel""")
def channel_means_long(spark, path):
    long = summaries.to_long(fleet(spark, path).select("dataset", *CHANNELS), CHANNELS, ["dataset"])
    return rounded(long.groupBy("dataset", "channel").agg(F.count("*").alias("n"), F.avg("x").alias("mean")))


# ---- labels -------------------------------------------------------------------------------------
@query("train_labels", "W1", f"""WITH {CYCLES_SQL} SELECT dataset, unit_number, time_cycles, n_full AS n_obs,
  (n_full - time_cycles)::DOUBLE AS actual_rul, least(n_full - time_cycles, {CAP})::DOUBLE AS clipped_rul FROM cycles""")
def train_labels(spark, path):
    frame = cycles(spark, path).select(*KEYS, CYCLE)
    return labels.label_train(frame, CAP).select(*KEYS, CYCLE, "n_obs", "actual_rul", "clipped_rul")


@query("truncate_units", "W8", f"""WITH {CYCLES_SQL}, kept AS (SELECT *, greatest({WINDOW}, least(floor(n_full * 0.6::DOUBLE)::BIGINT, n_full - 1)) AS n_obs FROM cycles)
SELECT dataset, unit_number, time_cycles, n_obs, {rnd('s_1')} FROM kept WHERE time_cycles <= n_obs""")
def truncate_units(spark, path):
    rows, _ = labels.truncate_units(cycles(spark, path).select(*KEYS, CYCLE, "s_1"), 0.6, WINDOW)
    return rounded(rows.select(*KEYS, CYCLE, "n_obs", "s_1"))


@query("truncation_truth", "W8", f"""WITH {CYCLES_SQL} SELECT DISTINCT dataset, unit_number,
  n_full - greatest({WINDOW}, least(floor(n_full * 0.6::DOUBLE)::BIGINT, n_full - 1)) AS rul_truth FROM cycles""")
def truncation_truth(spark, path):
    return labels.truncate_units(cycles(spark, path).select(*KEYS, CYCLE), 0.6, WINDOW)[1]


@query("test_labels", "W2 J2", f"""WITH {FLEET_SQL} SELECT dataset, unit_number, time_cycles, actual_rul, clipped_rul
FROM fleet WHERE split = 'test'""")
def test_labels(spark, path):
    test = cycles(spark, path).where("split = 'test'").select(*KEYS, CYCLE)
    rows, _ = labels.truncate_units(test, 0.6, WINDOW)
    return labels.label_test(rows, None, CAP).select(*KEYS, CYCLE, "actual_rul", "clipped_rul")


@query("renumber_units", "W15", """WITH named AS (SELECT s_nationkey, s_name FROM supplier),
ids AS (SELECT DISTINCT s_nationkey, s_name, dense_rank() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS unit_number FROM named)
SELECT s_nationkey, s_name, unit_number FROM ids""")
def renumber_units(spark, path):
    frame = table(spark, path, "supplier").select("s_nationkey", "s_name")
    return labels.renumber_units(frame, "s_name", ["s_nationkey"]).select("s_nationkey", "s_name", UNIT)


@query("union_fleets", "U1 W15", f"""WITH {FLEET_SQL} SELECT 'ALL' AS dataset, dataset AS member, split,
  unit_number + CASE dataset WHEN 'south' THEN (SELECT CASE WHEN max(unit_number) < 1000 THEN 1000 WHEN max(unit_number) < 10000
    THEN 10000 WHEN max(unit_number) < 100000 THEN 100000 ELSE 1000000 END FROM fleet) ELSE 0 END AS unit_number,
  count(*) AS n_rows, max((SELECT count(DISTINCT (dataset, unit_number)) FROM fleet)) AS n_ids FROM fleet GROUP BY ALL""")
def union_fleets(spark, path):
    rows = labels.require_members(fleet(spark, path), ["north", "south"])
    both = labels.union_fleets({m: rows.where(F.col("dataset") == m) for m in ("south", "north")}, "ALL")
    ids = both.agg(F.countDistinct("dataset", UNIT).alias("n_ids"))  # one row
    counted = both.groupBy("dataset", "member", "split", UNIT).agg(F.count("*").alias("n_rows"))
    return counted.join(F.broadcast(ids.withColumn("dataset", F.lit("ALL"))), "dataset")


@query("shared_units", "J10", f"""WITH {FLEET_SQL} SELECT DISTINCT a.dataset, a.unit_number FROM fleet a JOIN fleet b
  ON a.dataset = b.dataset AND a.unit_number = b.unit_number WHERE a.event_type = 'click' AND b.event_type = 'view'""")
def shared_units(spark, path):
    rows = fleet(spark, path)
    return windows.shared_units(rows.where("event_type = 'click'"), rows.where("event_type = 'view'"))


@query("given_truth_labels", "W2 J2", f"""WITH {FLEET_SQL} SELECT dataset, unit_number, time_cycles, actual_rul, clipped_rul
FROM fleet WHERE split = 'test'""")
def given_truth_labels(spark, path):
    rows, truth = labels.truncate_units(cycles(spark, path).where("split = 'test'").select(*KEYS, CYCLE), 0.6, WINDOW)
    return labels.label_test(rows.drop("n_obs", "rul_truth"), truth, CAP).select(*KEYS, CYCLE, "actual_rul", "clipped_rul")


@query("split_overlap", "J10", f"""WITH {FLEET_SQL}, u AS (SELECT DISTINCT dataset, split, unit_number FROM fleet)
SELECT a.split, count(*) AS n_units, 0::BIGINT AS n_shared FROM u a GROUP BY a.split""")
def split_overlap(spark, path):
    rows = fleet(spark, path)
    both = windows.shared_units(rows.where("split = 'train'"), rows.where("split = 'test'")).withColumn("_s", F.lit(1))
    seen = rows.select("split", *KEYS).distinct().join(both, KEYS, "left")
    return seen.groupBy("split").agg(F.count("*").alias("n_units"), F.count("_s").alias("n_shared"))


# ---- conditions ---------------------------------------------------------------------------------
_KEYED = """keyed AS (SELECT *, round_even(setting_1, 0) + 0e0 AS key_1, round_even(setting_2 * 100e0, 0) / 100e0 + 0e0 AS key_2,
  round_even(setting_3, 0) + 0e0 AS key_3 FROM fleet)"""


@query("dense_cycles", "W15", f"""WITH {CYCLES_SQL}, kept AS (SELECT * FROM cycles WHERE event_type <> 'view')
SELECT dataset, unit_number, time_cycles AS source_cycle, row_number() OVER (PARTITION BY dataset, unit_number ORDER BY time_cycles) AS time_cycles
FROM kept""")
def dense_cycles(spark, path):
    gaps = cycles(spark, path).where("event_type <> 'view'").select(*KEYS, CYCLE)
    return numbering.dense_cycles(gaps).select(*KEYS, "source_cycle", CYCLE)


@query("condition_keys", "P2", f"""WITH {FLEET_SQL}, {_KEYED} SELECT dataset, unit_number, time_cycles, {rnd('key_1', 'key_2', 'key_3')} FROM keyed""")
def condition_keys(spark, path):
    return rounded(conditions.condition_keys(fleet(spark, path)).select(*KEYS, CYCLE, "key_1", "key_2", "key_3"))


@query("half_even_prices", "P2", """SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_extendedprice * 10e0, 0) / 10e0 + 0e0 AS p1,
  round_even(l_quantity / 2e0, 0) + 0e0 AS half FROM lineitem""")
def half_even_prices(spark, path):
    return table(spark, path, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", conditions.snap(F.col("l_extendedprice"), 1).alias("p1"),
        conditions.snap(F.col("l_quantity") / 2.0, 0).alias("half"))


def _stats_sql(c):
    return (f"avg({c}) AS {c}_mean", f"CASE WHEN stddev_pop({c}) >= 1e-8::DOUBLE THEN stddev_pop({c}) ELSE 1 END AS {c}_std")


_SCALER = f"""scaler AS (SELECT dataset, key_1, key_2, key_3, count(*) AS n_rows, grouping(key_1) = 1 AS is_global,
  {', '.join(x for c in CHANNELS for x in _stats_sql(c))} FROM keyed WHERE split = 'train'
  GROUP BY GROUPING SETS ((dataset, key_1, key_2, key_3), (dataset)))"""


@query("condition_scaler", "A3", f"""WITH {FLEET_SQL}, {_KEYED}, {_SCALER} SELECT dataset, key_1, key_2, key_3, n_rows, is_global,
  {rnd(*[f'{c}_{s}' for c in CHANNELS for s in ('mean', 'std')])} FROM scaler""")
def condition_scaler(spark, path):
    train = conditions.condition_keys(fleet(spark, path, "train"))
    return rounded(conditions.fit_condition_scaler(train, CHANNELS))


@query("condition_normalized", "J1 A3", f"""WITH {FLEET_SQL}, {_KEYED}, {_SCALER.replace("split = 'train'", "split = 'train' AND event_type <> 'view'")}
SELECT k.dataset, k.unit_number, k.time_cycles, {', '.join(rnd(f'(k.{c} - coalesce(s.{c}_mean, g.{c}_mean)) / coalesce(s.{c}_std, g.{c}_std) AS {c}') for c in CHANNELS)}
FROM keyed k JOIN scaler g ON g.dataset = k.dataset AND g.is_global LEFT JOIN scaler s ON s.dataset = k.dataset
  AND s.key_1 = k.key_1 AND s.key_2 = k.key_2 AND s.key_3 = k.key_3 AND NOT s.is_global WHERE k.split = 'test'""")
def condition_normalized(spark, path):
    rows = conditions.condition_keys(fleet(spark, path))
    scaler = conditions.fit_condition_scaler(rows.where("split = 'train' AND event_type <> 'view'"), CHANNELS)
    out = conditions.apply_condition_scaler(rows.where("split = 'test'"), scaler, CHANNELS)
    return rounded(out.select(*KEYS, CYCLE, *CHANNELS))


@query("condition_ids", "A22", f"""WITH {FLEET_SQL}, {_KEYED} SELECT dataset, unit_number, time_cycles,
  dense_rank() OVER (PARTITION BY dataset ORDER BY key_1, key_2, key_3) - 1 AS condition_id FROM keyed""")
def condition_ids(spark, path):
    keyed = conditions.condition_keys(fleet(spark, path))
    return conditions.condition_ids(keyed).select(*KEYS, CYCLE, "condition_id")


# ---- perturbation -------------------------------------------------------------------------------
def _sd_sql(where="true"):
    return f"sd AS (SELECT dataset, {', '.join(f'stddev_pop({c}) AS sd_{c}' for c in CHANNELS)} FROM fleet WHERE {where} GROUP BY dataset)"


def _u_sql(c, seed, *tag):
    return s_hash("f.dataset", "f.unit_number", "f.time_cycles", f"'{c}'", str(seed), *tag)


def _gauss_sql(c, seed, scale):
    r, a = _u_sql(c, seed, "'r'"), _u_sql(c, seed, "'a'")
    return (f"f.{c} + sqrt(-2e0 * ln(({r} + 1)::DOUBLE / 4294967296e0)) * cos(6.283185307179586e0 * ({a}::DOUBLE / 4294967296e0)) "
            f"* sd_{c} / {scale!r}::DOUBLE AS {c}")


@query("gaussian_noise", "F13", f"""WITH {FLEET_SQL}, {_sd_sql()} SELECT f.dataset, f.unit_number, f.time_cycles,
  {rnd(*[_gauss_sql(c, 11, 10.0) for c in CHANNELS])} FROM fleet f JOIN sd ON f.dataset = sd.dataset""")
def gaussian_noise(spark, path):
    return rounded(perturb.add_gaussian(fleet(spark, path), CHANNELS, 11, 20.0).select(*KEYS, CYCLE, *CHANNELS))


_RAMP = "CASE WHEN n_obs > 1 THEN (f.time_cycles - 1)::DOUBLE / (n_obs - 1) ELSE 0 END"


@query("sensor_drift", "W12", f"""WITH {FLEET_SQL}, {_sd_sql()} SELECT f.dataset, f.unit_number, f.time_cycles,
  {rnd(*[f'f.{c} + {_RAMP} * 2e0 * sd_{c} AS {c}' for c in CHANNELS])} FROM fleet f JOIN sd ON f.dataset = sd.dataset""")
def sensor_drift(spark, path):
    return rounded(perturb.add_drift(fleet(spark, path), CHANNELS, 2.0).select(*KEYS, CYCLE, *CHANNELS))


@query("sensor_dropout", "F14", f"""WITH {FLEET_SQL} SELECT f.dataset, f.unit_number, f.time_cycles,
  {rnd(*[f'CASE WHEN {_u_sql(c, 5)}::DOUBLE / 4294967296e0 < 0.1 THEN 0 ELSE f.{c} END AS {c}' for c in CHANNELS])} FROM fleet f""")
def sensor_dropout(spark, path):
    return rounded(perturb.add_dropout(fleet(spark, path), CHANNELS, 5, 0.1).select(*KEYS, CYCLE, *CHANNELS))


@query("split_noise", "F15", f"""WITH {FLEET_SQL} SELECT f.dataset, f.split, f.unit_number, f.time_cycles,
  {rnd(*[f"CASE WHEN (CASE split WHEN 'train' THEN {_u_sql(c, 3)} ELSE {_u_sql(c, 4)} END)::DOUBLE / 4294967296e0 < 0.25 THEN 0 ELSE f.{c} END AS {c}" for c in CHANNELS])} FROM fleet f""")
def split_noise(spark, path):
    train, test = perturb.inject_split(fleet(spark, path, "train"), fleet(spark, path, "test"), CHANNELS,
                                       {"kind": "dropout", "rate": 0.25, "seed": 3}, 42, "turbofan")
    return rounded(train.unionByName(test).select("dataset", "split", UNIT, CYCLE, *CHANNELS))
