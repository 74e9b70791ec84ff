"""Whole experiments: preparation, ablation, window sizes, transfer, probes, fleets, stored results."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlife.config import CYCLE, KEYS, UNIT, content_hash
from fleetlife.operators import compare, labels, metrics, perturb, sampling, windows
from fleetlife.plans import prepare, scoring, sweep, transfer
from fleetlife.session import work_dir
from fleetlife.sources import append_results, materialize, read_results, source_key
from fleetlife.sources.files import parse_curves

from .base import (
    CAP, CELL, CHANNELS, COUNTS, CYCLES_SQL, EDGES, FEATURES_SQL, FLEET_SQL, LINES, MEMBERS_SQL, METRIC_NAMES, PCELL, PKEYS,
    PREDS_SQL, RESULTS_SQL, SEEDS, VAL, WINDOW, cells, cycles, features, fleet, predictions, query, results, rnd, rounded,
    s_metrics, units,
)
from .comparison import LABEL
from .preparation import _KEYED, _RAMP, _SCALER, _sd_sql


@query("prepared_frames", "X1", f"""WITH {FLEET_SQL}, {_KEYED}, {_SCALER},
normed AS (SELECT k.dataset, k.split, k.unit_number, k.time_cycles, k.n_obs, k.actual_rul, k.clipped_rul,
  {', '.join(f'(k.{c} - coalesce(s.{c}_mean, g.{c}_mean)) / coalesce(s.{c}_std, g.{c}_std) AS {c}' for c in CHANNELS)}
  FROM keyed k JOIN scaler g ON g.dataset = k.dataset AND g.is_global LEFT JOIN scaler s ON s.dataset = k.dataset
  AND s.key_1 = k.key_1 AND s.key_2 = k.key_2 AND s.key_3 = k.key_3 AND NOT s.is_global),
sd AS (SELECT dataset, split, {', '.join(f'stddev_pop({c}) AS sd_{c}' for c in CHANNELS)} FROM normed GROUP BY dataset, split)
SELECT f.dataset, f.split, f.unit_number, f.time_cycles, actual_rul, clipped_rul, {rnd(*[f'f.{c} + {_RAMP} * 1.5e0 * sd_{c} AS {c}' for c in CHANNELS])}
FROM normed f JOIN sd ON f.dataset = sd.dataset AND f.split = sd.split""")
def prepared_frames(spark, path):
    rows = cycles(spark, path).drop("n_full", "event_type")
    cut, _ = labels.truncate_units(rows.where("split = 'test'"), 0.6, WINDOW)
    train, test = prepare.prepare(rows.where("split = 'train'"), cut, None, CHANNELS, CAP,
                                  by_condition=prepare.several_conditions("FD002"), noise={"kind": "drift", "magnitude": 1.5})
    return rounded(train.unionByName(test).select("dataset", "split", UNIT, CYCLE, "actual_rul", "clipped_rul", *CHANNELS))


# ---- ablation and window sizes -----------------------------------------------------------------
FACTS = ("split", CYCLE, "n_obs", "label", "true_rul")
LENGTHS = [12, 24, 36]


def _named(frame):
    return frame.withColumnsRenamed({"clipped_rul": "label", "actual_rul": "true_rul"})


def _context_sweep(spark, path, features):
    """Full-data sweep of lines on the statistics of s_1 at every context length, from one pass."""
    rows = windows.loc_scales(_named(fleet(spark, path)), ["s_1"], LENGTHS, WINDOW, FACTS)
    lines = tuple((f"{n}:{name}", "mse", f"s_1_{stat}_{n}") for n in LENGTHS for name, stat in features.items())
    test = rows.where("split = 'test' AND end_cycle = n_obs")
    out = sweep.line_sweep(rows.where("split = 'train'"), test, sweep.whole_fleet(cells(spark, path)), lines, CAP)
    parts = F.split("model", ":")
    return out.withColumns({"context_length": parts[0].cast("int"), "head_features": parts[1], "pooling": F.lit("mean")})


def _ablation(spark, path):
    return _context_sweep(spark, path, {"emb": "loc", "emb+locscale": "scale"})


def _ctx_sql(n):
    o = f"OVER (PARTITION BY unit_number ORDER BY time_cycles ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"SELECT {n} AS context_length, *, avg(s_1) {o} AS loc, stddev_pop(s_1) {o} AS scale FROM fleet"


ABLATION_SQL = FLEET_SQL + ", " + MEMBERS_SQL + f""",
ctx AS ({' UNION ALL '.join(_ctx_sql(n) for n in (12, 24, 36))}),
rowsx AS (SELECT * FROM ctx WHERE time_cycles >= {WINDOW}),
tr AS (SELECT r.*, m.n_units, m.seed FROM rowsx r JOIN members m ON r.unit_number = m.unit_number AND m.role = 'train'
  JOIN avail a ON a.dataset = m.dataset AND a.available = m.n_units),
fit AS (SELECT context_length, dataset, n_units, seed, 'emb' AS head_features, regr_slope(clipped_rul, loc) AS sl, regr_intercept(clipped_rul, loc) AS ic FROM tr GROUP BY ALL
  UNION ALL SELECT context_length, dataset, n_units, seed, 'emb+locscale', regr_slope(clipped_rul, scale), regr_intercept(clipped_rul, scale) FROM tr GROUP BY ALL),
preds AS (SELECT f.*, r.actual_rul AS true_rul, greatest(0, least({CAP}, ic + sl * CASE head_features WHEN 'emb' THEN loc ELSE scale END)) AS pred
  FROM fit f JOIN rowsx r ON r.dataset = f.dataset AND r.context_length = f.context_length AND r.split = 'test' AND r.time_cycles = r.n_obs),
abl AS (SELECT context_length, dataset, n_units, seed, head_features, {s_metrics()} FROM preds GROUP BY context_length, dataset, n_units, seed, head_features)"""


@query("context_ablation", "X3 A13", f"""WITH {ABLATION_SQL} SELECT context_length, head_features, 'mean' AS pooling, count(*) AS n_seeds,
  {rnd('avg(rmse_clipped) AS mean', 'stddev_pop(rmse_clipped) AS std')} FROM abl GROUP BY ALL""")
def context_ablation(spark, path):
    return rounded(compare.ablation_table(_ablation(spark, path)))


@query("ablation_winner", "X3 A13", f"""WITH {ABLATION_SQL}, t AS (SELECT context_length, head_features, 'mean' AS pooling, count(*) AS n_seeds,
  avg(rmse_clipped) AS mean, stddev_pop(rmse_clipped) AS std FROM abl GROUP BY ALL)
SELECT context_length, head_features, pooling, n_seeds, {rnd('mean', 'std')} FROM t ORDER BY t.mean, context_length, head_features LIMIT 1""")
def ablation_winner(spark, path):
    return rounded(compare.best_cell(_ablation(spark, path)))


@query("window_sizes", "X6", f"""WITH {ABLATION_SQL} SELECT context_length AS baseline_window, dataset, n_units, seed, n, {rnd(*METRIC_NAMES)} FROM abl
WHERE head_features = 'emb'""")
def window_sizes(spark, path):
    out = _context_sweep(spark, path, {"linear_stats": "loc"}).withColumnRenamed("context_length", "baseline_window")
    return rounded(out.select("baseline_window", "dataset", "n_units", "seed", "n", *METRIC_NAMES))


# ---- restart ------------------------------------------------------------------------------------
@query("resumed_sweep", "X2 J4", f"WITH {RESULTS_SQL} SELECT {PKEYS}, {rnd(*METRIC_NAMES)}, n FROM results WHERE n_units >= 10")
def resumed_sweep(spark, path):
    feats = features(spark, path).withColumn("true_rul", F.col("actual_rul"))
    done = sampling.cell_grid(units(spark, path), COUNTS, SEEDS).where("n_units < 10")
    test = feats.where("split = 'test'").where(F.col(CYCLE) == F.col("n_obs"))
    return rounded(sweep.line_sweep(feats.where("split = 'train'"), test, cells(spark, path), LINES, CAP, done))


@query("pending_horizon_cells", "X7 U4 U5", f"WITH {RESULTS_SQL} SELECT DISTINCT {PKEYS} FROM results WHERE model IN ('level_mlp', 'cycle_reg')")
def pending_horizon_cells(spark, path):
    preds = predictions(spark, path).where("model NOT IN ('level_mlp', 'cycle_reg')")
    bins = scoring.horizon_rows(preds, CAP, EDGES)
    grid = results(spark, path).select(*PCELL)
    return scoring.pending_horizon(grid, bins, preds)


# ---- transfer -----------------------------------------------------------------------------------
SHOTS = [2, 5, 10, 25]
TLINES = (("cycle_reg", "native", CYCLE), ("level_mlp", "mse", "s_2"))


def _transfer(spark, path):
    feats = features(spark, path).withColumn("true_rul", F.col("actual_rul"))
    train = feats.where("split = 'train'")
    test = feats.where("split = 'test' AND dataset = 'south'").where(F.col(CYCLE) == F.col("n_obs"))
    plan = cells(spark, path)
    return transfer.line_transfer(
        train.where("dataset = 'north'"), train.where("dataset = 'south'"), test, plan.where("dataset = 'north'"),
        plan.where("dataset = 'south'"), SHOTS, TLINES, CAP)


TRANSFER_SQL = FEATURES_SQL + ", " + MEMBERS_SQL + f""",
src AS (SELECT f.*, m.seed FROM feats f JOIN members m ON f.unit_number = m.unit_number AND m.role = 'train' JOIN avail a
  ON a.dataset = m.dataset AND a.available = m.n_units WHERE f.dataset = 'north'),
tgt AS (SELECT f.*, m.seed, m.n_units AS k FROM feats f JOIN members m ON f.unit_number = m.unit_number AND m.role = 'train'
  WHERE f.dataset = 'south' AND m.n_units IN ({', '.join(map(str, SHOTS))})),
ks AS (SELECT DISTINCT seed, k FROM tgt),
arms AS (SELECT 'zero_shot' AS mode, 0 AS k, seed, label, time_cycles, s_2 FROM src
  UNION ALL SELECT 'target_only', k, seed, label, time_cycles, s_2 FROM tgt
  UNION ALL SELECT 'source+target', k, seed, label, time_cycles, s_2 FROM tgt
  UNION ALL SELECT 'source+target', k, seed, label, time_cycles, s_2 FROM src JOIN ks USING (seed)),
fit AS (SELECT mode, k, seed, 'cycle_reg' AS model, 'native' AS loss, regr_slope(label, time_cycles::DOUBLE) AS sl, regr_intercept(label, time_cycles::DOUBLE) AS ic FROM arms GROUP BY ALL
  UNION ALL SELECT mode, k, seed, 'level_mlp', 'mse', regr_slope(label, s_2), regr_intercept(label, s_2) FROM arms GROUP BY ALL),
preds AS (SELECT fit.*, actual_rul AS true_rul, greatest(0, least({CAP}, ic + sl * CASE model WHEN 'cycle_reg' THEN time_cycles ELSE s_2 END)) AS pred
  FROM fit, feats f WHERE f.dataset = 'south' AND f.split = 'test' AND f.time_cycles = f.n_obs),
tres AS (SELECT model, mode, 'north' AS source_dataset, 'south' AS target_dataset, k::BIGINT AS n_target_units, seed, loss, {s_metrics()}
  FROM preds GROUP BY model, mode, k, seed, loss)"""


@query("transfer_arms", "X9 U2", f"""WITH {TRANSFER_SQL} SELECT model, mode, source_dataset, target_dataset, n_target_units, seed, loss, n,
  {rnd(*METRIC_NAMES)} FROM tres""")
def transfer_arms(spark, path):
    return rounded(_transfer(spark, path))


@query("transfer_summary", "A24", f"""WITH {TRANSFER_SQL} SELECT source_dataset, target_dataset, {LABEL} AS label, mode,
  CASE WHEN mode <> 'zero_shot' THEN n_target_units ELSE -1 END AS n_target_units, {rnd('avg(rmse_clipped) AS mean', 'stddev_pop(rmse_clipped) AS std')}
FROM tres GROUP BY ALL""")
def transfer_summary(spark, path):
    shots = F.coalesce("n_target_units", F.lit(-1).cast("bigint"))
    return rounded(compare.transfer_summary(_transfer(spark, path)).withColumn("n_target_units", shots))


# ---- probes -------------------------------------------------------------------------------------
@query("noise_probe", "X12", f"""WITH {FLEET_SQL}, {MEMBERS_SQL}, sd AS (SELECT dataset, split, stddev_pop(s_1) AS sd_s_1 FROM fleet GROUP BY ALL),
lv AS (SELECT 'clean' AS level, f.*, f.s_1 AS x FROM fleet f UNION ALL
  SELECT 'drift', f.*, f.s_1 + {_RAMP} * 2e0 * sd_s_1 FROM fleet f JOIN sd ON f.dataset = sd.dataset AND f.split = sd.split),
fr AS (SELECT *, avg(x) OVER (PARTITION BY level, unit_number ORDER BY time_cycles ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS m FROM lv),
w AS (SELECT * FROM fr WHERE time_cycles >= {WINDOW}),
fit AS (SELECT level, w.dataset, n_units, seed, regr_slope(clipped_rul, m) AS sl, regr_intercept(clipped_rul, m) AS ic
  FROM w JOIN members USING (unit_number) WHERE role = 'train' GROUP BY ALL),
preds AS (SELECT f.level, f.dataset, n_units, seed, actual_rul AS true_rul, greatest(0, least({CAP}, ic + sl * m)) AS pred
  FROM fit f JOIN w ON w.dataset = f.dataset AND w.level = f.level AND w.split = 'test' AND w.time_cycles = w.n_obs)
SELECT level, dataset, n_units, seed, n, {rnd(*METRIC_NAMES)} FROM (SELECT level, dataset, n_units, seed, {s_metrics()} FROM preds GROUP BY level, dataset, n_units, seed)""")
def noise_probe(spark, path):
    def run(spec):
        train, test = fleet(spark, path, "train"), fleet(spark, path, "test")
        if spec:
            train, test = perturb.inject_split(train, test, ["s_1"], spec, 42, "turbofan")
        rows = [windows.loc_scale(_named(f), ["s_1"], WINDOW, WINDOW, FACTS) for f in (train, test)]
        return sweep.line_sweep(rows[0], rows[1].where("end_cycle = n_obs"), cells(spark, path),
                                (("linear_stats", "native", "s_1_loc"),), CAP)

    out = sweep.over_levels({"clean": None, "drift": {"kind": "drift", "magnitude": 2.0}}, run)
    return rounded(out.select("level", "dataset", "n_units", "seed", "n", *METRIC_NAMES))


# ---- all fleets with their own settings ---------------------------------------------------------
@query("fleet_settings", "X11", f"""WITH {FLEET_SQL}, st AS (SELECT * FROM (VALUES ('north', 20, NULL), ('south', NULL, 16)) AS s(dataset, max_rul, window_size)),
v AS (SELECT f.*, coalesce(st.max_rul, {CAP}) AS cap, coalesce(st.window_size, {WINDOW}) AS w FROM fleet f LEFT JOIN st ON st.dataset = f.dataset)
SELECT dataset, split, count(*) AS n_windows, cap AS max_rul, w AS window_size, {rnd('avg(least(actual_rul, cap)) AS mean_label')}
FROM v WHERE time_cycles >= w GROUP BY dataset, split, cap, w""")
def fleet_settings(spark, path):
    settings = spark.createDataFrame([("north", 20, None), ("south", None, 16)], "dataset string, max_rul int, window_size int")
    rows = prepare.label_fleets(fleet(spark, path), settings, {"max_rul": CAP, "window_size": WINDOW})
    return rounded(rows.where(F.col(CYCLE) >= F.col("window_size")).groupBy("dataset", "split", "max_rul", "window_size").agg(
        F.count("*").alias("n_windows"), F.avg("clipped_rul").alias("mean_label")))


# ---- stored tables ------------------------------------------------------------------------------
@query("materialized_windows", "S8", f"""WITH {FEATURES_SQL} SELECT dataset, split, unit_number, time_cycles, {rnd('label', 'm_1')} FROM feats""")
def materialized_windows(spark, path):
    rows = rounded(features(spark, path).select("dataset", "split", UNIT, CYCLE, "label", "m_1"))
    key = "windows_" + content_hash({"source": source_key(spark, f"{path}/events.parquet"), "window": WINDOW, "cap": CAP})
    return materialize(rows, work_dir(spark), key, partition_by=("split",))


@query("appended_results", "S10 S11 U3", f"WITH {RESULTS_SQL} SELECT {PKEYS}, {rnd(*METRIC_NAMES)}, n FROM results")
def appended_results(spark, path):
    import uuid

    target = f"{work_dir(spark)}/results_{uuid.uuid4().hex}"
    rows = rounded(results(spark, path))
    append_results(rows.where("loss = 'native'"), target)
    append_results(rows.where("loss <> 'native'"), target)
    return read_results(spark, target, rows.schema)


@query("learning_curves", "S12", f"""WITH {PREDS_SQL} SELECT n_units, seed, loss, 'pred' AS metric, time_cycles::DOUBLE AS x, count(*) AS n,
  {rnd('avg(pred) AS value')} FROM preds WHERE loss <> 'native' GROUP BY ALL""")
def learning_curves(spark, path):
    rows = predictions(spark, path)
    name = F.concat(F.lit("level_n"), "n_units", F.lit("_seed"), "seed", F.lit("_"), F.when(F.col("loss") == "native", "-").otherwise(F.col("loss")))
    odd = F.col("unit_number") > 50
    points = rows.select(name.alias("name"), F.when(odd, F.col(CYCLE).cast("double")).alias("step"),
                         F.col(CYCLE).cast("double").alias("epoch"), F.lit("pred").alias("metric"), F.col("pred").alias("value"))
    curves = parse_curves(points, F.col("name"))
    return rounded(curves.groupBy("n_units", "seed", "loss", "metric", "x").agg(
        F.count("*").alias("n"), F.avg("value").alias("value")))
