"""Sampling of units, data-volume cells, closed-form models and their sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlife.config import CYCLE, UNIT
from fleetlife.functions.hashing import digest, hash32, uniform
from fleetlife.models import closed
from fleetlife.operators import labels, metrics, sampling

from .base import (
    CAP, CELL, COUNTS, EDGES, FEATURES_SQL, FLEET_SQL, HORIZON_SQL, MEMBERS_SQL, METRIC_NAMES, PCELL, PKEYS,
    PREDS_SQL, RESULTS_SQL, SEEDS, UNITS_SQL, cells, features, fleet, horizon, lifetimes, members, predictions, query,
    results, rnd, rounded, s_hash, s_uniform, table, units,
)


@query("volume_sweep", "X2 A7 M11", f"WITH {RESULTS_SQL} SELECT {PKEYS}, {rnd(*METRIC_NAMES)}, n FROM results")
def volume_sweep(spark, path):
    return rounded(results(spark, path))


@query("unit_hash", "F16", f"""WITH lives AS (SELECT DISTINCT user_id AS unit_number FROM events)
SELECT unit_number, md5(concat_ws('|', unit_number, 7)) AS digest, {s_hash('unit_number', '7')}::BIGINT AS h,
  {rnd(s_uniform('unit_number', '7') + ' AS u')} FROM lives""")
def unit_hash(spark, path):
    u = table(spark, path, "events").select(F.col("user_id").alias(UNIT)).distinct()
    key = (F.col(UNIT), 7)
    return rounded(u.select(UNIT, digest(*key).alias("digest"), hash32(*key).alias("h"), uniform(*key).alias("u")))


@query("distinct_units", "L5", f"WITH {FLEET_SQL} SELECT DISTINCT dataset, unit_number FROM fleet")
def distinct_units(spark, path):
    return sampling.units_of(fleet(spark, path))


@query("unit_count_grid", "L4 J11", f"WITH {MEMBERS_SQL} SELECT dataset, available, n_units, seed FROM cells")
def unit_count_grid(spark, path):
    return sampling.cell_grid(units(spark, path), COUNTS, SEEDS)


@query("subsample_units", "L1", f"WITH {MEMBERS_SQL} SELECT dataset, n_units, seed, unit_number FROM drawn")
def subsample(spark, path):
    return sampling.subsample_units(units(spark, path), cells(spark, path))


@query("cell_membership", "L2 S13", f"WITH {MEMBERS_SQL} SELECT dataset, n_units, seed, unit_number, role FROM members")
def cell_membership(spark, path):
    return members(spark, path)


@query("bootstrap_units", "L3", f"""WITH {UNITS_SQL},
numbered AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY unit_number) AS i,
  count(*) OVER (PARTITION BY dataset) AS n FROM units),
draws AS (SELECT dataset, seed, ({s_hash("'boot'", 'seed', 'i')} % n + 1)::BIGINT AS i, count(*) AS freq
  FROM numbered, seeds GROUP BY 1, 2, 3)
SELECT d.dataset, d.seed, u.unit_number, d.freq FROM draws d JOIN numbered u ON d.dataset = u.dataset AND d.i = u.i""")
def bootstrap(spark, path):
    return sampling.bootstrap_units(units(spark, path), SEEDS)


@query("cell_train_rows", "J3", f"""WITH {FEATURES_SQL}, {MEMBERS_SQL}
SELECT m.dataset, n_units, seed, role, count(*) AS n_rows, {rnd('sum(label) AS label_sum')}
FROM feats f JOIN members m ON f.dataset = m.dataset AND f.unit_number = m.unit_number GROUP BY ALL""")
def cell_train_rows(spark, path):
    rows = features(spark, path).where("split = 'train'").select("dataset", UNIT, "label")
    per_cell = sampling.cell_rows(rows, cells(spark, path))
    return rounded(per_cell.groupBy(*CELL, "role").agg(
        F.count("*").alias("n_rows"), F.sum("label").alias("label_sum")))


@query("pending_cells", "J4", f"""WITH {MEMBERS_SQL} SELECT dataset, n_units, seed FROM cells
WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.dataset = cells.dataset AND m.n_units = cells.n_units
  AND m.seed = cells.seed AND m.role = 'val' AND m.unit_number >= 10)""")
def pending(spark, path):
    done = members(spark, path).where((F.col("role") == "val") & (F.col(UNIT) >= 10))
    grid = sampling.cell_grid(units(spark, path), COUNTS, SEEDS).select(*CELL)
    return sampling.pending_cells(grid, done, CELL)


@query("unit_row_mask", "P5", f"""WITH {FLEET_SQL}, {MEMBERS_SQL}
SELECT f.dataset, f.unit_number, time_cycles, {rnd('s_1', 's_2')} FROM fleet f WHERE EXISTS (SELECT 1 FROM members m
  WHERE m.dataset = f.dataset AND m.unit_number = f.unit_number AND m.role = 'val')""")
def unit_row_mask(spark, path):
    val = members(spark, path).where("role = 'val'")
    return rounded(sampling.rows_of(fleet(spark, path), val).select("dataset", UNIT, CYCLE, "s_1", "s_2"))


@query("predict_mean_floor", "A18", f"""WITH {FEATURES_SQL}, {MEMBERS_SQL}
SELECT f.dataset, n_units, seed, {rnd('avg(label) AS mean_label')} FROM feats f
JOIN members m ON f.dataset = m.dataset AND f.unit_number = m.unit_number AND role = 'train' GROUP BY ALL""")
def predict_mean_floor(spark, path):
    train = features(spark, path).where("split = 'train'")
    sums = closed.cell_sums(closed.unit_sums(train, []), cells(spark, path))
    return rounded(closed.fit_mean(sums).select(*CELL, F.col("intercept").alias("mean_label")))


@query("cycle_regression", "A19 X4 W11", f"""WITH {FEATURES_SQL}, {MEMBERS_SQL}
SELECT f.dataset, n_units, seed, {rnd('regr_slope(label, time_cycles::DOUBLE) AS slope',
                                      'regr_intercept(label, time_cycles::DOUBLE) AS intercept')}
FROM feats f JOIN members m ON f.dataset = m.dataset AND f.unit_number = m.unit_number AND role = 'train' GROUP BY ALL""")
def cycle_regression(spark, path):
    train = features(spark, path).where("split = 'train'")
    sums = closed.cell_sums(closed.unit_sums(train, [CYCLE]), cells(spark, path))
    return rounded(closed.fit_line(sums, CYCLE).select(*CELL, "slope", "intercept"))


@query("clip_predictions", "P4", f"""WITH {PREDS_SQL} SELECT {PKEYS}, count(*) AS n, {rnd('min(pred) AS lo', 'max(pred) AS hi',
  'sum(pred) AS total')} FROM preds GROUP BY ALL""")
def clip_predictions(spark, path):
    return rounded(predictions(spark, path).groupBy(*PCELL).agg(
        F.count("*").alias("n"), F.min("pred").alias("lo"), F.max("pred").alias("hi"), F.sum("pred").alias("total")))


@query("all_cycle_metrics", "A6 A7 X7", f"""WITH {PREDS_SQL} SELECT {PKEYS},
  {rnd(*[c for c in METRIC_NAMES if not c.startswith('nasa')])}, {rnd('nasa_clipped', 'nasa_unclipped', digits=4)}, n
FROM (SELECT {PKEYS}, sqrt(avg((pred - least(true_rul, {CAP}::DOUBLE)) ** 2)) AS rmse_clipped,
  avg(abs(pred - least(true_rul, {CAP}::DOUBLE))) AS mae_clipped,
  sum(CASE WHEN pred >= least(true_rul, {CAP}::DOUBLE) THEN exp((pred - least(true_rul, {CAP}::DOUBLE)) / 10e0) - 1
      ELSE exp((least(true_rul, {CAP}::DOUBLE) - pred) / 13e0) - 1 END) AS nasa_clipped,
  sqrt(avg((pred - true_rul) ** 2)) AS rmse_unclipped, avg(abs(pred - true_rul)) AS mae_unclipped,
  sum(CASE WHEN pred >= true_rul THEN exp((pred - true_rul) / 10e0) - 1
      ELSE exp((true_rul - pred) / 13e0) - 1 END) AS nasa_unclipped, count(*) AS n FROM preds GROUP BY {PKEYS})""")
def all_cycle_metrics(spark, path):
    out = metrics.evaluate(predictions(spark, path), PCELL, CAP)
    nasa = {c: F.round(c, 4) for c in ("nasa_clipped", "nasa_unclipped")}
    return rounded(out.withColumns(nasa))


@query("longest_units", "W16 L7", f"""WITH {FLEET_SQL}, c AS (SELECT dataset, unit_number, count(*) AS n_rows FROM fleet GROUP BY 1, 2)
SELECT dataset, unit_number, n_rows FROM (SELECT *, row_number() OVER (PARTITION BY dataset
  ORDER BY n_rows DESC, unit_number) AS r FROM c) WHERE r <= 4""")
def longest(spark, path):
    return sampling.longest_units(fleet(spark, path), 4)


@query("validation_size", "L2", f"""WITH {UNITS_SQL}, a AS (SELECT dataset, count(*) AS n FROM units GROUP BY 1)
SELECT dataset, n, CASE WHEN n > 1 THEN greatest(1, round_even(n * 0.2::DOUBLE, 0)::BIGINT) ELSE 0 END AS n_val FROM a""")
def validation_size(spark, path):
    n = units(spark, path).groupBy("dataset").agg(F.count("*").alias("n"))
    return n.withColumn("n_val", sampling.validation_size(F.col("n"), 0.2))
