"""Comparison of result rows: curves, competitors, paired tests, verdicts, rosters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlife.config import UNIT
from fleetlife.functions.names import model_class
from fleetlife.operators import compare, sampling

from .base import (
    HORIZON_SQL, METRIC_NAMES, PCELL, PKEYS, PREDS_SQL, RESULTS_SQL, fleet, horizon, predictions, query, results, rnd,
    rounded,
)

LABEL = "CASE WHEN loss IN ('', 'native') THEN model ELSE model || '[' || loss || ']' END"
CLASS = ("CASE WHEN regexp_matches(model, '(_mlp|_zeroshot)$') THEN 'candidate' "
         "WHEN model IN ('predict_mean', 'cycle_reg') THEN 'floor' ELSE 'competitor' END")


@query("model_classes", "P7", f"WITH {RESULTS_SQL} SELECT model, {CLASS} AS class, count(*) AS n FROM results GROUP BY 1, 2")
def model_classes(spark, path):
    return results(spark, path).groupBy("model", model_class(F.col("model")).alias("class")).agg(F.count("*").alias("n"))


@query("valid_rows", "P6", f"""WITH {RESULTS_SQL} SELECT {PKEYS}, {rnd('rmse_clipped')} FROM results
WHERE nullif(model, 'cycle_reg') IS NOT NULL AND rmse_clipped IS NOT NULL""")
def valid_rows(spark, path):
    holed = results(spark, path).withColumn("level", F.nullif(F.col("model"), F.lit("cycle_reg")))
    return rounded(compare.valid_rows(holed, "rmse_clipped", ["dataset", "level"]).select(*PCELL, "rmse_clipped"))


@query("data_scaling", "A12 X14", f"""WITH {RESULTS_SQL} SELECT dataset, {LABEL} AS label, n_units,
  {rnd('avg(rmse_clipped) AS mean', 'stddev_pop(rmse_clipped) AS std')} FROM results GROUP BY ALL""")
def data_scaling(spark, path):
    return rounded(compare.data_scaling(results(spark, path)))


def _ablation_rows(spark, path):
    """Result rows with the axes of an ablation: the context from the model, features from the loss."""
    return results(spark, path).select(
        F.length("model").alias("context_length"), F.col("loss").alias("head_features"),
        F.col("dataset").alias("pooling"), "seed", "rmse_clipped")


_ABL = f"""ab AS (SELECT length(model) AS context_length, loss AS head_features, dataset AS pooling, rmse_clipped FROM results),
abt AS (SELECT context_length, head_features, pooling, avg(rmse_clipped) AS mean, stddev_pop(rmse_clipped) AS std,
  count(*) AS n_seeds FROM ab GROUP BY ALL)"""


@query("ablation_table", "A13", f"""WITH {RESULTS_SQL}, {_ABL} SELECT context_length, head_features, pooling,
  {rnd('mean', 'std')}, n_seeds FROM abt""")
def ablation_table(spark, path):
    return rounded(compare.ablation_table(_ablation_rows(spark, path)))


@query("best_ablation_cell", "A13 L7", f"""WITH {RESULTS_SQL}, {_ABL} SELECT context_length, head_features, pooling,
  {rnd('mean', 'std')}, n_seeds FROM abt ORDER BY abt.mean, context_length, head_features, pooling LIMIT 1""")
def best_ablation_cell(spark, path):
    return rounded(compare.best_cell(_ablation_rows(spark, path)))


STRONG_SQL = RESULTS_SQL + f""",
means AS (SELECT dataset, n_units, model, loss, avg(nasa_clipped) AS m, avg(rmse_clipped) AS m2 FROM results GROUP BY ALL),
bar AS (SELECT dataset, n_units, model AS best_baseline, loss AS baseline_loss, m AS baseline_mean FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset, n_units ORDER BY m, model, loss) AS r FROM means
  WHERE {CLASS} = '@KIND@') WHERE r = 1)"""


@query("strongest_competitor", "A14 L7", f"""WITH {STRONG_SQL.replace('@KIND@', 'competitor')}
SELECT dataset, n_units, best_baseline, baseline_loss, {rnd('baseline_mean')} FROM bar""")
def strongest_competitor(spark, path):
    return rounded(compare.strongest(results(spark, path)))


@query("strongest_floor", "A14", f"""WITH {STRONG_SQL.replace('@KIND@', 'floor')}
SELECT dataset, n_units, best_baseline, baseline_loss, {rnd('baseline_mean')} FROM bar""")
def strongest_floor(spark, path):
    return rounded(compare.strongest(results(spark, path), kind="floor"))


# Two-sided p of t with 4 degrees of freedom (five seeds), closed form for even df.
_TEST = """s AS (SELECT *, max(abs(d - d0)) OVER w AS spread FROM (SELECT *, first(d ORDER BY seed) OVER w0 AS d0 FROM pairs
    WINDOW w0 AS (PARTITION BY @BY@ ORDER BY seed ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
  WINDOW w AS (PARTITION BY @BY@)),
g AS (SELECT @BY@, count(*) AS n_seeds, avg(a) AS mean_a, avg(b) AS mean_b, avg(d) AS mean_delta, CASE WHEN count(*) >= 2
  AND max(spread) > 1e-8::DOUBLE + 1e-5::DOUBLE * abs(any_value(d0)) THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END AS t
  FROM s GROUP BY @BY@),
tests AS (SELECT *, CASE WHEN t IS NOT NULL THEN greatest(0e0, 1 - sin(atan(abs(t) / 2e0)) * (1 + cos(atan(abs(t) / 2e0)) ** 2 / 2)) END AS p FROM g)"""


@query("paired_ttest", "A15 J5 U6", f"""WITH {RESULTS_SQL},
pairs AS (SELECT x.dataset, x.n_units, x.model, x.loss, x.seed, x.rmse_clipped AS a, y.rmse_clipped AS b, x.rmse_clipped - y.rmse_clipped AS d
  FROM results x JOIN results y ON x.dataset = y.dataset AND x.n_units = y.n_units AND x.seed = y.seed
  WHERE y.model = 'linear_stats' AND x.model <> 'linear_stats'),
{_TEST.replace('@BY@', 'dataset, n_units, model, loss')}
SELECT dataset, n_units, model, loss, n_seeds, {rnd('mean_a', 'mean_b', 'mean_delta', 't', 'p')} FROM tests""")
def paired_ttest(spark, path):
    in_cell = Window.partitionBy("dataset", "n_units", "seed")
    base = F.max(F.when(F.col("model") == "linear_stats", F.col("rmse_clipped"))).over(in_cell)
    pairs = (results(spark, path).withColumn("b", base).where("model <> 'linear_stats' AND b IS NOT NULL")
             .withColumnRenamed("rmse_clipped", "a"))
    return rounded(compare.paired_ttest(pairs, ["dataset", "n_units", "model", "loss"]))


@query("paired_loss_test", "A16", f"""WITH {HORIZON_SQL},
pairs AS (SELECT x.dataset, x.max_rul, x.n_units, x.bin_lo, x.bin_hi, x.seed, x.mae_clipped AS a, y.mae_clipped AS b,
  x.mae_clipped - y.mae_clipped AS d FROM horizon x JOIN horizon y ON x.dataset = y.dataset AND x.n_units = y.n_units
  AND x.seed = y.seed AND x.bin_lo IS NOT DISTINCT FROM y.bin_lo WHERE x.model = 'level_mlp' AND y.model = 'level_mlp'
  AND x.loss = 'corn' AND y.loss = 'mse'),
{_TEST.replace('@BY@', 'dataset, max_rul, n_units, bin_lo, bin_hi')}
SELECT dataset, max_rul, n_units, bin_lo, bin_hi, n_seeds, {rnd('mean_a', 'mean_b', 'mean_delta', 't', 'p')} FROM tests""")
def paired_loss_test(spark, path):
    return rounded(compare.paired_loss_test(horizon(spark, path), "level_mlp"))


def _map_sql(kind: str, hollow: str) -> str:
    return STRONG_SQL.replace("@KIND@", kind) + f""",
cand AS (SELECT * FROM means WHERE {CLASS} = 'candidate'),
pairs AS (SELECT x.dataset, x.n_units, x.model, x.loss, x.seed, x.nasa_clipped AS a, y.nasa_clipped AS b, x.nasa_clipped - y.nasa_clipped AS d
  FROM results x JOIN bar ON x.dataset = bar.dataset AND x.n_units = bar.n_units
  JOIN results y ON y.dataset = x.dataset AND y.n_units = x.n_units AND y.seed = x.seed AND y.model = bar.best_baseline
    AND y.loss = bar.baseline_loss WHERE {CLASS.replace('model', 'x.model')} = 'candidate'),
{_TEST.replace('@BY@', 'dataset, n_units, model, loss')},
map AS (SELECT c.dataset, c.n_units, c.model, c.loss, bar.baseline_mean - c.m AS margin, t.p, coalesce(t.n_seeds, 0) AS n_seeds,
  c.m AS candidate_mean, bar.best_baseline, bar.baseline_mean, f.m AS floor, c.m2 AS candidate_rmse_clipped
  FROM cand c JOIN bar USING (dataset, n_units) LEFT JOIN tests t USING (dataset, n_units, model, loss)
  LEFT JOIN (SELECT dataset, n_units, m FROM means WHERE model = 'predict_mean') f USING (dataset, n_units)),
verdicts AS (SELECT *, CASE WHEN p < 0.05 AND margin > 0 THEN {hollow} WHEN p < 0.05 AND margin < 0 THEN 'loss' ELSE 'tie' END AS verdict FROM map)"""


_HOLLOW = "CASE WHEN candidate_mean >= floor THEN 'hollow' ELSE 'win' END"
_MAP_OUT = ("dataset, n_units, model, loss, verdict, 'nasa_clipped' AS metric, n_seeds, best_baseline, "
            + rnd("margin", "p", "candidate_mean", "baseline_mean", "floor", "candidate_rmse_clipped"))


@query("success_map", "X10 J6 J7 F17", f"WITH {_map_sql('competitor', _HOLLOW)} SELECT {_MAP_OUT} FROM verdicts")
def success_map(spark, path):
    return rounded(compare.in_text_order(compare.success_map(results(spark, path)), ["dataset", "n_units", "model", "loss"]))


@query("success_map_floors", "X10 L6", f"WITH {_map_sql('floor', chr(39) + 'win' + chr(39))} SELECT {_MAP_OUT} FROM verdicts")
def success_map_floors(spark, path):
    table = compare.success_map(results(spark, path), versus_floors=True)
    return rounded(compare.in_text_order(table, ["dataset", "n_units", "model", "loss"]))


@query("verdict_grid", "A25", f"""WITH {_map_sql('competitor', _HOLLOW)},
pos AS (SELECT *, dense_rank() OVER (PARTITION BY dataset ORDER BY n_units) AS c FROM verdicts WHERE loss = 'mse')
SELECT dataset, model, {', '.join(f"max(CASE WHEN c = {i} THEN verdict END) AS c{i}" for i in range(1, 6))} FROM pos GROUP BY dataset, model""")
def verdict_grid(spark, path):
    table = compare.success_map(results(spark, path)).where("loss = 'mse'")
    return compare.verdict_grid(table, "n_units", 5)


@query("roster", "A17 L7", f"""WITH {RESULTS_SQL}, m AS (SELECT model, avg(nasa_clipped) AS mean, CASE WHEN regexp_matches(model, '(_mlp|_zeroshot)$')
  THEN 'candidate' WHEN model IN ('linear_stats', 'cycle_reg') THEN 'foil' WHEN model = 'predict_mean' THEN 'net' END AS category FROM results GROUP BY model),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY mean, model) AS place FROM m WHERE category IS NOT NULL)
SELECT model, {rnd('mean')}, category, place FROM r WHERE place <= CASE category WHEN 'net' THEN 1 ELSE 2 END""")
def roster(spark, path):
    return rounded(compare.roster(results(spark, path), foils=("linear_stats", "cycle_reg"), nets=("predict_mean",)))


@query("dedupe_results", "A23 U3", f"""WITH {RESULTS_SQL} SELECT {PKEYS}, {rnd(*METRIC_NAMES)}, n FROM results""")
def dedupe_results(spark, path):
    rows = results(spark, path).withColumn("run", F.lit(1))
    both = rows.unionByName(rows.where("loss = 'native'").withColumn("run", F.lit(2)))
    return rounded(compare.dedupe(both, PCELL, ["run"], same=["n", *METRIC_NAMES]).drop("run"))


@query("dedupe_predictions", "A23 U3", f"""WITH {PREDS_SQL} SELECT {PKEYS}, count(*) AS n, {rnd('sum(pred) AS total')}
FROM preds GROUP BY {PKEYS}""")
def dedupe_predictions(spark, path):
    rows = predictions(spark, path, spread=True).withColumn("run", F.lit(1))
    both = rows.unionByName(rows.where("loss = 'native'").withColumn("run", F.lit(2)))
    once = compare.dedupe(both, [*PCELL, UNIT, "time_cycles"], ["run"], same=["pred"])
    return rounded(once.groupBy(*PCELL).agg(F.count("*").alias("n"), F.sum("pred").alias("total")))


@query("finished_cells", "U4", f"""WITH {RESULTS_SQL} SELECT DISTINCT {PKEYS} FROM results WHERE model <> 'cycle_reg'""")
def finished_cells(spark, path):
    done = results(spark, path).where("model <> 'cycle_reg'")
    return sampling.finished_cells(done, predictions(spark, path), PCELL)


@query("orphan_cells", "U5", f"WITH {RESULTS_SQL} SELECT DISTINCT {PKEYS} FROM results WHERE model = 'cycle_reg'")
def orphan_cells(spark, path):
    kept = predictions(spark, path).where("model <> 'cycle_reg'")
    return sampling.orphan_cells(results(spark, path), kept, PCELL)


@query("mode_summary", "A24 X5", f"""WITH {RESULTS_SQL} SELECT model, CASE WHEN loss = 'corn' THEN 'common' ELSE 'native' END AS mode,
  {rnd('avg(rmse_clipped) AS mean', 'stddev_pop(rmse_clipped) AS std')} FROM results GROUP BY 1, 2""")
def mode_summary(spark, path):
    mode = F.when(F.col("loss") == "corn", "common").otherwise("native")
    return rounded(compare.mode_summary(results(spark, path).withColumn("mode", mode)))
