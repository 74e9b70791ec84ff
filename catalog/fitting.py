"""Health index, forecasts, embeddings, and Spark ML models of whole-fleet cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlife.config import CYCLE, KEYS, UNIT, content_hash
from fleetlife.models import embed, indicators, kernels, learned
from fleetlife.operators import features as heads
from fleetlife.operators import health, metrics, sampling, windows
from fleetlife.plans import sweep, zeroshot
from fleetlife.session import small_side, work_dir
from fleetlife.sources import materialize, source_key

from .base import (
    CAP, FEATURES_SQL, FLEET_SQL, PCELL, SEEDS, UNITS_SQL, WINDOW, cells, fleet, plan, query, rnd, rounded,
    s_hash, s_metrics, units,
)

HC = ["s_1", "s_2"]
LAST_K, HORIZON = 12, 30


@plan
def draws(spark, path):
    return sampling.bootstrap_units(units(spark, path), SEEDS)


@plan
def stored(spark, path):
    """The prepared fleet, written once: the zero-shot path passes over it six times."""
    rows = fleet(spark, path).select(*KEYS, "split", CYCLE, "n_obs", "actual_rul", "clipped_rul", *HC)
    return materialize(rows, work_dir(spark), f"fleet_{source_key(spark, f'{path}/events.parquet')}", partition_by=("split",))


def side(spark, path, split):
    return stored(spark, path).where(F.col("split") == split)


@plan
def transform(spark, path):
    return small_side(health.fit_health_index(side(spark, path, "train"), HC, draws(spark, path)))


# ---- zero-shot path -----------------------------------------------------------------------------
HEALTH_SQL = FLEET_SQL + ", " + UNITS_SQL + f""",
numbered AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY unit_number) AS i, count(*) OVER (PARTITION BY dataset) AS n FROM units),
drawn AS (SELECT dataset, seed, ({s_hash("'boot'", 'seed', 'i')} % n + 1)::BIGINT AS i FROM numbered, seeds),
boot AS (SELECT d.dataset, d.seed, u.unit_number FROM drawn d JOIN numbered u ON d.dataset = u.dataset AND d.i = u.i),
cal AS (SELECT b.seed, f.* FROM boot b JOIN fleet f ON f.dataset = b.dataset AND f.unit_number = b.unit_number AND f.split = 'train'),
mom AS (SELECT dataset, seed, avg(s_1) AS m1, avg(s_2) AS m2, stddev_pop(s_1) AS d1, stddev_pop(s_2) AS d2,
  CASE WHEN corr(s_1, s_2) < 0 THEN -1 ELSE 1 END AS sg, covar_pop(s_1, time_cycles::DOUBLE) AS c1, covar_pop(s_2, time_cycles::DOUBLE) AS c2 FROM cal GROUP BY ALL),
tf AS (SELECT *, CASE WHEN c1 / d1 + sg * c2 / d2 < 0 THEN -1 ELSE 1 END / sqrt(2e0) AS v1,
  sg * CASE WHEN c1 / d1 + sg * c2 / d2 < 0 THEN -1 ELSE 1 END / sqrt(2e0) AS v2 FROM mom),
thr AS (SELECT c.dataset, c.seed, quantile_cont((s_1 - m1) / d1 * v1 + (s_2 - m2) / d2 * v2, 0.5) AS threshold
  FROM cal c JOIN tf USING (dataset, seed) WHERE time_cycles = n_obs GROUP BY c.dataset, c.seed),
hi AS (SELECT t.seed, f.*, (s_1 - m1) / d1 * v1 + (s_2 - m2) / d2 * v2 AS hi FROM fleet f JOIN tf t ON t.dataset = f.dataset WHERE f.split = 'test'),
fc AS (SELECT dataset, unit_number, seed, any_value(n_obs) AS end_cycle, max(CASE WHEN time_cycles = n_obs THEN hi END) AS last_hi,
  max(CASE WHEN time_cycles = n_obs THEN actual_rul END) AS true_rul,
  regr_slope(hi, time_cycles::DOUBLE) AS b, avg(hi) AS y, avg(time_cycles) AS x FROM hi WHERE time_cycles > n_obs - {LAST_K} GROUP BY ALL),
steps AS (SELECT fc.*, h, y + b * (end_cycle + h - x) AS v FROM fc, (SELECT unnest(range(1, {HORIZON + 1})) AS h)),
crossed AS (SELECT s.dataset, s.unit_number, s.seed, any_value(end_cycle) AS end_cycle, any_value(true_rul) AS true_rul,
  CASE WHEN any_value(last_hi) >= any_value(threshold) THEN 0 ELSE coalesce(min(CASE WHEN v >= threshold THEN h END), {HORIZON}) END::DOUBLE AS crossing
  FROM steps s JOIN thr USING (dataset, seed) GROUP BY s.dataset, s.unit_number, s.seed)"""


@query("health_index_fit", "M1 L3", f"""WITH {HEALTH_SQL} SELECT dataset, seed, {rnd('m1 AS mean_1', 'm2 AS mean_2', 'd1 AS std_1',
  'd2 AS std_2', 'v1 AS dir_1', 'v2 AS dir_2')} FROM tf""")
def health_index_fit(spark, path):
    t = health.fit_health_index(side(spark, path, "train"), HC, draws(spark, path))
    parts = {"mean": "hi_mean", "std": "hi_std", "dir": "hi_dir"}
    return rounded(t.select("dataset", "seed", *[F.get(c, F.lit(i)).alias(f"{n}_{i + 1}") for n, c in parts.items() for i in (0, 1)]))


@query("health_index", "W13", f"""WITH {HEALTH_SQL} SELECT dataset, unit_number, time_cycles, seed, {rnd('hi')} FROM hi""")
def health_index(spark, path):
    out = health.health_index(side(spark, path, "test"), transform(spark, path), HC)
    return rounded(out.select(*KEYS, CYCLE, "seed", "hi"))


@query("failure_threshold", "A20", f"WITH {HEALTH_SQL} SELECT dataset, seed, {rnd('threshold')} FROM thr")
def failure_threshold(spark, path):
    return rounded(health.failure_threshold(side(spark, path, "train"), transform(spark, path), draws(spark, path), HC))


@query("trend_forecast", "M2", f"""WITH {HEALTH_SQL} SELECT dataset, unit_number, seed, end_cycle, {rnd('last_hi', 'y + b * (end_cycle + 1 - x) AS step_1',
  f'y + b * (end_cycle + {HORIZON} - x) AS step_last')} FROM fc""")
def trend_forecast(spark, path):
    out = health.trend_forecast(side(spark, path, "test"), transform(spark, path), HC, LAST_K, HORIZON)
    return rounded(out.select(*KEYS, "seed", "end_cycle", "last_hi", F.element_at("forecast", 1).alias("step_1"),
                              F.element_at("forecast", -1).alias("step_last")))


@query("threshold_crossing", "W14", f"WITH {HEALTH_SQL} SELECT dataset, unit_number, seed, end_cycle, {rnd('true_rul', 'crossing')} FROM crossed")
def threshold_crossing(spark, path):
    return rounded(zeroshot.crossings(side(spark, path, "train"), side(spark, path, "test"), HC, draws(spark, path), HORIZON, LAST_K))


@query("zero_shot", "X13 A7", f"""WITH {HEALTH_SQL},
floor AS (SELECT dataset, seed, avg(clipped_rul) AS m, regr_slope(clipped_rul, time_cycles::DOUBLE) AS sl,
  regr_intercept(clipped_rul, time_cycles::DOUBLE) AS ic FROM cal GROUP BY ALL),
ends AS (SELECT * FROM fleet WHERE split = 'test' AND time_cycles = n_obs),
preds AS (SELECT 'trend_zeroshot' AS model, 'zeroshot' AS loss, dataset, seed, true_rul, least({CAP}, crossing)::DOUBLE AS pred FROM crossed
  UNION ALL SELECT 'predict_mean', 'native', e.dataset, seed, actual_rul, greatest(0, least({CAP}, m)) FROM ends e JOIN floor f ON f.dataset = e.dataset
  UNION ALL SELECT 'cycle_reg', 'native', e.dataset, seed, actual_rul, greatest(0, least({CAP}, sl * time_cycles + ic)) FROM ends e JOIN floor f ON f.dataset = e.dataset)
SELECT model, dataset, {CAP}::DOUBLE AS max_rul, 0::BIGINT AS n_units, seed, loss, n, {rnd(*metrics.METRICS)}
FROM (SELECT model, dataset, seed, loss, {s_metrics()} FROM preds GROUP BY model, dataset, seed, loss)""")
def zero_shot(spark, path):
    return rounded(zeroshot.zero_shot(side(spark, path, "train"), side(spark, path, "test"), units(spark, path), HC,
                                      SEEDS, CAP, LAST_K))


@query("plugged_forecast", "M2", f"""WITH {FLEET_SQL}, t AS (SELECT dataset, unit_number, any_value(n_obs) AS end_cycle,
  max(CASE WHEN time_cycles = n_obs THEN s_1 END) AS b, max(CASE WHEN time_cycles = greatest(1, n_obs - 23) THEN s_1 END) AS a,
  any_value(least(n_obs, 24)) AS n FROM fleet WHERE split = 'test' GROUP BY ALL)
SELECT dataset, unit_number, end_cycle, {rnd('b + (b - a) / (n - 1) AS step_1', f'b + {HORIZON} * (b - a) / (n - 1) AS step_last')} FROM t""")
def plugged_forecast(spark, path):
    class Drift:
        """Continues the average step of the history."""

        def forecast(self, values, horizon):
            step = (values[-1] - values[0]) / (len(values) - 1)
            return [values[-1] + step * h for h in range(1, horizon + 1)]

    ctx = windows.last_contexts(fleet(spark, path, "test"), ["s_1"], 24)
    series = ctx.select(*KEYS, "end_cycle", F.transform("ctx", lambda s: s["s_1"]).alias("series"))
    out = health.plugged_forecast(series, Drift, HORIZON)
    return rounded(out.select(*KEYS, "end_cycle", F.element_at("forecast", 1).alias("step_1"),
                              F.element_at("forecast", -1).alias("step_last")))


# ---- embeddings ---------------------------------------------------------------------------------
DIMS, SCALE = 2, 100.0


def _projection(spark, path, split, keep=()):
    return embed.projection_embedding(fleet(spark, path, split), HC, 24, DIMS, 7, SCALE, WINDOW, keep)


_OV = "OVER (PARTITION BY unit_number ORDER BY time_cycles ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"


@query("projection_embedding", "M3", f"""WITH {FLEET_SQL} SELECT * FROM (SELECT dataset, unit_number, time_cycles AS end_cycle, {', '.join(
  rnd(f'tanh(avg({c}) {_OV} * {embed.weight(7, i, d) / SCALE!r}::DOUBLE) AS e_{i}_{d}') for i, c in enumerate(HC) for d in range(DIMS))},
  {rnd(f'stddev_pop(s_2) {_OV} AS scale_2')} FROM fleet WHERE split = 'train') WHERE end_cycle >= {WINDOW}""")
def projection_embedding(spark, path):
    out = _projection(spark, path, "train")
    return rounded(out.select(*KEYS, "end_cycle", *[
        F.get(F.get("emb", F.lit(i)), F.lit(d)).alias(f"e_{i}_{d}") for i in range(2) for d in range(DIMS)],
        F.get("locscale", F.lit(1))["scale"].alias("scale_2")))


@query("plugged_embedding", "M3", f"""WITH {FLEET_SQL} SELECT * FROM (SELECT dataset, unit_number, time_cycles AS end_cycle,
  clipped_rul AS label, count(*) {_OV}::DOUBLE AS n, sum((s_1 > 50)::INT) {_OV}::DOUBLE AS high_1, sum((s_2 > 50)::INT) {_OV}::DOUBLE AS high_2
  FROM fleet WHERE split = 'train') WHERE end_cycle >= {WINDOW}""")
def plugged_embedding(spark, path):
    class Counts:
        """Embeds a context as its length and the number of high readings per channel."""

        def embed_windows(self, series):
            emb = [[len(x), (x[:, 0] > 50).sum(), (x[:, 1] > 50).sum()] for x in series]
            import numpy as np

            return np.array(emb), [[(float(c.mean()), float(c.std())) for c in x.T] for x in series]

    ctx = windows.contexts(fleet(spark, path, "train"), HC, WINDOW, 24)
    out = embed.embed_contexts(ctx, Counts)
    return out.select(*KEYS, "end_cycle", "label", *[
        F.get("emb", F.lit(i)).cast("double").alias(n) for i, n in enumerate(("n", "high_1", "high_2"))])


# ---- Spark ML models on the whole-fleet cell of one seed ---------------------------------------
def _cell(spark, path):
    return sweep.whole_fleet(cells(spark, path)).where("seed = 0")


def _scores(spark, path, train, test, make, model, loss, what=""):
    """Result rows of a model. Its features are written once, so that the passes of the fit read a
    table instead of repeating the windows."""
    facts = {"source": source_key(spark, f"{path}/events.parquet"), "columns": train.columns, "window": WINDOW, "cap": CAP}
    name = f"{model}{what}_{content_hash(facts)}"
    train = materialize(train, work_dir(spark), f"train_{name}")
    test = materialize(test.withColumnRenamed("label", "true_rul"), work_dir(spark), f"test_{name}")
    preds = sweep.learned_predictions(train, test, _cell(spark, path), make, model, loss, CAP)
    return rounded(metrics.evaluate(preds, PCELL, CAP), 4)


def _stat_names(channels):
    return [f"{c}_{s}" for s in windows.STATS for c in channels]


def _stats(spark, path, channels):
    train = fleet(spark, path, "train").withColumn("age", F.col(CYCLE))
    test = fleet(spark, path, "test").withColumn("age", F.col(CYCLE))
    return (windows.window_stats(train, channels, WINDOW), windows.last_window_stats(test, channels, WINDOW))


@query("boosted_trees", "M4 M11")
def boosted_trees(spark, path):
    names = _stat_names(HC)
    return _scores(spark, path, *_stats(spark, path, HC), lambda s: learned.make_model("gbm", names, CAP, s, rounds=10), "gbm", "native")


@query("boosted_trees_with_age", "M5 X4")
def boosted_trees_with_age(spark, path):
    channels = ["age", *HC]
    names = _stat_names(channels)
    return _scores(spark, path, *_stats(spark, path, channels),
                   lambda s: learned.make_model("gbm_age", names, CAP, s, rounds=10), "gbm_age", "native")


def _windows(spark, path):
    return (windows.sliding_windows(fleet(spark, path, "train"), HC, WINDOW),
            windows.last_windows(fleet(spark, path, "test"), HC, WINDOW))


@query("random_kernels_ridge", "M6")
def random_kernels_ridge(spark, path):
    train, test = (kernels.kernel_features(w, HC, WINDOW, 32, 3) for w in _windows(spark, path))
    return _scores(spark, path, train, test,
                   lambda s: learned.make_model("kernel_ridge", "kernels", CAP, s, alphas=(1e-3, 0.1, 10.0)), "kernel_ridge", "native")


@query("indicator_trees", "M7")
def indicator_trees(spark, path):
    train, test = (indicators.window_indicators(w, HC, WINDOW) for w in _windows(spark, path))
    names = [f"{c}_{n}" for c in HC for n in indicators.INDICATORS]
    return _scores(spark, path, train, test, lambda s: learned.make_model("indicator_gbm", names, CAP, s, rounds=10), "indicator_gbm", "native")


def head_tables(spark, path, mode="emb+locscale", aggregation="concat"):
    """Head features of train windows and last test windows, standardized on the train units."""
    def rows(split, label):
        emb = F.flatten("emb") if aggregation == "concat" else F.zip_with(F.get("emb", F.lit(0)), F.get("emb", F.lit(1)), lambda a, b: (a + b) / 2)
        out = _projection(spark, path, split, (label, "n_obs", *HC)).withColumn("emb", emb)
        return out.withColumnRenamed(label, "label")

    train, test = rows("train", "clipped_rul"), rows("test", "actual_rul").where("end_cycle = n_obs")
    fit_on = sampling.cell_rows(train, _cell(spark, path)).where("role = 'train'")
    keep = [*KEYS, "end_cycle", "label", "head"]
    return tuple(heads.head_features(fit_on, r, mode, 2, HC, ["dataset"]).select(*keep) for r in (train, test))


@query("linear_head", "M8 F12")
def linear_head(spark, path):
    return _scores(spark, path, *head_tables(spark, path), lambda s: learned.make_model("linear_mlp", "head", CAP, s), "linear_mlp", "mse")


@query("ordinal_head", "M9")
def ordinal_head(spark, path):
    return _scores(spark, path, *head_tables(spark, path, "emb+locscale+raw"),
                   lambda s: learned.make_model("ordinal_mlp", "head", CAP, s, bins=4), "ordinal_mlp", "corn")


@query("representation_modes", "X5 A24")
def representation_modes(spark, path):
    def run(how):
        return _scores(spark, path, *head_tables(spark, path, "emb", how), lambda s: learned.make_model("linear_mlp", "head", CAP, s), "linear_mlp", "mse", "_" + how)

    return sweep.over_levels({"native": "concat", "common": "mean"}, run, "mode")
