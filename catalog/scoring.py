"""Metrics of predictions: bins, histograms, costs, ordinal decoding and quantile loss."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fleetlife.config import CYCLE, UNIT, content_hash
from fleetlife.functions.hashing import content_key
from fleetlife.functions import ordinal
from fleetlife.functions.errors import cap, nasa
from fleetlife.functions.names import bin_label, series_label
from fleetlife.operators import compare, metrics
from fleetlife.plans import scoring
from fleetlife.session import work_dir

from .base import (
    CAP, EDGES, HORIZON_SQL, PCELL, PKEYS, PREDS_SQL, RESULTS_SQL, horizon, predictions, query, results, rnd, rounded, s_nasa,
    table,
)
from .comparison import LABEL

ERROR_EDGES = [-20.0, -10.0, -5.0, 0.0, 5.0, 10.0, 20.0]
RATIOS = [1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0]
LEVELS = [0.1, 0.5, 0.9]


@query("cap_labels", "P3", f"SELECT event_id, {rnd(f'least(value, {CAP}::DOUBLE) AS capped')} FROM events")
def cap_labels(spark, path):
    return rounded(table(spark, path, "events").select("event_id", cap(F.col("value"), CAP).alias("capped")))


@query("nasa_penalty", "F1", f"""SELECT event_id, {rnd(s_nasa("least(value, 60e0) - json_extract_string(props, '$.k')::DOUBLE")
  + ' AS penalty')} FROM events""")
def nasa_penalty(spark, path):
    d = F.least(F.col("value"), F.lit(60.0)) - F.get_json_object("props", "$.k").cast("double")
    return rounded(table(spark, path, "events").select("event_id", nasa(d).alias("penalty")))


@query("horizon_bins", "A8 J8 X7", f"""WITH {HORIZON_SQL} SELECT {PKEYS}, is_all, bin_lo, bin_hi, n_bin,
  {rnd('rmse_clipped', 'mae_clipped', 'bias', 'nasa_mean')} FROM horizon""")
def horizon_bins(spark, path):
    return rounded(horizon(spark, path))


@query("bin_edges", "A9", """WITH caps AS (SELECT DISTINCT p_size AS cap FROM part),
steps AS (SELECT cap, i * 20e0 AS e FROM caps, range(0, 1000) AS r(i) WHERE i * 20 <= cap UNION SELECT cap, cap::DOUBLE FROM caps)
SELECT cap, count(*) AS n_edges, round(sum(e), 6) + 0e0 AS edge_sum, round(max(e), 6) + 0e0 AS top FROM steps GROUP BY cap""")
def bin_edges(spark, path):
    caps = table(spark, path, "part").select(F.col("p_size").alias("cap")).distinct()
    edges = caps.select("cap", F.explode(metrics.bin_edges_of(F.col("cap"), 20.0)).alias("e"))
    finite = edges.where(F.col("e") < F.lit(float("inf")))
    return rounded(finite.groupBy("cap").agg(
        F.count("*").alias("n_edges"), F.sum("e").alias("edge_sum"), F.max("e").alias("top")))


_EB = ["'-Infinity'::DOUBLE", *[f"{e}e0" for e in ERROR_EDGES], "'Infinity'::DOUBLE"]
_EROWS = ", ".join(f"({a}, {b})" for a, b in zip(_EB[:-1], _EB[1:]))
EARLY_SQL = PREDS_SQL + f""",
errs AS (SELECT {PKEYS}, pred - true_rul AS d FROM preds),
tot AS (SELECT {PKEYS}, count(*) AS n, avg(d) AS mean_signed_error, avg((d >= 0)::INT) AS frac_late,
  avg((d < 0)::INT) AS frac_early FROM errs GROUP BY ALL),
ebins AS (SELECT * FROM (VALUES {_EROWS}) AS b(lo, hi)),
hits AS (SELECT {PKEYS}, lo, count(*) AS c FROM errs JOIN ebins ON d >= lo AND d < hi GROUP BY ALL),
hist AS (SELECT t.*, b.lo, b.hi, CASE WHEN b.lo >= 0 THEN 'late' ELSE 'early' END AS side, coalesce(h.c, 0) AS n_bin,
  coalesce(h.c, 0) / t.n AS frac FROM tot t CROSS JOIN ebins b LEFT JOIN hits h
  ON h.model = t.model AND h.dataset = t.dataset AND h.n_units = t.n_units AND h.seed = t.seed AND h.loss = t.loss AND h.lo = b.lo)"""


@query("earliness_histogram", "A10 X8", f"""WITH {EARLY_SQL} SELECT {PKEYS}, lo, hi, side, n_bin, n,
  {rnd('frac', 'frac_late', 'frac_early', 'mean_signed_error')} FROM hist""")
def earliness_histogram(spark, path):
    out = metrics.earliness(predictions(spark, path), PCELL, ERROR_EDGES)
    names = ["frac", "frac_late", "frac_early", "mean_signed_error"]
    return out.select(*PCELL, "lo", "hi", "side", "n_bin", "n", *[(F.round(c, 6) + 0.0).alias(c) for c in names])


COST_SQL = PREDS_SQL + f""",
sums AS (SELECT {PKEYS}, sum(greatest(0e0, true_rul - pred)) AS e, sum(greatest(0e0, pred - true_rul)) AS l FROM preds GROUP BY ALL),
costs AS (SELECT {PKEYS}, r AS cost_ratio, e + r * l AS cost FROM sums, (SELECT unnest([{', '.join(f'{x}e0' for x in RATIOS)}]) AS r))"""


@query("cost_curve", "A11 J12 X8", f"WITH {COST_SQL} SELECT {PKEYS}, cost_ratio, {rnd('cost', digits=4)} FROM costs")
def cost_curve(spark, path):
    return rounded(metrics.cost_curve(predictions(spark, path), PCELL, RATIOS), 4)


def _restarted(spark, path):
    """Both tables after a first run over some cells and a second over all."""
    base, preds = f"{work_dir(spark)}/study_{uuid.uuid4().hex}", predictions(spark, path)
    scoring.restart(preds.where("n_units < 10"), base, ERROR_EDGES, RATIOS)
    return scoring.restart(preds, base, ERROR_EDGES, RATIOS)


@query("restarted_costs", "X8 X14 J4 S10", f"WITH {COST_SQL} SELECT {PKEYS}, cost_ratio, {rnd('cost', digits=4)} FROM costs")
def restarted_costs(spark, path):
    return rounded(_restarted(spark, path)[1], 4)


def _study(spark, path, name):
    """A table of the study over two runs, the second of which repeats some cells."""
    rows, preds = results(spark, path), predictions(spark, path, spread=True)
    twice = [t.unionByName(t.where("loss = 'native'")) for t in (rows, preds)]
    return scoring.study_tables(*twice, ERROR_EDGES, RATIOS)[name]


@query("study_data_scaling", "X14 U3 A12", f"""WITH {RESULTS_SQL} SELECT dataset, {LABEL} AS label, n_units,
  {rnd('avg(rmse_clipped) AS mean', 'stddev_pop(rmse_clipped) AS std', digits=3)} FROM results GROUP BY ALL""")
def study_data_scaling(spark, path):
    return rounded(_study(spark, path, "data_scaling"), 3)


@query("study_costs", "X14 X8 U3", f"WITH {COST_SQL} SELECT {PKEYS}, cost_ratio, {rnd('cost', digits=3)} FROM costs")
def study_costs(spark, path):
    return rounded(_study(spark, path, "cost"), 3)


@query("earliness_summary", "A24", f"""WITH {EARLY_SQL} SELECT dataset, max_rul, model,
  {rnd('avg(frac_late) AS frac_late', 'avg(frac_early) AS frac_early')} FROM tot GROUP BY dataset, max_rul, model""")
def earliness_summary(spark, path):
    hist = metrics.earliness(predictions(spark, path), PCELL, ERROR_EDGES)
    return rounded(compare.earliness_summary(hist, PCELL))


@query("cost_summary", "A24", f"""WITH {COST_SQL} SELECT dataset, max_rul, model, cost_ratio, {rnd('avg(cost) AS cost', digits=4)}
FROM costs GROUP BY dataset, max_rul, model, cost_ratio""")
def cost_summary(spark, path):
    return rounded(compare.cost_summary(metrics.cost_curve(predictions(spark, path), PCELL, RATIOS)), 4)


@query("horizon_summary", "A24 P9", f"""WITH {HORIZON_SQL} SELECT dataset, max_rul, n_units,
  CASE WHEN loss IN ('', 'native') THEN model ELSE model || '[' || loss || ']' END AS label, bin_lo, bin_hi,
  {rnd('avg(mae_clipped) AS mae_mean', 'stddev_pop(mae_clipped) AS mae_std', 'avg(bias) AS bias_mean',
       'stddev_pop(bias) AS bias_std')} FROM horizon WHERE NOT is_all GROUP BY ALL""")
def horizon_summary(spark, path):
    return rounded(compare.horizon_summary(horizon(spark, path)))


@query("bin_labels", "P10", f"""WITH {HORIZON_SQL} SELECT {PKEYS}, n_bin, CASE WHEN bin_lo IS NULL THEN 'all'
  WHEN isinf(bin_hi) THEN '≥' || bin_lo::BIGINT ELSE bin_lo::BIGINT || '–' || bin_hi::BIGINT END AS bin FROM horizon""")
def bin_labels(spark, path):
    return horizon(spark, path).select(*PCELL, "n_bin", bin_label(F.col("bin_lo"), F.col("bin_hi")).alias("bin"))


@query("series_labels", "P9", f"""WITH {PREDS_SQL} SELECT CASE WHEN loss = 'native' THEN model ELSE model || '[' || loss || ']' END AS label,
  count(*) AS n FROM preds GROUP BY 1""")
def series_labels(spark, path):
    label = series_label(F.col("model"), F.col("loss")).alias("label")
    return predictions(spark, path).groupBy(label).agg(F.count("*").alias("n"))


@query("pinball_loss", "F2 J12", f"""WITH {PREDS_SQL}, q AS (SELECT unnest([0.1e0, 0.5e0, 0.9e0]) AS q),
e AS (SELECT {PKEYS}, q, true_rul - (pred + (q - 0.5e0) * 10e0) AS e FROM preds, q)
SELECT {PKEYS}, {rnd('avg(greatest(q * e, (q - 1e0) * e)) AS pinball')} FROM e GROUP BY {PKEYS}""")
def pinball_loss(spark, path):
    bands = F.array(*[F.col("pred") + F.lit(q - 0.5) * 10.0 for q in LEVELS])
    return rounded(metrics.pinball_loss(predictions(spark, path).withColumn("bands", bands), PCELL, "bands", LEVELS))


@query("rul_bins", "F3 F4 F8", """SELECT event_id, least(24, greatest(0, floor(value / 5e0)))::BIGINT AS bin,
  round((least(24, greatest(0, floor(value / 5e0))) + 0.5e0) * 5e0, 6) + 0e0 AS centre, round(value / 125e0, 6) + 0e0 AS target FROM events""")
def rul_bins(spark, path):
    b = ordinal.rul_to_bin(F.col("value"), 125, 25)
    return rounded(table(spark, path, "events").select(
        "event_id", b.alias("bin"), ordinal.bin_to_rul(b, 125, 25).alias("centre"),
        ordinal.scale_target(F.col("value"), 125).alias("target")))


_SIG = "(1e0 / (1e0 + exp(-(embedding[{i}]::DOUBLE * 20e0))))"
_P = [" * ".join(_SIG.format(i=j) for j in range(1, k + 1)) for k in range(1, 5)]


@query("ordinal_ranks", "F5 F6", f"""SELECT vec_id, {rnd(' + '.join(_P) + ' AS expected')},
  {' + '.join(f"({p} > 0.5)::INT" for p in _P)}::DOUBLE AS argmax FROM embeddings""")
def ordinal_ranks(spark, path):
    logits = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * 20.0)
    return rounded(table(spark, path, "embeddings").select(
        "vec_id", ordinal.expected_rank(logits).alias("expected"), ordinal.argmax_rank(logits).alias("argmax")))


@query("decode_heads", "F7", f"""SELECT vec_id, {rnd(
  'least(125e0, greatest(0e0, embedding[1]::DOUBLE * 5e0 * 125e0)) AS mse',
  f"least(125e0, greatest(0e0, ({' + '.join(_P)} + 0.5e0) * 25e0)) AS corn",
  'least(125e0, greatest(0e0, embedding[2]::DOUBLE * 5e0 * 125e0)) AS quantile')} FROM embeddings""")
def decode_heads(spark, path):
    e = F.col("embedding")
    logits = F.transform(F.slice(e, 1, 4), lambda x: x.cast("double") * 20.0)
    outs = F.transform(F.slice(e, 1, 3), lambda x: x.cast("double") * 5.0)
    return rounded(table(spark, path, "embeddings").select(
        "vec_id", ordinal.decode(outs, "mse", 125).alias("mse"),
        ordinal.decode(logits, "corn", 125, bins=5).alias("corn"),
        ordinal.decode(outs, "quantile", 125).alias("quantile")))


@query("select_arm", "P11", f"""WITH {PREDS_SQL}, pick AS (SELECT max(n_units) AS n FROM preds WHERE dataset = 'north')
SELECT model, loss, unit_number, time_cycles, {rnd('true_rul', 'pred')} FROM preds, pick
WHERE dataset = 'north' AND n_units = n AND seed = 0""")
def select_arm(spark, path):
    arm = compare.select_arm(predictions(spark, path), dataset="north", seed=9)
    return rounded(arm.select("model", "loss", UNIT, CYCLE, "true_rul", "pred"))


@query("content_keys", "S9", """SELECT o_orderkey, substr(sha256('{"cap":' || o_custkey || ',"model":"' || o_orderpriority
  || '","n":' || o_orderkey || '}'), 1, 16) AS content_key FROM orders""")
def content_keys(spark, path):
    facts = F.struct(F.col("o_custkey").alias("cap"), F.col("o_orderpriority").alias("model"), F.col("o_orderkey").alias("n"))
    return table(spark, path, "orders").select(
        "o_orderkey", content_key(facts).alias("content_key"))
