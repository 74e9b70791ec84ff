"""Linear models of all cells from Gram matrices, with normal equations solved in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlife.config import CYCLE, UNIT
from fleetlife.functions.arrays import flatten_locscale
from fleetlife.models import embed, gram, kernels, ordinal
from fleetlife.operators import metrics, windows
from fleetlife.operators.sampling import CELL
from fleetlife.plans import ablation, sweep, transfer

from .base import CAP, FEATURES_SQL, FLEET_SQL, MEMBERS_SQL, PCELL, WINDOW, cells, features, fleet, query, rnd, rounded, s_metrics
from .fitting import DIMS, HC, SCALE, _projection

L2 = (1e-3,)


def scores(train, test, plan, column, model, loss, **options):
    """Result rows of a linear model for all cells."""
    preds = sweep.ridge_predictions(train, test, plan, column, model, loss, CAP, **options)
    return rounded(metrics.evaluate(preds, PCELL, CAP), 4)


# ---- SQL: sums per cell, elimination, choice of the penalty --------------------------------------
def solve_sql(d: int, cell: str, alphas, scaled=()) -> str:
    """CTEs from ``tr`` (the columns of ``cell``, role, y, x_0 .. x_{d-1}) to ``best`` (cell, w_0 .., ic). The elimination of a
    symmetric matrix needs no pivots."""
    x = range(d)
    sums = ", ".join([f"sum(x_{i}) AS s_{i}, sum(x_{i} * y) AS c_{i}" for i in x]
                     + [f"sum(x_{i} * x_{j}) AS q_{i}_{j}" for i in x for j in x if j >= i])
    unit = [f"(CASE WHEN n > 1 AND sqrt(greatest(q_{i}_{i} - s_{i} * s_{i} / n, 0) / (n - 1)) > {gram.STD_GUARD!r}::DOUBLE "
            f"THEN sqrt(greatest(q_{i}_{i} - s_{i} * s_{i} / n, 0) / (n - 1)) ELSE 1 END)" if i in scaled else "1e0" for i in x]
    units = ", ".join(f"{u} AS u_{i}" for i, u in enumerate(unit))
    system = ", ".join([f"(q_{i}_{j} - s_{i} * s_{j} / n) / (u_{i} * u_{j}){' + alpha' if i == j else ''} AS a_{i}_{j}" for i in x for j in x if j >= i]
                       + [f"(c_{i} - s_{i} * sy / n) / u_{i} AS b_{i}" for i in x])
    steps, last = [], "e0"
    for k in range(d - 1):
        new = ", ".join([f"a_{i}_{j} - a_{k}_{i} * a_{k}_{j} / a_{k}_{k} AS a_{i}_{j}" for i in range(k + 1, d) for j in range(i, d)]
                        + [f"b_{i} - a_{k}_{i} * b_{k} / a_{k}_{k} AS b_{i}" for i in range(k + 1, d)])
        steps.append(f"e{k + 1} AS (SELECT * REPLACE ({new}) FROM e{k})")
        last = f"e{k + 1}"
    for k in reversed(x):
        rest = "".join(f" - a_{k}_{j} * z_{j}" for j in range(k + 1, d))
        steps.append(f"f{k} AS (SELECT *, (b_{k}{rest}) / a_{k}_{k} AS z_{k} FROM {last})")
        last = f"f{k}"
    weights = ", ".join(f"z_{i} / u_{i} AS w_{i}" for i in x)
    inner = " + ".join(f"w_{i} * s_{i}" for i in x)
    side = lambda p: (f"{p}.syy - 2 * ic * {p}.sy + {p}.n * ic * ic"
                      + "".join(f" - 2 * f.w_{i} * {p}.c_{i} + 2 * ic * f.w_{i} * {p}.s_{i}" for i in x)
                      + "".join(f" + {'' if i == j else '2 * '}f.w_{i} * f.w_{j} * {p}.q_{i}_{j}" for i in x for j in x if j >= i))
    return f"""g AS (SELECT {cell}, role, count(*)::DOUBLE AS n, sum(y) AS sy, sum(y * y) AS syy, {sums} FROM tr GROUP BY {cell}, role),
t AS (SELECT *, {units} FROM g WHERE role = 'train'),
e0 AS (SELECT *, {system} FROM t, (SELECT unnest([{', '.join(repr(float(a)) + '::DOUBLE' for a in alphas)}]) AS alpha)),
{', '.join(steps)},
fitted AS (SELECT *, (sy - ({inner})) / n AS ic FROM (SELECT *, {weights} FROM {last})),
judged AS (SELECT f.*, CASE WHEN v.n IS NULL THEN {side('f')} ELSE {side('v')} END AS err
  FROM fitted f LEFT JOIN (SELECT * FROM g WHERE role = 'val') v USING ({cell})),
best AS (SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY {cell} ORDER BY err, alpha) = 1)"""


def ridge_sql(d: int, model: str, loss: str, alphas, scaled=()) -> str:
    """CTEs after ``hx`` (dataset, split, unit_number, end_cycle, n_obs, y: label, truth, x_0 .. x_{d-1}) and ``members`` that
    end in ``preds``."""
    values = " + ".join(f"w_{i} * x_{i}" for i in range(d))
    return f"""tr AS (SELECT h.*, m.n_units, m.seed, m.role FROM hx h JOIN members m ON m.dataset = h.dataset AND m.unit_number = h.unit_number
  WHERE h.split = 'train'),
{solve_sql(d, 'dataset, n_units, seed', alphas, scaled)},
preds AS (SELECT '{model}' AS model, h.dataset, {CAP}::DOUBLE AS max_rul, b.n_units, b.seed, '{loss}' AS loss, h.truth AS true_rul,
  greatest(0e0, least(ic + {values}, {CAP}::DOUBLE)) AS pred FROM hx h JOIN best b ON b.dataset = h.dataset
  WHERE h.split = 'test' AND h.end_cycle = h.n_obs)"""


def scores_sql(head: str, d: int, model: str, loss: str, alphas, scaled=()) -> str:
    keys = ", ".join(PCELL)
    return f"""WITH {head}, {MEMBERS_SQL}, {ridge_sql(d, model, loss, alphas, scaled)}
SELECT {keys}, n, {rnd(*metrics.METRICS, digits=4)} FROM (SELECT {keys}, {s_metrics()} FROM preds GROUP BY {keys})"""


_OV = "OVER (PARTITION BY unit_number ORDER BY time_cycles ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"
_EMB = [[f"tanh(avg({c}) {_OV} * {embed.weight(7, i, d) / SCALE!r}::DOUBLE)" for d in range(DIMS)] for i, c in enumerate(HC)]


def _head_sql(parts: list[str]) -> str:
    named = ", ".join(f"{p} AS x_{i}" for i, p in enumerate(parts))
    return FLEET_SQL + f""", hx AS (SELECT * FROM (SELECT dataset, split, unit_number, time_cycles AS end_cycle, n_obs, clipped_rul AS y, actual_rul AS truth,
  {named} FROM fleet) WHERE end_cycle >= {WINDOW})"""


def _heads(spark, path, column):
    """Contexts with the head's inputs in ``x``: train rows, and the last context of test units."""
    def rows(split, label):
        return _projection(spark, path, split, (label, "n_obs")).withColumn("x", column).withColumnRenamed(label, "label")

    test = rows("test", "actual_rul").where("end_cycle = n_obs").withColumnRenamed("label", "true_rul")
    return rows("train", "clipped_rul"), test


_LOCSCALE = [f"{f}({c}) {_OV}" for c in HC for f in ("avg", "stddev_pop")]


@query("linear_head_cells", "M8 M11 F12", scores_sql(_head_sql([e for v in _EMB for e in v] + _LOCSCALE), 8, "linear_mlp", "mse", L2, range(4, 8)))
def linear_head_cells(spark, path):
    column = F.concat(F.flatten("emb"), flatten_locscale(F.col("locscale")))
    return scores(*_heads(spark, path, column), cells(spark, path), "x", "linear_mlp", "mse", alphas=L2, scaled=range(4, 8))


@query("representation_native", "X5 M8 M11", scores_sql(_head_sql([e for v in _EMB for e in v]), 4, "linear_native", "mse", L2))
def representation_native(spark, path):
    return scores(*_heads(spark, path, F.flatten("emb")), cells(spark, path), "x", "linear_native", "mse", alphas=L2)


@query("representation_common", "X5 M8 M11", scores_sql(_head_sql([f"({a} + {b}) / 2" for a, b in zip(*_EMB)]), 2, "linear_common", "mse", L2))
def representation_common(spark, path):
    column = F.zip_with(F.get("emb", F.lit(0)), F.get("emb", F.lit(1)), lambda a, b: (a + b) / 2)
    return scores(*_heads(spark, path, column), cells(spark, path), "x", "linear_common", "mse", alphas=L2)


_FEATS = FEATURES_SQL + ", hx AS (SELECT dataset, split, unit_number, time_cycles AS end_cycle, n_obs, label AS y, actual_rul AS truth, m_1 AS x_0, s_3 AS x_1 FROM feats)"


@query("ridge_cells", "M6 M11", scores_sql(_FEATS, 2, "ridge", "native", gram.ALPHAS))
def ridge_cells(spark, path):
    rows = features(spark, path).withColumn("x", F.array("m_1", "s_3"))
    test = rows.where(f"split = 'test' AND {CYCLE} = n_obs").withColumnRenamed("actual_rul", "true_rul")
    return scores(rows.where("split = 'train'"), test.withColumnRenamed(CYCLE, "end_cycle"), cells(spark, path), "x", "ridge", "native")


@query("kernel_ridge_cells", "M6 M11")
def kernel_ridge_cells(spark, path):
    """All kernels of three channels, all ten penalties, every cell."""
    channels = ["s_1", "s_2", "s_3"]
    train = windows.sliding_windows(fleet(spark, path, "train"), channels, WINDOW)
    test = windows.last_windows(fleet(spark, path, "test"), channels, WINDOW).withColumnRenamed("label", "true_rul")
    made = [kernels.kernel_features(w, channels, WINDOW, seed=3) for w in (train, test)]
    return scores(*made, cells(spark, path), "kernels", "kernel_ridge", "native")


# ---- transfer -----------------------------------------------------------------------------------
PAIRS, SHOTS = [("north", "south"), ("south", "north")], [2, 5, 10, 25]
_ARM = "mode, source_dataset, target_dataset, n_target_units, seed"
_X = ", ".join(f"x_{i}" for i in range(8))


def _transfer_sql() -> str:
    values = " + ".join(f"w_{i} * x_{i}" for i in range(8))
    return f"""WITH {_head_sql([e for v in _EMB for e in v] + _LOCSCALE)}, {MEMBERS_SQL},
pairs AS (SELECT * FROM (VALUES {', '.join(map(str, PAIRS))}) AS p(source_dataset, target_dataset)),
src AS (SELECT p.*, m.seed, m.role, y, {_X} FROM pairs p JOIN avail a ON a.dataset = p.source_dataset
  JOIN members m ON m.dataset = a.dataset AND m.n_units = a.available JOIN hx h ON h.dataset = m.dataset AND h.unit_number = m.unit_number AND h.split = 'train'),
tgt AS (SELECT p.*, m.n_units AS n_target_units, m.seed, m.role, y, {_X} FROM pairs p JOIN members m ON m.dataset = p.target_dataset
  AND m.n_units IN ({', '.join(map(str, SHOTS))}) JOIN hx h ON h.dataset = m.dataset AND h.unit_number = m.unit_number AND h.split = 'train'),
ks AS (SELECT DISTINCT target_dataset, seed, n_target_units FROM tgt),
tr AS (SELECT 'zero_shot' AS mode, 0::BIGINT AS n_target_units, * FROM src UNION ALL BY NAME SELECT 'target_only' AS mode, * FROM tgt
  UNION ALL BY NAME SELECT 'source+target' AS mode, * FROM tgt UNION ALL BY NAME SELECT 'source+target' AS mode, src.*, n_target_units FROM src JOIN ks USING (target_dataset, seed)),
{solve_sql(8, _ARM, L2, range(4, 8))},
preds AS (SELECT {', '.join('b.' + c for c in _ARM.split(', '))}, h.truth AS true_rul, greatest(0e0, least(ic + {values}, {CAP}::DOUBLE)) AS pred
  FROM hx h JOIN best b ON b.target_dataset = h.dataset WHERE h.split = 'test' AND h.end_cycle = h.n_obs)
SELECT 'linear_mlp' AS model, 'mse' AS loss, {_ARM}, n, {rnd(*metrics.METRICS, digits=4)} FROM (SELECT {_ARM}, {s_metrics()} FROM preds GROUP BY {_ARM})"""


@query("transfer_heads", "X9 U2 M8", _transfer_sql())
def transfer_heads(spark, path):
    column = F.concat(F.flatten("emb"), flatten_locscale(F.col("locscale")))
    train, test = _heads(spark, path, column)
    return rounded(transfer.head_transfer(train, test, cells(spark, path), PAIRS, SHOTS, "x", "linear_mlp", "mse", CAP, L2, range(4, 8)), 4)


# ---- ordinal head -------------------------------------------------------------------------------
BINS = 25


@query("ordinal_head_cells", "M9 M11", f"""WITH {FLEET_SQL}, {MEMBERS_SQL}, t AS (SELECT dataset, count(DISTINCT unit_number) AS n FROM fleet
  WHERE split = 'test' GROUP BY dataset)
SELECT 'ordinal_mlp' AS model, 'corn' AS loss, c.dataset, c.n_units, c.seed, {BINS - 1}::BIGINT AS n_tasks, t.n, true AS in_range, true AS fits
FROM cells c JOIN t ON t.dataset = c.dataset""")
def ordinal_head_cells(spark, path):
    """Per cell: test units predicted, all predictions in range, and no task's loss above that of its classes' shares."""
    column = F.concat(F.flatten("emb"), flatten_locscale(F.col("locscale")))
    train, test = _heads(spark, path, column)
    head = ordinal.fit(train, cells(spark, path), "x", CAP, bins=BINS)
    preds = ordinal.predict(head, test, "x", CAP, [UNIT])
    fits = spark.createDataFrame([(*c, bool((a <= b + 1e-9).all()), len(a)) for c, a, b in zip(head.cells, head.loss, head.base)],
                                 "dataset string, n_units long, seed int, fits boolean, n_tasks long")
    found = preds.groupBy(*CELL).agg(F.count("*").alias("n"), F.expr(f"min(pred) >= 0 AND max(pred) <= {CAP}").alias("in_range"))
    return found.join(fits, CELL).select(F.lit("ordinal_mlp").alias("model"), F.lit("corn").alias("loss"), *CELL, "n_tasks", "n", "in_range", "fits")


# ---- ablation -----------------------------------------------------------------------------------
LENGTHS, PATCH = [12, 24, 36], 12


def _ablation_sql() -> str:
    over = lambda a, b: f"OVER (PARTITION BY unit_number ORDER BY time_cycles ROWS BETWEEN {a} PRECEDING AND {b})"
    patches = ", ".join(f"avg({c}) {over(PATCH * (j + 1) - 1, f'{PATCH * j} PRECEDING' if j else 'CURRENT ROW')} AS p{i}_{j}"
                        for i, c in enumerate(HC) for j in range(max(LENGTHS) // PATCH))
    whole = ", ".join(f"avg({c}) {over(n - 1, 'CURRENT ROW')} AS m{i}_{n}, stddev_pop({c}) {over(n - 1, 'CURRENT ROW')} AS d{i}_{n}"
                      for i, c in enumerate(HC) for n in LENGTHS)
    patch = lambda i, j: f"tanh(p{i}_{j} / {SCALE!r}::DOUBLE)"
    ctx = []
    for n in LENGTHS:
        means = [f"list_avg([{', '.join(patch(i, j) for j in range(n // PATCH))}])" for i in range(2)]
        ctx.append(f"SELECT {n} AS context_length, *, {', '.join(f'{m} AS e{i}' for i, m in enumerate(means))}, "
                   f"{', '.join(f'm{i}_{n} AS m{i}, d{i}_{n} AS d{i}' for i in range(2))} FROM pr")
    pool = ", ".join(f"CASE pooling WHEN 'mean' THEN e{i} WHEN 'last_content' THEN {patch(i, 0)} ELSE tanh({c} / {SCALE!r}::DOUBLE) END AS x_{i}"
                     for i, c in enumerate(HC))
    ls = ", ".join(f"CASE WHEN head_features LIKE '%locscale%' THEN {v} ELSE 0 END AS x_{2 + k}" for k, v in enumerate(("m0", "d0", "m1", "d1")))
    raw = ", ".join(f"CASE WHEN head_features LIKE '%raw' THEN {c} ELSE 0 END AS x_{6 + k}" for k, c in enumerate(HC))
    cell = "dataset, n_units, seed, context_length, head_features, pooling"
    values = " + ".join(f"w_{i} * x_{i}" for i in range(8))
    return f"""WITH {FLEET_SQL}, {MEMBERS_SQL},
pr AS (SELECT * FROM (SELECT *, {patches}, {whole} FROM fleet) WHERE time_cycles >= {WINDOW}),
ctx AS ({' UNION ALL '.join(ctx)}),
arms AS (SELECT context_length, head_features, pooling FROM (SELECT unnest({LENGTHS}) AS context_length),
  (SELECT unnest(['emb', 'emb+locscale', 'emb+locscale+raw']) AS head_features), (SELECT unnest(['mean', 'forecast_token', 'last_content']) AS pooling)
  WHERE head_features <> 'emb+locscale+raw' OR pooling = 'mean'),
ax AS (SELECT c.dataset, split, unit_number, time_cycles, n_obs, clipped_rul AS y, actual_rul AS truth, a.*, {pool}, {ls}, {raw}
  FROM ctx c JOIN arms a ON a.context_length = c.context_length),
tr AS (SELECT ax.*, m.n_units, m.seed, m.role FROM ax JOIN members m ON m.dataset = ax.dataset AND m.unit_number = ax.unit_number
  JOIN avail v ON v.dataset = m.dataset AND v.available = m.n_units WHERE ax.split = 'train'),
{solve_sql(8, cell, L2, range(2, 8))},
preds AS (SELECT {', '.join('b.' + c for c in cell.split(', '))}, truth AS true_rul, greatest(0e0, least(ic + {values}, {CAP}::DOUBLE)) AS pred
  FROM best b JOIN ax ON ax.dataset = b.dataset AND ax.context_length = b.context_length AND ax.head_features = b.head_features AND ax.pooling = b.pooling
  WHERE ax.split = 'test' AND ax.time_cycles = ax.n_obs),
res AS (SELECT {cell}, {s_metrics()} FROM preds GROUP BY {cell}),
winner AS (SELECT context_length, head_features, avg(rmse_clipped) AS m FROM res WHERE pooling = 'mean' AND head_features <> 'emb+locscale+raw'
  GROUP BY ALL ORDER BY m, context_length, head_features LIMIT 1)
SELECT 1 AS phase, {cell}, n, {rnd(*metrics.METRICS, digits=4)} FROM res WHERE pooling = 'mean' AND head_features <> 'emb+locscale+raw'
UNION ALL SELECT 2, {', '.join('r.' + c for c in cell.split(', '))}, n, {rnd(*metrics.METRICS, digits=4)} FROM res r JOIN winner w ON r.context_length = w.context_length
  AND (r.head_features = 'emb+locscale+raw' OR (r.head_features = w.head_features AND r.pooling <> 'mean'))"""


@query("ablation_phases", "X3 A13 F9 F10 F11", _ablation_sql())
def ablation_phases(spark, path):
    def made(rows):
        out = ablation.patch_rows(rows, HC, LENGTHS, PATCH, SCALE, WINDOW, ("n_obs", "clipped_rul", "actual_rul"))
        return out.withColumnsRenamed({"clipped_rul": "label", "actual_rul": "true_rul"})

    # Each part by itself, and of test units only what their last context reaches.
    train = made(fleet(spark, path, "train"))
    test = made(fleet(spark, path, "test").where(F.col(CYCLE) > F.col("n_obs") - max(LENGTHS))).where("end_cycle = n_obs")
    out = ablation.two_phases(train, test, sweep.whole_fleet(cells(spark, path)), LENGTHS, len(HC), CAP, L2[0])
    return rounded(out, 4)
