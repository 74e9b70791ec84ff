"""Sliding windows, contexts, statistics over them, scalers and head-feature layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlife.config import CYCLE, KEYS, UNIT
from fleetlife.functions import arrays
from fleetlife.models import indicators
from fleetlife.operators import features as heads
from fleetlife.operators import sampling, windows

from .base import (
    CAP, CELL, CHANNELS, CONTEXT, FEATURES_SQL, FLEET_SQL, MEMBERS_SQL, WINDOW, cells, features, fleet, query, rnd, rounded, table,
)

W, L = WINDOW, CONTEXT
_KEYS = "dataset, unit_number"
_ENDS = f"{_KEYS}, time_cycles AS end_cycle"


def _over(n):
    return f"OVER (PARTITION BY unit_number ORDER BY time_cycles ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _array_facts(df, column):
    """Scalars that describe an array of structs: size, ends and sums of its channels."""
    def total(c):
        return F.aggregate(F.transform(column, lambda s: s[c]), F.lit(0.0), lambda a, v: a + v)

    return df.select(*KEYS, "end_cycle", "label", F.size(column).cast("bigint").alias("size"),
                     F.element_at(column, 1)["s_1"].alias("first_1"), F.element_at(column, -1)["s_1"].alias("last_1"),
                     total("s_1").alias("sum_1"), total("s_2").alias("sum_2"))


def _facts_sql(n, label):
    return (f"{_ENDS}, {rnd(label + ' AS label')}, count(*) {_over(n)} AS size, "
            + rnd(f"first(s_1) {_over(n)} AS first_1", "s_1 AS last_1", f"sum(s_1) {_over(n)} AS sum_1",
                  f"sum(s_2) {_over(n)} AS sum_2"))


@query("sliding_windows", "W3", f"""WITH {FLEET_SQL} SELECT * FROM (SELECT {_facts_sql(W, 'clipped_rul')} FROM fleet WHERE split = 'train')
WHERE end_cycle >= {W}""")
def sliding_windows(spark, path):
    return rounded(_array_facts(windows.sliding_windows(fleet(spark, path, "train"), CHANNELS, W), "win"))


@query("last_windows", "W4", f"""WITH {FLEET_SQL}, r AS (SELECT *, count(*) OVER (PARTITION BY unit_number) AS n FROM fleet WHERE split = 'test'),
l AS (SELECT {_KEYS}, max(time_cycles) AS end_cycle, max(CASE WHEN time_cycles = n THEN actual_rul END) AS label,
  any_value(n) AS n, sum(s_1) FILTER (time_cycles > n - 30) AS t1, sum(s_2) FILTER (time_cycles > n - 30) AS t2,
  max(CASE WHEN time_cycles = greatest(1, n - 29) THEN s_1 END) AS f1, max(CASE WHEN time_cycles = greatest(1, n - 29) THEN s_2 END) AS f2,
  max(CASE WHEN time_cycles = n THEN s_1 END) AS l1 FROM r GROUP BY {_KEYS})
SELECT {_KEYS}, end_cycle, {rnd('label')}, 30::BIGINT AS size, {rnd('f1 AS first_1', 'l1 AS last_1',
  't1 + greatest(0, 30 - n) * f1 AS sum_1', 't2 + greatest(0, 30 - n) * f2 AS sum_2')} FROM l""")
def last_windows(spark, path):
    return rounded(_array_facts(windows.last_windows(fleet(spark, path, "test"), CHANNELS, 30), "win"))


@query("long_enough_windows", "W4", f"""WITH {FLEET_SQL}, r AS (SELECT *, count(*) OVER (PARTITION BY unit_number) AS n FROM fleet WHERE split = 'test')
SELECT {_KEYS}, max(time_cycles) AS end_cycle, {rnd('sum(s_1) FILTER (time_cycles > n - 40) AS sum_1')} FROM r WHERE n >= 40 GROUP BY {_KEYS}""")
def long_enough_windows(spark, path):
    wins = windows.last_windows(fleet(spark, path, "test"), CHANNELS, 40, pad=False)
    return rounded(_array_facts(wins, "win").select(*KEYS, "end_cycle", "sum_1"))


@query("contexts", "W5", f"""WITH {FLEET_SQL} SELECT * FROM (SELECT {_facts_sql(L, 'clipped_rul')} FROM fleet WHERE split = 'train')
WHERE end_cycle >= {W}""")
def contexts(spark, path):
    return rounded(_array_facts(windows.contexts(fleet(spark, path, "train"), CHANNELS, W, L), "ctx"))


@query("last_contexts", "W6", f"""WITH {FLEET_SQL} SELECT * EXCLUDE (n_obs) FROM (SELECT {_facts_sql(L, 'actual_rul')}, n_obs FROM fleet WHERE split = 'test')
WHERE end_cycle = n_obs""")
def last_contexts(spark, path):
    return rounded(_array_facts(windows.last_contexts(fleet(spark, path, "test"), CHANNELS, L), "ctx"))


@query("horizon_contexts", "W7", f"""WITH {FLEET_SQL} SELECT * FROM (SELECT {_facts_sql(L, 'actual_rul')} FROM fleet WHERE split = 'test')
WHERE end_cycle >= {W}""")
def horizon_contexts(spark, path):
    return rounded(_array_facts(windows.contexts(fleet(spark, path, "test"), CHANNELS, W, L, "actual_rul"), "ctx"))


@query("alignment_gaps", "J9", f"""WITH {FLEET_SQL}, a AS (SELECT {_ENDS}, clipped_rul AS label FROM fleet WHERE split = 'train' AND time_cycles >= {W}),
b AS (SELECT {_ENDS}, clipped_rul AS label FROM fleet WHERE split = 'train' AND time_cycles >= 20)
SELECT {_KEYS}, end_cycle, {rnd('a.label AS a_label', 'b.label AS b_label')} FROM a FULL JOIN b USING (dataset, unit_number, end_cycle)
WHERE a.label IS DISTINCT FROM b.label""")
def alignment_gaps(spark, path):
    train = fleet(spark, path, "train")
    a = windows.sliding_windows(train, CHANNELS, W)
    return rounded(windows.alignment_gaps(a, windows.contexts(train, CHANNELS, 20, L)))


@query("last_raw_values", "W9", f"""WITH {FLEET_SQL} SELECT {_ENDS}, {rnd('s_1', 's_2')} FROM fleet WHERE split = 'train' AND time_cycles >= {W}""")
def last_raw_values(spark, path):
    wins = windows.sliding_windows(fleet(spark, path, "train"), CHANNELS, W)
    last = windows.last_raw(F.col("win"))
    return rounded(wins.select(*KEYS, "end_cycle", last["s_1"].alias("s_1"), last["s_2"].alias("s_2")))


def _stat_sql(c, n=W):
    o = _over(n)
    return (f"avg({c}) {o} AS {c}_mean", f"stddev_pop({c}) {o} AS {c}_std", f"min({c}) {o} AS {c}_min", f"max({c}) {o} AS {c}_max",
            *[f"quantile_cont({c}, {q / 100}) {o} AS {c}_q{q}" for q in (25, 50, 75)],
            f"regr_slope({c}, time_cycles::DOUBLE) {o} AS {c}_slope", f"{c}::DOUBLE AS {c}_last")


_STATS = [f"{c}_{s}" for s in windows.STATS for c in ("s_1", "s_2")]


@query("window_statistics", "W10 W11", f"""WITH {FLEET_SQL}, s AS (SELECT {_ENDS}, clipped_rul AS label,
  {', '.join(x for c in ('s_1', 's_2') for x in _stat_sql(c))} FROM fleet WHERE split = 'train')
SELECT {_KEYS}, end_cycle, {rnd('label', *_STATS)} FROM s WHERE end_cycle >= {W}""")
def window_statistics(spark, path):
    return rounded(windows.window_stats(fleet(spark, path, "train"), ["s_1", "s_2"], W))


_AGE = [f"{c}_{s}" for s in windows.STATS for c in ("age", "s_1")]


@query("last_window_statistics", "W10 W11", f"""WITH {FLEET_SQL}, t AS (SELECT *, time_cycles AS age FROM fleet WHERE split = 'test'),
s AS (SELECT {_ENDS}, actual_rul AS label, n_obs, {', '.join(x for c in ('age', 's_1') for x in _stat_sql(c))} FROM t)
SELECT {_KEYS}, end_cycle, {rnd('label', *_AGE)} FROM s WHERE end_cycle = n_obs""")
def last_window_statistics(spark, path):
    test = fleet(spark, path, "test").withColumn("age", F.col(CYCLE))
    return rounded(windows.last_window_stats(test, ["age", "s_1"], W))


@query("loc_scale", "A21", f"""WITH {FLEET_SQL} SELECT * FROM (SELECT {_ENDS}, {', '.join(rnd(f'avg({c}) {_over(L)} AS {c}_loc',
  f'stddev_pop({c}) {_over(L)} AS {c}_scale') for c in CHANNELS)} FROM fleet) WHERE end_cycle >= {W}""")
def loc_scale(spark, path):
    return rounded(windows.loc_scale(fleet(spark, path), CHANNELS, L, W))


@query("channel_scaler", "A4", f"""WITH {FLEET_SQL}, x AS (SELECT a.dataset, b.s_1, b.s_2, b.s_3 FROM fleet a JOIN fleet b ON a.unit_number = b.unit_number
  AND b.time_cycles BETWEEN a.time_cycles - {W - 1} AND a.time_cycles WHERE a.split = 'train' AND a.time_cycles >= {W})
SELECT dataset, count(*)::DOUBLE AS weight, {', '.join(rnd(f'avg({c}) AS {c}_mean', f'stddev_pop({c}) AS {c}_std') for c in CHANNELS)} FROM x GROUP BY dataset""")
def channel_scaler(spark, path):
    return rounded(windows.channel_scaler(fleet(spark, path, "train"), CHANNELS, W))


@query("feature_standardizer", "A5", f"""WITH {FEATURES_SQL}, {MEMBERS_SQL} SELECT f.dataset, n_units, seed,
  {rnd('avg(m_1) AS m_1_mean', 'stddev_samp(m_1) AS m_1_std', 'avg(s_2) AS s_2_mean', 'stddev_samp(s_2) AS s_2_std')}
FROM feats f JOIN members m ON f.dataset = m.dataset AND f.unit_number = m.unit_number AND m.role = 'train' GROUP BY f.dataset, n_units, seed""")
def feature_standardizer(spark, path):
    train = features(spark, path).where("split = 'train'").select(*KEYS, "m_1", "s_2")
    rows = sampling.cell_rows(train, cells(spark, path)).where("role = 'train'")
    return rounded(heads.fit_standardizer(rows, ["m_1", "s_2"], CELL))


def _patches():
    """The 64-wide embedding seen as 4 variates x 4 patches x 4 dims; two patches are special."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda v: F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda p: F.slice(e, v * 16 + p * 4 + 1, 4)))


def _e(v, p, d):
    return f"embedding[{v * 16 + p * 4 + d + 1}]::DOUBLE"


_POOL_SQL = {
    "forecast_token": lambda v, d: _e(v, 3, d), "last_content": lambda v, d: _e(v, 1, d),
    "mean": lambda v, d: f"({_e(v, 0, d)} + {_e(v, 1, d)}) / 2",
}


def _checks(expr):
    """Length, first, last and weighted sum of an array."""
    total = F.aggregate(F.transform(expr, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return F.size(expr), F.element_at(expr, 1), F.element_at(expr, -1), total


@query("patch_pooling", "F9 F10", "SELECT vec_id, " + ", ".join(
    f"16 AS {s}_n, " + rnd(f"{f(0, 0)} AS {s}_first", f"{f(3, 3)} AS {s}_last",
                           " + ".join(f"{v * 4 + d + 1} * ({f(v, d)})" for v in range(4) for d in range(4)) + f" AS {s}_sum")
    for s, f in _POOL_SQL.items()) + ", 32 AS flatten_n, " + rnd(
        f"{_e(0, 0, 0)} AS flatten_first", f"{_e(3, 1, 3)} AS flatten_last",
        " + ".join(f"{v * 8 + p * 4 + d + 1} * {_e(v, p, d)}" for v in range(4) for p in range(2) for d in range(4)) + " AS flatten_sum")
    + " FROM embeddings")
def patch_pooling(spark, path):
    base = table(spark, path, "embeddings").select("vec_id", _patches().alias("patches"))
    cols = []
    for s in ("forecast_token", "last_content", "mean", "flatten"):
        n, first, last, total = _checks(arrays.pool_window(F.col("patches"), s))
        cols += [n.alias(f"{s}_n"), first.alias(f"{s}_first"), last.alias(f"{s}_last"), total.alias(f"{s}_sum")]
    return rounded(base.select("vec_id", *cols))


@query("variate_mean", "F10", "SELECT vec_id, " + ", ".join(rnd(
    "(" + " + ".join(f"({_e(v, 0, d)} + {_e(v, 1, d)}) / 2" for v in range(4)) + f") / 4 AS d{d}") for d in range(4)) + " FROM embeddings")
def variate_mean(spark, path):
    pooled = arrays.pool_window(_patches(), "mean", "mean")
    return rounded(table(spark, path, "embeddings").select("vec_id", pooled.alias("p")).select(
        "vec_id", *[F.get("p", F.lit(d)).alias(f"d{d}") for d in range(4)]))


_LS = [f"embedding[{i}]::DOUBLE" for i in range(1, 5)]


@query("head_features", "F11 F12", f"""WITH b AS (SELECT vec_id, label % 2 AS part, {', '.join(f'{x} AS l{i}' for i, x in enumerate(_LS))}, embedding[64]::DOUBLE AS raw, embedding[60]::DOUBLE AS e FROM embeddings),
s AS (SELECT part, {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in ('l0', 'l1', 'l2', 'l3', 'raw'))} FROM b WHERE label_train GROUP BY part)
SELECT vec_id, 6 AS width, {rnd('e AS h0', *[f'({c} - m_{c}) / s_{c} AS h{i}' for i, c in enumerate(('l0', 'l1', 'l2', 'l3', 'raw'), 1)])} FROM b JOIN s USING (part)"""
       .replace("WHERE label_train ", ""))
def head_features(spark, path):
    e = F.transform("embedding", lambda x: x.cast("double"))
    ls = F.array(F.struct(e[0].alias("loc"), e[1].alias("scale")), F.struct(e[2].alias("loc"), e[3].alias("scale")))
    rows = table(spark, path, "embeddings").select(
        "vec_id", (F.col("label") % 2).alias("part"), F.array(e[59]).alias("emb"), ls.alias("locscale"), e[63].alias("raw"))
    out = heads.head_features(rows, rows, "emb+locscale+raw", 2, ["raw"], ["part"])
    return rounded(out.select("vec_id", F.size("head").alias("width"), *[F.get("head", F.lit(i)).alias(f"h{i}") for i in range(6)]))


_EXP = "0.36787944117144233e0"
_IND_SQL = f"""ends AS (SELECT dataset, unit_number, time_cycles AS end_cycle FROM fleet WHERE split = 'train' AND time_cycles >= {W}),
x AS (SELECT e.dataset, e.unit_number, e.end_cycle, f.time_cycles - e.end_cycle + {W} AS p, f.s_1 AS x FROM ends e JOIN fleet f
  ON f.unit_number = e.unit_number AND f.time_cycles BETWEEN e.end_cycle - {W - 1} AND e.end_cycle),
z AS (SELECT *, x - avg(x) OVER g AS z, min(x) OVER g AS lo, max(x) OVER g AS hi, lag(x) OVER o AS px FROM x
  WINDOW g AS (PARTITION BY unit_number, end_cycle), o AS (PARTITION BY unit_number, end_cycle ORDER BY p)),
en AS (SELECT unit_number, end_cycle, sum(z * z) AS energy FROM z GROUP BY ALL),
pr AS (SELECT a.unit_number, a.end_cycle, b.p - a.p AS k, sum(a.z * b.z) AS s FROM z a JOIN z b
  ON a.unit_number = b.unit_number AND a.end_cycle = b.end_cycle AND b.p > a.p GROUP BY ALL),
ac AS (SELECT unit_number, end_cycle, k, s / energy AS r FROM pr JOIN en USING (unit_number, end_cycle)),
acs AS (SELECT unit_number, end_cycle, max(CASE WHEN k = 1 THEN r END) AS acf1, max(CASE WHEN k = 2 THEN r END) AS acf2,
  coalesce(min(CASE WHEN r < {_EXP} THEN k END), {W})::DOUBLE AS acf_drop,
  sum(CASE WHEN k <= 3 THEN r * r END) / sum(r * r) AS low_share FROM ac GROUP BY ALL),
runs AS (SELECT unit_number, end_cycle, count(*) AS len FROM (SELECT *, p - row_number() OVER (PARTITION BY unit_number, end_cycle ORDER BY p) AS isle
  FROM z WHERE z > 0) GROUP BY unit_number, end_cycle, isle),
best AS (SELECT unit_number, end_cycle, max(len)::DOUBLE AS longest_above FROM runs GROUP BY ALL),
st AS (SELECT dataset, unit_number, end_cycle, max(abs(x - px)) AS max_diff,
  sum(((z > 0) <> (pz > 0))::INT) / ({W - 1})::DOUBLE AS crossings FROM (SELECT *, lag(z) OVER (PARTITION BY unit_number, end_cycle ORDER BY p) AS pz FROM z) GROUP BY ALL),
hb AS (SELECT unit_number, end_cycle, least(4, floor((x - lo) / (hi - lo) * 5)) AS b, count(*) AS c FROM z GROUP BY ALL),
hm AS (SELECT unit_number, end_cycle, arg_min(b, (-c, b))::DOUBLE AS mode_bin FROM hb GROUP BY ALL)"""


@query("window_indicators", "M7", f"""WITH {FLEET_SQL}, {_IND_SQL}
SELECT dataset, unit_number, end_cycle, {rnd(*[f'{n} AS s_1_{n}' for n in indicators.INDICATORS])}
FROM st JOIN acs USING (unit_number, end_cycle) JOIN best USING (unit_number, end_cycle) JOIN hm USING (unit_number, end_cycle)""")
def window_indicators(spark, path):
    wins = windows.sliding_windows(fleet(spark, path, "train"), ["s_1"], W)
    return rounded(indicators.window_indicators(wins, ["s_1"], W).drop("label"))
