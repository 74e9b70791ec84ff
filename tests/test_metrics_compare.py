import math

import pytest
from pyspark.sql import functions as F

from rows import tuples
from fleetlife.functions import ordinal
from fleetlife.functions.ttest import t_pvalue
from fleetlife.operators import compare, metrics
from fleetlife.operators.quantiles import weighted_quantile

INF = float("inf")


def test_both_protocols(preds):
    row = metrics.evaluate(preds([150, 10], [125, 20]), ["model"], 125).first()
    assert row["rmse_clipped"] == pytest.approx(math.sqrt(50)) and row["mae_unclipped"] == pytest.approx(17.5)
    assert row["nasa_clipped"] == pytest.approx(math.e - 1) and row["n"] == 2
    assert row["nasa_unclipped"] == pytest.approx(math.e - 1 + math.exp(25 / 13) - 1)


def test_bin_edges(spark):
    assert metrics.bin_edges(125) == [0, 25, 50, 75, 100, 125, INF]
    assert metrics.bin_edges(200)[-4:] == [150, 175, 200, INF]
    assert metrics.bin_edges(30, 20) == [0, 20, 30, INF]
    got = spark.range(1).select(metrics.bin_edges_of(F.lit(30), 20.0)).first()[0]
    assert got == [0, 20, 30, INF]


def test_horizon_bins(preds):
    rows = metrics.horizon_bins(preds([5, 20, 45, 90], [10, 15, 40, 40]), ["model"], 40, [0.0, 25.0, 50.0, INF]).collect()
    got = {(r["bin_lo"], r["bin_hi"]): (r["n_bin"], round(r["mae_clipped"], 6), round(r["bias"], 6)) for r in rows}
    assert got == {(0.0, 25.0): (2, 5.0, 0.0), (25.0, 50.0): (1, 0.0, 0.0), (50.0, INF): (1, 0.0, 0.0), (None, None): (4, 2.5, 0.0)}


def test_earliness(preds):
    rows = metrics.earliness(preds([100, 100], [110, 90]), ["model"], [-50, -25, -10, 0, 10, 25, 50]).orderBy("lo").collect()
    assert len(rows) == 8 and sum(r["frac"] for r in rows) == 1.0
    assert {(r["lo"], r["hi"], r["side"]): r["n_bin"] for r in rows if r["n_bin"]} == {(-10.0, 0.0, "early"): 1, (10.0, 25.0, "late"): 1}
    assert (rows[0]["frac_late"], rows[0]["frac_early"], rows[0]["lo"], rows[-1]["hi"]) == (0.5, 0.5, -INF, INF)
    with pytest.raises(ValueError, match="at least one"):
        metrics.require_predictions(preds([1], [1]).where("false"))


def test_cost_curve(preds):
    rows = tuples(metrics.cost_curve(preds([100, 100], [110, 90]), ["model"], [1, 5, 100]), "cost_ratio", "cost")
    assert rows == [(1.0, 20.0), (5.0, 60.0), (100.0, 1010.0)]


def test_ordinal(spark):
    logits = F.array(*[F.lit(float(x)) for x in (2, 0, -1)])
    one = spark.range(1)
    assert one.select(ordinal.expected_rank(logits)).first()[0] == pytest.approx(1.4396370260117786)
    assert one.select(ordinal.argmax_rank(logits)).first()[0] == 1.0
    assert one.select(ordinal.rul_to_bin(F.lit(124.9), 125, 25), ordinal.rul_to_bin(F.lit(500.0), 125, 25)).first()[:] == (24, 24)
    assert one.select(ordinal.bin_to_rul(F.lit(3), 125, 25)).first()[0] == 17.5
    assert one.select(ordinal.decode(F.array(F.lit(2.0)), "mse", 125)).first()[0] == 125.0
    with pytest.raises(ValueError, match="unknown loss"):
        ordinal.decode(logits, "hinge", 125)


@pytest.mark.parametrize("t,df,p", [(12.7062, 1, 0.05), (4.30265, 2, 0.05), (3.18245, 3, 0.05), (2.776445, 4, 0.05),
                                    (2.570582, 5, 0.05), (2.262157, 9, 0.05), (4.60409, 4, 0.01), (0.0, 7, 1.0)])
def test_t_pvalue(spark, t, df, p):
    assert spark.range(1).select(t_pvalue(F.lit(t), F.lit(df))).first()[0] == pytest.approx(p, abs=1e-6)


def _pairs(spark, a, b):
    return spark.createDataFrame([("c", i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "cell string, seed int, a double, b double")


def test_paired_ttest(spark):
    def p(a, b):
        return compare.paired_ttest(_pairs(spark, a, b), ["cell"]).first()["p"]

    assert p([1], [2]) is None and p([1, 2, 3], [3, 4, 5]) is None
    assert p([10, 11, 9, 10, 10], [20, 19, 22, 21, 18]) < 0.05


def _results(spark, rows):
    out = [(m, "A", 5, s, "mse" if m.endswith("_mlp") else "native", float(v), float(v)) for m, vals in rows.items() for s, v in enumerate(vals)]
    return spark.createDataFrame(out, "model string, dataset string, n_units int, seed int, loss string, nasa_clipped double, rmse_clipped double")


JITTER = (0.0, 0.5, -0.5, 1.0, -1.0)


@pytest.mark.parametrize("candidate,floor,want", [(10, 90, "win"), (30, 90, "loss"), (20.01, 90, "tie"), (10, 8, "hollow")])
def test_verdicts(spark, candidate, floor, want):
    gbm = [20 + j for j in JITTER]
    cand = [candidate + j * 0.7 for j in reversed(JITTER)]
    row = compare.success_map(_results(spark, {"x_mlp": cand, "gbm": gbm, "predict_mean": [floor] * 5})).first()
    assert (row["verdict"], row["best_baseline"], row["n_seeds"]) == (want, "gbm", 5)
    assert row["margin"] == pytest.approx(20 - candidate) and row["floor"] == floor


def test_floors_mode_and_duplicates(spark):
    rows = _results(spark, {"x_zeroshot": [10 + j for j in JITTER], "predict_mean": [40 - j for j in JITTER], "cycle_reg": [50] * 5})
    assert compare.success_map(rows).count() == 0
    twice = rows.unionByName(rows)
    row = compare.success_map(twice, versus_floors=True).first()
    assert (row["verdict"], row["best_baseline"], row["n_seeds"]) == ("win", "predict_mean", 5)


def test_margin_and_alpha_shift_the_verdict(spark):
    rows = _results(spark, {"x_mlp": [10 + j for j in JITTER], "gbm": [20 - j for j in JITTER]})
    assert compare.success_map(rows).first()["verdict"] == "win"
    assert compare.success_map(rows, win_margin=15).first()["verdict"] == "tie"
    assert compare.success_map(rows, alpha=1e-9).first()["verdict"] == "tie"


def test_strongest(spark):
    rows = _results(spark, {"gbm": [20], "cnn": [15], "minirocket": [25], "predict_mean": [9], "x_mlp": [1]})
    assert tuples(compare.strongest(rows), "best_baseline", "baseline_mean") == [("cnn", 15.0)]


def test_paired_loss_test(spark):
    rows = [("level_mlp", "A", 30.0, 5, s, loss, lo, hi, v)
            for s, d in enumerate((0.8, 0.9, 1.1, 1.2)) for lo, hi, vals in ((0.0, 10.0, {"corn": 5.0, "mse": 5.0 + d}), (10.0, INF, {"corn": 2.0, "mse": 2.0}))
            for loss, v in vals.items()]
    df = spark.createDataFrame(rows, "model string, dataset string, max_rul double, n_units int, seed int, loss string, bin_lo double, bin_hi double, mae_clipped double")
    got = {r["bin_lo"]: r for r in compare.paired_loss_test(df, "level_mlp").collect()}
    assert got[0.0]["mean_delta"] == pytest.approx(-1) and got[0.0]["p"] < 0.01
    assert got[10.0]["p"] is None


def test_roster(spark):
    rows = _results(spark, {"a_mlp": [10], "b_mlp": [20], "c_zeroshot": [30], "gbm": [15], "minirocket": [12], "catch22_gbm": [50],
                            "cnn": [40], "lstm": [35], "predict_mean": [1]})
    got = tuples(compare.roster(rows), "category", "place", "model")
    assert got == [("candidate", 1, "a_mlp"), ("candidate", 2, "b_mlp"), ("foil", 1, "minirocket"), ("foil", 2, "gbm"), ("net", 1, "lstm")]


def test_select_arm(preds):
    two = preds([1], [1]).unionByName(preds([2], [2], seed=3)).unionByName(preds([3], [3], n_units=2))
    assert tuples(compare.select_arm(two, seed=3), "true_rul") == [(2.0,)]
    assert tuples(compare.select_arm(two, seed=9), "true_rul") == [(1.0,)]
    with pytest.raises(ValueError, match="n_units=7"):
        compare.select_arm(two, n_units=7)
    with pytest.raises(ValueError, match="mix max_rul"):
        compare.select_arm(two.unionByName(preds([1], [1], max_rul=30.0)))


def test_dedupe_keeps_cycles(preds):
    df = preds([1, 1], [1, 1]).withColumn("unit_number", F.lit(1)).withColumn("time_cycles", F.monotonically_increasing_id())
    keys = [*metrics.PRED_CELL, "unit_number", "time_cycles"]
    assert compare.dedupe(df.unionByName(df), keys, ["pred"]).count() == 2


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_weighted_quantile(spark, q):
    import numpy as np

    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=60), [1e6, 1e6, -3.0, -3.0]])
    freq = rng.integers(1, 5, len(values))
    df = spark.createDataFrame([("a", float(v), int(f)) for v, f in zip(values, freq)] + [("b", 2.0, 3)], "g string, v double, f long")
    got = {r["g"]: r["out"] for r in weighted_quantile(df, ["g"], "v", "f", q, "out").collect()}
    assert got["a"] == pytest.approx(np.quantile(np.repeat(values, freq), q)) and got["b"] == 2.0


def test_verdict_grid_order(spark):
    rows = [("A", "x_mlp", c, v) for c, v in (("10", "win"), ("2", "tie"), ("noisy", "loss"))]
    df = spark.createDataFrame(rows, "dataset string, model string, level string, verdict string")
    assert compare.verdict_grid(df, "level", 3).select("c1", "c2", "c3").first()[:] == ("tie", "win", "loss")


def test_verdict_grid_refuses_more_conditions_than_columns(spark):
    df = spark.createDataFrame([("A", "m", str(i), "win") for i in range(7)], "dataset string, model string, level string, verdict string")
    with pytest.raises(Exception, match="more than 5 conditions"):
        compare.verdict_grid(df, "level", 5).collect()
    assert len(compare.verdict_grid(df, "level", 7).columns) == 9


def test_copies_that_differ_are_refused(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 2.0), ("b", 1, 3.0)], "k string, run int, v double")
    assert [r.run for r in compare.dedupe(df, ["k"], ["run"], same=["v"]).orderBy("k").collect()] == [1, 1]
    with pytest.raises(Exception, match="differ"):
        compare.dedupe(df.union(spark.createDataFrame([("b", 2, 4.0)], df.schema)), ["k"], ["run"], same=["v"]).collect()


def test_copies_may_differ_in_their_last_digits(spark):
    schema = "k string, run int, v double"
    near = [("a", 1, 2.0000005), ("a", 2, 2.0000005 - 4e-16), ("n", 1, float("nan")), ("n", 2, float("nan")), ("i", 1, float("inf")), ("i", 2, float("inf"))]
    got = compare.dedupe(spark.createDataFrame(near, schema), ["k"], ["run"], same=["v"])
    assert [tuple(r)[:2] for r in got.orderBy("k").collect()] == [("a", 1), ("i", 1), ("n", 1)]
    for odd in (float("nan"), float("inf"), None, 2.00001):
        rows = spark.createDataFrame([("a", 1, 2.0), ("a", 2, odd)], schema)
        with pytest.raises(Exception, match="differ"):
            compare.dedupe(rows, ["k"], ["run"], same=["v"]).collect()
