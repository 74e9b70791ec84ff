import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rows import tuples
from fleetlife.models import closed, embed, indicators, kernels, learned
from fleetlife.operators import health, labels, sampling, windows
from fleetlife.operators.features import head_features
from fleetlife.plans import scoring, transfer, zeroshot


@pytest.mark.parametrize("series,forecast,threshold,want", [
    ([0, 1, 2], [3, 4, 5, 6], 5, 3.0), ([1, 5, 10], [0, 0], 5, 0.0), ([0, 1], [2, 3, 4], 99, 3.0)])
def test_crossing(spark, series, forecast, threshold, want):
    fc = F.array(*[F.lit(float(v)) for v in forecast])
    got = spark.range(1).select(health.crossing_rul(F.lit(float(series[-1])), fc, F.lit(float(threshold)), len(forecast))).first()[0]
    assert got == want


def _rising(spark, units=(1, 2, 3), n=20):
    rng = np.random.default_rng(2)
    rows = [("A", u, c, float(c + rng.normal()), float(500 - 2 * c + rng.normal()), 7.0) for u in units for c in range(1, n + 1)]
    return spark.createDataFrame(rows, "dataset string, unit_number long, time_cycles long, a double, b double, flat double")


def test_health_index_matches_a_direct_fit(spark):
    frame = _rising(spark)
    draws = spark.createDataFrame([("A", 0, 1, 2), ("A", 0, 3, 1)], "dataset string, seed int, unit_number long, freq long")
    row = health.fit_health_index(frame, ["a", "b", "flat"], draws).first()
    data = {u: np.array([(r.a, r.b, r.flat) for r in frame.where(F.col("unit_number") == u).orderBy("time_cycles").collect()]) for u in (1, 3)}
    x = np.concatenate([data[1], data[1], data[3]])
    std = x.std(axis=0)
    std[std < 1e-8] = 1
    z = (x - x.mean(axis=0)) / std
    v = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)[2][0]
    v = v * np.sign(np.corrcoef(z @ v, np.tile(np.arange(20), 3))[0, 1])
    assert row["hi_mean"] == pytest.approx(list(x.mean(axis=0))) and row["hi_std"] == pytest.approx(list(std))
    assert row["hi_dir"] == pytest.approx(list(v), abs=1e-9)
    hi = health.health_index(frame, health.fit_health_index(frame, ["a", "b", "flat"], draws), ["a", "b", "flat"])
    assert hi.select(F.corr("hi", "time_cycles")).first()[0] > 0.9


def test_zero_shot_beats_the_mean(spark):
    train = labels.label_train(_rising(spark), 30)
    cut, truth = labels.truncate_units(_rising(spark, (11, 12)), 0.6, 5)
    test = labels.label_test(cut.drop("n_obs"), truth, 30)
    out = zeroshot.zero_shot(train, test, sampling.units_of(train), ["a", "b"], (0, 1), 30, 8)
    rmse = {(r["model"], r["seed"]): r["rmse_clipped"] for r in out.collect()}
    assert len(rmse) == 6 and rmse["trend_zeroshot", 0] < 4


def test_lines_match_polyfit(spark, lives):
    frame = labels.label_train(lives({1: 30, 2: 12, 3: 25}), 20).withColumn("label", F.col("clipped_rul"))
    sums = closed.unit_sums(frame, ["time_cycles"])
    fit = closed.fit_lines(closed.add_up(sums, ["dataset"]), zeroshot.FLOORS, ["dataset"])
    x = [c for n in (30, 12, 25) for c in range(1, n + 1)]
    y = [min(20, n - c) for n in (30, 12, 25) for c in range(1, n + 1)]
    slope, shift = np.polyfit(x, y, 1)
    got = {r["model"]: (r["slope"], r["intercept"]) for r in fit.collect()}
    assert got["cycle_reg"] == pytest.approx((slope, shift)) and got["predict_mean"] == pytest.approx((0, np.mean(y)))


def test_constant_input_gives_the_mean(spark, lives):
    frame = lives({1: 5}).withColumn("label", F.col("s_2")).withColumn("x", F.lit(3.0))
    row = closed.fit_line(closed.add_up(closed.unit_sums(frame, ["x"]), ["dataset"]), "x", ["dataset"]).first()
    assert (row["slope"], row["intercept"]) == (0.0, 3.0)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    rows = [("A", i, i, float(a), float(b), float(np.clip(20 + 8 * a - 5 * b, 0, 40))) for i, (a, b) in enumerate(rng.normal(size=(240, 2)))]
    return spark.createDataFrame(rows, "dataset string, unit_number long, end_cycle long, a double, b double, label double")


@pytest.mark.parametrize("name,options,limit", [
    ("gbm", {"rounds": 10}, 6), ("kernel_ridge", {"alphas": (1e-3, 10.0)}, 3), ("linear_mlp", {}, 3),
    ("ordinal_mlp", {"bins": 4}, 7), ("ordinal_mlp", {"bins": 4, "corn": "argmax"}, 9)])
def test_learned_models(table, name, options, limit):
    train, test = table.where("end_cycle < 180"), table.where("end_cycle >= 180")
    model = learned.make_model(name, ["a", "b"], 40, 1, **options).fit(train, test)
    rows = model.predict(test).select("label", "pred").collect()
    assert all(0 <= r["pred"] <= 40 for r in rows)
    assert math.sqrt(np.mean([(r["pred"] - r["label"]) ** 2 for r in rows])) < limit


def test_unknown_model():
    with pytest.raises(KeyError):
        learned.make_model("nope", [], 1)


def test_ordinal_head_with_one_bin(table):
    low = table.withColumn("label", F.lit(3.0))
    pred = learned.make_model("ordinal_mlp", ["a"], 40, bins=4).fit(low).predict(low).first()["pred"]
    assert pred == pytest.approx(5.0, abs=1e-6)


def test_kernels_are_seeded(lives):
    frame = labels.label_train(lives({1: 14}), 20)
    wins = windows.sliding_windows(frame, ["s_2", "s_3"], 12)
    a, b = (tuples(kernels.kernel_features(w, ["s_2", "s_3"], 12, 16, 3), "end_cycle", "kernels") for w in (wins, wins.repartition(3)))
    assert a == b and len(a) == 3 and all(0 <= v <= 1 for _, k in a for v in k)
    with pytest.raises(ValueError, match="at least"):
        kernels.make_kernels(1, 5, 4, 0)


@pytest.mark.parametrize("unrolled", [40, 3])
def test_indicators_of_a_known_window(spark, monkeypatch, unrolled):
    monkeypatch.setattr(indicators, "UNROLLED", unrolled)
    x = [1.0, 2.0, 4.0, 4.0, 1.0, 0.0]
    rows = [("A", 1, 6, 0.0, [(v,) for v in x]), ("A", 2, 6, 0.0, [(5.0,)] * 6)]
    df = spark.createDataFrame(rows, "dataset string, unit_number long, end_cycle long, label double, win array<struct<s:double>>")
    got = {r["unit_number"]: r for r in indicators.window_indicators(df, ["s"], 6).collect()}
    z = np.array(x) - 2
    acf = [float((z[:6 - k] * z[k:]).sum() / (z * z).sum()) for k in range(1, 6)]
    assert got[1]["s_acf1"] == pytest.approx(acf[0]) and got[1]["s_acf2"] == pytest.approx(acf[1])
    assert got[1]["s_acf_drop"] == 1 + next(i for i, r in enumerate(acf) if r < 1 / math.e)
    assert (got[1]["s_longest_above"], got[1]["s_max_diff"], got[1]["s_mode_bin"]) == (2.0, 3.0, 1.0)
    assert got[1]["s_crossings"] == pytest.approx(2 / 5)
    assert got[1]["s_low_share"] == pytest.approx(sum(r * r for r in acf[:3]) / sum(r * r for r in acf))
    assert (got[2]["s_acf1"], got[2]["s_low_share"], got[2]["s_mode_bin"]) == (0.0, 0.0, 0.0)


def test_plugged_embedder(spark, lives):
    class Shape:
        def embed_windows(self, series):
            return np.array([[len(x), x[-1, 0]] for x in series]), [[(x[:, 0].mean(), 0.0)] for x in series]

    frame = labels.label_train(lives({1: 9}), 20)
    out = embed.embed_contexts(windows.contexts(frame, ["s_2"], 4, 6), Shape, batch_size=2)
    assert [(r["end_cycle"], list(r["emb"]), r["locscale"][0]["loc"]) for r in out.orderBy("end_cycle").collect()][0] == (4, [4.0, 4.0], 2.5)
    assert out.count() == 6


def test_head_features_use_train_statistics(spark):
    schema = "dataset string, emb array<double>, locscale array<struct<loc:double,scale:double>>, x double"
    train = spark.createDataFrame([("A", [1.0], [(1.0, 5.0)], 2.0), ("A", [2.0], [(3.0, 5.0)], 6.0)], schema)
    test = spark.createDataFrame([("A", [9.0], [(4.0, 7.0)], 4.0)], schema)
    head = head_features(train, test, "emb+locscale+raw", 1, ["x"], ["dataset"]).first()["head"]
    assert head == pytest.approx([9.0, (4 - 2) / math.sqrt(2), 2.0, 0.0])
    assert head_features(train, test, "emb", 1, ["x"], ["dataset"]).first()["head"] == [9.0]


def test_transfer_needs_two_shots():
    with pytest.raises(ValueError, match="at least 2"):
        transfer.transfer_arms(None, None, None, None, [1, 2])


def test_pending_horizon(preds):
    a, b = preds([1, 2], [1, 2]), preds([3, 4], [3, 4], seed=1)
    grid = a.unionByName(b).select(*scoring.PRED_CELL).distinct()
    left = scoring.pending_horizon(grid, scoring.horizon_rows(a, 125), a)
    assert tuples(left, "seed") == [(1,)]
    tables = scoring.study_tables(
        scoring.metrics.evaluate(a, scoring.PRED_CELL, 125), a.unionByName(a), [0.0], [1.0])
    assert tables["earliness"].agg(F.sum("n_bin")).first()[0] == 2
