import math

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from rows import tuples
from fleetlife.functions import arrays
from fleetlife.operators import conditions, labels, perturb, summaries, windows


def test_train_label_and_cap(lives):
    rows = labels.label_train(lives({1: 30}), 10)
    got = {r["time_cycles"]: (r["actual_rul"], r["clipped_rul"]) for r in rows.collect()}
    assert got[1] == (29.0, 10.0) and got[30] == (0.0, 0.0) and got[25] == (5.0, 5.0)


def test_test_label(spark, lives):
    truth = spark.createDataFrame([("A", 1, 7)], "dataset string, unit_number long, rul_truth long")
    got = tuples(labels.label_test(lives({1: 4}), truth, 8), "time_cycles", "actual_rul", "clipped_rul")
    assert got == [(1, 10.0, 8.0), (2, 9.0, 8.0), (3, 8.0, 8.0), (4, 7.0, 7.0)]


def test_truncate(lives):
    rows, truth = labels.truncate_units(lives({1: 20, 2: 30}), 0.6, 5)
    assert tuples(rows.groupBy("unit_number").count(), "unit_number", "count") == [(1, 12), (2, 18)]
    assert tuples(truth, "unit_number", "rul_truth") == [(1, 8), (2, 12)]


def test_truncate_too_short(lives):
    with pytest.raises(SparkRuntimeException, match="too short"):
        labels.truncate_units(lives({1: 4}), 0.6, 5)[0].collect()


def test_last_windows_pad_and_drop(spark, lives):
    truth = spark.createDataFrame([("A", 1, 7), ("A", 2, 12)], "dataset string, unit_number long, rul_truth long")
    frame = labels.label_test(lives({1: 4, 2: 25}), truth, 125)
    rows = windows.last_windows(frame, ["s_2"], 10).orderBy("unit_number").collect()
    assert [r["label"] for r in rows] == [7.0, 12.0]
    assert [x["s_2"] for x in rows[0]["win"]] == [1.0] * 7 + [2.0, 3.0, 4.0]
    assert [x["s_2"] for x in rows[1]["win"]] == [float(c) for c in range(16, 26)]
    assert windows.last_windows(frame, ["s_2"], 10, pad=False).count() == 1


def test_contexts_pair_with_windows(lives):
    frame = labels.label_train(lives({1: 12, 2: 3}), 125)
    wins, ctx = windows.sliding_windows(frame, ["s_2"], 5), windows.contexts(frame, ["s_2"], 5, 8)
    windows.require_aligned(wins, ctx)
    sizes = {r["end_cycle"]: len(r["ctx"]) for r in ctx.collect()}
    assert sizes == {c: min(c, 8) for c in range(5, 13)}
    with pytest.raises(ValueError, match="do not pair"):
        windows.require_aligned(wins, windows.contexts(frame, ["s_2"], 6, 8))


def test_disjoint_guard(lives):
    windows.require_disjoint(lives({1: 2}), lives({2: 2}))
    with pytest.raises(ValueError, match="share unit"):
        windows.require_disjoint(lives({1: 2}), lives({1: 3}))


def test_channel_scaler_counts_cycles_per_window(lives):
    frame = labels.label_train(lives({1: 9, 2: 6, 3: 2}), 125)
    fit = windows.channel_scaler(frame, ["s_2"], 4)
    values = [float(c) for n in (9, 6) for end in range(4, n + 1) for c in range(end - 3, end + 1)]
    mean = sum(values) / len(values)
    std = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    row = fit.first()
    assert row["s_2_mean"] == pytest.approx(mean) and row["s_2_std"] == pytest.approx(std)
    scaled = windows.apply_channel_scaler(frame, fit, ["s_2"])
    assert scaled.where("unit_number = 3 AND time_cycles = 2").first()["s_2"] == pytest.approx((2 - mean) / std)


def test_condition_scaler(spark):
    rows = [("A", 1, c, 10.004 * (c % 2), 0.25, 100.0, float(c), 5.0) for c in range(1, 9)]
    frame = spark.createDataFrame(rows, "dataset string, unit_number long, time_cycles long, setting_1 double, setting_2 double, setting_3 double, s_2 double, s_3 double")
    unseen = frame.withColumn("setting_1", F.lit(42.0))
    train, test = conditions.normalize_conditions(frame, unseen, ["s_2", "s_3"])
    per = train.groupBy(F.round("setting_1")).agg(F.avg("s_2").alias("m"), F.stddev_pop("s_2").alias("s"), F.max(F.abs("s_3")).alias("flat"))
    for r in per.collect():
        assert (r["m"], r["s"], r["flat"]) == (pytest.approx(0), pytest.approx(1), 0.0)
    whole = test.agg(F.avg("s_2"), F.stddev_pop("s_2")).first()
    assert whole[0] == pytest.approx(0) and whole[1] == pytest.approx(1)
    ids = conditions.condition_ids(conditions.condition_keys(frame)).select("condition_id").distinct().count()
    assert ids == 2


@pytest.mark.parametrize("value,places,want", [(0.5, 0, 0.0), (1.5, 0, 2.0), (-0.2, 0, 0.0), (2.675, 2, 2.68), (0.125, 2, 0.12)])
def test_half_even(spark, value, places, want):
    got = spark.range(1).select(conditions.snap(F.lit(value), places)).first()[0]
    assert got == want and math.copysign(1, got) == 1


def test_drift_starts_at_zero(lives):
    frame = lives({1: 20, 2: 1})
    out = tuples(perturb.add_drift(frame, ["s_2"], 5.0).where("unit_number = 1"), "time_cycles", "s_2")
    std = frame.agg(F.stddev_pop("s_2")).first()[0]
    assert out[0] == (1, 1.0) and out[-1][1] == pytest.approx(20 + 5 * std)


def test_noise_is_seeded(lives):
    frame = lives({1: 300})

    def noisy(df, seed):  # the deviation is a sum whose last bits depend on the row order
        out = perturb.inject(df, ["s_2"], {"kind": "gaussian"}, seed)
        return tuples(out.withColumn("s_2", F.round("s_2", 9)), "time_cycles", "s_2")

    assert noisy(frame, 3) == noisy(frame.repartition(7), 3)
    assert noisy(frame, 3) != noisy(frame, 4)
    zeros = perturb.add_dropout(frame, ["s_2"], 1, 0.5).where("s_2 = 0").count() / 300
    assert 0.3 < zeros < 0.7


def test_noise_guards(lives):
    frame = lives({1: 3})
    with pytest.raises(ValueError, match="only simulated"):
        perturb.inject_split(frame, frame, ["s_2"], {"kind": "drift"}, 0, "bearing")
    with pytest.raises(ValueError, match="unknown noise"):
        perturb.inject(frame, ["s_2"], {"kind": "hum"}, 0)


def test_cycle_summary_of_one_row(spark):
    df = spark.createDataFrame([("A", 1, 1, 0, 3.0, 5.0), ("A", 1, 2, 1, 2.0, 1.0), ("A", 1, 2, 0, 1.0, 4.0)],
                               "dataset string, unit_number long, time_cycles long, t long, Fc double, x double")
    rows = tuples(summaries.aggregate_cycles(df, ["x"], "Fc", ["t"]), "time_cycles", "setting_1", "x_mean", "x_std", "cycle_len_s")
    assert rows == [(1, 3.0, 5.0, 0.0, 1.0), (2, 1.0, 2.5, pytest.approx(2.1213203), 2.0)]


def test_flat_snapshot(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("z", 0.0), ("z", 0.0)], "id string, x double")
    rows = {r["id"]: r for r in summaries.snapshot_indicators(df, {"h": "x"}, ("id",)).collect()}
    assert (rows["a"]["h_kurtosis"], rows["a"]["h_skewness"], rows["a"]["h_crest"]) == (-3.0, 0.0, 1.0)
    assert (rows["z"]["h_rms"], rows["z"]["h_impulse"], rows["z"]["h_shape"]) == (0.0, 0.0, 1.0)


def test_flat_snapshot_in_several_tasks(spark):
    rows = spark.range(0, 3 * 11 * 500, 1, 3).select((F.col("id") % 500).alias("id"))  # 11 copies of each in each task
    df = rows.withColumn("x", 19653.43 + F.col("id") * 167.77)
    found = summaries.snapshot_indicators(df, {"h": "x"}, ("id",)).select("h_kurtosis", "h_skewness").distinct().collect()
    assert [tuple(r) for r in found] == [(-3.0, 0.0)]


def test_union_ids(lives):
    both = labels.union_fleets({"y": lives({1: 1, 2: 1}), "x": lives({1: 1, 2: 1, 3: 1})}, "ALL")
    assert [r[0] for r in tuples(both, "unit_number")] == [1, 2, 3, 1001, 1002]
    with pytest.raises(ValueError, match="two members"):
        labels.union_fleets({"x": lives({1: 1})}, "ALL")
    with pytest.raises(ValueError, match="missing fleet members"):
        labels.require_members(both, ["ALL", "other"])


def test_renumber_by_name(spark):
    names = [f"Bearing{c}_{i}" for c in (1, 2, 3) for i in range(1, 6)]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "unit_name string")
    got = tuples(labels.renumber_units(df, "unit_name"), "unit_number", "unit_name")
    assert got == [(i, n) for i, n in enumerate(names, 1)]


def test_pooling_layouts(spark):
    emb = [[[float(100 * v + 10 * p + d) for d in range(2)] for p in range(4)] for v in range(2)]
    df = spark.createDataFrame([(emb,)], "e array<array<array<double>>>")

    def pool(strategy, how="concat", special=2):
        return df.select(arrays.pool_window(F.col("e"), strategy, how, special)).first()[0]

    assert pool("forecast_token") == [30, 31, 130, 131]
    assert pool("last_content") == [10, 11, 110, 111]
    assert pool("mean") == [5, 6, 105, 106]
    assert pool("flatten") == [0, 1, 10, 11, 100, 101, 110, 111]
    assert pool("last_content", special=0) == [30, 31, 130, 131]
    assert pool("mean", "mean") == [55, 56]
    with pytest.raises(SparkRuntimeException, match="no content patch"):
        pool("mean", special=4)
    with pytest.raises(ValueError, match="unknown pooling"):
        pool("max")
    assert arrays.head_width("emb+locscale+raw", 8, 2, 3) == 15


def test_union_ids_stay_apart(lives):
    both = labels.union_fleets({"x": lives({1: 1, 1370: 1}), "y": lives({1: 1, 370: 1})}, "ALL")
    assert {r.unit_number for r in both.collect()} == {1, 1370, 10001, 10370}


def test_window_stats_with_missing_readings(spark):
    rows = [("A", 1, c, None if c in (2, 5) else float(c), float(c)) for c in range(1, 8)]
    frame = spark.createDataFrame(rows, "dataset string, unit_number long, time_cycles long, s_2 double, clipped_rul double")
    got = {r.end_cycle: r for r in windows.window_stats(frame, ["s_2"], 3).collect()}
    assert (got[3].s_2_q25, got[3].s_2_q50, got[3].s_2_mean, got[3].s_2_last) == (1.5, 2.0, 2.0, 3.0)
    assert got[7].s_2_q50 == 6.5 and sorted(got) == [3, 4, 5, 6, 7]
    none = windows.window_stats(frame.withColumn("s_2", F.lit(None).cast("double")), ["s_2"], 3).first()
    assert none.s_2_q75 is None and none.s_2_mean is None


def test_statistics_of_train_and_test_windows_agree_on_nulls(spark):
    readings = [[1.0, None, 3.0, 4.0, 5.0], [None] * 5, [2.0, 7.0, 1.0, 9.0, None], [None, None, 6.0, None, None], [1.0, 2.0, 4.0, 8.0, 16.0]]
    rows = [("A", u, c, v) for u, vs in enumerate(readings) for c, v in enumerate(vs, 1)]
    frame = labels.label_train(spark.createDataFrame(rows, "dataset string, unit_number long, time_cycles long, s_2 double"), 100)
    left = windows.window_stats(frame, ["s_2"], 5).collect()
    right = {r.unit_number: r for r in windows.last_window_stats(frame, ["s_2"], 5).collect()}
    assert len(left) == len(right) == 5
    for r in left:
        for s in windows.STATS:
            a, b = r[f"s_2_{s}"], right[r.unit_number][f"s_2_{s}"]
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b)), (r.unit_number, s)
