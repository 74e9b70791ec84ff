"""Positions, slices of large groups and unit blocks: results must not depend on either."""

import random

import pytest
from pyspark.sql import functions as F

from rows import tuples
from fleetlife.operators import labels, numbering, windows


@pytest.mark.parametrize("slice_rows", [1, 3, 7, 1_000_000])
def test_number_rows_with_a_hot_group(spark, slice_rows):
    rng = random.Random(1)
    rows = [(0, rng.choice([1, 2, 3, 50, 51, 900]), i) for i in range(120)] + [(1, i, i) for i in range(4)]
    df = spark.createDataFrame(rows, "k long, t long, id long").repartition(5)
    got = {r["id"]: r["n"] for r in numbering.number_rows(df, ["k"], ["t", "id"], "n", slice_rows).where("k = 0").collect()}
    want = {r[2]: i for i, r in enumerate(sorted(rows[:120], key=lambda r: (r[1], r[2])), 1)}
    assert got == want


def test_number_rows_by_timestamp(spark):
    df = spark.sql("SELECT 1 AS k, TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) AS ts, id FROM range(20)")
    out = numbering.number_rows(df, ["k"], ["ts", "id"], "n", slice_rows=6)
    assert tuples(out, "id", "n") == [(i, i + 1) for i in range(20)]


@pytest.mark.parametrize("block_rows", [5, 6, 13, 65_536])
def test_windows_do_not_depend_on_blocks(lives, block_rows):
    frame = labels.label_train(lives({1: 23, 2: 5, 3: 4, 4: 40}), 1000, block_rows)
    wins = windows.sliding_windows(frame, ["s_2", "s_3"], 5, block_rows=block_rows)
    got = tuples(wins.select("unit_number", "end_cycle", "label", F.col("win.s_2").alias("w")), "unit_number", "end_cycle", "label", "w")
    want = [(u, c, float(n - c), [float(x) for x in range(c - 4, c + 1)])
            for u, n in {1: 23, 2: 5, 4: 40}.items() for c in range(5, n + 1)]
    assert got == sorted(want)


def test_stats_do_not_depend_on_blocks(lives):
    frame = labels.label_train(lives({1: 30, 2: 9}), 1000)
    a, b = (tuples(windows.window_stats(frame, ["s_2"], 6, block_rows=n), "unit_number", "end_cycle", "s_2_mean", "s_2_q25", "s_2_slope")
            for n in (7, 65_536))
    assert a == b
    assert a[0][2:] == (3.5, 2.25, 1.0)


def test_block_must_hold_a_frame(lives):
    with pytest.raises(ValueError, match="wider than a block"):
        numbering.blocked(lives({1: 3}), 9, 8)


def test_results_do_not_depend_on_partitions(spark, lives):
    frame = lives({1: 30, 2: 12, 3: 17})
    seen = []
    for n in (1, 3, 11):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        labelled = labels.label_train(frame.repartition(n), 20)
        seen.append(tuples(windows.loc_scale(labelled, ["s_2"], 4), "unit_number", "end_cycle", "s_2_loc", "s_2_scale"))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert seen[0] == seen[1] == seen[2]


def test_gaps_are_renumbered(lives):
    gaps = lives({1: 9, 2: 4}).where("time_cycles NOT IN (1, 5)")
    with pytest.raises(ValueError, match="dense_cycles"):
        numbering.require_dense(gaps)
    dense = numbering.require_dense(numbering.dense_cycles(gaps))
    assert tuples(dense.where("unit_number = 1"), "time_cycles", "source_cycle") == list(enumerate([2, 3, 4, 6, 7, 8, 9], 1))


def test_null_and_nan_keys_have_one_place(spark):
    rows = [(0, None if i % 7 == 0 else float("nan") if i % 11 == 0 else float(i % 13), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, t double, id int")
    whole = {r.id: r.n for r in numbering.number_rows(df, ["k"], ["t", "id"], "n").collect()}
    cut = {r.id: r.n for r in numbering.number_rows(df, ["k"], ["t", "id"], "n", slice_rows=10).collect()}
    assert whole == cut and sorted(cut.values()) == list(range(1, 201))
    assert {i for i, n in cut.items() if n <= 29} == {i for i in range(0, 200, 7)}


def test_an_outlier_does_not_fill_a_slice(spark):
    df = spark.range(20000).selectExpr("0 AS k", "IF(id = 5, 1e15, CAST(id AS double)) AS t", "id")
    large = numbering._large_groups(df, ["k"], F.col("t"), 1000)
    cuts = large.first()["_cuts"]
    slices = df.withColumn("s", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("t")))).groupBy("s").count()
    assert slices.agg(F.max("count")).first()[0] <= 2 * 20000 / slices.count()
