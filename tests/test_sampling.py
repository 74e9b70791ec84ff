import pytest
from pyspark.sql import functions as F

from rows import tuples
from fleetlife.functions.hashing import digest
from fleetlife.operators import sampling


@pytest.fixture(scope="module")
def units(spark):
    return spark.range(1, 101).select(F.lit("A").alias("dataset"), F.col("id").alias("unit_number")).unionByName(
        spark.range(1, 4).select(F.lit("B").alias("dataset"), F.col("id").alias("unit_number")))


@pytest.fixture(scope="module")
def plan(units):
    return sampling.sampling_plan(units, (2, 5, 10), (0, 1), 0.2)


def test_grid_has_the_full_fleet(units):
    got = tuples(sampling.unit_counts(units, (2, 4, 100, 500)), "dataset", "n_units")
    assert got == [("A", 2), ("A", 4), ("A", 100), ("B", 2), ("B", 3)]


def test_draws(units, plan):
    members = {}
    for d, n, s, u, role in tuples(sampling.membership(units, plan), "dataset", "n_units", "seed", "unit_number", "role"):
        members.setdefault((d, n, s), {})[u] = role
    assert {(d, n) for d, n, _ in members} == {("A", 2), ("A", 5), ("A", 10), ("A", 100), ("B", 2), ("B", 3)}
    for (d, n, s), drawn in members.items():
        assert len(drawn) == n
        assert list(drawn.values()).count("val") == max(1, round(n * 0.2))
    assert set(members["A", 5, 0]) < set(members["A", 10, 0])
    assert set(members["A", 10, 0]) != set(members["A", 10, 1])
    by_digest = [r["unit_number"] for r in units.where("dataset = 'A'").orderBy(digest(F.col("unit_number"), 0, "sub")).limit(10).collect()]
    assert set(members["A", 10, 0]) == set(by_digest)


def test_same_draw_whatever_the_partitions(units, plan):
    again = sampling.sampling_plan(units.repartition(13), (2, 5, 10), (0, 1), 0.2)
    assert tuples(again, *again.columns[:3], "val_cut") == tuples(plan, *plan.columns[:3], "val_cut")


def test_single_unit_has_no_validation(spark):
    one = spark.createDataFrame([("A", 7)], "dataset string, unit_number long")
    plan = sampling.sampling_plan(one, (2,), (0,), 0.2)
    assert tuples(sampling.membership(one, plan), "unit_number", "role") == [(7, "train")]


def test_bootstrap(units):
    draws = sampling.bootstrap_units(units, (0, 1))
    sums = tuples(draws.groupBy("dataset", "seed").agg(F.sum("freq").alias("n")), "dataset", "seed", "n")
    assert sums == [("A", 0, 100), ("A", 1, 100), ("B", 0, 3), ("B", 1, 3)]
    assert draws.where("dataset = 'A' AND seed = 0").count() < 100


def test_restart_guards(spark):
    grid = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    done = spark.createDataFrame([(2,)], "k long")
    assert tuples(sampling.pending_cells(grid, done, ["k"]), "k") == [(1,), (3,)]
    assert tuples(sampling.finished_cells(done, grid, ["k"]), "k") == [(2,)]
    with pytest.raises(ValueError, match="without predictions"):
        sampling.finished_cells(grid, done, ["k"])


def test_restart_guards_move_cells_not_predictions(spark):
    grid = spark.createDataFrame([(1,), (3,)], "k long")
    preds = spark.range(100_000).select((F.col("id") % 2).alias("k"))
    plan = sampling.orphan_cells(grid, preds, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and tuples(sampling.orphan_cells(grid, preds, ["k"]), "k") == [(3,)]


def test_longest(preds):
    many = preds([1] * 3, [1] * 3).withColumn("unit_number", F.lit(4)).unionByName(preds([1, 2], [1, 2]))
    assert tuples(sampling.longest_units(many, 2), "unit_number", "n_rows") == [(0, 1), (4, 3)]
