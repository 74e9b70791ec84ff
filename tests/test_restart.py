"""Runs that end early leave whole cells, and the next run does the rest."""

import pytest
from pyspark.sql import functions as F

from fleetlife import sources
from fleetlife.operators import metrics
from fleetlife.plans import scoring
from rows import tuples

EDGES, RATIOS = [-5.0, 0.0, 5.0], [1.0, 10.0]


def _cells(path):
    return {p.name: max(f.stat().st_mtime_ns for f in p.iterdir()) for p in path.iterdir() if p.name.startswith("_cell=")}


@pytest.fixture
def runs(preds):
    def make(*seeds):
        out = None
        for s in seeds:
            one = preds([3.0, 9.0, 14.0], [4.0 + s, 7.0, 20.0], seed=s)
            out = one if out is None else out.unionByName(one)
        return out
    return make


def test_rerun_does_the_rest_alone(spark, runs, tmp_path):
    scoring.restart(runs(0, 1), str(tmp_path), EDGES, RATIOS)
    before = _cells(tmp_path / "cost")
    assert len(before) == 2
    hist, cost = scoring.restart(runs(0, 1, 2), str(tmp_path), EDGES, RATIOS)
    after = _cells(tmp_path / "cost")
    assert {k: v for k, v in after.items() if k in before} == before and len(after) == 3
    keys = metrics.PRED_CELL
    assert tuples(cost, "seed", "cost_ratio", "cost") == tuples(metrics.cost_curve(runs(0, 1, 2), keys, RATIOS), "seed", "cost_ratio", "cost")
    want = metrics.earliness(runs(0, 1, 2), keys, EDGES)
    assert sorted(map(repr, hist.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_a_failed_run_leaves_whole_cells(spark, runs, tmp_path):
    path = str(tmp_path / "cost")
    rows = metrics.cost_curve(runs(0, 1, 2), metrics.PRED_CELL, RATIOS)
    bad = rows.withColumn("cost", F.when(F.col("seed") == 2, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("cost")))
    with pytest.raises(Exception, match="lost"):
        sources.commit_cells(bad, path, metrics.PRED_CELL)
    assert sources.committed(spark, path, rows.schema).count() == 0
    sources.commit_cells(rows, path, metrics.PRED_CELL)
    assert sources.committed(spark, path, rows.schema).count() == 6
    sources.commit_cells(rows.where("seed = 1").withColumn("cost", F.lit(-1.0)), path, metrics.PRED_CELL)  # a cell is replaced as a whole
    assert tuples(sources.committed(spark, path, rows.schema).groupBy("seed").agg(F.min("cost").alias("low"), F.count("*").alias("n")).where("low < 0"), "seed", "n") == [(1, 2)]


def test_tables_of_several_runs(runs, spark):
    rows = metrics.evaluate(runs(0, 1), metrics.PRED_CELL, 125.0)
    tables = scoring.study_tables(rows.unionByName(rows.where("seed = 0")), runs(0, 1, 0), EDGES, RATIOS)
    assert set(tables) == {"data_scaling", "success_map", "earliness", "cost", "roster"}
    assert tables["cost"].count() == 4 and tables["data_scaling"].count() == 1


def test_predictions_are_read_once_for_both_tables(spark, runs, tmp_path):
    rows, read = runs(0, 1), spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    counted = spark.createDataFrame(rows.rdd.map(seen), rows.schema)
    hist, cost = scoring.restart(counted, str(tmp_path), EDGES, RATIOS)
    assert read.value == 6 and cost.count() == 4 and hist.count() == 8
