import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rows import tuples
from fleetlife import sources
from fleetlife.config import (
    BEARING_CHANNELS, FLEET_SETTINGS, FLEET_SETTINGS_SCHEMA, FLIGHT_SCENARIO, FLIGHT_SENSORS, TURBOFAN_COLUMNS, content_hash,
)
from fleetlife.functions.hashing import content_key
from fleetlife.plans import prepare
from fleetlife.sources import files


def test_cycle_text(spark, tmp_path):
    path = tmp_path / "train.txt"
    path.write_text("".join(f"1 {c} 0.5 -0.0001 100.0 " + " ".join(f"{c + i}.25" for i in range(21)) + "  \n" for c in (1, 2)) + "\n")
    df = sources.read_cycle_text(spark, str(path), "FD001")
    assert df.columns == ["dataset", *TURBOFAN_COLUMNS]
    assert tuples(df, "unit_number", "time_cycles", "setting_2", "s_1", "s_21") == [(1, 1, -0.0001, 1.25, 21.25), (1, 2, -0.0001, 2.25, 22.25)]


def test_truth_order_survives_splits(spark, tmp_path):
    path = tmp_path / "truth.txt"
    values = [(i * 37) % 91 for i in range(400)]
    path.write_text("\n".join(map(str, values)) + "\n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        got = [r[0] for r in sources.read_truth(spark, str(path), "FD001").orderBy("unit_number").select("rul_truth").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == values


def _snapshots(root, condition, unit, stems):
    folder = root / condition / unit
    folder.mkdir(parents=True)
    for s in stems:
        (folder / f"{s}.csv").write_text("Horizontal,Vertical\n" + "\n".join(f"{s + i},{2 * s - i}" for i in range(6)) + "\n")


def test_snapshot_tree(spark, tmp_path):
    _snapshots(tmp_path, "35Hz12kN", "Bearing1_1", [2, 10, 30])
    _snapshots(tmp_path, "37.5Hz11kN", "Bearing2_1", [1])
    (tmp_path / "__MACOSX" / "x").mkdir(parents=True)
    df = sources.read_snapshot_tree(spark, str(tmp_path))
    assert set(BEARING_CHANNELS) <= set(df.columns)
    assert tuples(df, "unit_number", "time_cycles", "setting_1", "setting_2", "setting_3", "h_peak") == [
        (1, 1, 0.0, 35.0, 12.0, 7.0), (1, 2, 0.0, 35.0, 12.0, 15.0), (1, 3, 0.0, 35.0, 12.0, 35.0), (2, 1, 1.0, 37.5, 11.0, 6.0)]


def test_unknown_condition_folder(spark, tmp_path):
    _snapshots(tmp_path, "40Hz12kN", "Bearing3_1", [1])
    with pytest.raises(ValueError, match="40Hz12kN"):
        sources.read_snapshot_tree(spark, str(tmp_path))


def test_high_rate(spark, tmp_path):
    names = FLIGHT_SCENARIO + FLIGHT_SENSORS
    rows = spark.range(6).select(
        F.lit(1).alias("unit_number"), (F.col("id") % 2 + 1).alias("time_cycles"), F.col("id").alias("t"), F.lit(3.0).alias("Fc"),
        F.lit(1).alias("hs"), F.lit(9.0).alias("Y"), *[(F.col("id") * 1.0).alias(n) for n in names])
    rows.write.parquet(str(tmp_path / "ds"))
    df = sources.read_high_rate(spark, str(tmp_path / "ds"), "DS01")
    assert tuples(df, "time_cycles", "T24_mean", "T24_std", "cycle_len_s", "setting_1") == [(1, 2.0, 2.0, 3.0, 3.0), (2, 3.0, 2.0, 3.0, 3.0)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Y#" not in plan.split("ReadSchema")[-1]
    rows.drop("T24").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="T24"):
        sources.read_high_rate(spark, str(tmp_path / "bad"), "DS01")


def test_channel_set(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, b double, a double")
    assert files.require_channels(df, ["a", "b"], ["id"]).columns == ["id", "a", "b"]
    with pytest.raises(ValueError, match="do not match"):
        files.require_channels(df, ["a", "c"], ["id"])


def test_curves(spark, tmp_path):
    (tmp_path / "m_n5_seed2_mse.csv").write_text("step,epoch,metric,value\n,1,val_rmse,9.5\n40,2,train_loss,0.5\n")
    (tmp_path / "notes.csv").write_text("step,epoch,metric,value\n1,1,val_rmse,1\n")
    got = tuples(sources.read_curves(spark, str(tmp_path)), "n_units", "seed", "loss", "metric", "x", "value")
    assert got == [(5, 2, "mse", "train_loss", 40.0, 0.5), (5, 2, "mse", "val_rmse", 1.0, 9.5)]


def test_materialize_runs_once(spark, tmp_path):
    base = str(tmp_path)
    a = sources.materialize(spark.range(3).toDF("x"), base, "k")
    assert a.count() == 3
    assert sources.materialize(spark.range(9).toDF("x"), base, "k").count() == 3
    assert sources.materialize(spark.range(9).toDF("x"), base, "k", overwrite=True).count() == 9


def test_results_store(spark, tmp_path):
    path = str(tmp_path / "res")
    df = spark.createDataFrame([("m", 1.0)], "model string, rmse double")
    assert sources.read_results(spark, path, df.schema).count() == 0
    sources.append_results(df, path)
    sources.append_results(df, path)
    assert sources.read_results(spark, path, df.schema).count() == 2
    with pytest.raises(ValueError, match="move the old table"):
        sources.append_results(df.withColumn("extra", F.lit(1)), path)
    (tmp_path / "a.csv").write_text("model,rmse\nm,2.5\nn,\n")
    got = sources.read_results(spark, str(tmp_path / "*.csv"), "model string, rmse double, n int", "csv")
    assert [tuple(r) for r in got.orderBy("model").collect()] == [("m", 2.5, None), ("n", None, None)]


def test_csv_files_are_read_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("model,rmse,mae\nm,2.5,1.5\n")
    (tmp_path / "b.csv").write_text("mae,seed,model,rmse\n7,3,n,8\n9,4,o,10\n")
    (tmp_path / "c.csv").write_text("")
    got = sources.read_results(spark, str(tmp_path / "*.csv"), "model string, rmse double, mae double, seed int", "csv")
    assert sorted(tuple(r) for r in got.collect()) == [("m", 2.5, 1.5, None), ("n", 8.0, 7.0, 3), ("o", 10.0, 9.0, 4)]
    assert sources.read_results(spark, str(tmp_path / "none*.csv"), "model string", "csv").count() == 0


def test_schema_is_checked_after_an_unfinished_write(spark, tmp_path):
    path = str(tmp_path / "r")
    sources.append_results(spark.createDataFrame([(1, "a")], "n int, m string"), path)
    (tmp_path / "r" / "_SUCCESS").unlink()
    with pytest.raises(ValueError):
        sources.append_results(spark.createDataFrame([(1,)], "n int"), path)


def test_content_keys(spark):
    parts = {"cap": 3, "model": "a", "n": 7}
    row = spark.createDataFrame([(3, "a", 7)], "cap int, model string, n int")
    assert row.select(content_key(F.struct("cap", "model", "n"))).first()[0] == content_hash(parts)
    assert content_hash(parts) == content_hash(dict(reversed(parts.items()))) != content_hash(parts | {"n": 8})


def test_source_key_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    first = sources.source_key(spark, path)
    assert first == sources.source_key(spark, path)
    spark.range(4).write.mode("append").parquet(path)
    assert first != sources.source_key(spark, path)


def test_settings_rows(spark):
    settings = spark.createDataFrame(FLEET_SETTINGS, FLEET_SETTINGS_SCHEMA)
    frame = spark.createDataFrame([("XJTU-SY",), ("FD001",)], "dataset string")
    got = prepare.with_settings(frame, settings, {"max_rul": 100, "window_size": 20}).collect()
    assert {(r.dataset, r.max_rul, r.window_size) for r in got} == {("XJTU-SY", 125, 30), ("FD001", 100, 20)}
    assert prepare.several_conditions("FD002") and not prepare.several_conditions("FD001")
