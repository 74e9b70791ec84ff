"""Loading of whole families from files: one scan per role, members from paths, cut test units."""

import pytest
from pyspark.sql import functions as F

from fleetlife.config import DEFAULT_CHANNELS, FAMILIES, FLEET_SETTINGS, FLEET_SETTINGS_SCHEMA, MULTI_CONDITION, UNION_MEMBERS
from fleetlife.plans import families, prepare
from rows import tuples

LABELS = ["unit_number", "time_cycles", "actual_rul", "clipped_rul"]


def _cycle_line(unit, cycle, setting=0.0):
    return f"{unit} {cycle} {setting} 0.84 100.0 " + " ".join(str(unit * 10 + cycle + i) for i in range(21)) + "  \n"


@pytest.fixture
def turbofan_root(tmp_path):
    for name, shift in (("FD001", 0), ("FD002", 20)):
        (tmp_path / f"train_{name}.txt").write_text("".join(_cycle_line(u, c, shift * (c % 2)) for u in (1, 2) for c in range(1, 4 + u)))
        (tmp_path / f"test_{name}.txt").write_text("".join(_cycle_line(u, c, shift * (c % 2)) for u in (1, 2) for c in (1, 2)))
        (tmp_path / f"RUL_{name}.txt").write_text(f"{7 + shift}\n\n{3 + shift}\n")
    return str(tmp_path)


def test_turbofan_files_of_two_datasets(spark, turbofan_root):
    train, test = families.load_prepared(spark, turbofan_root, ["FD001", "FD002"], families.Settings(max_rul=4))
    assert tuples(train.where("dataset = 'FD001' AND unit_number = 1"), *LABELS) == [
        (1, 1, 3.0, 3.0), (1, 2, 2.0, 2.0), (1, 3, 1.0, 1.0), (1, 4, 0.0, 0.0)]
    assert tuples(test.where("dataset = 'FD002'"), *LABELS) == [(1, 1, 28.0, 4.0), (1, 2, 27.0, 4.0), (2, 1, 24.0, 4.0), (2, 2, 23.0, 4.0)]
    # Only the fleet with several conditions is scaled, each condition by itself.
    assert {r.s_1 for r in train.where("dataset = 'FD001' AND unit_number = 1").collect()} == {11.0, 12.0, 13.0, 14.0}
    got = {r.dataset: (r.m, r.k) for r in train.groupBy("dataset").agg(F.round(F.avg("s_2"), 6).alias("m"), F.count("*").alias("k")).collect()}
    assert got["FD002"] == (0.0, 9) and got["FD001"][0] > 10
    alone, _ = families.load_prepared(spark, turbofan_root, "FD001", families.Settings(by_condition=True))
    assert abs(alone.agg(F.avg("s_2")).first()[0]) < 1e-9


def test_names_are_checked(spark, turbofan_root):
    with pytest.raises(ValueError, match="unknown dataset"):
        families.load(spark, turbofan_root, "FD009")
    with pytest.raises(ValueError, match="one family"):
        families.load(spark, turbofan_root, ["FD001", "DS01"])
    assert set(families.LOADERS) == set(FAMILIES) == set(DEFAULT_CHANNELS)
    assert {families.family_of(d) for d in MULTI_CONDITION} == {"turbofan", "bearing"}
    assert all(families.family_of(m) == "flight" for u, ms in UNION_MEMBERS.items() for m in (u, *ms))
    settings = prepare.with_settings(spark.createDataFrame([(d,) for d in families.FAMILY], "dataset string"),
                                     spark.createDataFrame(FLEET_SETTINGS, FLEET_SETTINGS_SCHEMA), {"window_size": 12})
    assert {r.dataset for r in settings.where("window_size = 30").collect()} == {"XJTU-SY"}


@pytest.fixture
def bearing_root(tmp_path):
    for condition, unit, n in (("35Hz12kN", "Bearing1_1", 4), ("35Hz12kN", "Bearing1_2", 10), ("40Hz10kN", "Bearing3_1", 5)):
        folder = tmp_path / condition / unit
        folder.mkdir(parents=True)
        for k in range(1, n + 1):
            (folder / f"{k}.csv").write_text("h,v\n" + "".join(f"{k * (-1) ** i},{k + i}\n" for i in range(4)))
    return str(tmp_path)


def test_bearing_tree(spark, bearing_root):
    settings = families.Settings(max_rul=125, window=2, test_units=("Bearing1_2",), by_condition=False)
    train, test = families.load_prepared(spark, bearing_root, "XJTU-SY", settings)
    assert {r.unit_name: r.n for r in train.groupBy("unit_name").agg(F.max("time_cycles").alias("n")).collect()} == {"Bearing1_1": 4, "Bearing3_1": 5}
    # Ten snapshots in order of their numbers, cut to six: four are left at the cut.
    assert tuples(test, "unit_number", "time_cycles", "h_rms", "actual_rul") == [(2, k, float(k), 10.0 - k) for k in range(1, 7)]
    fleet = families.load(spark, bearing_root, "XJTU-SY", settings)
    assert tuples(fleet.truth, "unit_number", "rul_truth") == [(2, 4)]


def test_bearing_units_are_checked(spark, bearing_root):
    with pytest.raises(ValueError, match=r"not in the data: \['Bearing2_9'\]"):
        families.load(spark, bearing_root, "XJTU-SY", families.Settings(window=2, test_units=("Bearing1_2", "Bearing2_9")))
    with pytest.raises(ValueError, match="train on"):
        families.load(spark, bearing_root, "XJTU-SY", families.Settings(window=2, test_units=("Bearing1_1", "Bearing1_2", "Bearing3_1")))
    with pytest.raises(Exception, match="too short"):
        families.load(spark, bearing_root, "XJTU-SY", families.Settings(window=4, test_units=("Bearing1_1",))).test.collect()


@pytest.fixture
def flight_root(spark, tmp_path):
    for member, top in (("DS01", 12), ("DS02", 1300)):
        for split, units in (("dev", (1, 2)), ("test", (11, top))):
            rows = [(u, c, t, 3, 1, float(c), float(t), 9.0) for u in units for c in (1, 2, 4, 5, 6) for t in range(1, 4)]
            spark.createDataFrame(rows, "unit_number long, time_cycles long, t long, Fc long, hs int, a double, b double, hidden double"
                                  ).write.parquet(f"{tmp_path}/{member}_{split}.parquet")
    return str(tmp_path)


def test_flight_files(spark, flight_root):
    settings = families.Settings(max_rul=3, window=2)
    fleet = families.load(spark, flight_root, ["DS01", "DS02"], settings, channels=["a", "b"])
    train, test = families.prepared(fleet, settings, ["a_mean", "b_std"])
    assert tuples(test.where("dataset = 'DS02' AND unit_number = 1300"), "time_cycles", "source_cycle", "a_mean", "b_std", "actual_rul") == [
        (1, 1, 1.0, 1.0, 4.0), (2, 2, 2.0, 1.0, 3.0), (3, 4, 4.0, 1.0, 2.0)]
    assert tuples(train.where("dataset = 'DS01'").groupBy("unit_number").agg(F.max("clipped_rul").alias("m"), F.count("*").alias("n")), "unit_number", "m", "n") == [
        (1, 3.0, 5), (2, 3.0, 5)]
    assert "hidden_mean" not in train.columns


def test_flight_union(spark, flight_root, tmp_path):
    settings = families.Settings(max_rul=3, window=2, members=("DS02", "DS01"))
    fleet = families.load(spark, flight_root, "DSALL", settings, channels=["a", "b"], store=str(tmp_path / "store"))
    again = families.load(spark, flight_root, "DSALL", settings, channels=["a", "b"], store=str(tmp_path / "store"))
    ids = [("DS01", 11), ("DS01", 12), ("DS02", 10011), ("DS02", 11300)]
    for f in (fleet, again):
        assert tuples(f.test.select("dataset", "member", "unit_number").distinct(), "dataset", "member", "unit_number") == [("DSALL", *i) for i in ids]
        assert tuples(f.truth, "unit_number", "rul_truth") == [(u, 2) for _, u in ids]
    assert len(list((tmp_path / "store").iterdir())) == 1
    with pytest.raises(ValueError, match="two of its members"):
        families.load(spark, flight_root, "DSALL", families.Settings(members=("DS01",)))
    with pytest.raises(ValueError, match="not among them"):
        families.load(spark, flight_root, "DSALL", families.Settings(members=("DS01", "DS99")))
    with pytest.raises(Exception, match="DS03"):
        families.load(spark, flight_root, "DSALL", families.Settings(members=("DS01", "DS03")))


def test_flight_reads_the_seconds_once(spark, flight_root):
    settings = families.Settings(max_rul=3, window=2)
    for names in (["DS01", "DS02"], "DSALL"):
        fleet = families.load(spark, flight_root, names, families.Settings(max_rul=3, window=2, members=("DS01", "DS02")), channels=["a", "b"])
        for frame in (*families.prepared(fleet, settings, ["a_mean", "b_std"]), fleet.truth):
            assert not any("_dev.parquet" in f or "_test.parquet" in f for f in frame.inputFiles())
