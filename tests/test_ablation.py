from catalog import load


def test_first_phase_is_not_made_twice(spark):
    out = load()["ablation_phases"].run(spark, "/root/testdata/sf0.001")
    assert out.where("phase = 1").inputFiles() == []  # read from the written results
    assert any("events" in f for f in out.where("phase = 2").inputFiles())
