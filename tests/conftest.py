import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lives(spark):
    """lives({unit: cycles}) -> canonical frame with s_2 = cycle, s_3 = cycle + 100, shuffled."""
    def make(lengths, dataset="A"):
        rows = [(dataset, u, c, float(c), float(c + 100)) for u, n in lengths.items() for c in range(1, n + 1)]
        rows.sort(key=lambda r: (r[2] * 7919 + r[1] * 31) % 101)
        return spark.createDataFrame(rows, "dataset string, unit_number long, time_cycles long, s_2 double, s_3 double")
    return make


@pytest.fixture(scope="session")
def preds(spark):
    def make(truth, pred, **cell):
        names = {"model": "m", "dataset": "A", "max_rul": 125.0, "n_units": 5, "seed": 0, "loss": "mse"} | cell
        rows = [(*names.values(), i, 1, float(t), float(p)) for i, (t, p) in enumerate(zip(truth, pred))]
        return spark.createDataFrame(rows, "model string, dataset string, max_rul double, n_units long, seed int, "
                                           "loss string, unit_number long, time_cycles long, true_rul double, pred double")
    return make
