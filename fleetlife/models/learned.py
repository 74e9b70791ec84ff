"""Spark ML models of a cell: boosted trees, ridge, linear and ordinal heads.

Each model is ``fit(train, val) -> predict(rows)``: ``rows`` gain ``pred`` in [0, max_rul]. Names
map to factories in ``MODELS``; an unknown name is a KeyError.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.errors import clip, rmse
from ..functions.ordinal import decode, rul_to_bin

LABEL = "label"
ALPHAS = tuple(10.0 ** (-3 + 6 * i / 9) for i in range(10))


def as_vector(rows: DataFrame, inputs: list[str] | str) -> DataFrame:
    """Add the ML vector ``features`` from scalar columns, or from one array column."""
    if isinstance(inputs, str):
        return rows.withColumn("features", array_to_vector(inputs))
    return VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep").transform(rows)


class Model:
    """Fit on the train rows of a cell, predict any rows."""

    def __init__(self, inputs, max_rul: float, seed: int = 0, **options):
        self.inputs, self.max_rul, self.seed, self.options = inputs, float(max_rul), seed, options

    def fit(self, train: DataFrame, val: DataFrame | None = None) -> "Model":
        raise NotImplementedError

    def raw(self, rows: DataFrame) -> DataFrame:
        return self.fitted.transform(rows)

    def predict(self, rows: DataFrame) -> DataFrame:
        out = self.raw(as_vector(rows, self.inputs))
        return out.withColumn("pred", clip(F.col("prediction"), self.max_rul)).select(*rows.columns, "pred")


class Trees(Model):
    """Gradient-boosted trees. The validation rows are not used: there is no stopping rule."""

    def fit(self, train, val=None):
        learner = GBTRegressor(labelCol=LABEL, maxIter=self.options.get("rounds", 20),
                               maxDepth=self.options.get("depth", 4), stepSize=self.options.get("rate", 0.1),
                               seed=self.seed)
        self.fitted = learner.fit(as_vector(train, self.inputs))
        return self


class Ridge(Model):
    """Least squares with an L2 penalty chosen on the validation rows (on the train rows when a
    cell has none)."""

    def fit(self, train, val=None):
        rows = as_vector(train, self.inputs).select("features", LABEL).persist()
        check = rows if val is None or val.isEmpty() else as_vector(val, self.inputs).select("features", LABEL)
        best = None
        for alpha in self.options.get("alphas", ALPHAS):
            model = LinearRegression(labelCol=LABEL, regParam=alpha, elasticNetParam=0.0).fit(rows)
            error = model.transform(check).select(rmse(F.col("prediction") - F.col(LABEL))).first()[0]
            if best is None or error < best[0]:
                best = (error, model)
        rows.unpersist()
        self.fitted = best[1]
        return self


class LinearHead(Model):
    """One linear layer on the scaled target."""

    def fit(self, train, val=None):
        rows = as_vector(train, self.inputs).withColumn("_y", F.col(LABEL) / self.max_rul)
        self.fitted = LinearRegression(labelCol="_y", regParam=self.options.get("l2", 1e-4)).fit(rows)
        return self

    def predict(self, rows):
        out = self.raw(as_vector(rows, self.inputs))
        pred = decode(F.array("prediction"), "mse", self.max_rul)
        return out.withColumn("pred", pred).select(*rows.columns, "pred")


class OrdinalHead(Model):
    """Conditional ordinal head: task k is "above bin k" among the rows that reached bin k. Tasks
    with one class only get a fixed logit."""

    SURE = 20.0

    def fit(self, train, val=None):
        bins = self.options.get("bins", 5)
        rows = as_vector(train, self.inputs).withColumn("_bin", rul_to_bin(F.col(LABEL), self.max_rul, bins))
        rows = rows.select("features", "_bin").persist()
        counts = {r[0]: r[1] for r in rows.groupBy("_bin").count().collect()}
        self.tasks = []
        for k in range(bins - 1):
            above = sum(n for b, n in counts.items() if b > k)
            here = counts.get(k, 0)
            if not above or not here:
                self.tasks.append(self.SURE if above else -self.SURE)
                continue
            task = rows.where(F.col("_bin") >= k).withColumn("_y", (F.col("_bin") > k).cast("double"))
            learner = LogisticRegression(labelCol="_y", regParam=self.options.get("l2", 1e-3), maxIter=50,
                                         rawPredictionCol=f"_raw{k}", probabilityCol=f"_pr{k}", predictionCol=f"_p{k}")
            self.tasks.append(learner.fit(task))
        rows.unpersist()
        return self

    def predict(self, rows):
        out, logits = as_vector(rows, self.inputs), []
        for k, task in enumerate(self.tasks):
            if isinstance(task, float):
                logits.append(F.lit(task))
            else:
                out = task.transform(out)
                logits.append(vector_to_array(f"_raw{k}")[1])
        pred = decode(F.array(*logits), "corn", self.max_rul, bins=len(self.tasks) + 1,
                      corn=self.options.get("corn", "expected_value"))
        return out.withColumn("pred", pred).select(*rows.columns, "pred")


MODELS: dict[str, Callable[..., Model]] = {
    "gbm": Trees, "gbm_age": Trees, "indicator_gbm": Trees, "kernel_ridge": Ridge,
    "linear_mlp": LinearHead, "ordinal_mlp": OrdinalHead,
}


def make_model(name: str, inputs, max_rul: float, seed: int = 0, **options) -> Model:
    return MODELS[name](inputs, max_rul, seed, **options)


def fit_cells(jobs: list[Callable[[], DataFrame]], threads: int = 4) -> DataFrame:
    """Run the fits of several cells from a small pool and union their predictions."""
    with ThreadPoolExecutor(max_workers=threads) as pool:
        parts = list(pool.map(lambda job: job(), jobs))
    return reduce(DataFrame.unionByName, parts)
