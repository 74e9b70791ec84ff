"""Transfer between fleets: source only, target only, and both, per number of target units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CYCLE, UNIT
from ..models import closed, gram
from ..operators.metrics import evaluate
from ..operators.sampling import CELL, cell_rows

ARM = ["mode", "source_dataset", "target_dataset", "n_target_units", "seed"]
TRANSFER_KEYS = ["model", *ARM, "loss"]


def transfer_arms(source: DataFrame, target: DataFrame, source_plan: DataFrame, target_plan: DataFrame,
                  shots: list[int]) -> DataFrame:
    """Rows (windows or unit sums) each arm trains on. ``zero_shot`` uses the source's train units,
    ``target_only`` k target units, ``source+target`` both. Shots above the target fleet are left
    out; a single shot would leave no unit to validate on."""
    if any(k < 2 for k in shots):
        raise ValueError("shots must be at least 2")
    whole = source_plan.where(F.col("n_units") == F.col("available"))
    few = target_plan.where(F.col("n_units").isin(*shots))
    src = cell_rows(source, whole).where("role = 'train'").drop("n_units", "role", "dataset")
    tgt = (cell_rows(target, few).where("role = 'train'").drop("role", "dataset")
           .withColumnRenamed("n_units", "n_target_units"))
    # the plans are small local tables
    per_shot = src.join(F.broadcast(few.select("seed", F.col("n_units").alias("n_target_units"))), "seed")
    arms = (src.withColumn("n_target_units", F.lit(0).cast("bigint")).withColumn("mode", F.lit("zero_shot"))
            .unionByName(tgt.withColumn("mode", F.lit("target_only")))
            .unionByName(tgt.withColumn("mode", F.lit("source+target")))
            .unionByName(per_shot.withColumn("mode", F.lit("source+target"))))
    names = (whole.select("seed", F.col("dataset").alias("source_dataset"))
             .join(target_plan.select("seed", F.col("dataset").alias("target_dataset")).distinct(), "seed"))
    return arms.join(F.broadcast(names), "seed")


def line_transfer(source: DataFrame, target: DataFrame, test: DataFrame, source_plan: DataFrame,
                  target_plan: DataFrame, shots: list[int], lines, max_rul: float) -> DataFrame:
    """Result rows of every arm on the target's test rows, with closed-form models. Rows are
    reduced to unit sums before the arms multiply them."""
    inputs = [x for _, _, x in lines if x]
    arms = transfer_arms(closed.unit_sums(source, inputs), closed.unit_sums(target, inputs),
                         source_plan, target_plan, shots)
    params = closed.fit_lines(closed.add_up(arms, ARM), lines, ARM)
    rows = test.withColumnRenamed("dataset", "target_dataset")
    preds = closed.predict_lines(params, rows, lines, max_rul, [UNIT, CYCLE, "true_rul"], ("target_dataset",))
    return evaluate(preds, TRANSFER_KEYS, max_rul)


def arm_grams(grams: DataFrame, plan: DataFrame, pairs: list[tuple[str, str]], shots: list[int]) -> DataFrame:
    """(arm, role, at, s): sums of products of every arm's train and validation units, for each (source, target) of ``pairs``.
    Units are added up once per cell of the plan; arms add up cells, so rows and units are never read again. ``zero_shot`` has
    the source's units, ``target_only`` k units of the target, ``source+target`` both, in training and validation."""
    if any(k < 2 for k in shots):
        raise ValueError("shots must be at least 2")
    used = plan.where(F.col("n_units").isin(*shots) | (F.col("n_units") == F.col("available")))
    drawn = grams.join(F.broadcast(used.groupBy("dataset").agg(F.max("available").alias("_all"))), "dataset")
    sums = gram.add_up(cell_rows(drawn, used), [*CELL, "_all", "role"])
    spark = grams.sparkSession
    names = F.broadcast(spark.createDataFrame(pairs, "source_dataset string, target_dataset string"))
    source = sums.where("n_units = _all").withColumnRenamed("dataset", "source_dataset").join(names, "source_dataset")
    target = (sums.where(F.col("n_units").isin(*shots)).withColumnRenamed("dataset", "target_dataset").join(names, "target_dataset")
              .withColumnRenamed("n_units", "n_target_units"))
    few = F.broadcast(used.where(F.col("n_units").isin(*shots)).select(
        F.col("dataset").alias("target_dataset"), "seed", F.col("n_units").alias("n_target_units")))
    source = source.drop("n_units", "_all")
    arms = (source.withColumn("n_target_units", F.lit(0).cast("bigint")).withColumn("mode", F.lit("zero_shot"))
            .unionByName(target.drop("_all").withColumn("mode", F.lit("target_only")))
            .unionByName(target.drop("_all").withColumn("mode", F.lit("source+target")))
            .unionByName(source.join(few, ["target_dataset", "seed"]).withColumn("mode", F.lit("source+target"))))
    return arms.groupBy(*ARM, "role", "at").agg(F.sum("s").alias("s"))


def head_transfer(train: DataFrame, test: DataFrame, plan: DataFrame, pairs: list[tuple[str, str]], shots: list[int], column: str,
                  model: str, loss: str, max_rul: float, alphas=gram.ALPHAS, scaled=()) -> DataFrame:
    """Result rows of a linear head on the inputs in the array ``column`` for every arm, in all directions at once. An arm's
    standardizer and its penalty come from the sums of its own units."""
    sums = arm_grams(gram.unit_grams(train, column), plan, pairs, shots)
    params = gram.fit_ridge(sums, ARM, alphas, scaled).withColumns({"model": F.lit(model), "loss": F.lit(loss)})
    rows = test.withColumnRenamed("dataset", "target_dataset")
    preds = gram.predict(params, rows, column, max_rul, [UNIT, "true_rul"], ("target_dataset",))
    return evaluate(preds, TRANSFER_KEYS, max_rul)
